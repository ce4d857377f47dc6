"""Snapshot ingest: pushed documents -> chunks (+ embeddings), overviews and
the project registry. The same batch function serves plain batch jobs and
Structured Streaming (``foreachBatch`` over a landing folder).

Per batch: parse and validate every document; the latest push per project wins,
by the pushes' times; chunks are upserted by (project, id) and never deleted
unless pruning is asked for; overviews are replaced per project. Every accepted
project gets a result row and every rejected push a dead-letter row with its
text and the reason.

All of these are tables of a log of batches (``streaming.log``): a batch reads
finished batches before its own number only, so replaying it, after success or
failure, gives the same state, the same results and each reject once. The
work of a batch follows its own size; batches are merged in tiers.

With ``stale="reject"`` a push is rejected whose ``generated_at`` is older than
that of a push of the same project that arrived before it, in whatever batch. What
is accepted then depends on the order of arrival alone, not on its division into
batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesnap.functions.text import py_strip
from treesnap.operators import registry as R
from treesnap.operators.describe import with_hashed_embedding
from treesnap.operators.ranges import running_max
from treesnap.session import materialize
from treesnap.sources import snapshots as S
from treesnap.streaming.log import BATCH, Log, Table, Unit

CHUNK_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("pushed", T.TimestampType()),
    T.StructField("embedding", T.ArrayType(T.FloatType()))])
PROJECT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("last_indexed_at", T.TimestampType()),
    T.StructField("file_chunk_count", T.IntegerType())])
OVERVIEW_SCHEMA = T.StructType(
    [T.StructField("project", T.StringType())]
    + [T.StructField(f, T.StringType()) for f in R.OVERVIEW_FIELDS]
    + [T.StructField("updated_at", T.TimestampType())])
RESULT_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("project", T.StringType()), T.StructField("chunks", T.IntegerType()),
    T.StructField("action", T.StringType()), T.StructField("indexed_at", T.StringType()),
    T.StructField("overview_fields", T.ArrayType(T.StringType()))])
REJECT_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("project", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("sha256", T.StringType())])
# the newest generated_at that a project's pushes have had so far
VERSION_SCHEMA = T.StructType([T.StructField("project", T.StringType()), T.StructField("newest", T.TimestampType())])
# file trees and diagrams of built documents, line by line in the order of (part, block, n)
TEXT_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("field", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("line", T.StringType())])
LINE_FIELDS = ("diagram", "file_tree")
BUILT_FIELDS = ("name", "generated_at", "instructions", "use_cases", "conventions_user", "conventions_ai")
NO_TIME = "1000-01-01 00:00:00"    # the version of a push whose generated_at is no time


def _merge_projects(rows: DataFrame) -> DataFrame:
    """The latest registry row, and from which batch on a project's chunks
    count: the last pruning of them all."""
    pruned = rows.groupBy("name").agg(F.max("chunks_from").alias("_from"))
    return R.latest_per_key(rows, ["name"], F.col(BATCH)).join(pruned, "name").withColumn("chunks_from", F.col("_from")).drop("_from")


def _merge_versions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project").agg(F.max("newest").alias("newest"), F.max(BATCH).alias(BATCH))


def _merge_texts(rows: DataFrame) -> DataFrame:
    """A project's texts are replaced as a whole."""
    last = rows.groupBy("project").agg(F.max(BATCH).alias(BATCH))
    return rows.join(last, ["project", BATCH], "left_semi")


TABLES = {
    "chunks": Table(CHUNK_SCHEMA, ("project", "id"), look_up=True),
    "projects": Table(T.StructType([*PROJECT_SCHEMA.fields, T.StructField("chunks_from", T.LongType())]), ("name",), merge=_merge_projects),
    "overviews": Table(OVERVIEW_SCHEMA, ("project",)),
    "versions": Table(VERSION_SCHEMA, ("project",), merge=_merge_versions),
    "texts": Table(TEXT_SCHEMA, merge=_merge_texts),
    "results": Table(RESULT_SCHEMA),
    "rejects": Table(REJECT_SCHEMA),
}


@dataclass
class State:
    chunks: DataFrame
    projects: DataFrame
    overviews: DataFrame
    versions: DataFrame | None = None
    texts: DataFrame | None = None   # file trees and diagrams kept as lines

    @staticmethod
    def empty(spark: SparkSession) -> "State":
        return State(*[spark.createDataFrame([], s) for s in (CHUNK_SCHEMA, PROJECT_SCHEMA, OVERVIEW_SCHEMA, VERSION_SCHEMA, TEXT_SCHEMA)])


@dataclass
class BatchResult:
    state: State             # the whole state after the batch
    results: DataFrame       # one row per accepted project
    rejected: DataFrame      # one row per rejected push, with its text
    changed: State           # the rows this batch wrote


def push_time(df: DataFrame, order_cols: list[str]) -> Column:
    """The order of pushes: a struct of the columns, texts read as times
    (offsets count; a text that is no time comes first)."""
    return F.struct(*[(F.expr(f"try_cast(`{c}` as timestamp)") if df.schema[c].dataType == T.StringType() else F.col(c)).alias(f"o{i}")
                      for i, c in enumerate(order_cols)])


def _mark_stale(parsed: DataFrame, versions: DataFrame, arrival: list[str]) -> DataFrame:
    """Accepted pushes with a ``generated_at`` older than one that arrived
    before get an error. Equal times are no older; no time is older than any."""
    version = F.coalesce(F.expr("try_cast(generated_at as timestamp)"), F.lit(NO_TIME).cast("timestamp"))
    sound = parsed.where("error is null").select("project", "row", version.alias("version"), *arrival)
    before = running_max(sound, "project", [*arrival, "row"], F.col("version"), "earlier").join(versions.select("project", "newest"), "project", "left")
    newest = F.greatest("earlier", "newest")   # null where there is none
    late = materialize(before.where(F.col("version") < newest).select("row", newest.alias("_newest")), "stale")
    told = F.coalesce("generated_at", F.lit("no generated_at"))
    reason = F.concat(F.lit("Stale push: "), told, F.lit(" is older than "), R.iso("_newest"))
    return parsed.join(late, "row", "left").withColumn("error", F.when(F.col("_newest").isNotNull(), reason).otherwise(F.col("error"))).drop("_newest")


def ingest_batch(state: State, raw: DataFrame, indexed_at, order_cols: list[str] = ("generated_at",),
                 embed: Callable | None = None, prune: bool = False, stale: str = "apply", arrival: list[str] = ()) -> BatchResult:
    """Apply one batch of pushed documents (column ``value``) to ``state``.
    ``embed`` maps a chunk DataFrame to the same with an ``embedding``
    column (default: the hashed stand-in; see ``describe.embed_with``).
    ``prune=True`` makes a touched project's chunks exactly those of its
    latest push; the default upserts and never deletes. ``stale="reject"``
    rejects pushes that are older than an earlier one of their project;
    ``arrival`` are the columns of ``raw`` that give the order of arrival, before
    the order of the rows."""
    if stale not in ("apply", "reject"):
        raise ValueError("stale is 'apply' or 'reject'")
    parsed = S.parse(raw.withColumn("_raw", F.col("value")))
    # read by several branches; the row number breaks ties between pushes
    parsed = parsed.withColumn("push", push_time(parsed, list(order_cols))).withColumn("row", F.monotonically_increasing_id())
    if stale == "apply":   # only the texts of rejects are kept
        parsed = parsed.withColumn("_raw", F.when(F.col("error").isNotNull(), F.col("_raw")))
    parsed = materialize(parsed, "parsed")
    if stale == "reject":
        parsed = materialize(_mark_stale(parsed, state.versions, list(arrival)), "judged")
    docs = S.accepted(parsed)
    latest = R.latest_per_key(docs, ["project"], F.struct("push", "row"))

    chunks = R.chunks_from_documents(latest if prune else docs, extra=["push", "row", "generated_at"])
    chunks = R.latest_per_key(chunks, ["project", "id"], F.struct("push", "row", "file_pos"))
    chunks = chunks.withColumn("pushed", F.expr("try_cast(generated_at as timestamp)"))
    chunks = embed(chunks) if embed else with_hashed_embedding(chunks, "text", "embedding")
    chunks = materialize(chunks.select(*CHUNK_SCHEMA.fieldNames()), "chunks")

    counts = R.chunks_from_documents(latest, extra=["row"]).groupBy("project").agg(F.countDistinct("id").alias("n"))
    batch_reg = latest.select("project").join(counts, "project", "left").select(
        F.col("project").alias("name"), F.coalesce("n", F.lit(0)).cast("int").alias("file_chunk_count"))
    overview = R.overview_fields(latest).withColumn("updated_at", F.lit(indexed_at).cast("timestamp"))
    versions = docs.groupBy("project").agg(F.max(F.expr("try_cast(generated_at as timestamp)")).alias("newest"))
    rejects = S.rejected(parsed).select(F.lit("error").alias("status"), "project", F.col("error").alias("message"),
                                        F.col("_raw").alias("value"), F.sha2("_raw", 256).alias("sha256"))
    return _result(state, chunks, batch_reg, overview, versions, rejects, indexed_at, prune)


def _result(state: State, chunks: DataFrame, batch_reg: DataFrame, overview: DataFrame, versions: DataFrame, rejects: DataFrame,
            indexed_at, prune: bool, texts: DataFrame | None = None) -> BatchResult:
    """The rows of a batch merged into the state; ``chunks`` is written already.
    ``texts`` are overview texts that come as lines."""
    projects = R.registry_upsert(state.projects, batch_reg, indexed_at)
    written = materialize(projects.where("action != 'kept'"), "registry")
    overview = materialize(overview, "overviews")
    present = overview
    if texts is not None:   # a text of blank lines is none
        seen = texts.where(py_strip(F.coalesce("line", F.lit(""))) != "").groupBy("project").agg(
            *[F.max(F.when(F.col("field") == f, "lines")).alias(f"_{f}") for f in LINE_FIELDS])
        present = overview.join(seen, "project", "left").withColumns({f: F.coalesce(f, f"_{f}") for f in LINE_FIELDS})
    results = written.join(present.select(F.col("project").alias("name"), R.present_fields(overview).alias("overview_fields")),
                           "name", "left").select(
        F.lit("ok").alias("status"), F.col("name").alias("project"), F.col("file_chunk_count").alias("chunks"),
        "action", R.iso("last_indexed_at").alias("indexed_at"), "overview_fields")
    old = state.chunks
    if prune:
        old = old.join(written.select(F.col("name").alias("project")), "project", "left_anti")
    changed = State(chunks, written.drop("action"), overview.select(*OVERVIEW_SCHEMA.fieldNames()), versions, texts)
    whole = State(R.upsert(old, chunks, ["project", "id"]), R.upsert(state.projects, changed.projects, ["name"]),
                  R.upsert(state.overviews, changed.overviews, ["project"]), None)
    if state.versions is not None:
        whole.versions = state.versions.unionByName(versions).groupBy("project").agg(F.max("newest").alias("newest"))
    if state.texts is not None:
        kept = state.texts.join(changed.overviews.select("project"), "project", "left_anti")
        whole.texts = kept if texts is None else kept.unionByName(texts)
    return BatchResult(whole, results, rejects, changed)


def ingest_built(state: State, built: S.Built, indexed_at, embed: Callable | None = None, prune: bool = False) -> BatchResult:
    """Apply the documents of a build, read as rows: chunks and counts by
    row, file trees and diagrams as lines. No document and no project's rows are
    gathered anywhere."""
    one = built.fields.where(F.col("field").isin(*BUILT_FIELDS)).groupBy("project").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in BUILT_FIELDS])
    docs = materialize(one.select("project", *BUILT_FIELDS, *[F.lit(None).cast("string").alias(f) for f in ("file_tree", "architecture")]), "built-documents")
    text = py_strip("description")
    at = F.expr("try_cast(generated_at as timestamp)")
    chunks = built.files.where(F.col("description").isNotNull() & (text != "")).join(docs.select("project", at.alias("pushed")), "project").select(
        "project", F.concat(F.lit(R.CHUNK_ID_PREFIX), F.col("path")).alias("id"), "path", text.alias("text"), "pushed")
    chunks = embed(chunks) if embed else with_hashed_embedding(chunks, "text", "embedding")
    chunks = materialize(chunks.select(*CHUNK_SCHEMA.fieldNames()), "chunks")
    counts = chunks.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    batch_reg = docs.select("project").join(counts, "project", "left").select(
        F.col("project").alias("name"), F.coalesce("n", F.lit(0)).cast("int").alias("file_chunk_count"))
    overview = R.overview_fields(docs).withColumn("updated_at", F.lit(indexed_at).cast("timestamp"))
    texts = built.texts.withColumn("field", F.when(F.col("field") == "architecture", "diagram").otherwise(F.col("field"))).select(*TEXT_SCHEMA.fieldNames())
    rejects = docs.sparkSession.createDataFrame([], REJECT_SCHEMA)
    return _result(state, chunks, batch_reg, overview, docs.groupBy("project").agg(F.max(at).alias("newest")), rejects, indexed_at, prune, texts)


# ------------------------------------------------------------ persistence
def open_log(spark: SparkSession, root: str) -> Log:
    return Log(spark, root, TABLES)


def batches(spark: SparkSession, root: str) -> list[int]:
    return open_log(spark, root).batches


def load_state(spark: SparkSession, root: str, before: int | None = None, log: Log | None = None) -> State:
    """State after the finished batches under ``root`` (those numbered below
    ``before`` only, when given); empty tables when there are none."""
    log = log or open_log(spark, root)
    projects, overviews = log.read("projects", before), log.read("overviews", before)
    chunks = _unpruned(log.read("chunks", before), projects)
    # lines of the batch that last replaced the project's overview
    texts = log.read("texts", before).join(overviews.select("project", BATCH), ["project", BATCH], "left_semi")
    return State(*[df.select(*s.fieldNames()) for df, s in (
        (chunks, CHUNK_SCHEMA), (projects, PROJECT_SCHEMA), (overviews, OVERVIEW_SCHEMA), (log.read("versions", before), VERSION_SCHEMA), (texts, TEXT_SCHEMA))])


def _unpruned(chunks: DataFrame, projects: DataFrame) -> DataFrame:
    """The chunks that no pruning push of their project has replaced."""
    pruned = projects.where("chunks_from is not null").select(F.col("name").alias("project"), F.col("chunks_from").alias("_from"))
    return chunks.join(pruned, "project", "left").where(f"_from is null or {BATCH} >= _from").drop("_from")


def find_chunks(spark: SparkSession, root: str, keys: list[tuple]) -> DataFrame:
    """Chunks by (project, id), or by project alone: (project,). Opens the files
    whose key range fits (``Log.files`` names them)."""
    log = open_log(spark, root)
    return _unpruned(log.look_up("chunks", keys), log.read("projects")).select(*CHUNK_SCHEMA.fieldNames())


def load_results(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch and accepted project: batch, status, project, chunks,
    action, indexed_at, overview_fields."""
    return open_log(spark, root).rows("results").withColumnRenamed(BATCH, "batch")


def load_rejects(spark: SparkSession, root: str) -> DataFrame:
    """One row per rejected push: batch, status, project (if it has one),
    message, value (the text as pushed) and its sha256."""
    return open_log(spark, root).rows("rejects").withColumnRenamed(BATCH, "batch")


def save_batch(result: BatchResult, root: str, batch_id: int, prune: bool = False, log: Log | None = None) -> None:
    """Write the batch's rows, results and rejects, then its marker. Writing
    the same batch again replaces the same folders."""
    log = log or open_log(result.changed.projects.sparkSession, root)
    frm = F.lit(batch_id if prune else None).cast("long")
    log.append(batch_id, {"chunks": result.changed.chunks, "overviews": result.changed.overviews, "versions": result.changed.versions,
                          "projects": result.changed.projects.withColumn("chunks_from", frm),
                          "texts": result.changed.texts if result.changed.texts is not None else result.changed.projects.sparkSession.createDataFrame([], TEXT_SCHEMA),
                          "results": result.results, "rejects": result.rejected})


def compact(spark: SparkSession, root: str) -> None:
    """Merge all finished batches into one run, which readers then use in
    their place. The batches' folders stay, for readers at work."""
    log = open_log(spark, root)
    if log.batches:
        log.merge(Unit(log.batches[0], log.batches[-1]))


def ingest_to(spark: SparkSession, raw: DataFrame, root: str, batch_id: int, indexed_at,
              order_cols=("generated_at",), prune: bool = False, stale: str = "apply", arrival: list[str] = ()) -> BatchResult:
    """Load the state before this batch, apply the batch, persist it."""
    log = open_log(spark, root)
    res = ingest_batch(load_state(spark, root, batch_id, log), raw, indexed_at, list(order_cols), prune=prune, stale=stale, arrival=list(arrival))
    save_batch(res, root, batch_id, prune, log)
    return res


def ingest_built_to(spark: SparkSession, path: str, root: str, batch_id: int, indexed_at, prune: bool = False) -> BatchResult:
    """Apply the documents that a build wrote under ``path`` as a batch."""
    log = open_log(spark, root)
    res = ingest_built(load_state(spark, root, batch_id, log), S.read_built_rows(spark, path), indexed_at, prune=prune)
    save_batch(res, root, batch_id, prune, log)
    return res


def start_stream(spark: SparkSession, landing: str, root: str, checkpoint: str,
                 clock: Callable[[int], object] | None = None, available_now: bool = True,
                 json_lines: bool = True, prune: bool = False, stale: str = "apply"):
    """Structured Streaming ingest of documents dropped into ``landing``:
    JSON Lines files (one document per line) or, with ``json_lines=False``,
    one (pretty-printed) document per file. Each micro-batch is applied with
    ``foreachBatch``; ``clock`` maps a batch id to the registry timestamp
    (default: now). Pushes arrive in the order of their files' times. What came
    of them is read with ``load_results`` and ``load_rejects``."""
    reader = spark.readStream.format("text")
    if not json_lines:
        reader = reader.option("wholetext", True)
    stream = (reader.load(landing)
              .select("value", F.col("_metadata.file_modification_time").alias("pushed_at")))

    def each(batch_df: DataFrame, batch_id: int):
        ts = clock(batch_id) if clock else F.current_timestamp()
        ingest_to(batch_df.sparkSession, batch_df, root, batch_id, ts, order_cols=("pushed_at", "generated_at"),
                  prune=prune, stale=stale, arrival=["pushed_at"])

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
