"""Keyed upserts and lookups over the serving tables:

* ``chunks(project, id, path, text[, embedding])`` - file descriptions to search
* ``projects(name, last_indexed_at, file_chunk_count)`` - the registry
* ``overviews(project, use_cases, conventions, diagram, file_tree, updated_at)``

Upserts are anti-join + union on the key (parquet has no MERGE); callers
write the result to a new location or overwrite only the touched
``project`` partitions. Last-writer-wins among several pushes of one
project in a batch is a ``max_by`` aggregate (partial, skew-safe).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treesnap.functions import paths as P
from treesnap.functions.text import blank_to_null, py_strip

# Overview fields in their fixed order, and the conventions
# block labels.
OVERVIEW_FIELDS = ("use_cases", "conventions", "diagram", "file_tree")
USER_LABEL, AI_LABEL = "[User-defined]", "[AI-inferred]"
CHUNK_ID_PREFIX = "file:"


def iso(ts) -> F.Column:
    """ISO text of a timestamp; microseconds only where there are any."""
    c = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_trunc("second", c) == c
    return F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))



def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace by key: every new row, plus old rows whose key is
    not in the new set. Nothing is deleted."""
    cols = new.columns
    return new.unionByName(old.select(*cols).join(new.select(*keys), keys, "left_anti"))


def latest_per_key(df: DataFrame, keys: list[str], order) -> DataFrame:
    """The row with the greatest ``order`` (a column, unique per key) per key.
    Only keys and order are aggregated; wide columns are joined once."""
    numbered = df.withColumn("_order", order)
    win = numbered.groupBy(*keys).agg(F.max("_order").alias("_order"))
    return numbered.join(win, [*keys, "_order"], "left_semi").drop("_order")


def chunks_from_documents(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One chunk per file entry with a non-blank description:
    (project, id='file:'+path, path, text=stripped description)."""
    e = docs.select("project", *extra, F.posexplode_outer("files").alias("file_pos", "path", "description"))
    text = py_strip("description")
    return (e.filter(F.col("path").isNotNull() & F.col("description").isNotNull() & (text != ""))
            .select("project", F.concat(F.lit(CHUNK_ID_PREFIX), F.col("path")).alias("id"), "path",
                    text.alias("text"), "file_pos", *extra))


def overview_fields(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Overview columns from parsed documents: stripped text or NULL; the
    conventions join the user and AI parts under their labels."""
    user = py_strip(F.coalesce("conventions_user", F.lit("")))
    ai = py_strip(F.coalesce("conventions_ai", F.lit("")))
    parts = F.array_compact(F.array(
        F.when(user != "", F.concat(F.lit(USER_LABEL + "\n"), user)),
        F.when(ai != "", F.concat(F.lit(AI_LABEL + "\n"), ai))))
    conventions = F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))
    return docs.select(
        "project", *extra,
        blank_to_null(F.coalesce("use_cases", F.lit(""))).alias("use_cases"),
        conventions.alias("conventions"),
        blank_to_null(F.coalesce("architecture", F.lit(""))).alias("diagram"),
        blank_to_null(F.coalesce("file_tree", F.lit(""))).alias("file_tree"))


def present_fields(ov: DataFrame) -> F.Column:
    """Names of the non-NULL overview fields, in the fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in OVERVIEW_FIELDS]))


def registry_upsert(old: DataFrame, batch: DataFrame, indexed_at) -> DataFrame:
    """batch(name, file_chunk_count) -> the whole registry with an action per
    row: 'created' (new name), 'updated' (name seen before) or 'kept'."""
    known = old.select("name").withColumn("_known", F.lit(True))
    b = batch.join(known, "name", "left").select(
        "name", F.lit(indexed_at).cast("timestamp").alias("last_indexed_at"),
        F.col("file_chunk_count").cast("int").alias("file_chunk_count"),
        F.when(F.col("_known"), F.lit("updated")).otherwise(F.lit("created")).alias("action"))
    kept = old.select("name", "last_indexed_at", F.col("file_chunk_count").cast("int").alias("file_chunk_count"),
                      F.lit("kept").alias("action"))
    return upsert(kept, b, ["name"])


def overview_upsert(old: DataFrame, batch: DataFrame, updated_at) -> DataFrame:
    """Full replace per project (NULLs overwrite)."""
    b = batch.select("project", *OVERVIEW_FIELDS, F.lit(updated_at).cast("timestamp").alias("updated_at"))
    return upsert(old.select(*b.columns), b, ["project"])


def list_projects(registry: DataFrame) -> DataFrame:
    """Registry listing ordered by name with ISO timestamps."""
    return registry.select(F.col("name").alias("project"), F.col("file_chunk_count").alias("chunks"),
                           iso("last_indexed_at").alias("last_indexed_at")
                           ).orderBy("project")


def _trigrams(name) -> F.Column:
    """Distinct runs of three characters of a lower-cased name between blanks."""
    t = F.concat(F.lit("  "), F.lower(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))


def nearest_names(asked: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """asked(name), known(name) -> name, nearest: up to ``k`` known names per
    asked one, by the number of shared three-character runs, then the edit
    distance, then the name. Names without a shared run are not near. Pairs are
    met through their runs and counted before they are shuffled."""
    a = asked.select("name").distinct().select("name", F.explode(_trigrams("name")).alias("run"))
    b = known.select(F.col("name").alias("near")).distinct().select("near", F.explode(_trigrams("near")).alias("run"))
    shared = a.join(b, "run").groupBy("name", "near").agg(F.count(F.lit(1)).alias("runs"))
    order = [F.desc("runs"), F.levenshtein(F.lower("name"), F.lower("near")), "near"]
    first = shared.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("place") <= k)
    return first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "near"))).alias("x")).select("name", F.col("x.near").alias("nearest"))


def joined_texts(texts: DataFrame) -> DataFrame:
    """(project, field, value): overview texts that are kept as lines (project,
    field, part, block, n, line), each as one stripped string. For the projects
    that somebody asked for."""
    row = F.struct("part", "block", "n", "line")
    g = texts.groupBy("project", "field").agg(F.array_sort(F.collect_list(row)).alias("x"))
    return g.select("project", "field", blank_to_null(F.array_join("x.line", "\n")).alias("value"))


def overview_lookup(requests: DataFrame, overviews: DataFrame, names: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """requests(project, field, ...) -> (..., project, field, value, error).
    Unknown project or an empty field gives an error row instead of a
    value. Other request columns are passed through. With ``names`` (name),
    the error tells the nearest registered ones; with ``texts``, fields kept as
    lines are found too."""
    ov = overviews.select("project", F.lit(True).alias("_known"), *[F.col(f).alias(f"_{f}") for f in OVERVIEW_FIELDS])
    j = requests.join(ov, "project", "left")
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(f"_{f}")) for f in OVERVIEW_FIELDS])
    if texts is not None:
        own = joined_texts(texts.join(requests.select("project", "field").distinct(), ["project", "field"], "left_semi"))
        j, value = j.join(own.withColumnRenamed("value", "_text"), ["project", "field"], "left"), F.coalesce(value, "_text")
    quoted = F.concat(F.lit("'"), F.col("project"), F.lit("'"))
    unknown = F.concat(F.lit("Unknown project "), quoted)
    if names is not None:
        near = nearest_names(requests.select(F.col("project").alias("name")).join(names.select("name"), "name", "left_anti"), names)
        j = j.join(near.select(F.col("name").alias("project"), F.col("nearest").alias("_nearest")), "project", "left")
        unknown = F.concat(unknown, F.when(F.size("_nearest") > 0, F.concat(F.lit(". Nearest: "), F.array_join("_nearest", ", "))).otherwise(F.lit("")))
    error = (F.when(F.col("_known").isNull(), unknown)
             .when(value.isNull() | (value == ""),
                   F.concat(F.lit("No "), F.col("field"), F.lit(" found for project "), quoted)))
    extra = [c for c in requests.columns if c not in ("project", "field")]
    return j.select(*extra, "project", "field", F.when(error.isNull(), value).alias("value"),
                    error.alias("error"))


def file_lookup(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests(path[, project]) -> one row per match (project, path, text)
    or one error row per unmatched request."""
    has_project = "project" in requests.columns
    r = requests.select("path", *(["project"] if has_project else []),
                        F.concat(F.lit(CHUNK_ID_PREFIX), F.col("path")).alias("id"))
    c = chunks.select(F.col("project").alias("match_project"), "id", "text")
    cond = [r["id"] == c["id"]]
    if has_project:
        cond.append(r["project"].isNull() | (r["project"] == c["match_project"]))
    j = r.join(c, cond, "left")
    err = F.when(F.col("match_project").isNull(), F.concat(F.lit("File not found in index: "), F.col("path")))
    return j.select("path", F.col("match_project").alias("project"), "text", err.alias("error"))


def collections(registry: DataFrame, chunks: DataFrame, prefix: str = "") -> DataFrame:
    """Per registered project: collection name, chunk count and emptiness."""
    g = chunks.groupBy("project").agg(F.count(F.lit(1)).alias("chunks"))
    n = F.coalesce("chunks", F.lit(0)).cast("bigint")
    return registry.select(F.col("name").alias("project")).join(g, "project", "left").select(
        "project", F.concat(F.lit(prefix), P.slug("project")).alias("collection"), n.alias("chunks"), (n == 0).alias("is_empty"))


def collection_names(registry: DataFrame, prefix: str = "", starting: str = "") -> DataFrame:
    """Names of the collections that start with ``starting``, in order."""
    name = F.concat(F.lit(prefix), P.slug("name"))
    return registry.select(name.alias("collection")).where(F.col("collection").startswith(starting)).distinct().orderBy("collection")
