"""The batch build: files of many projects -> descriptions (misses only) ->
change gate and project synthesis -> tree, dependency graph and diagram ->
snapshot documents, plus the updated description cache and synthesis.

    files ─ select(globs) ─ meta(hash, lines) ─ J(cache) ─┬─ misses ─ describe ─┐
                                                          └─ hits ──────────────┴─ work (checkpointed)
    work ─┬─ counts ─ gate ─ synthesis (gated projects only)
          ├─ tree lines / diagram (tree + dependency edges)
          └─ document lines ─ write (range partitioned, per project folder)

Cuts are written to the shared checkpoint folder: the classified work table
(hashing and the cache join run once), the answers of the models (kept before
anything reads them; with ``BuildSettings.answers``, as they come, for this run
and later ones) and the described work table that the output branches
read. A file whose description fails gets an error row and stays a miss, so
the next run asks for it alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesnap.functions import globs as G
from treesnap.functions.imports import build_registry
from treesnap.operators import assemble as A
from treesnap.operators import changes as C
from treesnap.operators import deps as D
from treesnap.operators import describe as DS
from treesnap.operators import incremental as INC
from treesnap.operators import registry as R
from treesnap.operators import synthesis as SY
from treesnap.operators import tree as TR
from treesnap.session import materialize
from treesnap.sources.answers import AnswerStore



@dataclass
class BuildSettings:
    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=list)
    threshold: float = C.DEFAULT_THRESHOLD
    force: bool = False
    instructions: str = ""
    user_conventions: str = ""
    generated_at: str | None = None          # ISO text; default: now (UTC)
    parsers: dict | None = None              # extra dependency parsers by extension
    describe: Callable[[DataFrame], DataFrame] | None = None    # pending -> (project, path, sha256, description)
    synthesize: Callable[[DataFrame, DataFrame], DataFrame] | None = None  # (gate, work) -> synthesis rows
    checkpoint: bool = True
    # one model for descriptions and synthesis: complete(prompts, max_tokens) -> texts
    complete: Callable[[list[str], int], list[str]] | None = None
    concurrency: int = DS.DEFAULT_CONCURRENCY
    answers: str | None = None               # folder in which the model's answers are kept as they come
    text_fields: str = "lines"               # 'string': tree and diagram as one string each
    prune_cache: bool = False                # drop cache entries of files no longer present
    derived: INC.Derived | None = None       # the derived tables of the run before (``Derived.empty`` at first): updated, not rebuilt


@dataclass
class BuildResult:
    work: DataFrame            # project, path, sha256, status, n_lines, sentences, description
    gate: DataFrame
    synthesis: DataFrame       # merged: regenerated + kept
    cache: DataFrame           # upserted description cache
    tree_lines: DataFrame
    dep_edges: DataFrame
    diagram_lines: DataFrame
    document_lines: DataFrame
    errors: DataFrame          # project, path ('' for the project's texts), error
    changed_cache: DataFrame   # the whole cache of the projects whose cache changed
    changed_synthesis: DataFrame
    derived: INC.Derived | None = None   # with ``BuildSettings.derived``


def build(files: DataFrame, cache: DataFrame, synthesis: DataFrame, settings: BuildSettings | None = None
          ) -> BuildResult:
    s = settings or BuildSettings()
    ask = AnswerStore(files.sparkSession, s.answers).ask if s.answers else DS.call_model
    sel = files.filter(G.select_paths("path", s.include, s.exclude))
    work = C.classify(C.file_meta(sel), cache)
    if s.checkpoint:  # hash + cache join once; the pending count and all branches read it
        work = materialize(work, "work")
    pending = C.pending_work(sel, work)
    if s.describe:
        generated = s.describe(pending)
    elif s.complete:
        generated = DS.describe_with(pending, s.complete, s.concurrency, C.pending_keys(work).count(), ask)
    else:
        generated = DS.stand_in_descriptions(pending)
    if "error" not in generated.columns:
        generated = generated.withColumn("error", F.lit(None).cast("string"))
    if s.checkpoint:  # answers are stored before anything reads them
        generated = materialize(generated, "descriptions")
    errors = generated.where("error is not null").select("project", "path", "error")
    generated = generated.where("error is null")
    merged = C.merge_descriptions(work, generated)
    if s.checkpoint:
        merged = materialize(merged, "described")

    gate = C.change_gate(C.miss_counts(merged), synthesis, s.threshold, s.force)
    paths = merged.select("project", "path")
    parsers = build_registry(s.parsers) if s.parsers else None
    derived = INC.update(s.derived, merged, INC.content_from(sel), parsers) if s.derived else None
    dirs = derived.dir_nodes() if derived else None
    tree = TR.tree_lines(paths, dirs=dirs)
    tree_rows = tree.select("project", "node_path", "line")
    if s.synthesize:
        regenerated = s.synthesize(gate, merged)
    elif s.complete:
        if s.checkpoint:  # read by the prompts (twice) and by the document
            tree_rows = materialize(tree_rows, "tree-lines")
        prompts = SY.prompts(gate, tree_rows, merged.select("project", "path", "description"),
                             s.instructions, s.user_conventions)
        answered = SY.synthesize_with(prompts, s.complete, s.concurrency, ask=ask)
        if s.checkpoint:  # project texts are generated once
            answered = materialize(answered, "synthesis")
        errors = errors.unionByName(answered.where("error is not null").select("project", F.lit("").alias("path"), "error"))
        regenerated = answered.where("error is null").drop("error")
    else:
        regenerated = DS.stand_in_synthesis(gate, merged)
    if s.checkpoint:
        regenerated = materialize(regenerated, "regenerated")
    new_synthesis = DS.merge_synthesis(synthesis, regenerated)
    new_cache = R.upsert(cache.select("project", "path", "sha256", "description"),
                         generated.select("project", "path", "sha256", "description"), ["project", "path"])
    if s.prune_cache:  # keep entries of current files only
        new_cache = new_cache.join(merged.select("project", "path"), ["project", "path"], "left_semi")

    dirty = generated.select("project").distinct()
    if s.prune_cache:  # projects that lose entries change too
        gone = cache.join(merged.select("project", "path"), ["project", "path"], "left_anti").select("project").distinct()
        dirty = dirty.unionByName(gone).distinct()
    changed_cache = new_cache.join(dirty, "project", "left_semi")

    edges = derived.edges() if derived else D.dependency_edges(sel, parsers)
    diagram = TR.diagram_tree_lines(paths, dirs, derived.tree if derived else None).unionByName(D.diagram_dep_lines(edges))

    gen = F.lit(s.generated_at) if s.generated_at else R.iso(F.current_timestamp())
    counts = merged.groupBy("project").agg(F.count(F.lit(1)).cast("int").alias("file_count"))
    meta = counts.join(new_synthesis, "project", "left").select(
        "project", gen.alias("generated_at"), "file_count", F.lit(s.instructions).alias("instructions"),
        "use_cases", F.lit(s.user_conventions).alias("conventions_user"), "conventions_ai")
    doc = A.document_lines(meta, tree_rows, diagram,
                           merged.select("project", "path", "description"), text_fields=s.text_fields)
    return BuildResult(merged, gate, new_synthesis, new_cache, tree, edges, diagram, doc, errors, changed_cache, regenerated, derived)


def write_build(result: BuildResult, out: str) -> None:
    """Persist a build: documents, then the cache and synthesis of the
    projects that changed (dynamic partition overwrite by project). A run
    without misses writes neither. Derived tables go to a folder of their own
    per run, named by its time, with a marker written last."""
    if result.derived:
        folder = f"{out}/derived/{time.time_ns():020d}"
        result.derived.write(folder)
        result.work.sparkSession.range(1).write.parquet(f"{folder}/done")
    A.write_documents(result.document_lines, f"{out}/documents")
    for name, df, order in (("cache", result.changed_cache, ["project", "path"]), ("synthesis", result.changed_synthesis, ["project"])):
        rows = materialize(df, name)  # its plan may read the partitions it replaces
        if not rows.isEmpty():
            (rows.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("project").parquet(f"{out}/{name}"))


def read_derived(spark, out: str) -> INC.Derived:
    """The derived tables of the last run under ``out`` that was written
    whole; empty ones if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/derived")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(path)), reverse=True) if fs.exists(path) else []
    for name in names:
        if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/derived/{name}/done/_SUCCESS")):
            return INC.Derived.read(spark, f"{out}/derived/{name}")
    return INC.Derived.empty(spark)


CACHE_SCHEMA = "path string, sha256 string, description string, project string"
SYNTHESIS_SCHEMA = "use_cases string, conventions_ai string, project string"


def read_state(spark, out: str) -> tuple[DataFrame, DataFrame]:
    """The cache and synthesis under ``out``. The schema is given, as project
    names in folder names may look like numbers or dates."""
    return (spark.read.schema(CACHE_SCHEMA).parquet(f"{out}/cache").select("project", "path", "sha256", "description"),
            spark.read.schema(SYNTHESIS_SCHEMA).parquet(f"{out}/synthesis").select("project", "use_cases", "conventions_ai"))
