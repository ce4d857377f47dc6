"""Derived tables of a tree kept up to date by what changed.

- ``imports``: the raw dependencies of each content, by (ext, sha256); content
  is read for contents not seen before alone
- ``wanted``: every path that a dependency could resolve to, by (project,
  candidate), in order of priority
- ``resolved``: the path that a dependency resolves to, where there is one
- ``dirs``: directories with the number of files below them; added files count up
  and removed ones down, and a directory without files is gone
- ``tree``: the parent-child edges with their first occurrence

A file's dependencies are worked out again when the file is new or its content
has changed, and a single one of them when one of its candidate paths was
added or removed. An edge of the tree is worked out again when the file of its first
occurrence was removed; added files only compete with it. The tables equal those of
a rebuild from all files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.functions import imports as I
from treesnap.functions import paths as P
from treesnap.functions import text as T
from treesnap.operators import deps as D
from treesnap.operators import tree as TR
from treesnap.session import materialize

FILE = ["project", "path"]
SCHEMAS = {
    "files": "project string, path string, sha256 string",
    "imports": "ext string, sha256 string, deps array<string>",
    "wanted": "project string, path string, dep_ord int, dep string, prio int, candidate string",
    "resolved": "project string, path string, dep_ord int, dep string, target string",
    "dirs": "project string, dir_path string, n_files long",
    "tree": "project string, parent_id string, child_id string, parent_path string, child_path string, first_file string, first_pos int",
}


@dataclass
class Derived:
    files: DataFrame
    imports: DataFrame
    wanted: DataFrame
    resolved: DataFrame
    dirs: DataFrame
    tree: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> "Derived":
        return Derived(*[spark.createDataFrame([], s) for s in SCHEMAS.values()])

    @staticmethod
    def read(spark: SparkSession, folder: str) -> "Derived":
        return Derived(*[spark.read.schema(s).parquet(f"{folder}/{name}") for name, s in SCHEMAS.items()])

    def write(self, folder: str) -> None:
        """To a new folder; the one that the tables were read from stays."""
        for name in SCHEMAS:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    def edges(self) -> DataFrame:
        """As ``deps.dependency_edges`` of all files."""
        return D.edges_of(self.resolved)

    def dir_nodes(self) -> DataFrame:
        """As ``tree.dir_nodes`` of all files."""
        d = F.col("dir_path")
        return self.dirs.select("project", "dir_path", P.parent(d).alias("parent"), P.name(d).alias("name"), P.depth(d).cast("int").alias("depth"))


def _dir_counts(paths: DataFrame, by) -> DataFrame:
    """(project, dir_path, n): ``by`` summed over the files below a directory."""
    levels = TR._levels(P.depth("path"))
    dirs = paths.select("project", "path", by.alias("n"), F.explode(levels).alias("level"))
    return dirs.groupBy("project", P.ancestor("path", F.col("level")).alias("dir_path")).agg(F.sum("n").alias("n"))


def _replaced(old: DataFrame, gone: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``gone``, and the new rows."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def _resolve(wanted: DataFrame, files: DataFrame) -> DataFrame:
    hits = wanted.join(files.select("project", F.col("path").alias("candidate")), ["project", "candidate"])
    return hits.groupBy("project", "path", "dep_ord", "dep").agg(F.min_by("candidate", "prio").alias("target"))


def update(previous: Derived, meta: DataFrame, content_of: Callable[[DataFrame], DataFrame], registry: dict | None = None) -> Derived:
    """The tables for the files in ``meta`` (project, path, sha256).
    ``content_of`` gets keys (project, path) and gives them with their
    ``content``; it is called with one file per content not seen before. The
    parsers in ``registry`` must be those of the run before, or ``previous`` empty."""
    reg = registry if registry is not None else I.build_registry()
    now = materialize(meta.select("project", "path", "sha256"), "files-now")
    before = previous.files.select("project", "path", F.col("sha256").alias("old"))
    moved = materialize(now.join(before, FILE, "full").where(~F.col("sha256").eqNullSafe(F.col("old"))), "files-moved")
    added, removed = moved.where("old is null"), moved.where("sha256 is null")
    fresh = moved.where("sha256 is not null").withColumn("ext", D.extension("path")).where(F.col("ext").isin(list(reg)))

    # content is read once per (ext, sha256) that no table row has
    unseen = (fresh.join(previous.imports.select("ext", "sha256"), ["ext", "sha256"], "left_anti")
              .groupBy("ext", "sha256").agg(F.min(F.struct(*FILE)).alias("f")).select("ext", "sha256", "f.*"))
    unseen = materialize(unseen, "contents-unseen")
    read = content_of(unseen.select(*FILE)).join(unseen, FILE)
    parsed = read.select("ext", "sha256", F.coalesce(I.extract(F.col("ext"), T.utf8_text("content"), reg), F.array().cast("array<string>")).alias("deps"))
    parsed = materialize(parsed, "imports-new")
    imports = previous.imports.unionByName(parsed)

    # dependencies of fresh files, and of others whose candidates came or went
    own = fresh.join(imports, ["ext", "sha256"]).select("project", "path", "ext", F.posexplode("deps").alias("dep_ord", "dep"))
    wanted_new = materialize(D.candidates(own).select(*previous.wanted.columns), "wanted-new")
    wanted = materialize(_replaced(previous.wanted, moved, wanted_new, FILE), "wanted")
    touched = added.unionByName(removed).select("project", F.col("path").alias("candidate"))
    dep = ["project", "path", "dep_ord", "dep"]
    open_deps = materialize(wanted_new.select(*dep).unionByName(
        wanted.join(touched, ["project", "candidate"], "left_semi").select(*dep)).distinct(), "dependencies-open")
    solved = _resolve(wanted.join(open_deps, dep, "left_semi"), now)
    still = previous.resolved.join(moved.select(*FILE), FILE, "left_anti").join(open_deps, dep, "left_anti")
    resolved = still.unionByName(solved.select(*previous.resolved.columns))

    delta = _dir_counts(added.withColumn("by", F.lit(1)).unionByName(removed.withColumn("by", F.lit(-1))), F.col("by"))
    counted = previous.dirs.select("project", "dir_path", F.col("n_files").alias("n")).join(delta.select("project", "dir_path"), ["project", "dir_path"], "left_semi")
    dirs_new = counted.unionByName(delta.select("project", "dir_path", "n")).groupBy("project", "dir_path").agg(F.sum("n").alias("n_files")).where("n_files > 0")
    dirs = _replaced(previous.dirs, delta, dirs_new, ["project", "dir_path"])

    edge = ["project", "parent_id", "child_id"]
    lost = previous.tree.join(removed.select("project", F.col("path").alias("first_file")), ["project", "first_file"], "left_semi")
    lost = materialize(lost.select(*edge), "edges-lost")
    # all files below the lost edges' parents may stand in
    heirs = now.join(lost.select("project").distinct(), "project", "left_semi")
    again = TR.tree_edges(heirs.select(*FILE)).join(lost, edge, "left_semi")
    more = TR.tree_edges(added.select(*FILE))
    order = F.struct(P.parts("first_file").alias("k"), F.col("first_pos").alias("p"))
    met = previous.tree.join(more.select(*edge), edge, "left_semi").join(lost, edge, "left_anti")
    whole = F.struct(*[c for c in previous.tree.columns if c not in edge])
    best = again.select(*previous.tree.columns).unionByName(more.select(*previous.tree.columns)).unionByName(met).groupBy(*edge).agg(
        F.min_by(whole, order).alias("x")).select(*edge, "x.*")
    tree = _replaced(previous.tree, lost.unionByName(more.select(*edge)), best, edge)
    return Derived(now, materialize(imports, "imports"), wanted, materialize(resolved, "resolved"), materialize(dirs, "dirs"), materialize(tree, "tree"))


def content_from(files: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``content_of`` over a table (project, path, content)."""
    return lambda keys: files.select(*FILE, "content").join(keys, FILE, "left_semi")
