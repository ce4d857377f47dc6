"""Directory hierarchy of each project as tables: ancestor directories, parent
-> child edges (first occurrence kept), the rendered text tree and the
Mermaid ``graph TD`` lines. No recursion: ancestors are exploded (bounded by
path depth) and joined back; duplicates are removed with partial aggregates,
so a directory holding a third of all files costs no single task more than
its share.

Ordering: line order is component order of paths (``split(path, '/')``),
which is also depth-first order with siblings sorted by name; directory node
lines sort by plain string. Each line carries (section, sort_path, pos) so a
writer can order them; nothing is concatenated per project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesnap.functions import paths as P

# Text-tree connectors and ancestor prefixes.
BRANCH, LAST_BRANCH = "├── ", "└── "
PIPE_PREFIX, SPACE_PREFIX = "│   ", "    "

# Sections of the diagram text, in output order.
SEC_HEADER, SEC_DIRS, SEC_FILES, SEC_TREE_EDGES, SEC_DEP_COMMENT, SEC_DEP_EDGES = range(6)


def _levels(depth_col):
    """1..depth-1 (empty for top-level entries)."""
    return F.when(depth_col > 1, F.sequence(F.lit(1), depth_col - 1)).otherwise(F.array().cast("array<int>"))


def dir_nodes(paths: DataFrame) -> DataFrame:
    """Every ancestor directory of every file: (project, dir_path, parent,
    name, depth). Distinct via partial aggregation."""
    d = paths.select("project", "path", P.depth("path").alias("d"))
    e = d.select("project", "path", F.explode(_levels(F.col("d"))).alias("level"))
    dirs = e.select("project", P.ancestor("path", F.col("level")).alias("dir_path"), "level")
    dirs = dirs.groupBy("project", "dir_path").agg(F.min("level").alias("depth"))
    return dirs.select("project", "dir_path", P.parent("dir_path").alias("parent"),
                       P.name("dir_path").alias("name"), F.col("depth").cast("int").alias("depth"))


def nodes(paths: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """Files and their ancestor directories: (project, node_path, parent,
    name, depth, is_dir). ``dirs`` are the ``dir_nodes`` if they are known."""
    files = paths.select("project", F.col("path").alias("node_path"), P.parent("path").alias("parent"),
                         P.name("path").alias("name"), P.depth("path").cast("int").alias("depth"),
                         F.lit(False).alias("is_dir"))
    dirs = (dir_nodes(paths) if dirs is None else dirs).select("project", F.col("dir_path").alias("node_path"), "parent", "name",
                                   "depth", F.lit(True).alias("is_dir"))
    return files.unionByName(dirs)


def tree_edges(paths: DataFrame) -> DataFrame:
    """Parent -> child edges keyed by node id, first occurrence kept.
    A file at depth L emits (parent dir -> file) and, for each inner level,
    (dir -> sub dir); top-level files emit nothing. Occurrence order is the
    file's component order, then the emit position."""
    d = paths.select("project", "path", P.depth("path").alias("L"))
    pos = F.when(F.col("L") > 1, F.sequence(F.lit(0), F.col("L") - 2)).otherwise(F.array().cast("array<int>"))
    e = d.select("project", "path", F.explode(pos).alias("pos"))
    parent = F.when(F.col("pos") == 0, P.parent("path")).otherwise(P.ancestor("path", F.col("pos")))
    child = F.when(F.col("pos") == 0, F.col("path")).otherwise(P.ancestor("path", F.col("pos") + 1))
    e = e.select("project", "path", "pos", parent.alias("parent_path"), child.alias("child_path"))
    e = e.select("*", P.node_id("parent_path").alias("parent_id"), P.node_id("child_path").alias("child_id"))
    order = F.struct(P.parts("path").alias("k"), F.col("pos").alias("p"))
    first = F.min_by(F.struct("parent_path", "child_path", F.col("path").alias("first_file"), "pos"), order)
    g = e.groupBy("project", "parent_id", "child_id").agg(first.alias("f"))
    return g.select("project", "parent_id", "child_id", "f.parent_path", "f.child_path",
                    "f.first_file", F.col("f.pos").alias("first_pos"))


def last_children(nd: DataFrame) -> DataFrame:
    """(project, node_path): the last child of every directory, by name."""
    last = nd.groupBy("project", "parent").agg(F.max("name").alias("name"))
    path = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat("parent", F.lit("/"), "name"))
    return last.select("project", path.alias("node_path"))


def sibling_flags(nd: DataFrame) -> DataFrame:
    """is_last: the node has the greatest name among its siblings. Joined on
    the node's own path, which is unique, so a large directory is no hot key."""
    j = nd.join(last_children(nd).withColumn("_last", F.lit(True)), ["project", "node_path"], "left")
    return j.select(*nd.columns, F.coalesce("_last", F.lit(False)).alias("is_last"))


def tree_lines(paths: DataFrame, root_name=None, dirs: DataFrame | None = None) -> DataFrame:
    """Rendered text tree, one row per line: (project, node_path, depth,
    line). The root line has node_path '' and depth 0 and reads
    '<root_name>/' (root_name defaults to the project name)."""
    flagged = sibling_flags(nodes(paths, dirs))
    anc = flagged.select("project", "node_path", "depth", F.explode(_levels(F.col("depth"))).alias("level"))
    anc = anc.select("project", "node_path", "level", P.ancestor("node_path", F.col("level")).alias("anc_path"))
    af = flagged.where("is_dir").select("project", F.col("node_path").alias("anc_path"), F.col("is_last").alias("anc_last"))
    piece = F.when(F.col("anc_last"), F.lit(SPACE_PREFIX)).otherwise(F.lit(PIPE_PREFIX))
    pre = (anc.join(af, ["project", "anc_path"], "inner")
           .groupBy("project", "node_path")
           .agg(F.array_sort(F.collect_list(F.struct("level", piece.alias("s")))).alias("pieces")))
    pre = pre.select("project", "node_path",
                     F.array_join(F.transform("pieces", lambda x: x["s"]), "").alias("prefix"))
    body = flagged.join(pre, ["project", "node_path"], "left")
    connector = F.when(F.col("is_last"), F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH))
    lines = body.select("project", "node_path", "depth",
                        F.concat(F.coalesce("prefix", F.lit("")), connector, F.col("name")).alias("line"))
    root = root_name if root_name is not None else F.col("project")
    roots = paths.select("project").distinct().select(
        "project", F.lit("").alias("node_path"), F.lit(0).alias("depth"),
        F.concat(root, F.lit("/")).alias("line"))
    return roots.unionByName(lines)


def diagram_tree_lines(paths: DataFrame, dirs: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Mermaid lines for the hierarchy: (project, section, sort_path, pos,
    line). Header, directory nodes, file nodes, then tree edges. ``dirs`` and
    ``edges`` are ``dir_nodes`` and ``tree_edges`` if they are known."""
    projects = paths.select("project").distinct()
    header = projects.select("project", F.lit(SEC_HEADER).alias("section"), F.lit("").alias("sort_path"),
                             F.lit(0).alias("pos"), F.lit("graph TD").alias("line"))
    dn = (dir_nodes(paths) if dirs is None else dirs).select(
        "project", F.lit(SEC_DIRS).alias("section"), F.col("dir_path").alias("sort_path"), F.lit(0).alias("pos"),
        F.concat(F.lit("    "), P.node_id("dir_path"), F.lit('("'), F.col("name"), F.lit('/")')).alias("line"))
    fn = paths.select(
        "project", F.lit(SEC_FILES).alias("section"), F.col("path").alias("sort_path"), F.lit(0).alias("pos"),
        F.concat(F.lit("    "), P.node_id("path"), F.lit("["), P.name("path"), F.lit("]")).alias("line"))
    ed = (tree_edges(paths) if edges is None else edges).select(
        "project", F.lit(SEC_TREE_EDGES).alias("section"), F.col("first_file").alias("sort_path"),
        F.col("first_pos").alias("pos"),
        F.concat(F.lit("    "), F.col("parent_id"), F.lit(" --> "), F.col("child_id")).alias("line"))
    return header.unionByName(dn).unionByName(fn).unionByName(ed)


def line_order(section="section", sort_path="sort_path", pos="pos"):
    """Sort expressions giving document order for diagram lines."""
    key = F.when(F.col(section) == SEC_DIRS, F.array(F.col(sort_path))).otherwise(P.parts(sort_path))
    return [F.col(section), key, F.col(pos)]
