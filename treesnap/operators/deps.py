"""Import extraction and resolution to intra-project dependency edges.

Resolution is an equi-join, not a lookup loop: every dependency expands to
its candidate paths in priority order (posexplode), the candidates are
inner-joined with the project's file set on (project, path), and the
highest-priority hit per dependency wins (``min_by``). A module imported by a
third of all files is one hot join key; AQE's skew-join handling splits that
partition on the candidate side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesnap.functions import imports as I
from treesnap.functions import paths as P
from treesnap.functions import text as T
from treesnap.operators.tree import SEC_DEP_COMMENT, SEC_DEP_EDGES


def extension(path) -> F.Column:
    return F.lower(F.regexp_replace(P.suffix(path), r"^\.", ""))


def raw_dependencies(files: DataFrame, registry=None) -> DataFrame:
    """(project, path, dep_ord, dep) for files whose extension has a parser.
    dep_ord is the 0-based position in the parser's output."""
    reg = registry if registry is not None else I.build_registry()
    ext = extension("path")
    f = files.select("project", "path", ext.alias("ext"), "content").filter(F.col("ext").isin(list(reg)))
    deps = I.extract(F.col("ext"), T.utf8_text("content"), reg)
    d = f.select("project", "path", "ext", deps.alias("deps"))
    # outer explode + null filter: a plain explode makes Spark infer a
    # size(deps) > 0 filter below the projection and run the parser twice
    e = d.select("project", "path", "ext", F.posexplode_outer("deps").alias("dep_ord", "dep"))
    return e.filter(F.col("dep").isNotNull())


def _js_candidates(src_path, dep):
    """Relative (./, ../) or root-anchored (/) target: the exact path, then
    with each known extension, then directory index files; extensions are
    tried only when the cleaned base has no suffix."""
    base = F.when(dep.startswith("/"), F.regexp_replace(dep, "^/+", "")) \
        .otherwise(P.join_path(P.parent(src_path), dep))
    # cleaned and normalised once; the bound names keep the optimiser from repeating them
    return F.transform(F.array(P.clean(base)), lambda c: F.transform(F.array(P.normalise(c)), lambda n: _js_paths(c, n))[0])[0]


def _js_paths(cleaned, normal):
    tail = F.when(P.name(cleaned) == "..", P.join_path(P.normalise(P.parent(cleaned)), F.lit(".."))).otherwise(normal)
    tried = [normal] + [F.concat(tail, F.lit(e)) for e in P.JS_EXTENSIONS] + [P.join_path(normal, F.lit("index" + e)) for e in P.INDEX_EXTENSIONS]
    return F.when(P.suffix(cleaned) == "", F.array(*tried)).otherwise(F.array(normal))


def _py_candidates(src_path, dep):
    """Python module: leading dots climb from the source's package
    (one dot = same package); otherwise resolved from the project root."""
    stripped = F.regexp_replace(dep, r"^\.+", "")
    levels = F.length(dep) - F.length(stripped)
    pkg = F.slice(P.parts(src_path), F.lit(1), F.size(P.parts(src_path)) - 1)
    keep = F.greatest(F.lit(0), F.size(pkg) - levels + 1)
    base = F.slice(pkg, F.lit(1), keep)
    mod = F.split(stripped, r"\.")
    rel = F.concat(F.array_join(F.concat(base, mod), "/"), F.lit(".py"))
    absolute = F.concat(F.replace(dep, F.lit("."), F.lit("/")), F.lit(".py"))
    return F.array(F.when(levels > 0, rel).otherwise(absolute))


def candidates(deps: DataFrame) -> DataFrame:
    """(project, path, dep_ord, dep, prio, candidate)."""
    dep, src = F.col("dep"), F.col("path")
    js_like = dep.startswith(".") | dep.startswith("/")
    cand = (F.when(F.col("ext") == "py", _py_candidates(src, dep))
            .when(js_like, _js_candidates(src, dep))
            .otherwise(F.array(F.concat(F.replace(dep, F.lit("."), F.lit("/")), F.lit(".py")))))
    c = deps.select("project", "path", "dep_ord", "dep", F.posexplode_outer(cand).alias("prio", "candidate"))
    return c.filter(F.col("candidate").isNotNull())


def resolve(deps: DataFrame, file_set: DataFrame) -> DataFrame:
    """First existing candidate per dependency: (project, path, dep_ord,
    dep, target)."""
    fs = file_set.select("project", F.col("path").alias("candidate"))
    hits = candidates(deps).join(fs, ["project", "candidate"], "inner")
    return hits.groupBy("project", "path", "dep_ord", "dep").agg(
        F.min_by("candidate", "prio").alias("target"))


def dependency_edges(files: DataFrame, registry=None) -> DataFrame:
    """Resolved edges without self-edges, one row per (project, src, dst)
    keeping the first occurrence: (project, src_path, dst_path, src_id,
    dst_id, dep_ord)."""
    deps = raw_dependencies(files, registry)
    return edges_of(resolve(deps, files.select("project", "path")))


def edges_of(resolved: DataFrame) -> DataFrame:
    """Resolved dependencies (project, path, dep_ord, dep, target) as edges."""
    r = resolved.filter(F.col("target") != F.col("path"))
    g = r.groupBy("project", F.col("path").alias("src_path"), F.col("target").alias("dst_path")).agg(
        F.min("dep_ord").alias("dep_ord"))
    return g.select("project", "src_path", "dst_path", P.node_id("src_path").alias("src_id"),
                    P.node_id("dst_path").alias("dst_id"), "dep_ord")


def diagram_dep_lines(edges: DataFrame) -> DataFrame:
    """Mermaid lines for dependency edges, deduplicated on node ids with the
    first occurrence (source component order, then import order) kept, plus
    the blank line and comment that precede them."""
    order = F.struct(P.parts("src_path").alias("k"), F.col("dep_ord").alias("o"))
    g = edges.groupBy("project", "src_id", "dst_id").agg(
        F.min_by(F.struct("src_path", "dep_ord"), order).alias("f"))
    lines = g.select("project", F.lit(SEC_DEP_EDGES).alias("section"), F.col("f.src_path").alias("sort_path"),
                     F.col("f.dep_ord").alias("pos"),
                     F.concat(F.lit("    "), F.col("src_id"), F.lit(" -.-> "), F.col("dst_id")).alias("line"))
    projects = edges.select("project").distinct()
    comment = projects.select("project", F.lit(SEC_DEP_COMMENT).alias("section"), F.lit("").alias("sort_path"),
                              F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("line")),
                                                F.struct(F.lit(1).alias("pos"),
                                                         F.lit("    %% dependency edges").alias("line"))))
                              .alias("l"))
    comment = comment.select("project", "section", "sort_path", "l.pos", "l.line")
    return comment.unionByName(lines)
