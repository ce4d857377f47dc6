"""Path functions over POSIX relative paths, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension candidates tried for a relative import without a
# suffix, in priority order, then the index files of a directory.
JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py")
INDEX_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parts(path) -> Column:
    return F.split(_c(path), "/")


def depth(path) -> Column:
    return F.size(parts(path))


def name(path) -> Column:
    return F.element_at(parts(path), -1)


def parent(path) -> Column:
    """Parent directory ('' for top-level entries)."""
    p = parts(path)
    return F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "/")


def ancestor(path, level) -> Column:
    """The first ``level`` components joined (level >= 1)."""
    return F.array_join(F.slice(parts(path), F.lit(1), _c(level)), "/")


def suffix(path) -> Column:
    """``PurePath.suffix``: last dot-extension, '' for dot-files and 'a.'."""
    return F.regexp_extract(name(path), r"^.+(\.[^./]+)$", 1)


def node_id(path) -> Column:
    """Diagram node id: '/', '.', '-' become '_' (collisions possible)."""
    return F.translate(_c(path), "/.-", "___")


def slug(project) -> Column:
    """Collection slug: lower-case, runs of non [a-z0-9] -> '_', trimmed of
    '_', 'default' when empty."""
    s = F.regexp_replace(F.lower(_c(project)), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", F.lit("default")).otherwise(s)


def clean(path) -> Column:
    """Lexical clean-up of a path as ``PurePath`` does it: empty and '.'
    components dropped, '..' kept."""
    p = F.filter(parts(path), lambda x: (x != "") & (x != "."))
    return F.array_join(p, "/")


def normalise(path) -> Column:
    """Resolve '.' and '..' lexically. A path climbing above the root gives
    NULL (it cannot name a file of the project)."""
    init = F.struct(F.array().cast("array<string>").alias("st"), F.lit(False).alias("up"))

    def step(acc, x):
        return (F.when((x == "") | (x == "."), acc)
                .when(x == "..",
                      F.when(F.size(acc["st"]) == 0,
                             F.struct(acc["st"].alias("st"), F.lit(True).alias("up")))
                      .otherwise(F.struct(F.slice(acc["st"], F.lit(1), F.size(acc["st"]) - 1).alias("st"),
                                          acc["up"].alias("up"))))
                .otherwise(F.struct(F.concat(acc["st"], F.array(x)).alias("st"), acc["up"].alias("up"))))

    r = F.aggregate(parts(path), init, step)
    return F.when(~r["up"], F.array_join(r["st"], "/"))


def join_path(directory, rel) -> Column:
    d, r = _c(directory), _c(rel)
    return F.when(d == "", r).otherwise(F.concat(d, F.lit("/"), r))


def url_path(url) -> Column:
    """Path part of a URL, without query or fragment and without the leading '/'."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
