"""Snapshot document assembly as ordered lines.

The document of a project (metadata, instructions, use cases, conventions,
file tree, architecture diagram, file descriptions) is emitted as rows of
pretty-printed JSON (indent 2, UTF-8 kept), one row per output line, each
with a sort key. Nothing is concatenated per project: the file tree and the
diagram are JSON arrays of their lines, and every file description is its
own line. The trailing comma of list items is decided by comparing a row's
key with the per-(project, section) maximum (a partial aggregate joined
back), not by a window over the whole project.

``write_documents`` range-partitions the lines by (project, key), sorts
within partitions and writes text partitioned by project: the part files of
a project folder, in name order, concatenate to its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesnap.functions import paths as P
from treesnap.functions.text import py_strip
from treesnap.operators.tree import SEC_DIRS


# Document sections in output order.
(S_OPEN, S_META_OPEN, S_NAME, S_GENERATED, S_COUNT, S_META_CLOSE, S_INSTR, S_USE, S_CONV_OPEN, S_CONV_USER,
 S_CONV_AI, S_CONV_CLOSE, S_TREE_OPEN, S_TREE, S_TREE_CLOSE, S_ARCH_OPEN, S_ARCH, S_ARCH_CLOSE, S_FILES_OPEN,
 S_FILES, S_FILES_CLOSE, S_CLOSE) = range(22)


def json_string(col) -> F.Column:
    """JSON string literal of a text column (quotes included)."""
    j = F.to_json(F.array(col))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _ord(k1=0, k2=None, k3=0):
    arr = k2 if k2 is not None else F.array().cast("array<string>")
    return F.struct(F.lit(k1).cast("int").alias("k1") if isinstance(k1, int) else k1.cast("int").alias("k1"),
                    arr.alias("k2"),
                    F.lit(k3).cast("int").alias("k3") if isinstance(k3, int) else k3.cast("int").alias("k3"))


def _fixed(meta: DataFrame, lines: list[tuple[int, F.Column]]) -> DataFrame:
    """All single lines of every document from one pass over ``meta``."""
    items = F.array(*[F.struct(F.lit(sec).alias("sec"), text.alias("line")) for sec, text in lines])
    e = meta.select("project", F.explode(items).alias("l"))
    return e.select("project", F.col("l.sec").alias("sec"), _ord().alias("ord"), F.col("l.line").alias("line"))


def _listed(df: DataFrame, sec: int, ord_col, item) -> DataFrame:
    """List items of one section with a trailing comma on all but the last."""
    rows = df.select("project", F.lit(sec).alias("sec"), ord_col.alias("ord"), item.alias("item"))
    last = rows.groupBy("project").agg(F.max("ord").alias("_last"))
    j = rows.join(last, "project", "inner")
    line = F.concat(F.lit("    "), F.col("item"), F.when(F.col("ord") != F.col("_last"), F.lit(",")).otherwise(F.lit("")))
    return j.select("project", "sec", "ord", line.alias("line"))


def _joined_text(lines: DataFrame, ord_col) -> DataFrame:
    """(project, text): the ordered lines of each project as one string."""
    rows = lines.select("project", F.struct(ord_col.alias("o"), "line").alias("x"))
    g = rows.groupBy("project").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("project", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("text"))


def document_lines(meta: DataFrame, tree_lines: DataFrame, diagram_lines: DataFrame,
                   descriptions: DataFrame, text_fields: str = "lines") -> DataFrame:
    """Lines of each project's document.

    meta: (project, generated_at, file_count, instructions, use_cases,
    conventions_user, conventions_ai), one row per project;
    tree_lines: (project, node_path, line); diagram_lines: (project,
    section, sort_path, pos, line); descriptions: (project, path,
    description). Returns (project, sec, ord, line).

    ``text_fields='lines'`` writes the file tree and the diagram as JSON
    arrays of lines. ``'string'`` writes them as single strings for every
    project, which needs a project's tree in one row of one task: a layout
    for readers that know no other."""
    if text_fields not in ("lines", "string"):
        raise ValueError("text_fields must be 'lines' or 'string'")
    tree_ord = _ord(0, F.when(F.col("node_path") == "", F.array().cast("array<string>"))
                    .otherwise(P.parts("node_path")))
    arch_ord = _ord(F.col("section"), F.when(F.col("section") == SEC_DIRS, F.array(F.col("sort_path")))
                    .otherwise(P.parts("sort_path")), F.col("pos"))
    m = meta.select("project", "generated_at", "file_count", "instructions", "use_cases",
                    "conventions_user", "conventions_ai")
    tree_rows, arch_rows = tree_lines, diagram_lines
    if text_fields == "string":
        m = (m.join(_joined_text(tree_lines, tree_ord).withColumnRenamed("text", "tree_text"), "project", "left")
             .join(_joined_text(diagram_lines, arch_ord).withColumnRenamed("text", "arch_text"), "project", "left"))
        tree_rows, arch_rows = tree_lines.limit(0), diagram_lines.limit(0)
    else:
        m = m.withColumn("tree_text", F.lit(None).cast("string")).withColumn("arch_text", F.lit(None).cast("string"))

    s = lambda c: json_string(py_strip(F.coalesce(F.col(c), F.lit(""))))
    as_string = lambda c: F.col(c).isNotNull()
    fixed = _fixed(m, [
        (S_OPEN, F.lit("{")),
        (S_META_OPEN, F.lit('  "metadata": {')),
        (S_NAME, F.concat(F.lit('    "name": '), json_string(F.col("project")), F.lit(","))),
        (S_GENERATED, F.concat(F.lit('    "generated_at": '), json_string(F.col("generated_at")), F.lit(","))),
        (S_COUNT, F.concat(F.lit('    "file_count": '), F.col("file_count").cast("string"))),
        (S_META_CLOSE, F.lit("  },")),
        (S_INSTR, F.concat(F.lit('  "instructions": '), s("instructions"), F.lit(","))),
        (S_USE, F.concat(F.lit('  "use_cases": '), s("use_cases"), F.lit(","))),
        (S_CONV_OPEN, F.lit('  "conventions": {')),
        (S_CONV_USER, F.concat(F.lit('    "user": '), s("conventions_user"), F.lit(","))),
        (S_CONV_AI, F.concat(F.lit('    "ai": '), s("conventions_ai"))),
        (S_CONV_CLOSE, F.lit("  },")),
        (S_TREE_OPEN, F.when(as_string("tree_text"), F.concat(F.lit('  "file_tree": '),
                                                              json_string(F.col("tree_text")), F.lit(",")))
         .otherwise(F.lit('  "file_tree": ['))),
        (S_TREE_CLOSE, F.when(~as_string("tree_text"), F.lit("  ],"))),
        (S_ARCH_OPEN, F.when(as_string("arch_text"), F.concat(F.lit('  "architecture": '),
                                                              json_string(F.col("arch_text")), F.lit(",")))
         .otherwise(F.lit('  "architecture": ['))),
        (S_ARCH_CLOSE, F.when(~as_string("arch_text"), F.lit("  ],"))),
        (S_FILES_OPEN, F.lit('  "files": {')),
        (S_FILES_CLOSE, F.lit("  }")),
        (S_CLOSE, F.lit("}")),
    ]).filter(F.col("line").isNotNull())
    tree = _listed(tree_rows, S_TREE, tree_ord, json_string(F.col("line")))
    arch = _listed(arch_rows, S_ARCH, arch_ord, json_string(F.col("line")))
    files = _listed(descriptions, S_FILES, _ord(0, F.array(F.col("path"))),
                    F.concat(json_string(F.col("path")), F.lit(": "),
                             json_string(F.coalesce("description", F.lit("")))))
    return fixed.unionByName(tree).unionByName(arch).unionByName(files)


def write_documents(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write each project's document under ``path/project=<name>/`` as text
    part files whose name order is document order."""
    spark = lines.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                          spark.sparkContext.defaultParallelism)
    ordered = (lines.repartitionByRange(n, "project", "sec", "ord")
               .sortWithinPartitions("project", "sec", "ord"))
    (ordered.select("project", "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("project").text(path))
