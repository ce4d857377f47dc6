"""Inputs built from the driver's parquet tables.

``documents`` stands in for a large multi-project source tree:
project = ``source``, path = ``<source>/<lang>/doc_<doc_id>.txt``,
content = the UTF-8 bytes of ``text``. The previous run's description cache,
the stored synthesis, a dependency-bearing variant of the files and a log of
pushed snapshots are all derived from the same table by fixed rules, so every
query's work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_path():
    return F.concat_ws("/", F.col("source"), F.col("lang"),
                       F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))


def files_from_documents(documents: DataFrame) -> DataFrame:
    """(project, path, content BINARY) from ``documents``."""
    return documents.select(F.col("source").alias("project"), doc_path().alias("path"),
                            F.col("text").cast("binary").alias("content"))


def previous_cache(documents: DataFrame) -> DataFrame:
    """Description cache of an earlier run: files with doc_id divisible by 5
    did not exist then (new now); those divisible by 7 had other content
    (changed now); the rest are unchanged (hits)."""
    d = documents.filter(F.col("doc_id") % 5 != 0)
    old_sha = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat(F.col("text"), F.lit(" (old)")), 256)) \
        .otherwise(F.sha2(F.col("text").cast("binary"), 256))
    return d.select(F.col("source").alias("project"), doc_path().alias("path"),
                    old_sha.alias("sha256"),
                    F.concat(F.lit("Cached description of "), doc_path(), F.lit(".")).alias("description"))


def previous_synthesis(cache: DataFrame) -> DataFrame:
    """A stored project synthesis exists for every project the earlier run saw."""
    return cache.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select(
        "project",
        F.concat(F.lit("graph LR\n    user --> "), F.col("project")).alias("use_cases"),
        F.concat(F.lit("- "), F.col("n").cast("string"), F.lit(" files described")).alias("conventions_ai"),
    )


def dependency_files(documents: DataFrame) -> DataFrame:
    """TypeScript-like files with one relative import each:
    project = lang, path = <source>/doc_<id>.ts, content =
    "import a from '../src<7*id mod 20>/doc_<7*id mod N>'\\n" + text,
    with N the number of documents. Targets in another language's project do
    not resolve; self-imports are dropped later."""
    n = documents.select(F.count(F.lit(1))).scalar()
    k = F.col("doc_id") * 7
    target = F.concat(F.lit("../src"), (k % 20).cast("string"), F.lit("/doc_"), (k % n).cast("string"))
    content = F.concat(F.lit("import a from '"), target, F.lit("'\n"), F.col("text"))
    return documents.select(
        F.col("lang").alias("project"),
        F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"),
        content.cast("binary").alias("content"))


def python_files(documents: DataFrame) -> DataFrame:
    """Python modules: one absolute, one relative and one package-relative
    import, then the text as a string literal."""
    n = documents.select(F.count(F.lit(1))).scalar()
    k = F.col("doc_id") * 3
    body = F.concat(
        F.lit("import os\nfrom ."), F.lit("doc_"), (k % n).cast("string"), F.lit(" import x\n"),
        F.lit("from ..src"), (k % 20).cast("string"), F.lit(" import helper\n"),
        F.lit("TEXT = '''"), F.col("text"), F.lit("'''\n"))
    return documents.select(
        F.col("source").alias("project"),
        F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        body.cast("binary").alias("content"))


# Fixed values for the push log: first push time and the two batch times.
PUSH_EPOCH = "2026-01-01 00:00:00"
BATCH_TIMES = ("2026-01-10 00:00:00", "2026-01-11 00:00:00")


def snapshot_pushes(documents: DataFrame) -> DataFrame:
    """A log of pushed snapshot documents, one per ``documents`` row, as
    JSON text: project = <source>-<lang>; the file map holds the document's
    own path and the project's README.md (so later pushes replace earlier
    chunks); pushes are ordered by doc_id through ``generated_at``. Columns:
    doc_id, batch (0 for the first half of doc_ids, 1 for the rest), value."""
    from treesnap.functions import paths as P
    from treesnap.functions.text import joined, line_count, longest, longest_line, sentence_count, sentences

    n = documents.select(F.count(F.lit(1))).scalar()
    project = F.concat(F.col("source"), F.lit("-"), F.col("lang"))
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(PUSH_EPOCH)) + F.col("doc_id"))
    gen = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    path = doc_path()
    # a column of its own, read by both descriptions: the longest of the longest is the longest
    documents = documents.withColumn("_sentences", longest(sentences("text"), sentence_count(line_count(F.col("text")))))
    desc = joined(F.col("_sentences"))
    readme = joined(longest(F.col("_sentences"), F.lit(1)))
    doc = F.struct(
        F.struct(project.alias("name"), gen.alias("generated_at"), F.lit(2).alias("file_count")).alias("metadata"),
        F.lit("").alias("instructions"),
        longest_line("text").alias("use_cases"),
        F.struct(F.when(F.col("lang") == "en", F.lit("")).otherwise(
                     F.concat(F.lit("  Write "), F.col("lang"), F.lit(" prose.  "))).alias("user"),
                 F.when(F.col("lang") == "de", F.lit("   ")).otherwise(
                     F.concat(F.lit("Sources come from "), F.col("source"), F.lit("."))).alias("ai")
                 ).alias("conventions"),
        F.concat(project, F.lit("/\n└── doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_tree"),
        F.concat(F.lit("graph TD\n    "), P.node_id(path), F.lit("[doc_"), F.col("doc_id").cast("string"),
                 F.lit(".txt]")).alias("architecture"),
        F.create_map(path, desc, F.lit("README.md"), readme).alias("files"))
    return documents.select("doc_id", F.when(F.col("doc_id") < n / 2, 0).otherwise(1).alias("batch"),
                            F.to_json(doc).alias("value"))
