"""The training-data pipeline over ``documents``.

Every stage takes (spark, docs, sf_dir) and reads its own parameters below.
All but the last return the columns of their input. Rows with a null doc_id
pass every filter on their text's account alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm import decontaminate, line_dedup, near_dedup, packing, quality_knn
from treesnap.llm.common import split_words, table, whole_row
from treesnap.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts. It learns from the labelled
    rows that op1 learns from; without any of them nothing is rejected."""
    labels = table(spark, sf_dir, "labels")
    model = quality_knn.train(docs, labels.where(quality_knn.remainder(F.col("doc_id"), 4) != 2))
    if not len(model["labels"]):
        return docs
    rows = docs.select(whole_row(docs).alias("__row"), F.col("text").alias("__text"))
    return quality_knn.score(rows, model, text="__text", keep=("__row",)).where("predicted = 1").select("__row.*")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks cut from the texts, n_chars brought up to date. A
    document of which nothing but white space is left is gone, as all of it
    stands elsewhere; texts that were blank before stay."""
    removed = next(n for n in (f"removed_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    cut = line_dedup.dedup_lines(docs, removed=removed)
    left = cut.where((F.col(removed) == 0) | (F.size(split_words(F.col("text"))) > 0)).drop(removed)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8):
    the smallest doc_id, null last, and of several the text with the smallest
    hash. Rows with one doc_id and different texts are different documents, linked
    by likeness alone, as are rows without a doc_id; of rows that agree in both
    one stays. Texts without words are like no other."""
    node = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("hash"))
    rows = docs.select(node.alias("__node"), whole_row(docs).alias("__row"))
    found = near_dedup.near_duplicates(rows.select("__node", F.col("__row.text").alias("text")), k=5, percent=80, key="__node")
    kept = materialize(found.where("kept").groupBy("__node").agg(F.count(F.lit(1)).alias("__rows")), "kept-nodes")
    one = kept.where("__rows = 1").select("__node").hint("shuffle_hash")
    out = rows.join(one, "__node", "left_semi").select("__row.*")
    several = kept.where("__rows > 1").select("__node")
    if not several.isEmpty():
        out = out.unionByName(rows.join(several, "__node", "left_semi").groupBy("__node").agg(F.min("__row").alias("__row")).select("__row.*"))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of the benchmark. Rows with equal doc_id and
    text share their fate; an empty benchmark drops nothing."""
    own = F.xxhash64(F.coalesce("text", F.lit("")), "doc_id")
    keyed = docs.select("doc_id", "text", own.alias("__hash"))
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), keep=("doc_id", "__hash"))
    hit = materialize(found.where("contaminated").select(F.col("doc_id").alias("__hit"), "__hash").distinct(), "contaminated")
    rows = docs.select(F.col("doc_id").alias("__id"), own.alias("__own"), whole_row(docs).alias("__row"))
    return rows.join(hit.hint("shuffle_hash"), (F.col("__own") == F.col("__hash")) & F.col("__id").eqNullSafe(F.col("__hit")), "left_anti").select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in batches; a token is a word. Null, empty
    and blank texts are one piece of length 0 (see ``packing.pack``)."""
    return packing.pack(docs, F.size(split_words(F.col("text"))))


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", cut_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The classifier, the sketches and the dynamic programme have no SQL form.
# Tests hold the rows of the near-duplicate, decontamination and packing stages,
# and the texts of the line stage on whole short lines, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
