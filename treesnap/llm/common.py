"""Column expressions and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treesnap.session import materialize

# ASCII white space 0x09-0x0D and 0x20, as characters and as a regex class
SPACE_CHARS = "\t\n\x0b\x0c\r "
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of ``text``; empty array for null or blank."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def gram_hashes(words: Column, n: Column, k: int) -> Column:
    """xxhash64 of every run of ``k`` consecutive words; empty array when
    there are fewer than ``k``. ``words`` and ``n`` must be plain columns, not
    expressions: the lambda would evaluate an expression once per element."""
    return F.when(n >= k, F.transform(
        F.sequence(F.lit(0), n - F.lit(k)),
        lambda i: F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(k)]),
    )).otherwise(F.array().cast("array<bigint>"))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the gapless position from 0 of each row in its group, in
    the given order (nulls first, tied rows in input order).

    Rows are dealt out by range and numbered within each range; the ranges'
    counts, one row per range and group, give each range its offset. No
    group is ever gathered in one task. ``group`` columns must not be null,
    and ``df`` must be a projection of a scan, so that a repeated task yields
    the same rows in the same order."""
    placed = materialize(
        df.withColumn("__row", F.monotonically_increasing_id())
          .repartitionByRange(*[F.col(c) for c in order], "__row")
          .withColumn("__range", F.spark_partition_id()), f"numbered-{out}")
    counts = placed.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__count"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__range", F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*group, "__range").orderBy(*order, "__row")
    return (placed.withColumn("__pos", F.row_number().over(within))
            .join(offsets, [*group, "__range"])
            .withColumn(out, (F.col("__offset") + F.col("__pos") - 1).cast("long"))
            .drop("__row", "__range", "__pos", "__offset"))
