"""Packing by optimal length buckets.

Texts longer than the model's length are cut into pieces. A dynamic
programme over the global histogram of piece lengths chooses the bucket
lengths with the least padding, and the pieces of a bucket are dealt, in key
order, to batches of a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm.common import numbered, split_words, table
from treesnap.session import materialize

MAX_LEN = 2048
BUDGET = 16384
BUCKETS = 8


def best_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending bucket lengths, at most ``buckets``, with the least padding;
    among equal ones those with the shorter cut first. The last one is the
    greatest length. Empty for no lengths."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(x)
    if not m:
        return []
    many, mass = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * x)))
    best = np.full(m + 1, np.iinfo(np.int64).max // 2, np.int64)
    best[0] = 0
    steps = []
    for _ in range(min(buckets, m)):
        new, back = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            total = best[:j] + x[j - 1] * (many[j] - many[:j]) - (mass[j] - mass[:j])
            i = int(total.argmin())
            if total[i] < new[j]:
                new[j], back[j] = total[i], i
        steps.append(back)
        best = new
    out, j = [], m
    for back in reversed(steps):
        if j and back[j] >= 0:
            out.append(int(x[j - 1]))
            j = int(back[j])
    return out[::-1]


def pack(docs: DataFrame, length: Column, key: str = "doc_id", max_len: int = MAX_LEN, budget: int = BUDGET,
         buckets: int = BUCKETS) -> DataFrame:
    """One row per piece: key, piece (number from 0), start and length in
    tokens, bucket, padded (the bucket's length), batch (number in the
    bucket) and place (in the batch).

    Every token of every row is in exactly one piece. A row without tokens,
    null text included, is one piece of length 0 in the first bucket. A batch
    has at most ``budget`` padded tokens, or one piece where a piece alone is
    longer; only a bucket's last batch is not full. Rows with equal keys,
    repeated rows included, stay apart; null keys come first. Other columns
    are ignored. The histogram has at most ``max_len + 1`` rows."""
    n = F.coalesce(length, F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(key).alias(key), n.alias("__n")), "pack-lengths")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / max_len))))
    pieces = rows.select(key, "__n", piece.alias("piece")).select(
        key, "piece", (F.col("piece") * max_len).alias("start"),
        F.least(F.lit(max_len), F.col("__n") - F.col("piece") * max_len).alias("length"))
    seen = pieces.groupBy("length").count().collect()
    bounds = best_buckets(np.array([r["length"] for r in seen]), np.array([r["count"] for r in seen]), buckets)
    bucket, padded = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, b in reversed(list(enumerate(bounds))):
        fits = F.col("length") <= b
        bucket, padded = F.when(fits, i).otherwise(bucket), F.when(fits, F.lit(b).cast("long")).otherwise(padded)
    dealt = numbered(pieces.withColumn("bucket", bucket).withColumn("padded", padded), ["bucket"], [key, "piece"], "__slot")
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("padded", F.lit(1).cast("long"))))
    return (dealt.withColumn("batch", F.floor(F.col("__slot") / per_batch)).withColumn("place", F.pmod("__slot", per_batch))
            .select(key, "piece", "start", "length", "bucket", "padded", "batch", "place"))


def batches_of_ids(pieces: DataFrame, ids: DataFrame, key: str = "doc_id", pad_id: int = 0) -> DataFrame:
    """The token ids of packed pieces: bucket, batch, place, key, piece, ids and
    the length that counts; ``ids`` is padded to the bucket's length by ``pad_id``.

    ``pieces`` comes from ``pack`` over the lengths in ``ids`` (key, ids), such as
    ``token_files.read`` gives; keys are unique there. A piece without tokens
    is all padding. A batch is not put into one row: its rows share bucket and
    batch and are in the order of ``place``."""
    own = ids.select(F.col(key).alias("__id"), F.col("ids").alias("__ids"))
    met = pieces.join(own, F.col(key).eqNullSafe(F.col("__id")))
    part = F.slice("__ids", F.col("start").cast("int") + 1, F.col("length").cast("int"))
    padding = F.array_repeat(F.lit(pad_id).cast("bigint"), (F.col("padded") - F.col("length")).cast("int"))
    return met.select("bucket", "batch", "place", key, "piece", "length", F.concat(part, padding).alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), F.size(split_words(F.col("text"))))
