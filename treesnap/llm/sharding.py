"""Weighted rendezvous hashing of stable record keys over shards.

Every (key, shard) pair gets a pseudo-random number u in (0, 1) from md5; a
record goes to the shard with the smallest ``-ln(u) / weight``. A shard thus
takes a share proportional to its weight, and a further shard only takes
records to itself: no record moves between the old shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm.common import numbered, table

# hex digits of md5 that fit a double's 53-bit mantissa
_HEX = 13


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number of ``key``. Deterministic in the key's text and the
    weights. A null key counts as the empty text, so all such rows share one
    shard."""
    if not weights or not all(math.isfinite(w) and w > 0 for w in weights):
        raise ValueError("weights must be positive numbers, one per shard")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def cost(shard: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(F.lit(f"{shard}:"), text)), 1, _HEX)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** _HEX)
        return F.struct((-F.log(u) / weight).alias("cost"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[cost(s, w) for s, w in enumerate(weights)]))["shard"]


def shard_documents(docs: DataFrame, weights: list[float], grown_weights: list[float] | None = None,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, size, text_crc32, shard, slot (its
    place in the shard, by key) and grown_shard.

    size is the text's UTF-8 bytes plus one; a null text has no bytes and the
    checksum of the empty text. Rows with equal keys, repeated rows included,
    share a shard and take successive slots; null keys sort first. Other
    columns are ignored. An empty table gives no rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    grown = rendezvous(F.col(key), grown_weights) if grown_weights else F.lit(None).cast("int")
    placed = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        grown.alias("grown_shard"))
    return numbered(placed, ["shard"], [key, "size", "text_crc32"], "slot")


SHARDS = 8


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _rank_sql(shards: int) -> str:
    pairs = ", ".join(f"{{'c': substr(md5('{s}:' || coalesce(doc_id::varchar, '')), 1, {_HEX}), 's': {s}}}"
                      for s in range(shards))
    return f"(list_sort([{pairs}], 'DESC')[1]).s::INTEGER"


# DuckDB has no crc32: the oracle runs the bytewise definition over a table
# of the 256 steps, reading the bytes from hex in pieces of 64.
ORACLE = f"""
WITH RECURSIVE step(b, i, r) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL
  SELECT b, i + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM step WHERE i < 8),
steps AS (SELECT list(r ORDER BY b) AS t FROM step WHERE i = 8),
bytes AS (
  SELECT doc_id, strlen(text) AS n,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents),
placed AS (
  SELECT doc_id, coalesce(n, 0) + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
             lambda c, x: xor(c >> 8, steps.t[xor(c & 255, x) + 1]))) AS text_crc32,
         {_rank_sql(SHARDS)} AS shard, {_rank_sql(SHARDS + 1)} AS grown_shard
  FROM bytes, steps)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""
