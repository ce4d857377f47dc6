"""Benchmark decontamination by winnowing.

A text's k-gram hashes are thinned to the smallest hash of every run of w
consecutive ones. Two texts sharing a span of k + w - 1 words share that
run and so its smallest hash: no such span is missed. Documents whose
fingerprints meet a benchmark item's are fetched again, and the hits are
extended: every window of the document around a shared fingerprint is
compared, word by word, with the benchmark's windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm.common import gram_hashes, table
from treesnap.session import materialize

SPAN = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# characters other than A-Z that lower() may change
OTHER_CAPITALS = r"[\p{Lu}\p{Lt}\x{2160}-\x{216F}\x{24B6}-\x{24CF}&&[^A-Z]]"


def benchmark_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(t.rlike(OTHER_CAPITALS), F.translate(t, UPPER, UPPER.lower())).otherwise(F.lower(t))
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def thinning(span: int) -> tuple[int, int]:
    """k and w with k + w - 1 == span."""
    k = (span + 1) // 2
    return k, span - k + 1


def fingerprints(grams: Column, w: int) -> Column:
    """Distinct smallest hashes of the runs of ``w``. ``grams`` is a plain
    column; fewer than ``w`` grams give none."""
    n = F.size(grams)
    return F.when(n >= w, F.array_distinct(F.transform(
        F.sequence(F.lit(0), n - F.lit(w)),
        (lambda i: F.least(*[F.get(grams, i + F.lit(j)) for j in range(w)])) if w > 1 else (lambda i: F.get(grams, i)),
    ))).otherwise(F.array().cast("array<bigint>"))


def _windows(words: Column, n: Column, span: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - F.lit(span)),
                       lambda i: F.array_join(F.slice(words, i + F.lit(1), span), " "))


def item_windows(benchmark: DataFrame, span: int = SPAN, text: str = "text", item: str = "item_id") -> DataFrame:
    """(span, item, window) of every item window; an item of fewer words
    than ``span`` is one window of its own length."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), benchmark_words(F.col(text)).alias("w"))
    sized = words.withColumn("n", F.size("w")).where("n > 0").withColumn("span", F.least(F.col("n"), F.lit(span)))
    return sized.select("span", "item", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("span")),
        lambda i: F.array_join(F.slice(F.col("w"), i + F.lit(1), F.col("span")), " "))).alias("window")).distinct()


def _hits(docs: DataFrame, key: Column, text: str, base: DataFrame, windows: DataFrame, spans: list[int]) -> DataFrame:
    """(__key, span, start, item) of every window found. The texts of documents
    that share a fingerprint of any length are fetched once; places of shared
    fingerprints in them come from a join."""
    def prints_of(s: int) -> DataFrame:
        k, w = thinning(s)
        grams = windows.where(F.col("span") == s).select(F.split("window", " ").alias("w")).withColumn("g", gram_hashes(F.col("w"), F.size("w"), k))
        return grams.select(F.lit(s).alias("span"), F.explode(fingerprints(F.col("g"), w)).alias("print")).distinct()

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    prints = materialize(union([prints_of(s) for s in spans]), "item-prints")
    own = union([base.select("__key", F.lit(s).alias("span"), F.explode(f"__f{s}").alias("print")) for s in spans])
    met = own.join(prints, ["span", "print"], "left_semi").select("__key").distinct()
    near = materialize(docs.select(key.alias("__key"), F.col(text).alias("__text")).join(met, "__key")
                       .groupBy("__key").agg(F.first("__text").alias("__text"))   # repeated rows
                       .select("__key", benchmark_words(F.col("__text")).alias("w")), "met-documents")
    sized = near.withColumn("n", F.size("w"))
    grams = union([sized.select("__key", F.lit(s).alias("span"), F.posexplode(gram_hashes(F.col("w"), F.col("n"), thinning(s)[0])).alias("at", "print")) for s in spans])
    places = grams.join(prints, ["span", "print"], "left_semi").groupBy("__key", "span").agg(F.collect_set("at").alias("places"))
    k = F.when(F.lit(False), 0)
    for s in spans:
        k = k.when(F.col("span") == s, thinning(s)[0])
    starts = places.withColumn("k", k).join(near, "__key").select("__key", "span", "w", F.array_distinct(F.flatten(F.transform(
        "places", lambda p: F.sequence(F.greatest(F.lit(0), p - (F.col("span") - F.col("k"))), F.least(p, F.size("w") - F.col("span")))))).alias("starts"))
    return (starts.select("__key", "span", F.explode(F.transform("starts", lambda i: F.struct(
                i.alias("start"), F.array_join(F.slice("w", i + F.lit(1), F.col("span")), " ").alias("window")))).alias("at"))
            .select("__key", "span", "at.start", "at.window").join(windows, ["span", "window"])
            .select("__key", "span", "start", "item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, text: str = "text",
                  item: str = "item_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_words, n_hit, n_items, items_sha256 (null when no
    item occurs), contaminated and hit_starts (spans and positions of the
    windows found), one row per input row.

    Null and empty texts have no words and no hits. Null item ids count as
    the item named ''. Repeated rows get equal results, since results depend
    on the text alone. An empty benchmark leaves every document clean, and an
    empty table gives an empty one. Texts count whole whatever their length;
    columns that are not kept are ignored, whatever their names. The
    first of ``keep`` spreads rows with equal text over the tasks."""
    windows = materialize(item_windows(benchmark, span, text, item).withColumn("item", F.coalesce("item", F.lit(""))), "item-windows")
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most `span` values
    # 128 bits: rows are joined on it, and there may be very many
    key = F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(keep[0]).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))))
    words = docs.select(*[F.col(c).alias(c) for c in keep], key.alias("__key"), benchmark_words(F.col(text)).alias("__w"))
    for s in spans:
        words = words.withColumn(f"__g{s}", gram_hashes(F.col("__w"), F.size("__w"), thinning(s)[0]))
    thinned = words.select(*keep, "__key", F.size("__w").cast("long").alias("n_words"),
                           *[fingerprints(F.col(f"__g{s}"), thinning(s)[1]).alias(f"__f{s}") for s in spans])
    base = materialize(thinned, "doc-fingerprints")
    found = _hits(docs, key, text, base, windows, spans) if spans else None
    if found is None:
        return base.select(*keep, "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
                           F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"),
                           F.array().cast("array<struct<start:int,end:int>>").alias("hit_starts"))
    per_doc = (found.groupBy("__key").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("span")).alias("end")))).alias("hit_starts"),
        F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("hit", _union_length(F.col("hit_starts"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (base.join(per_doc, "__key", "left").select(
        *keep, "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"), F.coalesce("hit_starts", none).alias("hit_starts")))


def _union_length(spans: Column) -> Column:
    """Positions covered by half-open spans sorted by start."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda a, x: F.struct(
        F.greatest(a["upto"], x["end"]).alias("upto"),
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["upto"], x["start"]))).alias("n")), lambda a: a["n"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("hit_starts")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, w, least(len(w), {SPAN}) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT s, item, array_to_string(w[p + 1:p + s], ' ') AS win
       FROM (SELECT s, item, w, unnest(range(len(w) - s + 1)) AS p FROM i)),
dw AS (SELECT r, s, p, array_to_string(w[p + 1:p + s], ' ') AS win
       FROM (SELECT r, s, w, unnest(range(greatest(0, len(w) - s + 1))) AS p FROM d, (SELECT DISTINCT s FROM iw))),
hits AS (SELECT r, dw.s, p, item FROM dw JOIN iw ON dw.s = iw.s AND dw.win = iw.win),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + s)) AS q FROM hits) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
