"""Weak supervision of text quality.

Eight rules vote on each document: good, bad, or abstain. The distinct vote
patterns (at most 3**8) are counted over all documents, and expectation
maximisation on those counts estimates each rule's voting rates among good
and bad documents and the share of good ones. A document is kept when its
posterior probability of being good reaches the threshold, so no single rule
has to be passed. Rates are class-conditional: a rule that seldom votes
"bad" on good text carries much weight when it does."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm.common import SPACE_CHARS, gram_hashes, split_words, table
from treesnap.session import materialize

WINDOW = 5
NOT_SYMBOL = r"[^#*$%&|<>]+"
NOT_UPPER = r"[^\p{Lu}]+"
NOT_STOP = r"[^.!?]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
GOOD, ABSTAIN, BAD = 1, 0, -1


def _repeat_windows(h: Column) -> Column:
    """(hash, position) of every window, sorted; null where all are distinct."""
    return F.when(F.size(F.array_distinct(h)) < F.size(h),
                  F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def _repeat_starts(s: Column) -> Column:
    """Positions of windows whose hash a neighbour in ``s`` shares."""
    def shared(e: Column, i: Column) -> Column:
        return ((F.get(s, i - F.lit(1))["h"] == e["h"]) & (i > 0)) | (F.get(s, i + F.lit(1))["h"] == e["h"])
    return F.sort_array(F.transform(F.filter(s, lambda e, i: F.coalesce(shared(e, i), F.lit(False))), lambda e: e["i"]))


def _covered(starts: Column, width: int) -> Column:
    """Number of positions within ``width`` of a start; starts ascend."""
    zero = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.coalesce(F.aggregate(
        starts, zero,
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(width), x - a["last"])).alias("n")),
        lambda a: a["n"]), F.lit(0).cast("long"))


def text_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the counts of every whole text.

    Windows are told apart by 64-bit hashes within one text. A null or empty
    text counts zero everywhere; repeated rows are counted row by row."""
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(
        *[F.col(c).alias(c) for c in keep],
        split_words(F.col(text)).alias("__w"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("__l"),
        F.length(t).alias("__len"),
        F.length(F.regexp_replace(t, WORD_RUN, "")).alias("__space"),
        F.length(F.regexp_replace(t, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, NOT_UPPER, "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(t, NOT_STOP, "")).cast("long").alias("n_stops"))
    second = first.select(
        *keep, "n_symbols", "n_upper", "n_stops",
        F.size("__w").cast("long").alias("n_words"),
        (F.col("__len") - F.col("__space")).cast("long").alias("word_chars"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        gram_hashes(F.col("__w"), F.size("__w"), WINDOW).alias("__h"))
    third = second.withColumn("__s", _repeat_windows(F.col("__h"))).drop("__h")
    return (third.withColumn("n_repeat_words", _covered(_repeat_starts(F.col("__s")), WINDOW)).drop("__s"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rule_votes() -> dict[str, Column]:
    """The rules, over the columns of ``text_counts``. All abstain on a text
    without words."""
    n, chars = F.col("n_words"), F.col("word_chars")
    some, enough = n > 0, n >= 20
    rules = {
        "symbols": _vote(20 * F.col("n_symbols") > chars, 50 * F.col("n_symbols") < chars),
        "capitals": _vote(10 * F.col("n_upper") > 4 * chars, 10 * F.col("n_upper") < chars),
        "punctuation": _vote((2 * F.col("n_stops") > n) | (enough & (F.col("n_stops") == 0)),
                             10 * F.col("n_stops") < 3 * n),
        "noise_per_word": _vote(2 * (F.col("n_symbols") + F.col("n_stops")) > n,
                                5 * (F.col("n_symbols") + F.col("n_stops")) < n),
        "dup_lines": _vote((F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
                           20 * F.col("n_dup_lines") < F.col("n_lines")),
        "repeats": _vote(20 * F.col("n_repeat_words") > 3 * n, 100 * F.col("n_repeat_words") < 5 * n),
        "variety": _vote(enough & (20 * F.col("n_distinct") < n), 10 * F.col("n_distinct") > 2 * n),
        "word_length": _vote((chars < 2 * n) | (chars > 15 * n), (chars >= 3 * n) & (chars <= 10 * n)),
    }
    return {k: F.when(some, v).otherwise(ABSTAIN) for k, v in rules.items()}


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, anchor: float = 0.02) -> dict:
    """EM over vote patterns (rows of -1, 0, 1) with their counts.

    Starts from the belief that a document with a "bad" vote is bad. Each
    rule's rates have a Dirichlet prior worth ``anchor`` of all documents:
    on good text a "bad" vote is rare, on bad text it is as likely as not.
    The prior keeps the classes from changing places and defines the result
    on empty or one-sided input. Deterministic: patterns are sorted first."""
    m = patterns.shape[1]
    order = np.lexsort(patterns.T[::-1]) if len(patterns) else np.arange(0)
    v, c = patterns[order].astype(int), counts[order].astype(float)
    onehot = np.stack([v == x for x in (BAD, ABSTAIN, GOOD)], axis=2).astype(float)
    weight = max(anchor * c.sum(), 1.0)
    prior = {1: np.array([0.02, 0.18, 0.80]), 0: np.array([0.45, 0.15, 0.40])}
    q = np.where((v == BAD).any(axis=1), 0.1, 0.95)
    share, rates = 0.85, {k: np.tile(p, (m, 1)) for k, p in prior.items()}
    for _ in range(rounds):
        for k, r in ((1, q), (0, 1 - q)):
            got = np.einsum("p,pmk->mk", c * r, onehot) + weight * prior[k]
            rates[k] = got / got.sum(axis=1, keepdims=True)
        share = float(((c * q).sum() + 0.85 * weight) / (c.sum() + weight))
        odds = np.log(share / (1 - share)) + np.einsum("pmk,mk->p", onehot, np.log(rates[1]) - np.log(rates[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        done = len(q) == 0 or np.abs(new - q).max() < 1e-9
        q = new
        if done:
            break
    return {"share": share, "good": rates[1], "bad": rates[0]}


def posterior(model: dict, votes: list[Column]) -> Column:
    """Probability of being good, as a column expression."""
    odds = F.lit(float(np.log(model["share"] / (1 - model["share"]))))
    gain = np.log(model["good"]) - np.log(model["bad"])
    for j, vote in enumerate(votes):
        odds = odds + F.when(vote == BAD, float(gain[j, 0])).when(vote == GOOD, float(gain[j, 2])).otherwise(float(gain[j, 1]))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the counts, the votes, base_failed, quality
    (posterior) and kept, one row per input row. Extra columns are ignored
    unless named in ``keep``; an empty table gives no rows; null ids stay."""
    rules = rule_votes()
    measured = materialize(text_counts(docs, text, keep).select("*", *[v.alias(f"vote_{k}") for k, v in rules.items()]),
                           "rule-votes")
    names = [f"vote_{k}" for k in rules]
    seen = measured.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    patterns = np.array([[r[k] for k in names] for r in seen], dtype=int).reshape(-1, len(names))
    model = fit_votes(patterns, np.array([r["count"] for r in seen], dtype=float))
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    return (measured.withColumn("base_failed", failed)
            .withColumn("quality", posterior(model, [F.col(c) for c in names]))
            .withColumn("kept", ~failed & (F.col("quality") >= threshold)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "quality")
