"""Periodic runs of words: passages that repeat with a small period.

A run of period q and at least 4 q words (6 at least) equals itself q words on
over 5 words for q = 1 and over 3 q words for q > 1. So for lags from 2^j up to
2^(j+1) the grams of 3 * 2^j words (5 for lag 1) are indexed: every run has such
a gram that stands again q words on. As the gram is no shorter than q, a nearer
occurrence inside the run would give it a smaller period; so q is the lag to the
next occurrence, and consecutive occurrences are all that has to be listed.
Their diagonals are extended word by word to both sides; for each lag a table
keeps how far it is covered, so that no stretch is extended twice. Grams are
named exactly, the longer ones from two halves, and only repeated ones go on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm.arrays import gram_hashes
from treesnap.llm.common import split_words, table
from treesnap.session import bound_arrow_batches

LEAST, TIMES = 6, 4        # words of a run: at least, and times its period
SEED = LEAST - 1           # words over which every run of period 1 equals itself
_BATCH = 1 << 20           # bytes of texts searched at once, or one text more
RUNS = "array<struct<start:long,length:long,period:long>>"


class _Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that occur twice or more, and their names from 0."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[name] > 1)
    return at, name[at]


def _seeds(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the grams of SEED words that repeat in their text."""
    if len(words) < SEED + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(words.astype(np.uint64), SEED) + text[:len(words) - SEED + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(hashes, kind="stable")
    same = np.diff(hashes[order]) == 0
    at = np.sort(order[np.append(same, False) | np.append(False, same)])
    name = text[at]   # the hash only thins out; names are exact
    for j in range(SEED):
        _, name = np.unique(name * (words.max() + 2) + words[at + j] + 1, return_inverse=True)
    count = np.bincount(name, minlength=1)
    keep = count[name] > 1
    return at[keep], name[keep]


def _stretch(words: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """The longest stretch around ``i`` that equals itself ``lag`` words on."""
    ends = []
    for step in (1, -1):
        at, width = i, 64
        while True:
            lo, hi = (at, min(at + width, len(words) - lag)) if step == 1 else (max(at - width, 0), at)
            differ = np.flatnonzero(words[lo:hi] != words[lo + lag:hi + lag])
            if len(differ):
                ends.append(lo + int(differ[0]) if step == 1 else lo + int(differ[-1]) + 1)
                break
            at = hi if step == 1 else lo
            if at in (0, len(words) - lag):
                ends.append(at)
                break
            width *= 2
    return ends[1], ends[0]


def runs_of(words: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. ``words`` are
    numbers; texts that follow each other are parted by numbers used once, and
    ``text`` tells each word's text."""
    found: dict[tuple[int, int], int] = {}
    at, name = _seeds(words, text)
    size, low, high = SEED, 1, 2
    while len(at):
        order = np.argsort(name, kind="stable")
        lag = np.diff(at[order])
        pair = np.flatnonzero((np.diff(name[order]) == 0) & (lag >= low) & (lag < high))
        first, lag = at[order[pair]], lag[pair]
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        edges = np.append(np.flatnonzero(np.diff(lag, prepend=-1)), len(lag))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            q, own, covered = int(lag[lo]), first[lo:hi], -1
            while True:   # the next seed of this lag that no stretch covers
                n = int(np.searchsorted(own, covered))
                if n == len(own):
                    break
                start, covered = _stretch(words, int(own[n]), q)
                if covered - start >= max(LEAST, TIMES * q) - q:
                    found.setdefault((start, covered + q), q)   # smaller periods come first
        # grams of 6, 12, 24, ... words from two repeated ones
        shift = 1 if size == SEED else size
        names = np.full(len(words) + shift, -1)
        names[at] = name
        both = names[at + shift] >= 0
        at, name = at[both], name[both] * (len(words) + 1) + names[at[both] + shift]
        place, name = _repeated(name)
        at, size, low, high = at[place], size + shift, high, 2 * high
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _search(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Words, runs and the text without repetitions, text by text."""
    numbers, split = _Numbers(), [t.split() for t in texts]   # ASCII white space
    sizes = np.array([len(s) for s in split], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int((sizes + 1).sum()), np.int64)
    for i, (b, s) in enumerate(zip(begin.tolist(), split, strict=True)):
        words[b:b + len(s)] = np.fromiter(map(numbers.__getitem__, s), np.int64, len(s))
    ends = begin + sizes
    words[ends] = len(numbers) + np.arange(len(split))
    found: list[list] = [[] for _ in split]
    for s, n, q in runs_of(words, np.repeat(np.arange(len(split)), sizes + 1)):
        own = int(np.searchsorted(ends, s))
        found[own].append((s - int(begin[own]), n, q))
    for s, runs in zip(split, found, strict=True):
        kept = s
        if runs:
            keep = np.ones(len(s), bool)
            for start, n, q in runs:
                keep[start + q:start + n] = False
            kept = [s[i] for i in np.flatnonzero(keep).tolist()]
        yield len(s), runs, b" ".join(kept).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_words, runs (start, length, period in words, by
    start and period) and collapsed: the text's words joined by single blanks,
    without those that a run contains after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a longest
    stretch whose words ``period`` apart are the same, for its smallest period,
    with ``max(6, 4 * period)`` words or more. Null, empty and blank texts have
    no words and no runs, and collapse to the empty text. Runs that start
    together come by period. One row per input row, repeated ones included;
    an empty table gives an empty one. Texts count whole whatever their length;
    a batch of them is searched together but each for itself. Columns that are
    not kept are ignored, whatever their names."""
    bound_arrow_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "n_words long", f"runs {RUNS}", "collapsed string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b["__text"]]
            own = b.drop(columns="__text")
            edges = [0]
            size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > _BATCH or i + 1 == len(texts):
                    edges.append(i + 1)
                    size = 0
            for lo, hi in zip(edges, edges[1:]):
                got = list(_search(texts[lo:hi]))
                yield own.iloc[lo:hi].assign(
                    n_words=[n for n, *_ in got], collapsed=pd.Series([c for *_, c in got], dtype=object).to_numpy(),
                    runs=pd.Series([[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in got], dtype=object).to_numpy())

    return docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text")).mapInPandas(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which every tenth row by a checksum of its id
    repeats some words of its own up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    drawn = docs.select("doc_id", "text", F.when(h % 10 == 0, split_words(F.col("text"))).alias("words"), F.floor(h / 10).alias("g"))
    drawn = drawn.withColumn("n", F.when(F.size("words") > 0, F.size("words"))).withColumn("a", F.pmod("g", "n")).withColumn(
        "p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    return drawn.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's."""
    first = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("top"),
                         F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return named.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_runs(planted(table(spark, sf_dir, "documents"))))
