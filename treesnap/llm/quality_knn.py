"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are its character-class trigrams (what kind of characters
follow one another), hashed letter trigrams and counts of repeated words,
word pairs and lines. Term weights and a truncated singular value
decomposition are fitted on a bounded sample of labelled rows. The sample's
vectors are broadcast (``rows * rank`` floats), every document's vector is
compared with all of them in blocks, and the labels of the nearest ones
vote, weighted by their cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm.arrays import as_bytes, gram_hashes, run_hashes, word_hashes
from treesnap.llm.common import table
from treesnap.session import bound_arrow_batches

SAMPLE = 3000       # labelled rows the model is fitted on, at most
RANK = 48           # latent dimensions
NEIGHBOURS = 25
SHARPNESS = 8.0     # a neighbour's weight is its cosine to this power
KEEP_AT = 0.7

# Byte classes: blank, line break, other control, a-z, A-Z, digit, full stop,
# ! and ?, comma and the like, quotes and brackets, symbols, bar, lead byte of
# a multi-byte character, its lower and its upper continuation half.
_CLASSES = 15
_CLASS = np.full(256, 2, np.int64)
_CLASS[[9, 32]] = 0
_CLASS[[10, 13]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 3, 4, 5
_CLASS[ord(".")] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in ",;:-_/"]] = 8
_CLASS[[ord(c) for c in "'\"()[]{}`"]] = 9
_CLASS[[ord(c) for c in "#*$%&<>@^~+=\\"]] = 10
_CLASS[ord("|")] = 11
_CLASS[192:], _CLASS[128:160], _CLASS[160:192] = 12, 13, 14

_LETTER_BINS = 1024
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SHAPES = _CLASSES ** 3
_REPEATS = 4
TERMS = _SHAPES + _LETTER_BINS + _REPEATS


def terms(text: str | None) -> np.ndarray:
    """Term frequencies (square roots, float32) of one whole text; all zero
    for null or empty text."""
    out = np.zeros(TERMS, np.float32)
    buf = as_bytes(text)
    if len(buf) == 0:
        return out
    c = _CLASS[buf]
    if len(c) >= 3:
        out[:_SHAPES] = np.bincount(c[:-2] * (_CLASSES * _CLASSES) + c[1:-1] * _CLASSES + c[2:], minlength=_SHAPES)
        b = _LOWER[buf]
        h = (b[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ b[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
             ^ b[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(54)
        out[_SHAPES:_SHAPES + _LETTER_BINS] = np.bincount(h.astype(np.int64), minlength=_LETTER_BINS)
        out[:_SHAPES + _LETTER_BINS] /= len(c) - 2
    w = word_hashes(buf)
    if len(w):
        lines = run_hashes(buf, buf == 10)[0]
        repeats = [np.count_nonzero(w[1:] == w[:-1]) / len(w)]
        for h in (gram_hashes(w, 2), gram_hashes(w, 4), lines):
            repeats.append(1 - len(np.unique(h)) / len(h) if len(h) else 0.0)
        out[-_REPEATS:] = repeats
    return np.sqrt(out)


def fit(rows: np.ndarray, labels: np.ndarray, rank: int = RANK) -> dict:
    """Term weights, latent axes and the labelled vectors. ``rows`` are
    ``terms`` of the sample (overwritten), ``labels`` in [0, 1]. A fixed start makes the
    decomposition repeatable."""
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    idf[-_REPEATS:] *= 4
    x = rows
    x *= idf  # in place: the driver holds one copy of the sample
    k = int(min(rank, *x.shape)) if len(x) else 0
    if k:
        start = np.random.default_rng(0).standard_normal((x.shape[1], min(k + 10, len(x)))).astype(np.float32)
        q = np.linalg.qr(x @ start)[0]
        for _ in range(4):
            q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
        axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T.astype(np.float32)
    else:
        axes = np.zeros((TERMS, 0), np.float32)
    prior = float(labels.mean()) if len(labels) else 0.5
    return {"project": idf[:, None] * axes, "vectors": _unit(x @ axes), "labels": labels.astype(np.float32), "prior": prior}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(model: dict, rows: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 2048) -> np.ndarray:
    """Probability of label 1 for each row of ``terms``: exact cosines with
    every labelled vector, block by block. A row without terms, or with no
    neighbour at a positive cosine, gets the sample's share of label 1."""
    out = np.full(len(rows), model["prior"])
    vectors, labels = model["vectors"], model["labels"]
    if not len(vectors):
        return out
    k = min(neighbours, len(vectors))
    for at in range(0, len(rows), block):
        cosine = _unit(rows[at:at + block] @ model["project"]) @ vectors.T
        near = np.argpartition(cosine, len(vectors) - k, axis=1)[:, len(vectors) - k:]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(float), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        voted = total > 0
        out[at:at + block][voted] = (weight * labels[near]).sum(axis=1)[voted] / total[voted]
    return np.clip(out, 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, text: str = "text",
                    key: str = "doc_id", label: str = "quality") -> DataFrame:
    """At most ``rows`` labelled documents (text, label), the first by a hash
    of the key. Several labels of one key are averaged; null keys and labels
    do not count; of several texts under one key the smallest is taken."""
    chosen = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(key).alias("__key")).agg(F.avg(label).alias("__label"))
              .orderBy(F.xxhash64("__key"), "__key").limit(rows))
    return (docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
            .join(F.broadcast(chosen), "__key")  # `rows` rows at most
            .groupBy("__key").agg(F.min("__text").alias("text"), F.first("__label").alias("label"))
            .select("text", "label"))


def train(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE, text: str = "text",
          key: str = "doc_id", label: str = "quality") -> dict:
    """Fit on a bounded sample; the tasks turn its texts into terms."""
    bound_arrow_batches(docs.sparkSession)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "terms": [terms(t).astype(np.float16).tobytes() for t in b["text"]]})

    got = (labelled_sample(docs, labelled, rows, text, key, label).mapInPandas(measure, "label double, terms binary")
           .orderBy("terms", "label").collect())
    labels = np.array([r["label"] for r in got], float)
    x = np.empty((len(got), TERMS), np.float32)
    for i in range(len(got) - 1, -1, -1):
        x[i] = np.frombuffer(got.pop()["terms"], np.float16)
    return fit(x, labels)


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          keep_at: float = KEEP_AT) -> DataFrame:
    """The kept columns, score (probability of label 1) and predicted, one row
    per input row. Null and empty texts are scored with the sample's share
    of label 1. Texts count whole whatever their length; equal texts, repeated
    rows included, get equal scores, and of neighbours at the same cosine some
    fixed ones vote. Columns that are not kept are ignored, whatever their names;
    an empty table gives no rows."""
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            parts = [b.iloc[at:at + 512] for at in range(0, len(b), 512)]
            yield pd.Series(np.concatenate([vote(shared.value, np.stack([terms(t) for t in x])) for x in parts] or [np.zeros(0)]))

    return (docs.select(*[F.col(c).alias(c) for c in keep], measure(F.col(text)).alias("score"))
            .withColumn("predicted", (F.col("score") >= keep_at).cast("int")))


def remainder(key, modulus: int):
    """crc32 of the key's text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
