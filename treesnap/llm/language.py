"""Hierarchical language identification.

Linear support vector machines over hashed letter n-grams first name the
language family; within a family, one machine for each pair of languages
votes. A language without a known family is a family of its own."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treesnap.llm.common import table
from treesnap.llm.quality_knn import remainder
from treesnap.session import bound_arrow_batches

# ISO 639-1 codes by language family.
FAMILIES = {
    "romance": "es fr it pt ro ca gl oc",
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky tt",
    "indic": "hi ur bn pa mr gu ne si",
    "semitic": "ar he am mt",
    "iranian": "fa ku ps tg",
    "austronesian": "id ms tl jv",
    "dravidian": "ta te kn ml",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

SAMPLE = 2400            # learning rows over all languages, at most
SAMPLE_PER_LANG = 400    # and in one language
BINS = 4096
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[:128] = 32
_SPACED[97:123] = np.arange(97, 123)
UNKNOWN = "und"


def features(text: str | None) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed 2- and 3-byte runs of
    the lower-cased text, other ASCII characters than letters as blanks."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    b = _SPACED[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.uint64)
    two = (b[:-1] << np.uint64(8) | b[1:]) + np.uint64(1)
    three = two[:-1] << np.uint64(8) | b[2:]
    out = np.zeros(BINS, np.float32)
    for x in (two, three):
        out += np.bincount(((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), minlength=BINS)
    out = np.sqrt(out)
    return out / max(float(np.linalg.norm(out)), 1e-12)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine (squared hinge) by dual coordinate descent; y is -1 or
    1, classes weighted to equal sums. Returns weights and bias."""
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
    c = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) * len(y) / 2 * cost
    diagonal = 1 / (2 * c)
    q = (xb * xb).sum(axis=1) + diagonal
    alpha, w = np.zeros(len(y)), np.zeros(xb.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (xb[i] @ w) - 1 + alpha[i] * diagonal[i]
            new = max(alpha[i] - g / q[i], 0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * xb[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1].astype(np.float32), float(w[-1])


def fit(x: np.ndarray, langs: list[str], family_of: dict[str, str] = FAMILY_OF) -> dict:
    langs_of: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        langs_of.setdefault(family_of.get(lang, f"only {lang}"), []).append(lang)
    names = np.array(langs)
    family = np.array([family_of.get(v, f"only {v}") for v in langs])
    tops = sorted(langs_of)
    top = [svm(x, np.where(family == f, 1, -1)) for f in tops] if len(tops) > 1 else []
    pairs = {}
    for f in tops:
        for a, b in combinations(langs_of[f], 2):
            rows = (names == a) | (names == b)
            pairs[a, b] = svm(x[rows], np.where(names[rows] == a, 1, -1))
    return {"families": tops, "top": top, "langs_of": langs_of, "pairs": pairs}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * x, -60, 60)))


def predict(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each row. Ties go to the name that sorts first."""
    n = len(x)
    if not model["families"]:
        return [UNKNOWN] * n, np.zeros(n)
    if model["top"]:
        margins = np.stack([x @ w + b for w, b in model["top"]], axis=1)
        family, sure = margins.argmax(axis=1), _sigmoid(margins.max(axis=1))
    else:
        family, sure = np.zeros(n, int), np.ones(n)
    out, total = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
    for i, f in enumerate(model["families"]):
        rows = np.flatnonzero(family == i)
        langs = model["langs_of"][f]
        wins, faith = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
        for (a, b), (w, bias) in model["pairs"].items():
            if a in langs and b in langs:
                p = _sigmoid(x[rows] @ w + bias)
                for lang, q in ((a, p), (b, 1 - p)):
                    wins[:, langs.index(lang)] += (q > 0.5) if lang == b else (q >= 0.5)
                    faith[:, langs.index(lang)] += q
        best = (wins + faith / (len(langs) + 1)).argmax(axis=1)
        out[rows] = np.array(langs, dtype=object)[best]
        share = faith[np.arange(len(rows)), best] / (len(langs) - 1) if len(langs) > 1 else 1.0
        total[rows] = sure[rows] * share
    return list(out), np.clip(total, 0, 1)


def has_letter(text):
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learning_sample(docs: DataFrame, text: str, key: str, lang: str, rows: int = SAMPLE,
                    rows_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """At most ``rows`` rows over all languages and ``rows_per_lang`` in one:
    the first by a hash of key and text. Copies under one key count once, so
    that a language with many of them keeps its other rows, and one that has
    nothing else is learned from one. Of more languages than half the rows, the
    most frequent are learned. Rates from the languages' counts of different
    rows, estimated, thin the rows where they are read, so that only a few times
    the sample is ranked."""
    drawn = F.xxhash64(F.col(key).cast("string"), F.col(text))
    usable = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), drawn.alias("drawn")).where(
        F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("drawn").alias("count")).orderBy(F.desc("count"), "lang").limit(rows // 2).collect()
    each = max(2, min(rows_per_lang, rows // max(1, len(counts))))
    known = docs.sparkSession.createDataFrame([(r["lang"], r["count"]) for r in counts], "lang string, count long")
    thin = (usable.join(F.broadcast(known), "lang")  # rows // 2 rows at most
            .where(F.pmod("drawn", F.lit(1 << 20)) * F.col("count") < F.lit(8 * each << 20))
            .groupBy("lang", "drawn").agg(F.min("text").alias("text")))   # copies meet before they are shuffled
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "text"))
    return thin.withColumn("rank", rank).where(F.col("rank") <= each).select("text", "lang")


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> dict:
    """Fit on a bounded sample of rows with a language. No such rows: a model
    that knows no language."""
    bound_arrow_batches(docs.sparkSession)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "x": [features(t).tobytes() for t in b["text"]]})

    got = (learning_sample(docs, text, key, lang).mapInPandas(measure, "lang string, x binary")
           .orderBy("lang", "x").collect())
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float32).reshape(-1, BINS)
    return fit(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score, one row per input row. Null
    text and text without a letter are ``und`` at score 0, as is everything
    when no language was learned. Texts count whole, whatever their length;
    equal texts, repeated rows included, get equal results; ties go to the
    language that sorts first. An empty table gives an empty one. Columns that are
    not kept are ignored, whatever their names."""
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def name(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, scores = [], []
            for at in range(0, len(b), 512):
                got, sure = predict(shared.value, np.stack([features(t) for t in b.iloc[at:at + 512]]))
                langs += got
                scores += list(sure)
            yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    letter = has_letter(F.col(text))
    return (docs.select(*[F.col(c).alias(c) for c in keep], letter.alias("__letter"), name(F.col(text)).alias("__named"))
            .select(*keep, F.when(F.col("__letter"), F.col("__named.lang")).otherwise(UNKNOWN).alias("lang_pred"),
                    F.when(F.col("__letter"), F.col("__named.score")).otherwise(0.0).alias("score")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(remainder(F.col("doc_id"), 3) != 1))
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
