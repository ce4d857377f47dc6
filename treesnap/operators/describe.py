"""Model calls at the edges: file descriptions, project synthesis and
embeddings. Each has a deterministic stand-in (so everything runs
offline and reproducibly) and a helper that runs a user-supplied function
over Arrow batches in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesnap.functions.text import py_strip, salient_sentences
from treesnap.session import bound_arrow_batches

# Output budgets per call and default concurrency.
DESCRIBE_MAX_TOKENS = 512
SYNTH_MAX_TOKENS = 2048
DEFAULT_CONCURRENCY = 10
EMBED_DIM = 64
CALL_ROWS = 16          # prompts in one model call
ITEMS_PER_TASK = 1000   # files in one task
BUCKET_WORDS = 200_000  # words whose buckets a task remembers
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def stand_in_descriptions(pending: DataFrame) -> DataFrame:
    """(project, path, sha256, description, error): the ``sentences`` longest
    sentences of each fresh pending file's whole text."""
    return pending.select("project", "path", "sha256",
                          F.when(F.col("fresh"), salient_sentences(F.col("text"), F.col("sentences"))).alias("description"),
                          stale().alias("error"))


def stale() -> Column:
    return F.when(~F.col("fresh"), F.lit("content changed while the run read it"))


def ask_prompts(complete: Callable, prompts: list[str], max_tokens: int) -> list[tuple[str | None, str | None, int, int]]:
    """(answer, error, input tokens, output tokens) of each prompt. A model
    returns texts, or (text, input tokens, output tokens); tokens that it does
    not tell count 0. If the call fails, its prompts are tried one by one."""
    try:
        got = complete(prompts, max_tokens)
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        told = [(x, 0, 0) if isinstance(x, str) else tuple(x) for x in got]
        return [(str(t).strip(), None, int(i or 0), int(o or 0)) for t, i, o in told]
    except Exception as e:  # reported per prompt
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}", 0, 0)]
        return [x for p in prompts for x in ask_prompts(complete, [p], max_tokens)]


def call_model(rows: DataFrame, complete: Callable[[list[str], int], list[str]], max_tokens: int, tasks: int,
               call_rows: int = CALL_ROWS) -> DataFrame:
    """The columns of ``rows`` without ``prompt``, plus answer (stripped) and
    error. ``complete(prompts, max_tokens) -> texts`` gets up to ``call_rows``
    prompts; when a call fails its prompts are tried one by one, and a prompt
    that fails alone becomes an error row, so the others' answers are kept.
    ``tasks`` is the number of pieces the work is cut into; how many run at
    once is the cluster's to say (task slots)."""
    keep = [f for f in rows.schema.fields if f.name != "prompt"]
    schema = T.StructType([*keep, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), call_rows):
                part = pdf.iloc[lo:lo + call_rows]
                got = ask_prompts(complete, part["prompt"].tolist(), max_tokens)
                yield part.drop(columns="prompt").astype(object).assign(answer=[x[0] for x in got], error=[x[1] for x in got])

    return rows.repartition(tasks).mapInPandas(run, schema)


def describe_with(pending: DataFrame, complete: Callable[[list[str], int], list[str]],
                  concurrency: int = DEFAULT_CONCURRENCY, items: int | None = None, ask: Callable = call_model) -> DataFrame:
    """(project, path, sha256, description, error) for the pending work, one
    row per file. With ``items``, their number, the work is cut into tasks of
    about ITEMS_PER_TASK files, ``concurrency`` tasks at least. ``ask`` is the
    way to the model: ``call_model``, or an answer store's ``ask``."""
    tasks = max(concurrency, -(-(items or 0) // ITEMS_PER_TASK))
    asked = ask(pending.where("fresh").select("project", "path", "sha256", "prompt"), complete, DESCRIBE_MAX_TOKENS, tasks)
    skipped = pending.where("not fresh").select("project", "path", "sha256", F.lit(None).cast("string").alias("description"), stale().alias("error"))
    return asked.withColumnRenamed("answer", "description").unionByName(skipped)


class _Buckets(dict):
    """Bucket of a word by md5, computed where missing; forgotten when full."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= BUCKET_WORDS:
            self.clear()
        self[word] = b = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:4], "big") % self.dim
        return b


def _unit_counts(dim: int):
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket = _Buckets(dim).__getitem__
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo:lo + 256].tolist()
                words = " ".join(filter(None, part))
                at = np.fromiter(map(bucket, words.split(" ") if words else ()), np.int64)
                row = np.repeat(np.arange(len(part)), [t.count(" ") + 1 if t else 0 for t in part])
                counts = np.bincount(row * dim + at, minlength=len(part) * dim).reshape(-1, dim)
                # whole numbers, so their squares add up to the same in any order
                size = np.sqrt((counts * counts).sum(axis=1).astype(float))[:, None]
                out.extend(np.divide(counts, size, out=np.zeros(counts.shape), where=size > 0).astype(np.float32))
            yield pd.Series(out, dtype=object)
    return embed


def hashed_embedding(text, dim: int = EMBED_DIM) -> Column:
    """Stand-in embedding: counts of lower-cased word tokens in ``dim``
    buckets by md5, L2-normalised (zeros for text without words)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    tokens = F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)
    return _unit_counts(dim)(F.array_join(tokens, " "))   # letters and digits, so no token holds a blank


def with_hashed_embedding(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
                          dim: int = EMBED_DIM) -> DataFrame:
    bound_arrow_batches(df.sparkSession)
    return df.withColumn(out_col, hashed_embedding(F.col(text_col), dim))


def embed_with(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "text",
               concurrency: int = DEFAULT_CONCURRENCY) -> DataFrame:
    """Add ``embedding`` by calling ``embed(texts) -> vectors`` per batch."""
    schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            vecs = embed(pdf[text_col].tolist())
            pdf = pdf.copy()
            pdf["embedding"] = [np.asarray(v, dtype=np.float32) for v in vecs]
            yield pdf

    return df.repartition(concurrency).mapInPandas(run, schema)


def stand_in_synthesis(gate: DataFrame, work: DataFrame) -> DataFrame:
    """Project texts for gated projects only: a use-case graph naming the
    top-level directories and a conventions list from per-project counts
    (all partial aggregates; no project text is concatenated)."""
    w = work.select("project", F.split("path", "/").alias("p"))
    tops = (w.filter(F.size("p") > 1).select("project", F.element_at("p", 1).alias("top"))
            .groupBy("project", "top").count()
            .groupBy("project").agg(F.count(F.lit(1)).alias("n_top"),
                                    F.max_by("top", F.struct("count", F.col("top"))).alias("main_top")))
    exts = (w.select("project", F.lower(F.regexp_extract(F.element_at("p", -1), r"^.+\.([^./]+)$", 1)).alias("ext"))
            .groupBy("project", "ext").count()
            .groupBy("project").agg(F.max_by("ext", F.struct("count", F.col("ext"))).alias("main_ext")))
    g = gate.filter("regenerate").select("project", "total_files")
    j = g.join(tops, "project", "left").join(exts, "project", "left")
    use_cases = F.concat(F.lit("graph LR\n    user((User)) --> "), F.col("project"),
                         F.lit("\n    "), F.col("project"), F.lit(" --> "),
                         F.coalesce(F.col("main_top"), F.lit("root")))
    conventions = F.concat(F.lit("- "), F.col("total_files").cast("string"), F.lit(" files across "),
                           F.coalesce(F.col("n_top"), F.lit(0)).cast("string"),
                           F.lit(" top-level directories\n- most files are ."),
                           F.coalesce(F.nullif(F.col("main_ext"), F.lit("")), F.lit("(none)")))
    return j.select("project", py_strip(use_cases).alias("use_cases"), py_strip(conventions).alias("conventions_ai"))


def merge_synthesis(previous: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Regenerated projects take the new texts; the others keep theirs."""
    cols = ["project", "use_cases", "conventions_ai"]
    new = regenerated.select(*cols)
    return new.unionByName(previous.select(*cols).join(new.select("project"), "project", "left_anti"))
