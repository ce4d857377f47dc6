"""Exact top-k vector search over the ``chunks`` table, many queries per job.

Chunks and queries are dealt into blocks; every pair of a chunk block and a
query block is scored in NumPy by one call of a cogrouped function, which
returns k rows per query (or per query and project), never the products. The
queries stay a DataFrame. Windows over ``row_number() <= k`` finish the job;
Spark plans them with a map-side limit.

Distances are rounded to 9 digits before they order anything, so equal
vectors tie and ids decide. The cosine distance of a vector without length is
1. Rows without an embedding are not searched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesnap.session import materialize

# Default number of results and score precision.
DEFAULT_K = 5
SCORE_DIGITS = 4
DIST_DIGITS = 9
METRICS = ("l2sq", "cosine", "ip")

CHUNK_BLOCK = 20_000   # chunks scored together, on average
QUERY_BLOCK = 512      # queries scored together, on average
_STRIPE = 64           # queries whose distances are held at once


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(n, d) chunks x (m, d) queries -> (m, n) distances in float64."""
    if metric == "l2sq":
        out = np.stack([((x - v) ** 2).sum(axis=1) for v in q])
    else:
        out = q @ x.T
        if metric == "cosine":
            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
            out = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
        out = 1.0 - out
    return np.round(out, DIST_DIGITS)


def _nearest(dist: np.ndarray, project: np.ndarray, ids: np.ndarray, k: int, each_project: bool) -> np.ndarray:
    """Rows that can be among a query's best: k per project, or k overall in
    the order of the rounded score, project, distance and id."""
    if each_project:
        order = np.lexsort((ids, dist, project))
        new = np.concatenate(([True], project[order][1:] != project[order][:-1]))
        start = np.flatnonzero(new)
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        return order[rank < k]
    if k < len(dist):
        # no row beyond the k-th distance has a better rounded score
        kth = np.partition(dist, k - 1)[k - 1]
        rows = np.flatnonzero(dist <= kth + 10.0 ** -SCORE_DIGITS)
    else:
        rows = np.arange(len(dist))
    score = np.round(1 - dist[rows], SCORE_DIGITS)
    return rows[np.lexsort((ids[rows], dist[rows], project[rows], -score))[:k]]


def candidates(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: str = "l2sq", each_project: bool = True,
               chunk_block: int = CHUNK_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The best rows of every block: (query_id, <chunk columns>, dist)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be >= 1")
    payload = [c for c in chunks.columns if c != "embedding"]
    out_schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType)] + [chunks.schema[c] for c in payload]
                              + [T.StructField("dist", T.DoubleType())])
    # read twice (count, score) and possibly the output of a model
    q = materialize(queries.where("embedding is not null").select("query_id", "embedding", F.monotonically_increasing_id().alias("_row")), "queries")
    c = chunks.where("embedding is not null")
    n_q, n_c = -(-q.count() // query_block), max(1, -(-c.count() // chunk_block))
    if n_q == 0:
        return chunks.sparkSession.createDataFrame([], out_schema)
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.withColumn("_cb", F.pmod(F.xxhash64(*[x for x in payload if x in ("project", "id")]), F.lit(n_c)).cast("int")).withColumn("_qb", blocks(n_q))
    q = q.withColumn("_qb", F.pmod(F.xxhash64("_row"), F.lit(n_q)).cast("int")).withColumn("_cb", blocks(n_c))

    def score(chunk: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        which, rows, dists = [], [], []
        if len(chunk) and len(query):
            x = np.array(chunk["embedding"].tolist(), np.float64)
            vectors = np.array(query["embedding"].tolist(), np.float64)
            # factorised in name order: comparing codes compares names
            project, ids = pd.factorize(chunk["project"], sort=True)[0], pd.factorize(chunk["id"], sort=True)[0]
            for lo in range(0, len(vectors), _STRIPE):
                for j, dist in enumerate(_distances(x, vectors[lo:lo + _STRIPE], metric), lo):
                    near = _nearest(dist, project, ids, k, each_project)
                    which.append(np.full(len(near), j))
                    rows.append(near)
                    dists.append(dist[near])
        take = lambda col, at: col.to_numpy(dtype=object)[np.concatenate(at)] if at else np.zeros(0, object)
        out = {"query_id": take(query["query_id"], which)} | {c: take(chunk[c], rows) for c in payload}
        return pd.DataFrame(out | {"dist": np.concatenate(dists) if dists else np.zeros(0)})

    return c.groupBy("_cb", "_qb").cogroup(q.groupBy("_cb", "_qb")).applyInPandas(score, out_schema)


def per_project(cands: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """W3: the k nearest chunks per (query, project), with score and rank."""
    w = Window.partitionBy("query_id", "project").orderBy(F.col("dist").asc_nulls_last(), F.col("id"))
    r = cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return r.withColumn("score", F.round(1 - F.col("dist"), SCORE_DIGITS))


def global_topk(scored: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """O4: across projects, highest rounded score first; ties keep project
    name order, then nearness."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col("project"), F.col("dist"), F.col("id"))
    return (scored.drop("rank").withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def registered(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks of registered projects: a push whose registry row was never
    written is not complete and not searched."""
    return chunks.join(registry.select(F.col("name").alias("project")), "project", "left_semi")


def search(chunks: DataFrame, queries: DataFrame, registry: DataFrame | None, k: int = DEFAULT_K, metric: str = "l2sq",
           projects: DataFrame | None = None) -> DataFrame:
    """Top-k per query over the registered projects (``registry`` has a
    column name; None where the caller's chunks are complete by themselves),
    or those of them that ``projects`` names in its first column."""
    if registry is not None:
        chunks = registered(chunks, registry)
    if projects is not None:
        chunks = chunks.join(projects.select(F.col(projects.columns[0]).alias("project")).distinct(), "project", "left_semi")
    best = candidates(chunks, queries, k, metric, each_project=False)
    return global_topk(best.withColumn("score", F.round(1 - F.col("dist"), SCORE_DIGITS)), k)
