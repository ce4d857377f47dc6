import numpy as np
import pytest

from treesnap.operators import search as SR


def make(spark, n=300, d=8, projects=4, seed=1):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n, d)).astype(np.float32)
    rows = [(f"p{i % projects}", f"file:{i:04d}", vecs[i].tolist()) for i in range(n)]
    chunks = spark.createDataFrame(rows, "project string, id string, embedding array<float>").repartition(3)
    q = rng.normal(size=(5, d)).astype(np.float32)
    queries = spark.createDataFrame([(j, q[j].tolist()) for j in range(5)], "query_id int, embedding array<float>")
    return rows, chunks, q, queries


def brute(rows, q, k, metric):
    out = {}
    for j in range(len(q)):
        items = []
        for p, i, v in rows:
            v = np.asarray(v, dtype=np.float64)
            qq = q[j].astype(np.float64)
            if metric == "l2sq":
                dist = round(float(((v - qq) ** 2).sum()), 9)
            else:
                dist = round(float(1 - v @ qq / (np.linalg.norm(v) * np.linalg.norm(qq))), 9)
            items.append((p, i, dist))
        per = []
        for p in sorted({x[0] for x in items}):
            per += sorted([x for x in items if x[0] == p], key=lambda x: (x[2], x[1]))[:k]
        per.sort(key=lambda x: (-round(1 - x[2], 4), x[0], x[2], x[1]))
        out[j] = [x[1] for x in per[:k]]
    return out


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_search_matches_brute_force(spark, metric):
    rows, chunks, q, queries = make(spark)
    got = SR.search(chunks, queries, None, k=5, metric=metric).collect()
    by_q = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_q.setdefault(r["query_id"], []).append(r["id"])
    assert by_q == brute(rows, q, 5, metric)


def test_small_blocks_and_k_larger_than_project(spark):
    rows, chunks, q, queries = make(spark, n=9, projects=3)
    got = SR.per_project(SR.candidates(chunks, queries, k=10, chunk_block=2, query_block=2), k=10).collect()
    assert len(got) == 9 * 5  # every chunk of every project, for each query
    filt = SR.search(chunks, queries, None, k=2, projects=spark.createDataFrame([("p1",)], "name string")).collect()
    assert {r["project"] for r in filt} == {"p1"} and len(filt) == 10


def test_bad_arguments(spark):
    _, chunks, _, queries = make(spark, n=5)
    with pytest.raises(ValueError):
        SR.candidates(chunks, queries, metric="l1")


def test_zero_vectors_come_after_matches(spark):
    chunks = spark.createDataFrame([("p", "file:zero", [0.0, 0.0]), ("p", "file:hit", [1.0, 0.0]), ("p", "file:far", [-1.0, 0.0]),
                                    ("p", "file:none", None), ("q", "file:x", [1.0, 0.0])],
                                   "project string, id string, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<float>")
    registry = spark.createDataFrame([("p",)], "name string")
    got = SR.search(chunks, queries, registry, k=4, metric="cosine").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("file:hit", 1.0), ("file:zero", 0.0), ("file:far", -1.0)]
    per = SR.per_project(SR.candidates(chunks, queries, 1, "cosine"), 1).collect()
    assert {r["id"] for r in per} == {"file:hit", "file:x"}


def test_candidates_do_not_grow_with_projects(spark):
    rows, chunks, q, queries = make(spark, n=400, projects=400)
    assert SR.candidates(chunks, queries, k=5, each_project=False, chunk_block=100).count() <= 5 * 5 * 4
    got = SR.search(chunks, queries, None, k=5).collect()
    by_q = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_q.setdefault(r["query_id"], []).append(r["id"])
    assert by_q == brute(rows, q, 5, "l2sq")
