import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from treesnap.operators import changes as C
from treesnap.operators import describe as DS
from treesnap.operators import search as SR
from treesnap.plans import build as B


def test_describe_with_user_function_only_misses(spark, project_files):
    calls = []

    def complete(prompts, max_tokens):
        calls.append((len(prompts), max_tokens))
        return ["  Describes %s.  " % p.split("Path: ")[1].split("\n")[0] for p in prompts]

    work = C.classify(C.file_meta(project_files),
                      spark.createDataFrame([], "project string, path string, sha256 string, description string"))
    got = DS.describe_with(C.pending_work(project_files, work), complete, concurrency=2).collect()
    assert {r["path"]: r["description"] for r in got}["src/cli.py"] == "Describes src/cli.py."
    assert len(got) == 4


def test_embed_with_and_search(spark):
    chunks = spark.createDataFrame([("p", "file:a", "alpha beta"), ("p", "file:b", "gamma delta")],
                                   "project string, id string, text string")

    def embed(texts):
        return [[1.0, 0.0] if "alpha" in t else [0.0, 1.0] for t in texts]

    ch = DS.embed_with(chunks, embed, concurrency=2).select("project", "id", "embedding")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<float>")
    top = SR.search(ch, q, None, k=1).collect()
    assert top[0]["id"] == "file:a" and top[0]["score"] == 1.0


def test_hashed_embedding_is_unit_norm(spark):
    df = spark.createDataFrame([("Hello hello world",), ("",)], "text string")
    rows = DS.with_hashed_embedding(df).collect()
    v = rows[0]["embedding"]
    assert abs(sum(x * x for x in v) - 1.0) < 1e-5 and len(v) == DS.EMBED_DIM
    assert sum(rows[1]["embedding"]) == 0


def test_hashed_embedding_counts_words_in_one_pass(spark):
    texts = ["Hello hello, world", "", None, " .!? ", "Ünï-漢字 x9 x9 " * 300, *[f"word{i} w" for i in range(600)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    embedded = DS.with_hashed_embedding(df)
    for r in embedded.collect():
        counts = [0] * DS.EMBED_DIM
        for w in re.findall(r"[^\W_]+", (r["text"] or "").lower()):
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % DS.EMBED_DIM] += 1
        size = math.sqrt(sum(c * c for c in counts))
        assert r["embedding"] == [float(np.float32(c / size)) if size else 0.0 for c in counts]
    plan = embedded._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan   # no pass over a text's words for each dimension


def test_build_with_user_synthesis_and_force(spark, project_files):
    empty_cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    syn = spark.createDataFrame([("proj", "old UC", "old C")], "project string, use_cases string, "
                                "conventions_ai string")

    def synth(gate, work):
        return gate.filter("regenerate").select("project", F.lit("UC1").alias("use_cases"),
                                                F.lit("C1").alias("conventions_ai"))

    res = B.build(project_files, empty_cache, syn, B.BuildSettings(synthesize=synth, checkpoint=False,
                                                                   generated_at="2026-01-01T00:00:00+00:00"))
    assert [(r["use_cases"], r["conventions_ai"]) for r in res.synthesis.collect()] == [("UC1", "C1")]
    full = spark.createDataFrame([(r["project"], r["path"], r["sha256"], r["description"])
                                  for r in res.work.collect()],
                                 "project string, path string, sha256 string, description string")
    kept = B.build(project_files, full, syn, B.BuildSettings(synthesize=synth, checkpoint=False))
    assert [r["use_cases"] for r in kept.synthesis.collect()] == ["old UC"]
    forced = B.build(project_files, full, syn, B.BuildSettings(synthesize=synth, force=True, checkpoint=False))
    assert [r["use_cases"] for r in forced.synthesis.collect()] == ["UC1"]


def test_build_calls_model_once_per_miss(spark, project_files):
    from treesnap.session import scratch_path
    calls = spark.sparkContext.accumulator(0)

    def complete(prompts, max_tokens):
        calls.add(len(prompts))
        return ["d"] * len(prompts)

    settings = B.BuildSettings(describe=lambda pending: DS.describe_with(pending, complete, concurrency=2),
                               generated_at="2026-01-01T00:00:00+00:00")
    empty_cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    empty_syn = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    res = B.build(project_files, empty_cache, empty_syn, settings)
    B.write_build(res, scratch_path(spark, "once"))
    res.document_lines.count()
    assert calls.value == 4


def test_build_with_one_model_for_files_and_projects(spark, project_files):
    from treesnap.operators import synthesis as SY
    calls = spark.sparkContext.accumulator(0)

    def complete(prompts, max_tokens):
        calls.add(len(prompts))
        return ["graph LR" if "Mermaid" in p else ("- bullet" if "bullets" in p else "desc") for p in prompts]

    empty_cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    empty_syn = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    res = B.build(project_files, empty_cache, empty_syn,
                  B.BuildSettings(complete=complete, concurrency=2, instructions="Be brief.",
                                  generated_at="2026-01-01T00:00:00+00:00"))
    syn = res.synthesis.collect()
    assert [(r["use_cases"], r["conventions_ai"]) for r in syn] == [("graph LR", "- bullet")]
    res.document_lines.count()
    assert calls.value == 4 + 2
    gate = spark.createDataFrame([("proj", True)], "project string, regenerate boolean")
    tl = spark.createDataFrame([("proj", "", "proj/"), ("proj", "a.py", "└── a.py")],
                               "project string, node_path string, line string")
    d = spark.createDataFrame([("proj", "a.py", "A.")], "project string, path string, description string")
    p = SY.prompts(gate, tl, d, user_conventions="Tabs.").first()
    assert f"{SY.TREE_HEAD}\nproj/\n└── a.py\n{SY.FILES_HEAD}\na.py: A." in p["use_cases_prompt"]
    assert "Tabs." in p["conventions_prompt"] and "Tabs." not in p["use_cases_prompt"]


def test_large_project_is_answered_in_parts(spark):
    from treesnap.operators import synthesis as SY
    gate = spark.createDataFrame([("big", True), ("small", True), ("kept", False)], "project string, regenerate boolean")
    tl = spark.createDataFrame([(p, "", p + "/") for p in ("big", "small", "kept")], "project string, node_path string, line string")
    files = [("big", f"f{i:04d}", "x" * 50) for i in range(400)] + [("big", "long", "y" * 5000), ("small", "a", "A."), ("kept", "b", "B.")]
    d = spark.createDataFrame(files, "project string, path string, description string")
    p = SY.prompts(gate, tl, d, part_chars=1000).collect()
    parts = [r for r in p if r["project"] == "big"]
    assert len(parts) > 20 and {r["parts"] for r in parts} == {len(parts)} and sorted(r["part"] for r in parts) == list(range(1, len(parts) + 1))
    text = "\n".join(r["use_cases_prompt"] for r in sorted(parts, key=lambda r: r["part"]))
    assert all(text.count(f"{path}: {desc}\n") == 1 for pr, path, desc in files if pr == "big")  # no line left out
    assert {r["project"] for r in p} == {"big", "small"}

    def complete(prompts, max_tokens):
        return [f"<{p.count('<') + 1 if 'Combine' in p else 1}>" for p in prompts]

    out = {r["project"]: r for r in SY.synthesize_with(SY.prompts(gate, tl, d, part_chars=1000), complete, 2, merge_parts=4).collect()}
    assert out["big"]["use_cases"] and out["big"]["error"] is None and out["small"]["use_cases"] == "<1>"

    def fails(prompts, max_tokens):
        if any("f0007:" in p for p in prompts):
            raise RuntimeError("refused")
        return ["ok"] * len(prompts)

    out = {r["project"]: r for r in SY.synthesize_with(SY.prompts(gate, tl, d, part_chars=1000), fails, 2).collect()}
    assert "refused" in out["big"]["error"] and out["big"]["use_cases"] is None and out["small"]["use_cases"] == "ok"


def test_failed_item_is_asked_again_alone(spark, project_files):
    from treesnap.session import scratch_path
    asked = spark.sparkContext.accumulator(0)

    def flaky(prompts, max_tokens):
        if any("Path: src/cli.py" in p for p in prompts):
            raise RuntimeError("no answer")
        return ["d"] * len(prompts)

    def sound(prompts, max_tokens):
        asked.add(len(prompts))
        return ["e"] * len(prompts)

    settings = lambda f: B.BuildSettings(describe=lambda pending: DS.describe_with(pending, f, concurrency=1))
    empty_cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    empty_syn = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    out = scratch_path(spark, "flaky")
    first = B.build(project_files, empty_cache, empty_syn, settings(flaky))
    B.write_build(first, out)
    assert [(r["path"], "no answer" in r["error"]) for r in first.errors.collect()] == [("src/cli.py", True)]
    cache, syn = B.read_state(spark, out)
    assert cache.count() == 3
    second = B.build(project_files, cache, syn, settings(sound))
    B.write_build(second, out)
    assert asked.value == 1 and second.errors.count() == 0 and B.read_state(spark, out)[0].count() == 4


def test_clean_run_writes_no_state(spark, project_files):
    from treesnap.session import scratch_path
    empty_cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    empty_syn = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    out, again = scratch_path(spark, "dirty"), scratch_path(spark, "clean")
    B.write_build(B.build(project_files, empty_cache, empty_syn), out)
    res = B.build(project_files, *B.read_state(spark, out))
    B.write_build(res, again)
    import os
    assert sorted(os.listdir(again.removeprefix("file:"))) == ["documents"]
