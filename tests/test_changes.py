import hashlib

import pytest
from pyspark.sql import functions as F

from treesnap.operators import changes as C
from treesnap.operators import describe as DS
from treesnap.operators import registry as R


def cache_of(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, sha256 string, description string")


def test_classify_hit_changed_new(spark, project_files):
    sha = hashlib.sha256(b"def helper(): pass\n").hexdigest()
    cache = cache_of(spark, [("proj", "src/utils.py", sha, "Loaded from disk."),
                             ("proj", "src/cli.py", "old_hash", "stale"),
                             ("proj", "gone.py", "x", "deleted file")])
    work = C.classify(C.file_meta(project_files), cache)
    st = {r["path"]: (r["status"], r["description"]) for r in work.collect()}
    assert st["src/utils.py"] == ("hit", "Loaded from disk.")
    assert st["src/cli.py"] == ("changed", None)
    assert st["README.md"][0] == "new" and "gone.py" not in st
    counts = C.miss_counts(work).first()
    assert (counts["total_files"], counts["miss_files"]) == (4, 3)


def test_pending_work_only_misses_and_prompt(spark, project_files):
    work = C.classify(C.file_meta(project_files), cache_of(spark, []))
    pend = C.pending_work(project_files, work).collect()
    assert len(pend) == 4
    p = [r for r in pend if r["path"] == "src/cli.py"][0]
    assert "Path: src/cli.py" in p["prompt"] and "import os\nprint('hello')\n" in p["prompt"]
    assert "in 2 sentences" in p["prompt"] and p["fresh"]


def test_content_that_changed_after_hashing_is_left_out(spark, project_files):
    work = C.classify(C.file_meta(project_files), cache_of(spark, []))
    later = project_files.withColumn("content", F.when(F.col("path") == "src/cli.py", F.lit(b"edited\n")).otherwise(F.col("content")))
    got = {r["path"]: r for r in DS.stand_in_descriptions(C.pending_work(later, work)).collect()}
    assert got["src/cli.py"]["description"] is None and "changed" in got["src/cli.py"]["error"]
    assert got["src/utils.py"]["description"] and got["src/utils.py"]["error"] is None


def test_run_twice_second_run_has_no_misses(spark, project_files):
    empty = cache_of(spark, [])
    work = C.classify(C.file_meta(project_files), empty)
    gen = DS.stand_in_descriptions(C.pending_work(project_files, work)).drop("error")
    cache2 = R.upsert(empty, gen, ["project", "path"])
    work2 = C.classify(C.file_meta(project_files), cache2)
    assert work2.filter("status != 'hit'").count() == 0
    merged = C.merge_descriptions(work2, gen.limit(0))
    assert merged.filter(F.col("description").isNull()).count() == 0


@pytest.mark.parametrize("miss,total,threshold,cached,expected", [
    (0, 10, 0.2, False, True), (1, 10, 0.2, True, False), (2, 10, 0.2, True, True),
    (5, 10, 0.2, True, True), (0, 0, 0.2, True, False), (10, 10, 0.2, True, True)])
def test_regenerate_rule(spark, miss, total, threshold, cached, expected):
    df = spark.createDataFrame([(miss, total, cached)], "m bigint, t bigint, c boolean")
    got = df.select(C.regenerate_rule(F.col("m"), F.col("t"), F.lit(threshold), F.col("c"))).first()[0]
    assert got is expected


def test_gate_includes_projects_without_files(spark):
    counts = spark.createDataFrame([("a", 10, 1, 1, 0)],
                                   "project string, total_files bigint, miss_files bigint, new_files bigint, "
                                   "changed_files bigint")
    syn = spark.createDataFrame([("a", "UC", "C"), ("b", "UC", "C")], "project string, use_cases string, "
                                "conventions_ai string")
    g = {r["project"]: r for r in C.change_gate(counts, syn).collect()}
    assert g["a"]["regenerate"] is False and g["b"]["regenerate"] is False and g["b"]["total_files"] == 0
    assert all(r["regenerate"] for r in C.change_gate(counts, syn, force=True).collect())
    with pytest.raises(ValueError):
        C.change_gate(counts, syn, threshold=1.5)


def test_cache_keeps_or_prunes_deleted_files(spark, project_files):
    from treesnap.plans import build as B
    cache = cache_of(spark, [("proj", "gone.py", "x", "deleted file")])
    syn = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    kept = B.build(project_files, cache, syn, B.BuildSettings(checkpoint=False)).cache
    assert kept.filter("path = 'gone.py'").count() == 1 and kept.count() == 5
    pruned = B.build(project_files, cache, syn, B.BuildSettings(checkpoint=False, prune_cache=True)).cache
    assert pruned.filter("path = 'gone.py'").count() == 0 and pruned.count() == 4
