import json
import random

import pytest

from pyspark.sql import functions as F

from treesnap.operators import registry as R
from treesnap.sources import snapshots as S
from treesnap.streaming import ingest as IG


def doc(name, files, use_cases="UC", user="", ai="AI", tree="root/", arch="graph TD", gen="2026-01-01T00:00:00+00:00"):
    return json.dumps({"metadata": {"name": name, "generated_at": gen, "file_count": len(files)},
                       "instructions": "", "use_cases": use_cases, "conventions": {"user": user, "ai": ai},
                       "file_tree": tree, "architecture": arch, "files": files}, ensure_ascii=False)


def raw(spark, docs):
    return spark.createDataFrame([(d,) for d in docs], "value string")


def test_parse_validation_and_line_arrays(spark):
    docs = [doc("A", {"a.py": "x"}), "not json", json.dumps({"metadata": {}}), json.dumps([1, 2]),
            json.dumps({"metadata": {"name": "B"}, "file_tree": ["r/", "└── a"], "files": {}})]
    p = S.parse(raw(spark, docs)).collect()
    assert [r["error"] for r in p] == [None, S.INVALID_JSON, S.MISSING_NAME, S.INVALID_JSON, None]
    assert p[4]["file_tree"] == "r/\n└── a"


def test_overview_fields_rules(spark):
    docs = [doc("A", {}, use_cases="  ", user=" mine ", ai="", tree="  t  ", arch="")]
    ov = R.overview_fields(S.accepted(S.parse(raw(spark, docs)))).first()
    assert ov["use_cases"] is None and ov["conventions"] == "[User-defined]\nmine"
    assert ov["diagram"] is None and ov["file_tree"] == "t"
    both = R.overview_fields(S.accepted(S.parse(raw(spark, [doc("A", {}, user="u", ai="a")])))).first()
    assert both["conventions"] == "[User-defined]\nu\n\n[AI-inferred]\na"


def test_ingest_batches_upsert_and_last_writer(spark):
    st = IG.State.empty(spark)
    b1 = [doc("My App", {"a.py": "first", "b.py": "  "}, gen="2026-01-01T00:00:01+00:00"),
          doc("Other", {"x.py": "x"}), "{bad"]
    r1 = IG.ingest_batch(st, raw(spark, b1), "2026-02-01 00:00:00")
    res = {r["project"]: r for r in r1.results.collect()}
    assert res["My App"]["action"] == "created" and res["My App"]["chunks"] == 1
    assert r1.rejected.count() == 1
    b2 = [doc("My App", {"c.py": "third"}, use_cases="new", gen="2026-01-02T00:00:00+00:00"),
          doc("My App", {"a.py": "second"}, use_cases="older", gen="2026-01-01T12:00:00+00:00")]
    r2 = IG.ingest_batch(r1.state, raw(spark, b2), "2026-02-02 00:00:00")
    chunks = {(r["project"], r["id"]): r["text"] for r in r2.state.chunks.collect()}
    assert chunks[("My App", "file:a.py")] == "second" and chunks[("My App", "file:c.py")] == "third"
    assert ("Other", "file:x.py") in chunks  # untouched project kept
    reg = {r["name"]: r for r in r2.state.projects.collect()}
    assert reg["My App"]["file_chunk_count"] == 1  # latest push had one file
    ov = {r["project"]: r for r in r2.state.overviews.collect()}
    assert ov["My App"]["use_cases"] == "new"
    act = {r["project"]: r["action"] for r in r2.results.collect()}
    assert act == {"My App": "updated"}


def test_lookups(spark):
    ov = spark.createDataFrame([("A", "uc", None, "d", "t")],
                               "project string, use_cases string, conventions string, diagram string, file_tree string")
    req = spark.createDataFrame([("A", "use_cases"), ("A", "conventions"), ("Z", "diagram")],
                                "project string, field string")
    got = {(r["project"], r["field"]): (r["value"], r["error"]) for r in R.overview_lookup(req, ov).collect()}
    assert got[("A", "use_cases")] == ("uc", None)
    assert got[("A", "conventions")] == (None, "No conventions found for project 'A'")
    assert got[("Z", "diagram")] == (None, "Unknown project 'Z'")
    chunks = spark.createDataFrame([("A", "file:x.py", "X in A"), ("B", "file:x.py", "X in B")],
                                   "project string, id string, text string")
    fr = R.file_lookup(spark.createDataFrame([("x.py",), ("y.py",)], "path string"), chunks).collect()
    assert sorted((r["path"], r["project"]) for r in fr if r["project"]) == [("x.py", "A"), ("x.py", "B")]
    assert [r["error"] for r in fr if r["path"] == "y.py"] == ["File not found in index: y.py"]
    one = R.file_lookup(spark.createDataFrame([("x.py", "B")], "path string, project string"), chunks).collect()
    assert [(r["project"], r["text"]) for r in one] == [("B", "X in B")]


def test_registry_upsert_actions(spark):
    old = spark.createDataFrame([("a", "2026-01-01 00:00:00", 3)], "name string, last_indexed_at string, "
                                "file_chunk_count int").withColumn("last_indexed_at", F.to_timestamp("last_indexed_at"))
    batch = spark.createDataFrame([("a", 5), ("b", 1)], "name string, file_chunk_count int")
    got = {r["name"]: (r["action"], r["file_chunk_count"]) for r in R.registry_upsert(old, batch, "2026-02-01").collect()}
    assert got == {"a": ("updated", 5), "b": ("created", 1)}
    lp = R.list_projects(R.registry_upsert(old, batch, "2026-02-01 00:00:00").drop("action")).collect()
    assert [r["project"] for r in lp] == ["a", "b"] and lp[0]["last_indexed_at"] == "2026-02-01T00:00:00+00:00"


def test_stream_ingest_two_drops(spark, tmp_path):
    landing, root, ckpt = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "ckpt")
    clock = lambda b: F.lit("2026-03-0%d 00:00:00" % (b + 1)).cast("timestamp")
    raw(spark, [doc("S", {"a.py": "one"})]).write.mode("append").text(landing)
    IG.start_stream(spark, landing, root, ckpt, clock=clock).awaitTermination()
    raw(spark, [doc("S", {"b.py": "two"}), doc("T", {"t.py": "t"})]).write.mode("append").text(landing)
    IG.start_stream(spark, landing, root, ckpt, clock=clock).awaitTermination()
    st = IG.load_state(spark, root)
    assert sorted(r["id"] for r in st.chunks.filter("project = 'S'").collect()) == ["file:a.py", "file:b.py"]
    reg = {r["name"]: r["last_indexed_at"].isoformat() for r in st.projects.collect()}
    assert reg == {"S": "2026-03-02T00:00:00", "T": "2026-03-02T00:00:00"}


def test_prune_replaces_project_chunks(spark):
    st = IG.State.empty(spark)
    r1 = IG.ingest_batch(st, raw(spark, [doc("P", {"a.py": "A", "b.py": "B"})]), "2026-02-01 00:00:00")
    r2 = IG.ingest_batch(r1.state, raw(spark, [doc("P", {"b.py": "B2"}, gen="2026-01-02T00:00:00+00:00")]),
                         "2026-02-02 00:00:00", prune=True)
    assert sorted((r["id"], r["text"]) for r in r2.state.chunks.collect()) == [("file:b.py", "B2")]
    keep = IG.ingest_batch(r1.state, raw(spark, [doc("P", {"b.py": "B2"}, gen="2026-01-02T00:00:00+00:00")]),
                           "2026-02-02 00:00:00")
    assert sorted(r["id"] for r in keep.state.chunks.collect()) == ["file:a.py", "file:b.py"]


def test_stream_whole_file_documents(spark, tmp_path):
    landing, root, ckpt = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "ckpt")
    landing.mkdir()
    pretty = json.dumps(json.loads(doc("Pretty", {"x.py": "X does things."})), indent=2, ensure_ascii=False)
    (landing / "push1.json").write_text(pretty, encoding="utf-8")
    IG.start_stream(spark, str(landing), root, ckpt, json_lines=False).awaitTermination()
    st = IG.load_state(spark, root)
    assert [(r["name"], r["file_chunk_count"]) for r in st.projects.collect()] == [("Pretty", 1)]


def everything(state):
    return [sorted(map(str, df.collect())) for df in (state.chunks.drop("embedding"), state.projects, state.overviews)]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "state")
    first, second = [doc("A", {"a.py": "one"}), doc("007", {"x": "y"})], [doc("A", {"b.py": "two"}), doc("1e3", {"z": "z"})]
    IG.ingest_to(spark, raw(spark, first), root, 0, "2026-02-01 00:00:00")
    r = IG.ingest_to(spark, raw(spark, second), root, 1, "2026-02-02 00:00:00")
    acts, state = sorted(map(str, r.results.collect())), everything(IG.load_state(spark, root))
    again = IG.ingest_to(spark, raw(spark, second), root, 1, "2026-02-02 00:00:00")
    assert sorted(map(str, again.results.collect())) == acts and everything(IG.load_state(spark, root)) == state
    assert everything(IG.load_state(spark, root)) == everything(r.state)
    IG.compact(spark, root)
    assert everything(IG.load_state(spark, root)) == state
    IG.ingest_to(spark, raw(spark, [doc("A", {"b.py": "three"})]), root, 2, "2026-02-03 00:00:00")
    assert {r["id"]: r["text"] for r in IG.load_state(spark, root).chunks.where("project = 'A'").collect()} == {
        "file:a.py": "one", "file:b.py": "three"}


def test_project_names_that_look_like_values(spark, tmp_path):
    root = str(tmp_path / "state")
    names = ["007", "1e3", "2024-01-01", "true", "a=b/c"]
    for b, text in enumerate(("old", "new")):
        IG.ingest_to(spark, raw(spark, [doc(n, {"f": text}) for n in names]), root, b, "2026-02-01 00:00:00")
    got = [(r["project"], r["text"]) for r in IG.load_state(spark, root).chunks.collect()]
    assert sorted(got) == sorted((n, "new") for n in names)


def test_prune_survives_storage(spark, tmp_path):
    root = str(tmp_path / "state")
    IG.ingest_to(spark, raw(spark, [doc("P", {"a": "1", "b": "2"}), doc("Q", {"q": "1"})]), root, 0, "2026-02-01 00:00:00")
    IG.ingest_to(spark, raw(spark, [doc("P", {"b": "3"})]), root, 1, "2026-02-02 00:00:00", prune=True)
    IG.ingest_to(spark, raw(spark, [doc("P", {"c": "4"})]), root, 2, "2026-02-03 00:00:00")
    for _ in range(2):
        got = {(r["project"], r["id"], r["text"]) for r in IG.load_state(spark, root).chunks.collect()}
        assert got == {("P", "file:b", "3"), ("P", "file:c", "4"), ("Q", "file:q", "1")}
        IG.compact(spark, root)


def test_push_order_is_time_order(spark):
    docs = [doc("T", {"a": "later"}, gen="2026-01-01T10:00:00Z"), doc("T", {"a": "earlier"}, gen="2026-01-01T11:00:00+02:00"),
            doc("T", {"a": "no time"}, gen="zzz")]
    r = IG.ingest_batch(IG.State.empty(spark), raw(spark, docs), "2026-02-01 00:00:00")
    assert [x["text"] for x in r.state.chunks.collect()] == ["later"]


def test_long_and_odd_documents(spark):
    big = "x" * (21 << 20)
    docs = [json.dumps({"metadata": {"name": "L"}, "files": {"a": big}}), '{"metadata": {"name": "D", "name": "E"}, "files": {}}',
            '{"metadata": {"name": "cut"}', '{"metadata": "no object"}', '{"metadata": {"name": ""}}']
    p = S.parse(raw(spark, docs)).select("project", "error", F.length(F.col("files")["a"]).alias("n")).collect()
    assert [r["error"] for r in p] == [None, None, S.INVALID_JSON, S.MISSING_NAME, S.MISSING_NAME]
    assert p[0]["n"] == len(big) and p[1]["project"] == "E"


def test_iso_keeps_microseconds(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00",), ("2026-01-01 00:00:00.000120",)], "t string")
    assert [r[0] for r in df.select(R.iso(F.to_timestamp("t"))).collect()] == [
        "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00.000120+00:00"]


def test_collections_with_empty_project(spark):
    reg = spark.createDataFrame([("My App",), ("none",)], "name string")
    chunks = spark.createDataFrame([("My App", "1"), ("gone", "2")], "project string, id string")
    assert sorted(map(tuple, R.collections(reg, chunks, "c_").collect())) == [("My App", "c_my_app", 1, False), ("none", "c_none", 0, True)]
    assert [r[0] for r in R.collection_names(reg, "c_", "c_m").collect()] == ["c_my_app"]


def test_rejects_and_results_are_kept(spark, tmp_path):
    root = str(tmp_path / "state")
    docs = [doc("A", {"a.py": "one"}), '{"metadata": {"name": "cut"}', doc("", {"x": "y"})]
    IG.ingest_to(spark, raw(spark, docs), root, 0, "2026-02-01 00:00:00")
    for _ in range(2):   # a replay writes each once
        IG.ingest_to(spark, raw(spark, [doc("A", {"b.py": "two"}), "[]"]), root, 1, "2026-02-02 00:00:00")
    got = sorted((r["batch"], r["message"], r["value"]) for r in IG.load_rejects(spark, root).collect())
    assert got == sorted([(0, S.INVALID_JSON, docs[1]), (0, S.MISSING_NAME, docs[2]), (1, S.INVALID_JSON, "[]")])
    found = sorted((r["batch"], r["project"], r["chunks"], r["action"], r["indexed_at"]) for r in IG.load_results(spark, root).collect())
    assert found == [(0, "A", 1, "created", "2026-02-01T00:00:00+00:00"), (1, "A", 1, "updated", "2026-02-02T00:00:00+00:00")]
    # a batch without its marker is not seen
    IG.open_log(spark, root)._write("rejects", IG.load_rejects(spark, root).select(*IG.REJECT_SCHEMA.fieldNames(), F.lit(2).cast("long").alias("v")), IG.Unit(2, 2))
    assert IG.load_rejects(spark, root).count() == 3


def test_stream_keeps_rejects(spark, tmp_path):
    landing, root, ckpt = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "ckpt")
    raw(spark, [doc("S", {"a.py": "one"}), "broken"]).coalesce(1).write.mode("append").text(landing)
    IG.start_stream(spark, landing, root, ckpt).awaitTermination()
    assert [(r["status"], r["message"], r["value"]) for r in IG.load_rejects(spark, root).collect()] == [("error", S.INVALID_JSON, "broken")]
    assert [(r["status"], r["project"]) for r in IG.load_results(spark, root).collect()] == [("ok", "S")]


def test_stale_pushes_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(3)
    pushes = [(i, doc(rng.choice("AB"), {f"{rng.choice('xyz')}.py": f"text {i}"}, gen=rng.choice(
        ["", "no time", *[f"2026-01-{d:02d}T00:00:00+00:00" for d in range(1, 9)]]))) for i in range(40)]
    newest, stale = {}, set()
    for i, text in pushes:
        m = json.loads(text)["metadata"]
        at = m["generated_at"] if m["generated_at"][:1] == "2" else "0"
        if at < newest.get(m["name"], ""):
            stale.add(i)
        newest[m["name"]] = max(at, newest.get(m["name"], ""))
    assert 5 < len(stale) < 35
    states = []
    for n, cuts in enumerate([[40], [20, 40], [1, 2, 17, 30, 40]]):
        root, lo = str(tmp_path / f"state{n}"), 0
        for b, hi in enumerate(cuts):
            part = spark.createDataFrame(pushes[lo:hi], "at int, value string").repartition(3)
            IG.ingest_to(spark, part, root, b, "2026-02-01 00:00:00", order_cols=("at",), stale="reject", arrival=["at"])
            lo = hi
        rejects = IG.load_rejects(spark, root).collect()
        assert {r["value"] for r in rejects} == {t for i, t in pushes if i in stale} and all(r["message"].startswith("Stale push: ") for r in rejects)
        state = IG.load_state(spark, root)
        states.append([sorted(map(str, df.collect())) for df in (state.chunks.drop("embedding"), state.overviews, state.versions)])
    assert states[0] == states[1] == states[2]
    with pytest.raises(ValueError):
        IG.ingest_to(spark, raw(spark, []), str(tmp_path / "no"), 0, "2026-02-01 00:00:00", stale="maybe")


def test_log_tiers():
    from treesnap.streaming.log import Unit, tiers
    assert tiers(6) == [] and tiers(7) == [Unit(0, 7)] and tiers(63) == [Unit(56, 63), Unit(0, 63)]


def test_many_batches_are_merged(spark, tmp_path):
    from pyspark.sql import types as T
    from treesnap.streaming.log import Log, Table
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("x", T.LongType())])
    tables = {"kept": Table(schema, ("k",), look_up=True), "all": Table(schema)}
    root = str(tmp_path / "log")
    log = Log(spark, root, tables)
    for b in range(17):
        rows = spark.createDataFrame([(f"k{b % 5}", b), (f"own{b}", b)], schema).coalesce(1)
        log.append(b, {"kept": rows, "all": rows})
    log = Log(spark, root, tables)   # as listed anew
    assert [u.folder for u in log.units()] == ["run=0-7", "run=8-15", "v=16"]
    assert [u.folder for u in log.units(before=8)] == ["run=0-7"] and [u.folder for u in log.units(before=7)] == [f"v={b}" for b in range(7)]
    for before in (None, 16, 9, 8, 3):
        last = 17 if before is None else before
        want = {f"own{b}": b for b in range(last)} | {f"k{b % 5}": b for b in range(last)}
        assert {r["k"]: r["x"] for r in log.read("kept", before).collect()} == want
        assert log.rows("all", before).count() == 2 * last
    log.append(3, {"kept": spark.createDataFrame([("k3", 3), ("own3", 3)], schema), "all": spark.createDataFrame([("k3", 3), ("own3", 3)], schema)})
    assert Log(spark, root, tables).read("kept").where("k = 'k3'").first()["x"] == 13
    # a look-up opens the files whose range of keys fits
    assert [r["x"] for r in log.look_up("kept", [("own16",)]).collect()] == [16]
    assert len(log.files("kept", [("own16",)])) == 3 and log.files("kept", [("zzz",)]) == log.files("kept", [("a",)]) == []
    assert log.look_up("kept", [("nothing",)]).count() == 0


def test_point_look_ups(spark, tmp_path):
    root = str(tmp_path / "state")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # several files of few rows
    for b in range(2):
        IG.ingest_to(spark, raw(spark, [doc(f"P{i}", {f"f{j}.py": f"{b} {i} {j}" for j in range(20)}) for i in range(8)]), root, b, "2026-02-01 00:00:00")
    got = IG.find_chunks(spark, root, [("P3", "file:f7.py"), ("P5", "file:none")]).collect()
    assert [(r["project"], r["text"]) for r in got] == [("P3", "1 3 7")]
    assert IG.find_chunks(spark, root, [("P6",)]).count() == 20
    log = IG.open_log(spark, root)
    every = spark.read.parquet(f"{root}/manifest/chunks/*").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert every > 4 and len(log.files("chunks", [("P3", "file:f7.py")])) <= every / 2
    IG.ingest_to(spark, raw(spark, [doc("P6", {"z.py": "alone"})]), root, 2, "2026-02-03 00:00:00", prune=True)
    assert [r["text"] for r in IG.find_chunks(spark, root, [("P6",)]).collect()] == ["alone"]


def test_nearest_names(spark):
    known = spark.createDataFrame([("web-app",), ("Web-Api",), ("billing",), ("web-application",), ("xyz",)], "name string")
    asked = spark.createDataFrame([("web-ap",), ("web-ap",), ("biling",), ("qqq",)], "name string")
    got = {r["name"]: r["nearest"] for r in R.nearest_names(asked, known).collect()}
    assert got["web-ap"][:2] == ["Web-Api", "web-app"] and len(got["web-ap"]) == 3 and got["biling"][0] == "billing" and "qqq" not in got
    ov = spark.createDataFrame([("billing", "uc", None, None, None)], "project string, use_cases string, conventions string, diagram string, file_tree string")
    req = spark.createDataFrame([("biling", "use_cases"), ("qqq", "use_cases"), ("billing", "use_cases")], "project string, field string")
    errors = {r["project"]: r["error"] for r in R.overview_lookup(req, ov, known).collect()}
    assert errors == {"biling": "Unknown project 'biling'. Nearest: billing", "qqq": "Unknown project 'qqq'", "billing": None}
