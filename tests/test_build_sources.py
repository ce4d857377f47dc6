import json
import os

from pyspark.sql import functions as F

from treesnap.operators import usage as U
from treesnap.plans import build as B
from treesnap.session import scratch_path
from treesnap.sources.files import read_tree


def make_tree(root):
    files = {"src/cli.py": "import os\nprint('hello')\n", "src/utils.py": "def helper(): pass\n",
             "tests/test_main.py": "from src import main\n", "README.md": "# Project\n",
             "pkg/__init__.py": "", ".env": "A=1\n", "_private/x.txt": "x\n", "web/app.ts": "import u from './u'\n",
             "web/u.ts": "export const u = 1; // Uses <b> & 'quotes'.\n"}
    for p, c in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, p)) or root, exist_ok=True)
        with open(os.path.join(root, p), "w") as fh:
            fh.write(c)
    return files


def test_tree_source_reads_hidden_and_patterns(spark, tmp_path):
    root = str(tmp_path / "MyApp")
    files = make_tree(root)
    df = read_tree(spark, root, tasks=3)
    got = {r["path"]: bytes(r["content"]).decode() for r in df.collect()}
    assert got == files and {r["project"] for r in df.collect()} == {"MyApp"}
    sel = read_tree(spark, root, include=["src/**"], exclude=["*utils*"]).collect()
    assert [r["path"] for r in sel] == ["src/cli.py"]


def test_tree_source_bad_root(spark, tmp_path):
    import pytest
    with pytest.raises(Exception):
        read_tree(spark, str(tmp_path / "missing")).collect()


def test_build_documents_are_valid_json(spark, tmp_path):
    root = str(tmp_path / "MyApp")
    make_tree(root)
    files = read_tree(spark, root)
    empty_cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    empty_syn = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    res = B.build(files, empty_cache, empty_syn, B.BuildSettings(generated_at="2026-01-01T00:00:00+00:00",
                                                                  exclude=["tests/**"]))
    out = scratch_path(spark, "build-test")
    B.write_build(res, out)
    local = out[len("file:"):] if out.startswith("file:") else out
    pdir = os.path.join(local, "documents", "project=MyApp")
    text = "".join(open(os.path.join(pdir, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(pdir)) if f.startswith("part-"))
    doc = json.loads(text)
    assert doc["metadata"] == {"name": "MyApp", "generated_at": "2026-01-01T00:00:00+00:00", "file_count": 8}
    assert list(doc["files"]) == sorted(doc["files"]) and "tests/test_main.py" not in doc["files"]
    assert doc["file_tree"][0] == "MyApp/" and doc["architecture"][0] == "graph TD"
    assert "    web_app_ts -.-> web_u_ts" in doc["architecture"]
    assert doc["use_cases"].startswith("graph LR")
    # a second run with the written cache has no misses
    cache, syn = B.read_state(spark, out)
    res2 = B.build(files, cache, syn, B.BuildSettings(exclude=["tests/**"]))
    assert res2.work.filter("status != 'hit'").count() == 0
    assert res2.gate.filter("regenerate").count() == 0


def test_token_usage(spark):
    calls = spark.createDataFrame([(100, 50, True), (200, 75, True)], "input_tokens bigint, output_tokens bigint, "
                                  "is_call boolean")
    r = U.usage(calls).first()
    assert (r["input_tokens"], r["output_tokens"], r["total_tokens"], r["calls"]) == (300, 125, 425, 2)
    assert F is not None


def test_string_layout_matches_python_json(spark, tmp_path):
    root = str(tmp_path / "MyApp")
    make_tree(root)
    files = read_tree(spark, root)
    empty_cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    empty_syn = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    res = B.build(files, empty_cache, empty_syn, B.BuildSettings(generated_at="2026-01-01T00:00:00+00:00",
                                                                  text_fields="string"))
    out = scratch_path(spark, "build-string")
    B.write_build(res, out)
    local = out[len("file:"):] if out.startswith("file:") else out
    pdir = os.path.join(local, "documents", "project=MyApp")
    text = "".join(open(os.path.join(pdir, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(pdir)) if f.startswith("part-"))
    doc = json.loads(text)
    assert isinstance(doc["file_tree"], str) and doc["file_tree"].startswith("MyApp/\n")
    assert isinstance(doc["architecture"], str) and "\n\n    %% dependency edges\n" in doc["architecture"]
    # byte-for-byte the layout Python's json.dumps(indent=2, ensure_ascii=False) gives
    assert text == json.dumps(doc, ensure_ascii=False, indent=2) + "\n"


def test_unreadable_files_are_not_passed_over(spark, tmp_path):
    import pytest
    root = tmp_path / "App"
    root.mkdir()
    (root / "ok.txt").write_text("x")
    os.symlink("/proc/1/mem", root / "bad.txt")
    with pytest.raises(Exception):
        read_tree(spark, str(root)).collect()
    assert read_tree(spark, str(root), unreadable="null", tasks=2).where("content is null").count() == 1
    got = {r["path"]: r["content"] for r in read_tree(spark, str(root), unreadable="null").collect()}
    assert got["bad.txt"] is None and bytes(got["ok.txt"]) == b"x"


def test_build_write_read_ingest(spark, tmp_path, project_files):
    from treesnap.sources import snapshots as S
    from treesnap.streaming import ingest as IG
    from treesnap.operators import assemble as A
    empty_cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    empty_syn = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    res = B.build(project_files, empty_cache, empty_syn)
    out = str(tmp_path / "docs")
    A.write_documents(res.document_lines, out, partitions=8)
    assert len([f for f in os.listdir(os.path.join(out, "project=proj")) if f.startswith("part-")]) > 1
    r = IG.ingest_batch(IG.State.empty(spark), S.read_built(spark, out), "2026-02-01 00:00:00")
    assert r.rejected.count() == 0 and r.results.first()["chunks"] == 4
    assert {x["path"] for x in r.state.chunks.collect()} == {x["path"] for x in project_files.collect()}


def test_built_rows_equal_whole_documents(spark, tmp_path):
    """Names and paths that look like sections, both text forms, many parts."""
    from treesnap.operators import assemble as A
    from treesnap.plans.build import BuildSettings, build
    from treesnap.operators import registry as R
    from treesnap.sources import snapshots as S
    from treesnap.streaming import ingest as IG
    paths = ["name", "user", "ai", "files", "a/b.py", "file_tree/x \"q\".md", "metadata", "architecture/[", "z,", "ü/ö.txt", "a%2Bb +.txt"]
    rows = [(p, f, f"One. {p} {f}!\nTwo: \\ \"x\",".encode()) for p in ("P", "a=b/c%", "007", "x+y z") for f in paths + [f"d{i % 7}/f{i}.py" for i in range(40)]]
    files = spark.createDataFrame(rows, "project string, path string, content binary")
    cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    synthesis = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    for form in ("lines", "string"):
        res = build(files, cache, synthesis, BuildSettings(user_conventions="Mine: \"a\",", generated_at="2026-01-01T00:00:00+00:00", text_fields=form))
        out = str(tmp_path / form)
        A.write_documents(res.document_lines, out, partitions=9)
        whole = IG.ingest_batch(IG.State.empty(spark), S.read_built(spark, out), "2026-02-01 00:00:00")
        rowed = IG.ingest_built(IG.State.empty(spark), S.read_built_rows(spark, out), "2026-02-01 00:00:00")
        same = lambda df: sorted(map(str, df.collect()))
        assert same(rowed.state.chunks) == same(whole.state.chunks)
        assert same(rowed.state.projects) == same(whole.state.projects) and same(rowed.results) == same(whole.results)
        req = files.select("project").distinct().crossJoin(spark.createDataFrame([(f,) for f in R.OVERVIEW_FIELDS], "field string"))
        assert same(R.overview_lookup(req, rowed.state.overviews, texts=rowed.state.texts)) == same(R.overview_lookup(req, whole.state.overviews))
        root = str(tmp_path / f"state-{form}")
        for b in range(2):
            IG.ingest_built_to(spark, out, root, b, "2026-02-01 00:00:00")
        state = IG.load_state(spark, root)
        assert same(R.overview_lookup(req, state.overviews, texts=state.texts)) == same(R.overview_lookup(req, whole.state.overviews))
        assert "collect_list" not in rowed.changed.chunks._jdf.queryExecution().toString()


def test_filters_reach_the_tree_source(spark, tmp_path):
    """Filtered scans walk and open matching files only: the others cannot be read."""
    import os
    from treesnap.operators import changes as C
    from treesnap.sources import files as SF
    for project in ("a", "b", "c"):
        for path in ("src/x.py", "src/deep/y.py", "doc/z.md", "top.txt", ".hid/_h"):
            full = tmp_path / project / path
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_bytes(f"{project} {path}\n".encode() * 3)
    read = lambda: SF.read_tree(spark, str(tmp_path), multi=True)
    keys = lambda df: sorted((r["project"], r["path"]) for r in df.collect())
    every = keys(read())
    assert len(every) == 15
    meta = SF.tree_meta(spark, str(tmp_path), multi=True)
    assert sorted(map(str, meta.collect())) == sorted(map(str, C.file_meta(read()).collect()))
    for name in os.listdir(tmp_path / "c" / "src"):
        if name != "deep":
            os.remove(tmp_path / "c/src" / name)
    os.symlink("/nothing", tmp_path / "c/src/x.py")
    os.remove(tmp_path / "b/src/x.py")
    os.mkfifo(tmp_path / "b/src/x.fifo")
    opened = []
    reader = SF.TreeDataSource({"root": str(tmp_path), "layout": "projects"}).reader(SF.SCHEMA)
    from pyspark.sql.datasource import EqualTo, In, StringContains, StringStartsWith
    left = list(reader.pushFilters([EqualTo(("project",), "a"), StringStartsWith(("path",), "src/"), In(("path",), ("src/x.py", "doc/z.md")), StringContains(("path",), "x")]))
    assert [type(f).__name__ for f in left] == ["StringContains"]
    assert [(p.project, p.entry) for p in reader.partitions()] == [("a", ""), ("a", "src")]
    for p in reader.partitions():
        opened += [r[:2] for r in reader.read(p)]
    assert opened == [("a", "src/x.py")]
    for where in ("project = 'a'", "project in ('a', 'zz') and path like 'src/%'", "path = 'top.txt'", "path like 'doc/%' and project <> 'b'", "path in ('src/deep/y.py', 'none')", "project = 'none'"):
        want = keys(spark.createDataFrame(every, "project string, path string").where(where))
        assert keys(read().where(where)) == want, where
    plan = read().where("project = 'a' and path like 'src/%' and length(path) > 3").select("path")._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter" in x and "length" in x]
    assert "BatchScan" in plan and not any("StartsWith" in x for x in filters)
    assert keys(SF.fetch_files(spark.createDataFrame([("a", "src/x.py")], "project string, path string"), str(tmp_path), multi=True)) == [("a", "src/x.py")]
