"""Derived tables after changes against a rebuild from all files."""

import random

from pyspark.sql import functions as F

from treesnap.operators import changes as C
from treesnap.operators import deps as D
from treesnap.operators import incremental as INC
from treesnap.operators import tree as TR

SCHEMA = "project string, path string, content binary"


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))


def check(derived, files):
    same(derived.edges(), D.dependency_edges(files))
    same(derived.dir_nodes(), TR.dir_nodes(files))
    same(derived.tree, TR.tree_edges(files))
    levels = files.select("project", F.explode(TR._levels(F.size(F.split("path", "/")))).alias("l"), "path")
    counts = levels.groupBy("project", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("l")), "/").alias("dir_path")).agg(F.count(F.lit(1)).alias("n_files"))
    same(derived.dirs, counts)


def random_tree(rng, old):
    """A tree with some files of the old one removed, changed and added."""
    files = {k: v for k, v in old.items() if rng.random() > 0.2}
    names = ["a", "b", "a-b", "a_b", "c.d", "index"]
    for _ in range(14):
        project = rng.choice(["p", "p", "p", "q"])
        path = "/".join(rng.choice(names[:4]) for _ in range(rng.randint(0, 3))) + "/" + rng.choice(names) + rng.choice([".ts", ".py", ".js", ".md", ""])
        path = path.lstrip("/")
        imports = "".join(rng.choice([f"import x from './{rng.choice(names)}'\n", f"import y from '../{rng.choice(names)}/{rng.choice(names)}'\n",
                                      f"from .{rng.choice(names[:2])} import z\n", f"import {rng.choice(names[:2])}.{rng.choice(names[:2])}\n", "text\n"]) for _ in range(rng.randint(0, 4)))
        files[project, path] = imports
    return files


def test_updates_equal_rebuilds(spark):
    rng = random.Random(12)
    derived, tree = INC.Derived.empty(spark), {}
    for _ in range(4):
        tree = random_tree(rng, tree)
        files = spark.createDataFrame([(p, n, c.encode()) for (p, n), c in tree.items()], SCHEMA)
        derived = INC.update(derived, C.file_meta(files), INC.content_from(files))
        check(derived, files)


def test_content_is_read_for_unseen_contents_alone(spark, tmp_path):
    asked = []

    def content(files):
        def get(keys):
            asked.append(sorted((r["project"], r["path"]) for r in keys.collect()))
            return INC.content_from(files)(keys)
        return get

    rows = [("p", f"src/m{i}.py", f"import src.m{(i + 1) % 6}\n".encode()) for i in range(6)] + [("p", "README.md", b"text")]
    files = spark.createDataFrame(rows, SCHEMA)
    first = INC.update(INC.Derived.empty(spark), C.file_meta(files), content(files))
    first.write(str(tmp_path / "derived"))
    kept = INC.Derived.read(spark, str(tmp_path / "derived"))
    # one changed, one moved with its content, one gone
    rows = [("p", "src/m0.py", b"import src.m9\nimport src.m3\n"), ("p", "lib/m1.py", rows[1][2]), *rows[2:5], rows[6]]
    files = spark.createDataFrame(rows, SCHEMA)
    second = INC.update(kept, C.file_meta(files), content(files))
    check(second, files)
    assert len(asked[0]) == 6 and asked[1] == [("p", "src/m0.py")]
    third = INC.update(second, C.file_meta(files), content(files))
    check(third, files)
    assert asked[2] == []
    empty = INC.update(third, C.file_meta(files.where("false")), content(files))
    check(empty, files.where("false"))
    assert empty.imports.count() == third.imports.count()   # contents may come back


def test_builds_with_derived_tables(spark, tmp_path, project_files):
    from treesnap.plans import build as B
    out = str(tmp_path / "out")
    cache = spark.createDataFrame([], "project string, path string, sha256 string, description string")
    synthesis = spark.createDataFrame([], "project string, use_cases string, conventions_ai string")
    lines = lambda r: [tuple(x) for x in r.document_lines.select("project", "line").orderBy("project", "sec", "ord").collect()]
    files = project_files
    for more in (None, ("proj", "src/new/x.py", b"import src.cli\n")):
        if more:
            files = project_files.where("path <> 'README.md'").unionByName(spark.createDataFrame([more], SCHEMA))
        plain = B.build(files, cache, synthesis, B.BuildSettings(generated_at="2026-01-01T00:00:00+00:00"))
        kept = B.build(files, cache, synthesis, B.BuildSettings(generated_at="2026-01-01T00:00:00+00:00", derived=B.read_derived(spark, out)))
        assert lines(kept) == lines(plain)
        B.write_build(kept, out)
    assert B.read_derived(spark, out).files.count() == 4
