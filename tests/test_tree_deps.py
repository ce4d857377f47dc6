from pyspark.sql import functions as F

import pytest

from treesnap.functions.imports import py_imports
from treesnap.operators import deps as D
from treesnap.operators import tree as TR


def paths_df(spark, paths, project="p"):
    return spark.createDataFrame([(project, x) for x in paths], "project string, path string")


def render_reference_style(root, files):
    """Brute-force renderer: nested dicts walked recursively."""
    tree = {}
    for f in files:
        node = tree
        for part in f.split("/"):
            node = node.setdefault(part, {})
    lines = [root + "/"]

    def walk(node, prefix):
        names = sorted(node)
        for i, n in enumerate(names):
            last = i == len(names) - 1
            lines.append(prefix + ("└── " if last else "├── ") + n)
            if node[n]:
                walk(node[n], prefix + ("    " if last else "│   "))
    walk(tree, "")
    return lines


def test_tree_lines_match_recursive_render(spark):
    files = ["src/a.py", "src/b/c.py", "src/b/d/e.txt", "a-b/x", "a/x", "a/y/z", "top.md", "src/b-c.py"]
    rows = TR.tree_lines(paths_df(spark, files)).collect()
    ordered = sorted(rows, key=lambda r: (r["node_path"] != "", r["node_path"].split("/")))
    assert [r["line"] for r in ordered] == render_reference_style("p", files)


def test_tree_edges_dedup_and_top_level(spark):
    e = TR.tree_edges(paths_df(spark, ["src/a.py", "src/b.py", "cli.py", "a/b/c/deep.py"])).collect()
    pairs = sorted((r["parent_id"], r["child_id"]) for r in e)
    assert pairs == sorted([("src", "src_a_py"), ("src", "src_b_py"), ("a_b_c", "a_b_c_deep_py"),
                            ("a", "a_b"), ("a_b", "a_b_c")])
    dirs = sorted(r["dir_path"] for r in TR.dir_nodes(paths_df(spark, ["a/b/c/deep.py"])).collect())
    assert dirs == ["a", "a/b", "a/b/c"]


def test_diagram_text(spark):
    lines = TR.diagram_tree_lines(paths_df(spark, ["src/utils.py"])).orderBy(*TR.line_order()).collect()
    assert [r["line"] for r in lines] == ["graph TD", '    src("src/")', "    src_utils_py[utils.py]",
                                          "    src --> src_utils_py"]


@pytest.mark.parametrize("source,found", [
    ("import os\n", ["os"]), ("from pathlib import Path\n", ["pathlib"]), ("from .utils import helper\n", [".utils"]),
    ("from ...top import x\n", ["...top"]), ("def (broken syntax{{{", []), ("", []), ("from . import z\n", []),
    ("import a.b as c, d\nif x: import e; import f\n", ["a.b", "d", "e", "f"]), ("from.x import (\n  y,\n)\n", [".x"]),
    ("\"\"\"\nimport no\n\"\"\"\n# import no\nx = 'import no'\n    import yes\n", ["yes"]), ("x = '#'\nimport a # b\n", ["a"]),
    ("t = \"it's\"\nimport a\ns = 'say \\\'import b\\\''\nimport c\n", ["a", "c"]), ("important = 1\nfromage import x\n", []),
    ("import a, \\\n   b\n", ["a", "b"]), ("'" + "x" * 200_000 + "'\nimport z\n", ["z"])])
def test_python_imports(spark, source, found):
    df = spark.createDataFrame([(source,)], "c string")
    assert df.select(py_imports(F.col("c"))).first()[0] == found


def files_df(spark, rows, project="p"):
    return spark.createDataFrame([(project, p, c.encode()) for p, c in rows],
                                 "project string, path string, content binary")


def test_js_extraction_forms(spark):
    src = ("import foo from './foo'\nimport bar from \"./bar\"\nconst x = require('./utils')\n"
           "import './styles.css'\nexport { foo } from './foo'\nimport React from 'react'\n")
    deps = D.raw_dependencies(files_df(spark, [("app.js", src), ("empty.ts", "")])).collect()
    got = [r["dep"] for r in sorted(deps, key=lambda r: r["dep_ord"])]
    assert got == ["./foo", "./bar", "./utils", "./styles.css", "./foo"]


def test_resolution_priority_index_and_self(spark):
    files = files_df(spark, [
        ("src/app.ts", "import a from './lib'\nimport b from './comp'\nimport c from '../util'\n"
                       "import d from './app'\nimport e from './missing'\nimport f from './x.service'"),
        ("src/lib.ts", ""), ("src/lib.js", ""), ("src/comp/index.tsx", ""), ("util.py", ""),
        ("src/x.service", ""),
        ("pkg/mod.py", "from .helpers import h\nimport pkg.other\nfrom ..top import t\n"),
        ("pkg/helpers.py", ""), ("pkg/other.py", ""), ("top.py", "")])
    e = {(r["src_path"], r["dst_path"]) for r in D.dependency_edges(files).collect()}
    assert ("src/app.ts", "src/lib.ts") in e and ("src/app.ts", "src/lib.js") not in e
    assert ("src/app.ts", "src/comp/index.tsx") in e and ("src/app.ts", "util.py") in e
    assert ("src/app.ts", "src/x.service") in e
    assert not any(d == "src/app.ts" for _, d in e)
    assert ("pkg/mod.py", "pkg/helpers.py") in e and ("pkg/mod.py", "pkg/other.py") in e
    assert ("pkg/mod.py", "top.py") in e


def test_diagram_dep_lines(spark):
    files = files_df(spark, [("a.ts", "import x from './b'\nimport y from './b'"), ("b.ts", "")])
    lines = D.diagram_dep_lines(D.dependency_edges(files)).orderBy("section", "pos").collect()
    assert [r["line"] for r in lines] == ["", "    %% dependency edges", "    a_ts -.-> b_ts"]
    assert F is not None
