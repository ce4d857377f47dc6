import hashlib

import pytest
from pyspark.sql import functions as F

from treesnap.functions import globs as G
from treesnap.functions import paths as P
from treesnap.functions import text as T


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("n,expected", [(5, 2), (29, 2), (30, 4), (100, 4), (149, 4), (150, 6), (500, 6)])
def test_sentence_buckets(spark, n, expected):
    assert one(spark, T.sentence_count, n, "int") == expected


@pytest.mark.parametrize("s", ["", "a", "a\n", "\n\n", "x\ny\nz"])
def test_line_count(spark, s):
    assert one(spark, T.line_count, s) == s.count("\n") + 1


@pytest.mark.parametrize("s", ["  a b \n", "　x ", "\x1cy\x1f", "none", "", " \t\n "])
def test_py_strip(spark, s):
    assert one(spark, T.py_strip, s) == s.strip()


def test_py_strip_looks_at_the_ends_only(spark):
    every = "".join(chr(i) for i in range(0x3100) if chr(i).isspace())
    df = spark.createDataFrame([(f"{every}a{every}b{every}",), (every,), ("\u200bx\u180e",)], "v string").select(T.py_strip("v").alias("r"))
    assert [r["r"] for r in df.collect()] == [f"a{every}b", "", "\u200bx\u180e"]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_longest_of_many_ties_and_nulls(spark):
    found = [["b", "ä", "aa", "c", "dd"], [], None]
    df = spark.createDataFrame([(x, n) for x in found for n in (0, 1, 2, 9)], "xs array<string>, n int")
    for r in df.select("xs", "n", T.longest(F.col("xs"), F.col("n")).alias("r")).collect():
        xs = r["xs"]
        best = None if xs is None else sorted(sorted(range(len(xs)), key=lambda i: (-len(xs[i].encode()), i))[:r["n"]])
        assert r["r"] == (None if best is None else [xs[i] for i in best])


def test_pushes_cut_a_text_into_sentences_once(spark):
    from treesnap.sources import tables as TB
    docs = spark.createDataFrame([(1, "One. Two two! Three", "en", "src0")], "doc_id int, text string, lang string, source string")
    pushes = TB.snapshot_pushes(docs)
    assert '"src0/en/doc_1.txt":"Two two! Three","README.md":"Two two!"' in pushes.first()["value"]
    assert pushes._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_sha256(spark):
    data = b"new content\n"
    got = one(spark, T.sha256_hex, bytearray(data), "binary")
    assert got == hashlib.sha256(data).hexdigest() and len(got) == 64


def test_salient_sentences_whole_text(spark):
    df = spark.createDataFrame([("One. Two words! A longer third? Four more words", 2), ("no stop at all " * 1000, 2),
                                ("a. " * 5000 + "The last sentence is the longest one.", 1), ("", 2)], "t string, n int")
    got = [r[0] for r in df.select(T.salient_sentences(F.col("t"), F.col("n"))).collect()]
    assert got == ["A longer third? Four more words", "no stop at all " * 1000, "The last sentence is the longest one.", ""]
    assert one(spark, T.longest_line, "ab\nabc\nabd\n") == "abc"


@pytest.mark.parametrize("path,suffix", [("a/b.py", ".py"), (".bashrc", ""), ("a.", ""), ("x/a.tar.gz", ".gz"),
                                         ("..a", ".a"), ("noext", "")])
def test_suffix(spark, path, suffix):
    assert one(spark, P.suffix, path) == suffix


@pytest.mark.parametrize("path,norm", [("src/../x", "x"), ("a/./b//c", "a/b/c"), ("../x", None), ("a/b/..", "a")])
def test_normalise(spark, path, norm):
    assert one(spark, P.normalise, path) == norm


@pytest.mark.parametrize("name,slug", [("My App", "my_app"), ("my-app", "my_app"), ("__", "default"),
                                       ("Ünïcode Proj!", "n_code_proj")])
def test_slug(spark, name, slug):
    assert one(spark, P.slug, name) == slug


def test_node_id(spark):
    assert one(spark, P.node_id, "src/a-b.py") == "src_a_b_py"


def select(spark, paths, include, exclude=()):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return sorted(r[0] for r in df.filter(G.select_paths("path", include, exclude)).collect())


FILES = ["src/cli.py", "src/utils.py", "tests/test_main.py", "README.md", "docs/a/README.md", ".env",
         "pkg/__init__.py", "a-b/x", "a/x"]


def test_glob_include_all(spark):
    assert select(spark, FILES, ["**/*"]) == sorted(FILES)


def test_glob_src_only(spark):
    assert select(spark, FILES, ["src/**"]) == ["src/cli.py", "src/utils.py"]


def test_glob_exclude_tests_and_md(spark):
    got = select(spark, FILES, ["**/*"], ["tests/**", "*.md"])
    assert "README.md" not in got and "docs/a/README.md" not in got
    assert not any(p.startswith("tests/") for p in got)


def test_glob_negation_last_match_wins(spark):
    assert select(spark, FILES, ["*.py", "!src/", "src/cli.py"]) == ["pkg/__init__.py", "src/cli.py",
                                                                      "tests/test_main.py"]


def test_glob_anchored_and_dir(spark):
    assert select(spark, FILES, ["/README.md"]) == ["README.md"]
    assert select(spark, FILES, ["a/"]) == ["a/x", "docs/a/README.md"]  # any depth
    assert select(spark, FILES, ["/a/"]) == ["a/x"]
    assert select(spark, FILES, ["docs/**/README.md"]) == ["docs/a/README.md"]
    assert select(spark, FILES, ["?.env", ".e?v"]) == [".env"]
    assert select(spark, FILES, ["[st]*/*.py"]) == ["src/cli.py", "src/utils.py", "tests/test_main.py"]


@pytest.mark.parametrize("pattern,hits,misses", [
    ("*.txt", ["a.txt", "d/a.txt", "d.txt/x"], ["a.txt2", "atxt"]),
    ("a/*.txt", ["a/x.txt"], ["a/b/x.txt", "z/a/x.txt"]),
    ("**/b/**", ["b/x", "a/b/c/d"], ["b", "ab/x"]),
    ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["az", "b/a/z"]),
    ("build/", ["build/x", "a/build/y/z"], ["build", "a/build"]),
    ("[!a]x", ["bx"], ["ax", "x"]), ("[]x]y", ["]y", "xy"], ["ay"]), ("a[b-d]", ["ac"], ["ae"]),
    ("\\*.md", ["*.md"], ["a.md"]), ("\\#x", ["#x"], ["x"]), ("\\!x", ["!x"], ["x"]), ("x\\ ", ["x "], ["x"]), ("x  ", ["x"], ["x "]),
    ("a?c", ["abc"], ["a/c", "ac"]), ("a+b.c", ["a+b.c"], ["aab.c", "a+bxc"]), ("*", ["x", "a/x", "a\nb", "x\n"], []),
    ("x", ["x", "x/y", "d/x"], ["x\n", "xx"])])
def test_gitignore_rules_in_columns_and_in_the_reader(spark, pattern, hits, misses):
    assert select(spark, hits + misses, [pattern]) == sorted(hits)
    rules = G.compile_patterns([pattern])
    assert [p for p in hits + misses if G.selected(rules, p)] == hits


def test_glob_bad_patterns():
    with pytest.raises(TypeError):
        G.compile_patterns("**/*")
    assert G.compile_patterns(["", "# comment"]) == []
