import json
import os

from treesnap.sources.cache import read_description_cache, read_synthesis


def test_read_reference_cache_files(spark, tmp_path):
    for proj, entries in {"alpha": {"src/foo.py": {"sha256": "deadbeef", "description": "Loaded from disk."}},
                          "beta": {"a.py": {"sha256": "x", "description": "Uses <b> & 'quotes'."},
                                   "b.py": {"sha256": "y", "description": "B"}}}.items():
        d = tmp_path / proj / "state"
        os.makedirs(d)
        (d / "cache.json").write_text(json.dumps(entries, indent=2), encoding="utf-8")
        (d / "synthesis.json").write_text(json.dumps({"use_cases": "UC1", "conventions_ai": "C1"}, indent=2))
    rows = read_description_cache(spark, str(tmp_path / "*" / "state" / "cache.json")).collect()
    got = sorted((r["project"], r["path"], r["sha256"], r["description"]) for r in rows)
    assert got == [("alpha", "src/foo.py", "deadbeef", "Loaded from disk."),
                   ("beta", "a.py", "x", "Uses <b> & 'quotes'."), ("beta", "b.py", "y", "B")]
    syn = sorted(tuple(r) for r in read_synthesis(spark, str(tmp_path / "*" / "state" / "synthesis.json")).collect())
    assert syn == [("alpha", "UC1", "C1"), ("beta", "UC1", "C1")]


def test_missing_cache_is_empty(spark, tmp_path):
    assert read_description_cache(spark, str(tmp_path / "nothing" / "cache.json")).count() == 0
    assert read_synthesis(spark, str(tmp_path / "nothing.json")).columns == ["project", "use_cases", "conventions_ai"]


def test_broken_cache_is_an_error(spark, tmp_path):
    import pytest
    d = tmp_path / "p" / "state"
    d.mkdir(parents=True)
    (d / "cache.json").write_text('{"a": {"sha256": "x"')
    with pytest.raises(Exception, match="no JSON object"):
        read_description_cache(spark, str(tmp_path / "*" / "state" / "cache.json")).collect()
