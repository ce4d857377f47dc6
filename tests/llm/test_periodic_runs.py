"""Runs of repeated words against a search of all periods."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from treesnap.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                if j + q - i >= max(6, 4 * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def report(doc_id, text):
    words = plant(doc_id, WORD.findall(text or ""))
    runs = all_runs(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapse(words, runs)))


def texts(rng):
    """Texts with few different words, with nested periods and with runs at their edges."""
    out = []
    for _ in range(400):
        out.append([rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randint(0, 60))])
    for _ in range(200):
        words = []
        while len(words) < 120:
            root = [rng.choice("abcd") for _ in range(rng.randint(1, 9))] * rng.randint(1, 3)
            words += root * rng.randint(1, 7) + root[:rng.randint(0, len(root))] + [rng.choice("xyz") for _ in range(rng.randint(0, 2))]
        out.append(words)
    for _ in range(60):   # a period in which every short gram stands twice
        a, b, c = ([rng.choice("ab") for _ in range(rng.randint(3, 8))] for _ in range(3))
        root = a + b + a + c + a + b + b + c
        out.append(root * rng.randint(3, 6) + root[:rng.randint(0, len(root))])
    return out


def test_search_against_all_periods():
    cases = texts(random.Random(4))
    for lo in range(0, len(cases), 37):   # many texts at once, parted
        part = cases[lo:lo + 37]
        got = list(pr._search([" ".join(t).encode() for t in part]))
        for words, (n, runs, text) in zip(part, got, strict=True):
            want = all_runs(words)
            assert (n, runs, text) == (len(words), want, collapse(words, want)), words


def test_long_texts_stay_cheap():
    began = time.time()
    same = np.zeros(300_000, np.int64)
    assert pr.runs_of(np.append(same, 1), np.zeros(300_001, np.int64)) == [(0, 300_000, 1)]
    root = np.arange(40_000)
    assert pr.runs_of(np.append(np.tile(root, 5), -1) + 1, np.zeros(200_001, np.int64)) == [(0, 200_000, 40_000)]
    rng = np.random.default_rng(1)
    assert isinstance(pr.runs_of(rng.integers(0, 2, 200_000), np.zeros(200_000, np.int64)), list)
    assert time.time() - began < 30


def test_messy_rows(spark, messy, nothing):
    got = pr.find_runs(messy, keep=("doc_id", "text")).collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(map(str, [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]))
    for r in got:
        words = WORD.findall(r.text or "")
        assert r.n_words == len(words)
        if len(words) < 500:
            want = all_runs(words)
            assert [tuple(x) for x in r.runs] == want and r.collapsed == collapse(words, want)
    assert pr.find_runs(nothing).count() == 0


def test_query_against_brute_force(spark, messy):
    rng = random.Random(8)
    rows = [(i, " ".join(t) + rng.choice(["", "\n", " \x0b tail"])) for i, t in enumerate(texts(rng)[::4])]
    rows += [(r.doc_id, r.text) for r in messy.collect() if len(r.text or "") < 5000] + [(900 + i, "word " * i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("runs", F.lit("clash"))
    got = sorted(map(str, [tuple(r) for r in pr.digests(pr.find_runs(pr.planted(df))).collect()]))
    assert got == sorted(map(str, [(i, *report(i, t)) for i, t in rows]))
    assert sum(r[1] > 0 for r in [(i, report(i, t)[0]) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0]) > 3


def test_query_on_the_table(spark):
    from tests.conftest import SF
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 8000]
    want = {r.doc_id: report(r.doc_id, r.text) for r in rows}
    got = {r.doc_id: tuple(r)[1:] for r in pr.op12_periodic_runs(spark, SF).collect()}
    assert {k: got[k] for k in want} == want and any(v[0] for v in want.values())
