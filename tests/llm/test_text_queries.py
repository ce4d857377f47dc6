"""Word counts, rules, decontamination, sharding and near-duplicates against
brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from treesnap.llm import decontaminate, near_dedup, quality_rules, sharding, sketch
from treesnap.llm.arrays import as_bytes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(hit))


def test_rule_counts(messy, nothing):
    got = quality_rules.judge(messy, keep=("doc_id", "text")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in messy.collect())
    for r in got:
        assert tuple(r[c] for c in quality_rules.COUNTS) == counts(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(nothing).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(20_000) < np.where(good, 0.03, 0.7), -1, 1) for _ in range(5)], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = quality_rules.fit_votes(patterns, n)
    assert abs(m["share"] - 0.8) < 0.02
    assert np.allclose(m["good"][:, 0], 0.03, atol=0.02) and np.allclose(m["bad"][:, 0], 0.7, atol=0.05)
    shuffled = rng.permutation(len(n))
    again = quality_rules.fit_votes(patterns[shuffled], n[shuffled])
    assert np.allclose(again["good"], m["good"])
    assert np.isfinite(quality_rules.fit_votes(np.zeros((0, 5), int), np.zeros(0))["good"]).all()


def contamination(text, items):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, found = split.findall((text or "").translate(LOWER)), set(), set()
    for item, body in items:
        own = split.findall((body or "").translate(LOWER))
        n = min(10, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, messy, nothing):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 7, 9, 10, 11, 30])))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "--- !!"), (103, "Two Words"), (104, "ONE"), (105, items[5][1]), (106, "É à ß")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40)) + rng.choice(items[:12])[1].upper().split()
                          + rng.choices(vocab, k=5))) for i in range(60)]
    docs = messy.select("doc_id", "text", "n").unionByName(spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True)
    got = decontaminate.decontaminate(docs, bench).collect()
    want = [(r.doc_id, *contamination(r.text, items)) for r in docs.collect()]
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got))) == sorted(map(str, want))
    assert sum(r.contaminated for r in got) > 30
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    clean = decontaminate.decontaminate(messy, bench.where("false")).collect()
    assert len(clean) == messy.count() and not any(r.contaminated or r.n_hit for r in clean)


def test_winnowing_guarantee():
    for span in range(1, 20):
        k, w = decontaminate.thinning(span)
        assert k >= 1 and w >= 1 and k + w - 1 == span


def owner(key, shards):
    draws = [int(hashlib.md5(f"{s}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) for s in range(shards)]
    return draws.index(max(draws))


def test_sharding(messy, nothing):
    got = sharding.shard_documents(messy, [1.0] * 8, [1.0] * 9).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), owner(r.doc_id, 8), owner(r.doc_id, 9))
                   for r in messy.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in {r.shard for r in got}:
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in mine]
        assert keys == sorted(keys)
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert sharding.shard_documents(nothing, [1.0]).count() == 0


def test_weighted_shards(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    n = Counter(r.shard for r in sharding.shard_documents(docs, [1.0, 3.0]).collect())
    assert abs(n[1] / 20_000 - 0.75) < 0.015
    with pytest.raises(ValueError):
        sharding.rendezvous(docs.doc_id, [1.0, 0.0])


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    k = min(k, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def groups(rows, k, percent):
    """Smallest key reachable, for every (key, text)."""
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i in up}


def test_near_duplicates_messy(messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    want = groups(rows, 3, 85)
    got = near_dedup.near_duplicates(messy, k=3, percent=85).collect()
    assert len(got) == len(rows)
    assert sorted((r.n_shingles for r in got)) == sorted(len(shingles(t, 3)) for _, t in rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_chains(spark):
    """Drifting copies: neighbours are linked, far ones are not, so bands mix
    components and the exact join has to find the links."""
    rng = random.Random(11)
    rows, key = [], 0
    for _ in range(12):
        base = [f"t{rng.randrange(10 ** 9)}" for _ in range(120)]
        for _ in range(14):
            rows.append((key, " ".join(base)))
            key += 1
            for _ in range(rng.choice([1, 2, 3, 4])):
                base[rng.randrange(120)] = f"t{rng.randrange(10 ** 9)}"
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == groups(rows, 3, 85)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in (0, 1, 2, 5, 40, 3000)]
    got = sketch.sketches(sets, 64)
    empty = np.uint64(2 ** 64 - 1)
    assert (got[0] == empty).all() and (got[1:] != empty).all()
    a = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2 ** 63, 100).astype(np.uint64)))
    s = sketch.sketches([a, b], 2000)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.04


def test_word_hashes():
    words = "a bb a ccc \t\n bb a" + " " + "z" * 3000
    h = word_hashes(as_bytes(words))
    assert len(h) == 7 and h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h)) == 4


def test_block_hashes_and_word_places_match_the_plain_definition():
    import random

    import numpy as np

    from treesnap.llm import line_dedup as LD
    full, rng = 2 ** 64 - 1, random.Random(7)

    def mix(x):
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * m & full
        return x ^ x >> 33

    def plain(part, salt):
        blocks = [int.from_bytes(part[i:i + 8], "little") for i in range(0, len(part), 8)]
        return mix((sum(mix(mix(b + salt & full) + i * LD._ODD & full) for i, b in enumerate(blocks)) + len(part) * LD._BACK) & full)

    text = "".join(rng.choice(["a", "bc", "ß漢", " ", "\n", "\n\n", " \n ", "x" * rng.randint(1, 40)]) for _ in range(3000)).encode()
    buf = np.frombuffer(text, np.uint8)
    size = np.array([rng.randint(1, 40) for _ in range(300)] + [1, 7, 8, 9, 16, 17], np.int64)
    begin = np.array([rng.randint(0, len(text) - 40) for _ in size], np.int64)
    begin[-1], size[-1] = len(text) - 3, 3
    for salt in (1, LD._BACK):
        for only in (slice(None), size <= 8, size > 8):
            got = LD._block_hashes(buf, begin[only], size[only], salt)
            assert got.tolist() == [plain(text[b:b + n], salt) for b, n in zip(begin[only].tolist(), size[only].tolist())]
    h, start, end, words, lines = LD.units_of(buf)
    assert b"".join(text[a:b] for a, b in zip(start, end)) == text and words.sum() == len(text.split())
    ended = np.cumsum(lines)
    assert ended[-1] == sum(bool(x.split()) for x in text.split(b"\n"))
