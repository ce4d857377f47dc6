"""Block tables and repaired conversations against plain searches."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from treesnap.llm import conversation_repair as cr
from treesnap.llm import turn_tables as t

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """(cost, audit, repaired turns) over all edit sequences; a turn is (role, text, fault)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def rest(i, at, puts):
        found = [(0, "", ())] if i == len(turns) and at in ("", "a") else []
        other = "a" if at == "u" else "u"
        full = {"u": "user", "a": "assistant"}[other]
        if i < len(turns):
            role, text, fault = turns[i]
            extra = 3 if fault == "truncated" else 0
            found += [(c + 4, "D" + e, o) for c, e, o in rest(i + 1, at, 3)]
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in follow[at]:
                    found += [(c + extra, "K" + e, ((role, text), *o)) for c, e, o in rest(i + 1, role[0], 3)]
                found += [(c + extra + 3, "R" + e, ((full, text), *o)) for c, e, o in rest(i + 1, other, 3)]
        if puts:
            found += [(c + 3, "I" + e, ((full, ""), *o)) for c, e, o in rest(i, other, puts - 1)]
        return found and [min(found)]

    return rest(0, "", 3)[0]


def brute(rows, hurt=True):
    """Expected report rows by conversation; ``rows`` are (conv, turn, role, text)."""
    out = {c: [] for c, *_ in rows}
    for c, n, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, n)).encode()) % 20 if hurt else 9
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[c] += [(n, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    found = {}
    for c, turns in out.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        judged, seen = [], set()
        for _, role, text in turns:
            bare = text.strip(SPACE)
            judged.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
            seen.add((role, text))
        cost, audit, fixed = cheapest(tuple(judged))
        known = [n for n, *_ in turns if n is not None]
        heads = [r[:1] for _, r, _ in turns]
        faults = [f for *_, f in judged]
        found[c] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest())
    return found


def as_dict(df):
    rows = df.collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_tables_give_the_least_letters():
    roles = ["s", "u", "a", "x"]
    turn = {0: ("u", "", "blank")} | {t.symbol(r, o): (r, "", "truncated" if o else None) for r in roles for o in (False, True)}
    rng = random.Random(5)
    cases = [c for n in range(4) for c in itertools.product(range(9), repeat=n)] + [tuple(rng.choices(range(9), k=rng.randint(4, 60))) for _ in range(300)]
    for c in cases:
        marks = "".join(map(str, c))
        cost, audit, _ = cheapest(tuple(turn[x] for x in c))
        assert t.backward(marks, t.ACCEPT)[0][0] == cost
        assert t.trace(marks, t.ACCEPT, 0)[0] == audit


def test_other_block_lengths_agree():
    rng = random.Random(6)
    for block in (1, 2, 3):
        own = t.Tables(block)
        for _ in range(50):
            marks = rng.choices(range(9), k=block)
            v = rng.randrange(len(own.vectors))
            want = own.vectors[v]
            for s in reversed(marks):
                want = t.step(s, want)
            code = int("".join(map(str, marks)), 9)
            got = tuple(min(x + int(own.low[code, v]), t.FAR) for x in own.vectors[int(own.form[code, v])])
            assert [min(x, t.FAR // 2) for x in got] == [min(x, t.FAR // 2) for x in want]


def talk(rng, conv, n):
    rows = []
    for i in range(n):
        role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
        text = rng.choice(["Yes.", "No!", "And then", "  ", "", None, "Why?\n", "One. Two", f"Turn {i}."])
        rows.append((conv, None if rng.random() < 0.05 else i + 3 * (rng.random() < 0.1), role, text))
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    found = [r for c in range(60) for r in talk(rng, c, rng.randint(1, 9))]
    found += talk(rng, 1000, 70) + talk(rng, None, 25) + [(1001, 4, "user", "Same."), (1001, 4, "user", "Same.")] * 9
    found += [(1002, None, None, None)] + [(1003, 1, "user", "word " * 20_000), (1003, 2, "assistant", "x" * 100_000 + ".")]
    return found


@pytest.mark.parametrize("segment", [4, 512])
def test_repair_against_brute_force(spark, rows, segment):
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("n", "segment", "rows", "audit", "__conv", "__at", "drawn", "copy", "own"):
        df = df.withColumn(c, F.lit("clash"))
    assert as_dict(cr.repaired(df.repartition(5), segment)) == want


def test_repair_keeps_sound_talks(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"), (2, 0, "user", "So?"), (2, 1, "assistant", "So.")]
    found = cr.repair(spark.createDataFrame(rows, SCHEMA))
    assert {r.conv_id: (r.cost, r.audit) for r in found.report.collect()} == {1: (0, "KKK"), 2: (0, "KK")}
    turns = {r.conv_id: [tuple(x) for x in r.turns] for r in found.pieces.collect()}
    assert turns[2] == [("user", "So?"), ("assistant", "So.")]


def test_dropped_and_empty(spark):
    gone = next(n for n in range(1000) if zlib.crc32(f"7:{n}".encode()) % 20 == 0)
    got = as_dict(cr.repaired(spark.createDataFrame([(7, gone, "user", "Hello.")], SCHEMA)))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert cr.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_the_table(spark):
    from tests.conftest import SF
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(cr.op13_conversation_repair(spark, SF)) == brute(rows)
