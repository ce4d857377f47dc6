"""Repair of conversations: blank, repeated and cut-off turns, wrong and missing
roles. The cheapest edits come from block tables (``turn_tables``).

A conversation of at most ``segment`` turns is one array and one call. The
turns of a longer one are numbered by ranges and dealt into segments of that
many turns; each segment gives the least cost from every state before it to
every state behind it, and these small matrices are chained, backward for the
costs and forward for the states. No group of turns is larger than a segment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm import turn_tables as tables
from treesnap.llm.common import SPACE_CHARS, numbered, table
from treesnap.session import materialize

SEGMENT = 512
NOTHING = " "    # stands for a null role or text
_CONV = ["__conv", "__null"]
_TAKEN = "array<int>"


class Repair(NamedTuple):
    report: DataFrame   # conversation, gaps, blank, duplicate, truncated, illegal, cost, audit
    pieces: DataFrame   # conversation, segment, turns: array<struct<role, text>>, whole (the only segment)


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    c = F.col(conv)
    return turns.select(F.coalesce(c.cast("string"), F.lit("")).alias("__conv"), c.isNull().alias("__null"), F.col(turn).cast("long").alias("__turn"),
                        F.coalesce(F.col(role), F.lit(NOTHING)).alias("__role"), F.coalesce(F.col(text), F.lit(NOTHING)).alias("__text"))


def _fault(text: Column, duplicate: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return (F.when(bare == "", "blank").when(duplicate, "duplicate")
            .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated"))


def _counted(faults: Column) -> list[Column]:
    return [F.size(F.filter(faults, lambda x: x == name)).cast("long").alias(name) for name in ("blank", "duplicate", "truncated")]


def _mark(role: Column, fault: Column) -> Column:
    """The turn's symbol as a digit."""
    code = F.lit(str(tables.MUST_DELETE))
    out = F.when(fault.isin("blank", "duplicate"), code)
    for open_end in (False, True):
        for initial in tables.ROLES:
            here = F.substring(role, 1, 1) == initial
            out = out.when(here & (F.coalesce(fault, F.lit("")) == ("truncated" if open_end else "")), str(tables.symbol(initial, open_end)))
    return out.otherwise(F.when(fault.isNull(), str(tables.symbol("", False))).otherwise(str(tables.symbol("", True))))


def _initials(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.when(r["role"] == "", "-").otherwise(F.substring(r["role"], 1, 1))), "")


def _illegal(initials: Column) -> Column:
    """Adjacent pairs that are not su, ua or au."""
    n = F.length(initials)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(initials, i, F.lit(2)))
    return F.when(n < 2, F.lit(0)).otherwise(F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))))


def _turns(rows: Column, taken: Column) -> Column:
    """The repaired turns from the places and edits of ``turn_tables.trace``."""
    def one(x: Column) -> Column:
        row, edit = F.get(rows, F.floor(x / 3).cast("int")), F.pmod(x, F.lit(3))
        inserted = F.when(x == -1, "user").otherwise("assistant")
        role = F.when(x < 0, inserted).when(edit == 1, "user").when(edit == 2, "assistant").otherwise(row["role"])
        return F.struct(role.alias("role"), F.when(x < 0, "").otherwise(row["text"]).alias("text"))
    return F.transform(taken, one)


def _call(fn, kind: str, *args) -> Column:
    return F.pandas_udf(fn, kind)(*args)


def _solve(marks: pd.Series) -> pd.DataFrame:
    got = [(tables.backward(m, tables.ACCEPT)[0][0], *tables.trace(m, tables.ACCEPT, 0)[:2]) for m in marks]
    return pd.DataFrame(got, columns=["cost", "audit", "taken"])


def _matrix(marks: pd.Series) -> pd.Series:
    return pd.Series([tables.matrix(m) for m in marks], dtype=object)


def _chain_back(ways: pd.Series) -> pd.DataFrame:
    """From the matrices of a conversation's segments the vector behind each."""
    out = []
    for all_ways in ways:
        vector, behind = list(tables.ACCEPT), []
        for w in reversed([np.asarray(x).tolist() for x in all_ways]):
            behind.append(vector)
            vector = tables.before(w, vector)
        out.append((vector[0], behind[::-1]))
    return pd.DataFrame(out, columns=["cost", "behind"])


def _traces(marks: pd.Series, behind: pd.Series, last: pd.Series) -> pd.Series:
    """The segment's edits from each state; those that no way leads on from are empty."""
    out = []
    for m, v, end in zip(marks, behind, last, strict=True):
        vector = tuple(int(x) for x in v)
        open_states = tables.backward(m, vector)[0]
        out.append([dict(zip(("audit", "taken", "state"), tables.trace(m, vector, q, bool(end)) if open_states[q] < tables.FAR else ("", [], q), strict=True))
                    for q in range(4)])
    return pd.Series(out, dtype=object)


def _chain_on(states: pd.Series) -> pd.Series:
    """From each segment's state behind, by state before, the state before each segment."""
    out = []
    for steps in states:
        state, got = 0, []
        for s in steps:
            got.append(state)
            state = int(s[state])
        out.append(got)
    return pd.Series(out, dtype=object)


def _whole(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Conversations that fit one segment: an array of turns each."""
    row = F.struct(F.col("__turn").alias("turn"), F.col("__role").alias("role"), F.col("__text").alias("text"))
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    same = F.transform("rows", lambda r: F.struct(r["role"], r["text"]))
    found = found.withColumn("same", same)
    fault = F.transform("rows", lambda r, i: _fault(r["text"], F.array_position(F.col("same"), F.struct(r["role"], r["text"])) <= i))
    found = found.select(*keys, "rows", fault.alias("faults"))
    marks = F.array_join(F.zip_with("rows", "faults", lambda r, f: _mark(r["role"], f)), "")
    found = found.select(*keys, "rows", "faults", _initials(F.col("rows")).alias("initials"), _call(_solve, f"cost long, audit string, taken {_TAKEN}", marks).alias("solved"))
    return found.select(*keys, *_counted(F.col("faults")), _illegal(F.col("initials")).cast("long").alias("illegal"), F.col("solved.cost").alias("cost"),
                        F.col("solved.audit").alias("audit"), _turns(F.col("rows"), F.col("solved.taken")).alias("turns"))


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """Longer conversations: an array of turns per segment, with its marks and initials."""
    placed = materialize(numbered(rows, _CONV, ["__turn", "__role", "__text"], "__at").select(*rows.columns, "__at", F.sha2("__text", 256).alias("__digest")), "long-turns")
    same = [*_CONV, "__role", "__digest"]
    # only what stands twice is joined back; written, so that the join stands between plain shuffles
    first = materialize(placed.groupBy(*same).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"), "repeated-turns")
    judged = placed.join(first, same, "left").withColumn("__fault", _fault(F.col("__text"), F.coalesce(F.col("__at") > F.col("__first"), F.lit(False))))
    row = F.struct(F.col("__at").alias("at"), F.col("__role").alias("role"), F.col("__text").alias("text"), F.col("__fault").alias("fault"))
    found = judged.groupBy(*_CONV, F.floor(F.col("__at") / segment).alias("segment")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    marks = F.array_join(F.transform("rows", lambda r: _mark(r["role"], r["fault"])), "")
    return materialize(found.select(*_CONV, "segment", "rows", marks.alias("marks"), _initials(F.col("rows")).alias("initials")), "turn-segments")


def _long(rows: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    segments = _segments(rows, segment)
    # a row of a conversation's small arrays has one entry per segment
    ways = segments.select(*_CONV, "segment", F.struct("segment", _call(_matrix, "array<long>", "marks").alias("ways")).alias("x"))
    chained = ways.groupBy(*_CONV).agg(F.array_sort(F.collect_list("x")).alias("x")).select(
        *_CONV, F.col("x.segment").alias("segment"), _call(_chain_back, "cost long, behind array<array<long>>", "x.ways").alias("chain"))
    chained = materialize(chained.select(*_CONV, "segment", "chain.*"), "chain-back")
    behind = chained.select(*_CONV, F.explode(F.arrays_zip("segment", "behind")).alias("x"), F.size("segment").alias("n")).select(
        *_CONV, F.col("x.segment").alias("segment"), F.col("x.behind").alias("behind"), (F.col("x.segment") == F.col("n") - 1).alias("last"))
    at = [*_CONV, "segment"]
    traced = materialize(segments.drop("initials").join(behind, at).select(
        *at, "rows", _call(_traces, f"array<struct<audit: string, taken: {_TAKEN}, state: int>>", "marks", "behind", "last").alias("traces")), "traces")
    on = traced.groupBy(*_CONV).agg(F.array_sort(F.collect_list(F.struct("segment", F.col("traces.state").alias("state")))).alias("x")).select(
        *_CONV, F.col("x.segment").alias("segment"), _call(_chain_on, "array<int>", "x.state").alias("start"))
    start = on.select(*_CONV, F.explode(F.arrays_zip("segment", "start")).alias("x")).select(
        *_CONV, F.col("x.segment").alias("segment"), F.col("x.start").alias("start"))
    taken = materialize(traced.join(start, at).select(*at, "rows", F.get("traces", "start").alias("trace"))
                        .select(*at, F.col("trace.audit").alias("audit"), _turns(F.col("rows"), F.col("trace.taken")).alias("turns")), "long-repairs")
    small = segments.select(*at, *_counted(F.col("rows.fault")), _illegal(F.col("initials")).alias("illegal"), F.left("initials", F.lit(1)).alias("head"), F.right("initials", F.lit(1)).alias("tail"))
    ends = F.array_sort(F.collect_list(F.struct("segment", "head", "tail")))
    met = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.concat(F.get("ends", i - 1)["tail"], F.get("ends", i)["head"]))
    seams = F.when(F.size("ends") < 2, F.lit(0)).otherwise(F.size(F.filter(met, lambda p: ~p.isin("su", "ua", "au"))))
    sums = small.groupBy(*_CONV).agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], ends.alias("ends"))
    audit = taken.groupBy(*_CONV).agg(F.array_sort(F.collect_list(F.struct("segment", "audit"))).alias("x")).select(*_CONV, F.array_join("x.audit", "").alias("audit"))
    report = sums.select(*_CONV, "blank", "duplicate", "truncated", (F.col("illegal") + seams).cast("long").alias("illegal")).join(
        chained.select(*_CONV, "cost"), _CONV).join(audit, _CONV)
    return report, taken.select(*at, "turns")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> Repair:
    """Faults and cheapest repair of every conversation.

    Turns go by number, nulls first, and of equal numbers by role and text, so
    repeated rows stand together. A null role or text counts as one blank; a null
    conversation id is a conversation of its own. A turn is blank (no word), else
    a duplicate (role and text of an earlier one), else truncated (its last
    visible character is not one of ``.!?``). Keeping costs 0, a new role 3,
    deletion 4, an inserted empty turn 3; blank and duplicate turns must go,
    truncated ones that stay cost 3 more. Roles of the result read
    ``(s?(ua)+)?`` by initials; of equally cheap repairs the one whose letters
    sort first is taken. Other columns are ignored, whatever their names; texts
    of any length count whole. An empty table gives empty tables."""
    kind = turns.schema[conv].dataType
    rows = _rows(turns, conv, turn, role, text)
    sizes = materialize(rows.groupBy(*_CONV).agg(
        F.count(F.lit(1)).alias("n"), (F.max("__turn") - F.min("__turn") + 1 - F.countDistinct("__turn")).alias("gaps")), "conversations")
    many = sizes.where(F.col("n") > segment).select(*_CONV)
    whole = materialize(_whole(rows.join(many, _CONV, "left_anti"), _CONV), "short-repairs")
    pieces, reports = whole.select(*_CONV, F.lit(0).cast("long").alias("segment"), "turns", F.lit(True).alias("whole")), whole.drop("turns")
    if not many.isEmpty():
        report, taken = _long(rows.join(many, _CONV, "left_semi"), segment)
        reports = reports.unionByName(report)
        pieces = pieces.unionByName(taken.select("*", F.lit(False).alias("whole")))
    key = F.when(~F.col("__null"), F.col("__conv")).cast(kind).alias(conv)
    report = reports.join(sizes, _CONV).select(key, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(report, pieces.select(key, "segment", "turns", "whole"))


def text_digests(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines. Segments of a longer
    one are read in order and hashed piece by piece, never as one string."""
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = pieces.where("whole").select(conv, F.sha2(line, 256).alias("repaired_sha256"))
    name, schema = conv, f"`{conv}` {pieces.schema[conv].dataType.simpleString()}, repaired_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for b in batches:
            for key, piece in zip(b[name], b["piece"], strict=True):
                key = None if pd.isna(key) else key
                if state is None or key != held:
                    if state is not None:
                        yield pd.DataFrame({name: pd.Series([held], dtype=object), "repaired_sha256": state.hexdigest()})
                    held, state, some = key, hashlib.sha256(), False
                if piece is not None:
                    state.update((b"\n" if some else b"") + piece.encode("utf-8", "surrogatepass"))
                    some = True
        if state is not None:
            yield pd.DataFrame({name: pd.Series([held], dtype=object), "repaired_sha256": state.hexdigest()})

    rest = (pieces.where("not whole").select(conv, "segment", F.when(F.size("turns") > 0, line).alias("piece"))
            .repartition(conv).sortWithinPartitions(conv, "segment").mapInPandas(run, schema))
    return whole.unionByName(rest)


def damage(turns: DataFrame) -> DataFrame:
    """The query's damage, drawn by a checksum of conversation and turn."""
    blank = F.lit(NOTHING)
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    drawn = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    bad = turns.select("conv_id", "turn", F.when(drawn == 4, "user").otherwise(role).alias("role"),
                       F.when(drawn == 1, "").when(drawn == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), drawn.alias("drawn"))
    return (bad.where("drawn != 0").withColumn("copy", F.explode(F.when(F.col("drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("drawn", "copy"))


def repaired(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    found = repair(damage(turns), segment=segment)
    known = found.report.join(text_digests(found.pieces).withColumnRenamed("conv_id", "same"), F.col("conv_id").eqNullSafe(F.col("same"))).drop("same")
    names = turns.select(F.col("conv_id").alias("own")).distinct()
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return names.join(known, F.col("own").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("own").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
