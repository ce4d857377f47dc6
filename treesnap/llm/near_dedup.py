"""Near-duplicate documents: sketches, bands, exact verification.

1. Documents with equal shingle sets form one class; a class is one node.
2. Classes that share a band of their sketches are compared with the
   smallest class of that band, exactly, on full sets. Links found so far
   give provisional components.
3. Where a band still holds several components, its classes are joined
   exactly: a set's shingles are put in one global order, those that occur in
   one component first, then rarest first. Two linked sets must share a
   shingle within the first n - ceil(s n) + 1 of both, at places that leave
   room for the overlap. Only pairs across components are formed, and they
   are verified on full sets. This step has no caps and loses no link among
   the classes that share a band with another component.
4. Components of all verified links."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treesnap.llm.arrays import _SPACE, gram_hashes, run_hashes
from treesnap.llm.common import table
from treesnap.llm.components import components
from treesnap.llm.sketch import band_keys, banding, sketches
from treesnap.session import bound_arrow_batches, materialize

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words, A-Z
    lower-cased; of the whole sequence where there are fewer words."""
    buf = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    words = run_hashes(buf, _SPACE[buf])[0]
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _describe(k: int, bands: int, rows: int):
    @F.pandas_udf("n long, same binary, bands array<long>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(texts), 256):
            sets = [shingle_set(t, k) for t in texts.iloc[at:at + 256]]
            keys = band_keys(sketches(sets, bands * rows), bands, rows).view(np.int64)
            out += [(len(s), _digest(s), b) for s, b in zip(sets, keys, strict=True)]
        return pd.DataFrame(out, columns=["n", "same", "bands"])
    return describe


def _sets(k: int):
    @F.pandas_udf("same binary, set array<long>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t, k) for t in texts]
        return pd.DataFrame({"same": [_digest(s) for s in found], "set": [s.view(np.int64) for s in found]})
    return sets


def _similar(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("same").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("same").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(_similar(common, F.size("set_a"), F.size("set_b"), percent)).select("a", "b")


def _cross_pairs(open_nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components: step 3. ``open_nodes`` has
    same and root."""
    listed = materialize(sets.join(open_nodes, "same").select("same", "root", F.size("set").alias("n"), F.explode("set").alias("shingle")),
                         "open-shingles")
    shared = (listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
              .where("lo != hi").select("shingle", "df"))
    met = listed.join(materialize(shared, "shared-shingles"), "shingle")
    n = F.col("n")
    prefix = n - F.floor((percent * n + 99) / 100) + 1
    mine = Window.partitionBy("same")
    own = n - F.count(F.lit(1)).over(mine)
    place = own + F.row_number().over(mine.orderBy("df", "shingle"))
    front = materialize(met.select("same", "root", "n", "shingle", prefix.alias("prefix"), place.alias("place"))
                        .where(F.col("place") <= F.col("prefix")).drop("prefix"), "prefixes")
    a = front.select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("same", "root", "n", "place")])
    b = front.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("same", "root", "n", "place")])
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    fits = ((F.col("same_a") < F.col("same_b")) & (F.col("root_a") != F.col("root_b"))
            & _similar(room, F.col("n_a"), F.col("n_b"), percent)
            & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    return a.join(b, "shingle").where(fits).select(F.col("same_a").alias("a"), F.col("same_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable over links) and
    kept (it is the smallest), one row per input row.

    Documents are linked when their sets of ``k``-word shingles have a
    Jaccard similarity of ``percent`` per cent or more. Null texts and texts
    without words have empty sets and are linked with nothing. Rows with
    equal keys are one document: each of their texts is compared, and all
    share a component. A null key is linked with nothing: its component is
    null and it is kept. Of documents that are equally good the smallest key
    is kept. Texts count whole whatever their length; an empty table gives an
    empty one. Other columns are ignored, whatever their names. Shingles are told
    apart by 64-bit hashes, sets by 128-bit ones."""
    bound_arrow_batches(docs.sparkSession)
    bands, rows = banding(percent / 100)
    doc = F.col("__d")
    base = materialize(docs.select(F.col(key).alias("__id"), F.xxhash64(text).alias("__hash"), _describe(k, bands, rows)(F.col(text)).alias("__d"))
                       .select("__id", "__hash", doc["n"].alias("n"), doc["same"].alias("same"), doc["bands"].alias("bands")), "sketches")
    linkable = base.where(F.col("__id").isNotNull() & (F.col("n") > 0))
    classes = materialize(linkable.groupBy("same").agg(F.min(F.struct("__id", "__hash")).alias("r"), F.first("bands").alias("bands"))
                          .select("same", F.col("r.__id").alias("rep"), F.col("r.__hash").alias("hash"), "bands"), "classes")
    node = F.struct("rep", "same")
    banded = classes.select(F.explode("bands").alias("band"), node.alias("node"), "hash")
    leaders = materialize(banded.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
                          .where("leader < last").select("band", F.col("leader.same").alias("leader")), "leaders")
    members = materialize(banded.join(leaders, "band").select("band", F.col("node.same").alias("same"), F.col("node.rep").alias("rep"), "hash", "leader"),
                          "band-members")
    active = members.select("rep", "hash").distinct()
    texts = (docs.select(F.col(key).alias("rep"), F.xxhash64(text).alias("hash"), F.col(text).alias("__text"))
             .join(active.hint("shuffle_hash"), ["rep", "hash"])
             .groupBy("rep", "hash").agg(F.first("__text").alias("__text")))  # repeated rows
    sets = materialize(texts.select(_sets(k)(F.col("__text")).alias("listed")).select("listed.same", "listed.set"), "sets")
    stars = members.where("same != leader").select(F.col("same").alias("a"), F.col("leader").alias("b")).distinct()
    # rows under one key are one document
    twins = (linkable.groupBy("__id").agg(F.min("same").alias("a"), F.max("same").alias("z")).where("a != z").select("__id", "a"))
    twins = linkable.select("__id", F.col("same").alias("b")).join(twins, "__id").where("a != b").select("a", "b")
    links = materialize(_verify(stars, sets, percent).unionByName(twins).distinct(), "star-links")
    roots = materialize(components(links), "star-roots")
    rooted = members.select("band", "same").join(roots.withColumnRenamed("node", "same"), "same", "left").select(
        "band", "same", F.coalesce("root", "same").alias("root"))
    mixed = (rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band"))
    open_nodes = materialize(rooted.join(mixed, "band").select("same", "root").distinct(), "open-nodes")
    more = materialize(_verify(_cross_pairs(open_nodes, sets, percent), sets, percent), "cross-links")
    if not more.isEmpty():
        roots = materialize(components(links.unionByName(more)), "roots")
    labelled = classes.select("same", "rep").join(roots.withColumnRenamed("node", "same"), "same", "left").select(
        "same", "rep", F.coalesce("root", "same").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = materialize(labelled.join(lowest, "root").select("same", "component_id"), "component-of")
    found = base.select("__id", "n", F.when(F.col("__id").isNotNull() & (F.col("n") > 0), F.col("same")).alias("same")).join(placed, "same", "left")
    component = F.coalesce("component_id", "__id")
    return found.select(F.col("__id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(component == F.col("__id"), F.lit(True)).alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
