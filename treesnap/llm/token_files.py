"""Token ids as files of Huffman-coded blocks.

Texts are dealt out by range of their key, encoded in key order and counted;
the global counts give one canonical code. The format is a parquet folder:

- ``blocks/``: range, seq (of the block's first text in its range), at (ids
  of the range before the block), keys and sizes (one entry per text),
  payload (coded bits), marks (bit offset of every 128th id)
- ``code/``: id, length (the canonical code is rebuilt from the lengths)
- ``ranges/``: range, start (ids of all ranges before it), key_type (keys
  are kept as text)

Any block can be decoded by itself, and within it from any mark."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from treesnap.llm.common import table
from treesnap.llm.huffman import LIMIT, Code
from treesnap.session import bound_arrow_batches, scratch_path

BLOCK_IDS = 1 << 16
END_ID = 0
_YOUNG_PIECES = 600_000
_BATCH_CHARS = 1 << 23  # of texts cut together, or of one text
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
# texts of these characters are cut into pieces here, all others by the tokenizer
_OTHER = re.compile(f"[^\\n -~{_LETTERS}]").search
# characters that these texts do not have: a chunk's end, a text's start, a
# blank inside white space
_END, _START, _INNER = "\t", "\x00", "\x01"
_NO_ID = 0xFFFFFFFF  # stands for a chunk's end among the ids
# fixed value: how byte-level tokenizers cut a text, for those characters; a
# chunk's end is a piece of its own and looks like white space to the one before
_PIECES = re.compile(f"{_END}|'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[!-/:-@\\[-`{{-~]+|[\\n ]+(?![^\\n {_END}])|[\\n ]+").findall
# blanks that begin no piece: white space on both sides, or before the text's end
_BLANKS = re.compile("(?<=[\n ]) (?![^\n ])").sub
_ID = attrgetter("id")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 characters
    stand for themselves, the others for successive characters from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of the pieces that texts are cut into, computed where missing; a
    bounded memory of two generations, of which the older is dropped when the
    younger is full."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.older, self.spelling = model.model.tokenize, {}, _byte_letters()
        self.blank = self.spelling[32]

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if piece == _END:
            ids = array("I", [_NO_ID]).tobytes()
        elif ids is None:
            if piece.isascii() and "\n" not in piece:  # only the blank is spelt differently
                spelt = piece.replace(" ", self.blank)
            else:
                spelt = piece.encode().decode("latin-1").translate(self.spelling)
            ids = array("I", list(map(_ID, self.tokenize(spelt)))).tobytes()
        if len(self) >= _YOUNG_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Byte-level BPE of whole texts through the tokenizers library.

    Texts of blanks, line breaks, ASCII signs and Latin letters are cut into
    pieces here, as the library's byte-level pre-tokenizer cuts them, and a piece is
    encoded once while the bounded memory holds it. Many texts together are first
    cut at the blanks, where a piece always begins, and only their distinct chunks
    are cut into pieces; blanks inside longer white space are left. Texts with other
    characters or an added token, and all texts of other kinds of tokenizers, are
    encoded whole."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        kind = json.loads(self.model.to_str())
        cutter = kind.get("pre_tokenizer") or {}
        self.known = (cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
                      and not kind.get("normalizer") and kind["model"].get("type", "BPE") == "BPE")
        added = [re.escape(t["content"]) for t in kind.get("added_tokens") or []]
        self.added = re.compile("|".join(added)).search if added else lambda text: None
        self.pieces = _Pieces(self.model)

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the text, without an end id."""
        return self.encode([text])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The same for each text."""
        out, held, chars = [b""] * len(texts), [], 0

        def flush():
            for k, ids in zip(held, self._chunked([texts[k] for k in held]), strict=True):
                out[k] = ids
            held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.known or _OTHER(text) or self.added(text):
                out[i] = array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()
                continue
            if held and chars + len(text) > _BATCH_CHARS:
                flush()
                chars = 0
            held.append(i)
            chars += len(text)
        if held:
            flush()
        return out

    def _chunked(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are cut into pieces here."""
        marked = [_START + (_BLANKS(_INNER, t) if "  " in t or "\n \n" in t or t.endswith("\n ") else t) for t in texts]
        lists = pc.split_pattern(pa.array(marked, pa.string()), " ")
        chunks = lists.values.dictionary_encode()
        every = pa.ListArray.from_arrays([0, len(chunks.dictionary)], chunks.dictionary)
        joined = f" {pc.binary_join(every, f'{_END} ')[0]}{_END}".replace(f" {_START}", "").replace(_INNER, " ")
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, _PIECES(joined))), np.uint32)
        ends = np.flatnonzero(ids == _NO_ID)
        sizes = np.diff(ends, prepend=-1) - 1
        code = chunks.indices.to_numpy()
        n = sizes.take(code)
        stops = np.cumsum(n)
        at = np.repeat((ends - sizes).take(code) - (stops - n), n)
        at += np.arange(len(at))
        raw = ids.take(at).tobytes()
        bounds = np.append(0, 4 * stops[lists.offsets.to_numpy()[1:] - 1]).tolist()
        return [raw[a:b] for a, b in pairwise(bounds)]


def _token_rows(path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seq, at, total = Encoder.load(path), TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.int64)
        end = np.array([end_id], np.uint32).tobytes()
        for b in batches:
            found = encoder.encode(b["__text"].tolist())
            for lo in range(0, len(b), 256):
                piece = b.iloc[lo:lo + 256]
                ids = [x + end for x in found[lo:lo + 256]]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                whole = np.frombuffer(b"".join(ids), np.uint32)
                got = np.bincount(whole, minlength=len(total))
                got[:len(total)] += total
                total, wide = got, int(whole.max()) > 0xFFFF
                yield pd.DataFrame({
                    "range": np.int32(part), "seq": np.arange(seq, seq + len(ids)), "at": at + np.cumsum(n) - n,
                    "key": piece["__key"].to_numpy(), "n": n, "wide": wide,
                    "ids": ids if wide else [np.frombuffer(x, np.uint32).astype(np.uint16).tobytes() for x in ids]})
                seq, at = seq + len(ids), at + int(n.sum())
        # the range's counts by id, as a row before its first text
        yield pd.DataFrame({"range": np.int32(part), "seq": [-1], "at": 0, "key": pd.Series([None], dtype=object), "n": 0, "wide": False, "ids": [total.tobytes()]})
    return run


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if wide else np.uint16)


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for raw in b["ids"]:
            total = np.frombuffer(raw, np.int64)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"id": at, "count": total[at]})


def _block_rows(code: Code, block_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def flush():
            payload, marks = code.encode(np.concatenate([x[4] for x in held]))
            row = {"range": held[0][0], "seq": held[0][1], "at": held[0][2], "keys": [x[3] for x in held],
                   "sizes": [len(x[4]) for x in held], "payload": payload, "marks": marks}
            held.clear()
            return pd.DataFrame([row])

        size = 0
        for b in batches:
            for part, seq, at, key, wide, raw in zip(b["range"], b["seq"], b["at"], b["key"], b["wide"], b["ids"], strict=True):
                if held and (size >= block_ids or held[0][0] != part or held[-1][1] + 1 != seq):
                    yield flush()
                    size = 0
                held.append((part, seq, at, key, _ids(raw, wide)))
                size += len(held[-1][4])
        if held:
            yield flush()
    return run


def write(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id",
          end_id: int = END_ID, block_ids: int = BLOCK_IDS, limit: int = LIMIT) -> None:
    """Encode every whole text, append ``end_id`` and write the files.

    A null or empty text has the end id alone. Texts go in ascending key
    order, null keys first; rows with equal keys by a hash of the text, then
    in input order. Other columns are ignored. An empty table gives files
    without blocks. A block holds whole texts, ``block_ids`` ids or one text
    more. The counts collected have one row per id of the vocabulary."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    placed = (docs.select(F.col(key).alias("__order"), F.col(key).cast("string").alias("__key"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))
              .withColumn("__row", F.monotonically_increasing_id())
              .repartitionByRange("__order", "__hash", "__row").sortWithinPartitions("__order", "__hash", "__row")
              .select("__key", "__text"))
    head = [StructField("range", _type("int")), StructField("seq", _type("long")), StructField("at", _type("long"))]
    token_schema = StructType([*head, StructField("key", _type("string")), StructField("n", _type("long")),
                               StructField("wide", _type("boolean")), StructField("ids", _type("binary"))])
    tokens = scratch_path(spark, "token-ids")
    placed.mapInPandas(_token_rows(tokenizer, end_id), token_schema).write.option("compression", "zstd").parquet(tokens)
    stored = spark.read.schema(token_schema).parquet(tokens)
    ids = stored.where("seq >= 0")
    counts = stored.where("seq < 0").select("ids").mapInPandas(_count_rows, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    code = Code.fit(np.array([r["id"] for r in counts], np.int64), np.array([r["count"] for r in counts], np.int64), limit)
    block_schema = StructType([*head, StructField("keys", _type("array", _type("string"))), StructField("sizes", _type("array", _type("long"))),
                               StructField("payload", _type("binary")), StructField("marks", _type("array", _type("long")))])
    (ids.select("range", "seq", "at", "key", "wide", "ids").mapInPandas(_block_rows(code, block_ids), block_schema)
     .write.mode("overwrite").option("compression", "uncompressed").parquet(f"{folder}/blocks"))
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(code.ids, code.lengths, strict=True)],
                          "id long, length long").write.mode("overwrite").parquet(f"{folder}/code")
    totals = ids.groupBy("range").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    (totals.select("range", F.lit(docs.schema[key].dataType.simpleString()).alias("key_type"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
     .write.mode("overwrite").parquet(f"{folder}/ranges"))


def _type(name: str, of=None):
    from pyspark.sql import types as T
    kinds = {"int": T.IntegerType, "long": T.LongType, "boolean": T.BooleanType, "binary": T.BinaryType, "string": T.StringType}
    return T.ArrayType(of) if name == "array" else kinds[name]()


def read(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Decode the files: key, start (ids of all texts before it), n_tokens,
    ids_crc32 and, with ``with_ids``, ids, one row per text."""
    bound_arrow_batches(spark)
    blocks = spark.read.parquet(f"{folder}/blocks")
    lengths = spark.read.parquet(f"{folder}/code").collect()  # one row per id of the vocabulary
    code = spark.sparkContext.broadcast(Code(np.array([r["id"] for r in lengths], np.int64),
                                             np.array([r["length"] for r in lengths], np.int64)))
    fields = [StructField("range", _type("int")), StructField("__key", _type("string")), StructField("at", _type("long")),
              StructField("n_tokens", _type("long")), StructField("ids_crc32", _type("long"))]
    if with_ids:
        fields.append(StructField("ids", _type("array", _type("long"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 8):
                part = b.iloc[lo:lo + 8]
                found = code.value.decode(list(part["payload"]), [np.asarray(m, np.int64) for m in part["marks"]],
                                          [int(sum(s)) for s in part["sizes"]])
                rows = []
                for r, at, keys, sizes, ids in zip(part["range"], part["at"], part["keys"], part["sizes"], found, strict=True):
                    end = 0
                    for k, n in zip(keys, sizes, strict=True):
                        own = np.ascontiguousarray(ids[end:end + n], "<u4")
                        rows.append((r, k, at + end, n, zlib.crc32(own.data), *([own.astype(np.int64)] if with_ids else [])))
                        end += n
                yield pd.DataFrame(rows, columns=[f.name for f in fields]).astype({"__key": object})

    decoded = (blocks.select("range", "at", "keys", "sizes", "payload", "marks").mapInPandas(run, StructType(fields)))
    ranges = spark.read.parquet(f"{folder}/ranges")
    kind = (ranges.select("key_type").first() or ["string"])[0]
    return decoded.join(F.broadcast(ranges), "range").select(  # one row per written range
        F.col("__key").cast(kind).alias(key), (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, str(public_tokenizers.path("byte_bpe_50k.json")))
    return read(spark, folder, with_ids=False)
