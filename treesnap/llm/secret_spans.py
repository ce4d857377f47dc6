"""Secrets in texts: three plain patterns, and what a conditional random field
(``secret_crf``) adds to them.

The field learns from a bounded sample of texts. What the patterns find there is
tagged; as that alone would teach the patterns' own alphabets, each sampled
stretch is also learned with a drawn secret put into it, in the manner of
settings, headers and bare keys, and with drawn harmless look-alikes."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesnap.llm import secret_crf as crf
from treesnap.llm.common import table
from treesnap.session import bound_arrow_batches

KINDS = ("assign", "access", "hex", "crf")   # order of spans that start together
SPANS = "array<struct<kind:string,start:long,end:long>>"
SAMPLE = 1200      # texts learned from, at most: half of them with a pattern's match
THINNED = 40_000   # rows looked at for them, about
LEARNED = 200_000  # characters of each that are learned from, at most
_MARGIN = 90       # characters kept on both sides of what is learned
_BATCH = 1 << 20   # bytes decoded at once, or one text more

# fixed values: the base patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_VALUE = 12
_HINT = r"(?i)passw|secret|token|api_?key|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the patterns, in code points, by start and kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    # a match of these two patterns ends with its run, so that shorter ones need not be visited
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _values(text: str) -> list[tuple[int, int]]:
    """The secrets themselves in what the patterns match, without numbers."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= _VALUE]
    found += [m.span() for p in (_ACCESS, _HEX) for m in p.finditer(text) if not m[0].isdigit()]
    kept: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if not kept or s >= kept[-1][1]:
            kept.append((s, e))
    return kept


def _draw(rng: random.Random, alphabet: str, lo: int, hi: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(lo, hi)))


def _secret(rng: random.Random) -> tuple[str, str, str]:
    """What stands before a drawn secret, the secret, and what stands behind it."""
    plain, lower = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    bare = [lambda: rng.choice(["ghp_", "gho_", "npm_", "pat_", "sk_live_", "rk_test_", "xoxb-", "sk-"]) + _draw(rng, plain, 20, 40),
            lambda: _draw(rng, plain + "+/", 32, 64) + rng.choice(["", "=", "=="]), lambda: _draw(rng, string.hexdigits[:16].upper(), 32, 64),
            lambda: "eyJ" + _draw(rng, plain, 15, 40) + "." + _draw(rng, plain + "_-", 20, 60) + "." + _draw(rng, plain + "_-", 20, 43),
            lambda: "AIza" + _draw(rng, plain + "_-", 35, 35), lambda: _draw(rng, plain, 28, 48), lambda: "AKIA" + _draw(rng, string.ascii_uppercase + string.digits, 16, 16),
            lambda: _draw(rng, "0123456789abcdef", 24, 64), lambda: _draw(rng, lower, 24, 40)]
    short = [lambda: _draw(rng, string.ascii_lowercase, 3, 8) + _draw(rng, string.digits, 1, 4) + rng.choice(["", "!", "#", "$", "!!"]),
             lambda: _draw(rng, plain + "!#$%&*@^~", 8, 18), lambda: _draw(rng, plain, 8, 11)]
    if rng.random() < 0.5:
        value, quote = rng.choice(bare)(), rng.choice(["", "", "'", '"', "`"])
        return quote, value, quote
    name = rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "client_secret", "access_token", "auth", "private_key", "DB_PASSWORD", "SECRET_KEY"])
    name = rng.choice([name, name.upper(), name.capitalize()])
    quote = rng.choice(["", '"', "'"])
    before = rng.choice([f"{name}={quote}", f"{name}: {quote}", f"{name} = {quote}", f'"{name}": {quote}', f"Authorization: Bearer {quote}", f"export {name}={quote}", f"{name} := {quote}"])
    return before, rng.choice(bare + short + short)() if "Bearer" not in before else rng.choice(bare)(), quote


def _harmless(rng: random.Random, background: str) -> str:
    """Drawn text that only looks like a secret."""
    words = [w for w in background.split() if w.isalpha()] or ["plain"]
    digits = lambda lo, hi: _draw(rng, string.digits, lo, hi)
    return rng.choice([
        lambda: f"{digits(4, 4)}-{digits(2, 2)}-{digits(2, 2)}", lambda: f"{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}", lambda: digits(5, 16),
        lambda: f"+{digits(1, 2)} ({digits(3, 3)}) {digits(3, 3)}-{digits(4, 4)}", lambda: ".".join(digits(1, 3) for _ in range(4)),
        lambda: f"{rng.choice(words)}.{digits(1, 3)}@{rng.choice(words).lower()}.example.com", lambda: f"https://{rng.choice(words).lower()}.example.org/{rng.choice(words)}/{digits(2, 6)}",
        lambda: "_".join(rng.choices(words, k=3)).lower(), lambda: "".join(w.capitalize() for w in rng.choices(words, k=3)), lambda: "-".join(rng.choices(words, k=4)),
        lambda: "".join(rng.choices(words, k=4)), lambda: f"{rng.choice(['the password', 'a token', 'your secret', 'the api key'])} {' '.join(rng.choices(words, k=3))}",
        lambda: f"{rng.choice(['password', 'token', 'secret'])}: {rng.choice(words)}", lambda: f"{digits(1, 3)},{digits(3, 3)}.{digits(2, 2)}", lambda: rng.choice(words).upper() + digits(1, 3)])()


def lessons(texts: list[str], seed: int = 5) -> list[tuple[bytes, list[tuple[int, int]], list[int]]]:
    """Short stretches of the texts as they are, with a drawn secret and with a
    drawn look-alike: bytes, byte spans of the secrets, features of the file."""
    import numpy as np
    rng, out = random.Random(seed), []

    def add(parts: list[tuple[str, bool]], file: list[int]) -> None:
        raw, spans = b"", []
        for part, secret in parts:
            own = part.encode("utf-8", "surrogatepass")
            if secret:
                spans.append((len(raw), len(raw) + len(own)))
            raw += own
        out.append((raw, spans, file))

    def marked(text: str) -> list[tuple[str, bool]]:
        parts, at = [], 0
        for s, e in _values(text):
            parts += [(text[at:s], False), (text[s:e], True)]
            at = e
        return [*parts, (text[at:], False)]

    for text in texts:
        buf = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        file = crf.file_features(buf, crf.tokens(buf)[0])
        places = [s for s, _ in _values(text)][:2] or [rng.randrange(len(text) + 1)]
        for place in places:
            # whole words; a secret cut by the margin is not one
            lo, hi = text.find(" ", max(0, place - _MARGIN)), text.rfind(" ", 0, place + _MARGIN + 60)
            part = text[lo + 1 if 0 <= lo < place else place:hi if hi > place else len(text)][:2000]
            add(marked(part), file)
        lo = rng.randrange(len(text) + 1)
        lo = max(0, text.find(" ", lo))
        part = text[lo:lo + 2 * _MARGIN]
        for copy in range(3):
            cuts = [i for i, c in enumerate(part) if c in " \n"] or [0, len(part)]
            at = rng.choice(cuts)
            left, right = marked(part[:at] + rng.choice([" ", "\n"])), marked(rng.choice([" ", "\n", ", ", ". "]) + part[at:].lstrip(" "))
            if copy == 2:
                add([*left, (_harmless(rng, part), False), *right], file)
            else:
                before, value, after = _secret(rng)
                add([*left, (before, False), (value, True), (after, False), *right], file)
    return out


def learning_sample(docs: DataFrame, text: str, rows: int = SAMPLE, thinned: int = THINNED, chars: int = LEARNED) -> list[str]:
    """Up to ``rows`` texts, half of them with a hint of a secret, the first by a
    hash of the text, each once; looked for in about ``thinned`` rows that a
    hash draws from all. Of a longer text the first ``chars`` characters are
    learned from, so that the driver holds rows * chars at most; spans are
    looked for in whole texts."""
    total = docs.where(F.col(text).isNotNull()).count()
    rank = F.xxhash64(F.col(text))
    drawn = (docs.select(F.col(text).alias("text"), rank.alias("rank")).where(F.pmod(rank, F.lit(1 << 30)) < F.lit((thinned << 30) / max(1, total)))
             .where(F.length(F.trim("text")) > 0))
    parts = [drawn.where(hint).distinct().orderBy("rank", "text").limit(rows // 2)
             for hint in (F.col("text").rlike(_HINT), ~F.col("text").rlike(_HINT))]
    return [r["text"] for p in parts for r in p.select(F.substring("text", 1, chars).alias("text")).collect()]


def train(docs: DataFrame, text: str = "text", rows: int = SAMPLE) -> dict:
    """Weights from at most ``rows`` texts; without any, of a field that adds nothing."""
    return crf.fit(lessons(learning_sample(docs, text, rows)))


def find_secrets(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and spans: kind, start and end (code points, end
    exclusive) of what the patterns find and of what the field adds where no
    pattern matches (kind ``crf``), by start and the order of ``KINDS``.

    Null, empty and blank texts have no spans. Equal texts get equal spans; of
    equally likely taggings one fixed choice is made. Texts count whole whatever
    their length. One row per input row; an empty table gives an empty one.
    Columns that are not kept are ignored, whatever their names."""
    bound_arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a few MB, of fixed size
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], f"spans {SPANS}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = crf.Tagger(shared.value)
        for b in batches:
            texts, own, lo = b["__text"].tolist(), b.drop(columns="__text"), 0
            while lo < len(texts):
                raw, size, hi = [], 0, lo
                while hi < len(texts) and size < _BATCH:
                    raw.append((texts[hi] or "").encode("utf-8", "surrogatepass"))
                    size += len(raw[-1])
                    hi += 1
                spans = []
                for t, r, added in zip(texts[lo:hi], raw, tagger(raw), strict=True):
                    base = base_spans(t or "")
                    for s, e in added:
                        s, e = (len(r[:x].decode("utf-8", "surrogatepass")) for x in (s, e))
                        if all(e <= lo_ or s >= hi_ for _, lo_, hi_ in base):
                            base = [*base, ("crf", s, e)]
                    base.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                    spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                yield own.iloc[lo:hi].assign(spans=pd.Series(spans, dtype=object).to_numpy())
                lo = hi

    return docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text")).mapInPandas(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(find_secrets(docs, train(docs)))
