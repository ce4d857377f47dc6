"""Scalar text functions as JVM-side column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() treats as whitespace
# (str.isspace): tab, LF, VT, FF, CR, the four information separators
# U+001C..U+001F, space, NEL, NBSP, OGHAM SPACE MARK, U+2000..U+200A,
# LINE SEPARATOR, PARAGRAPH SEPARATOR, NNBSP, MMSP, IDEOGRAPHIC SPACE.
PY_WS_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
PY_WS_CHARS = "".join(map(chr, [*range(9, 14), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                                0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))

# Sentence count per file size, by line count.
# fewer than 30 lines -> 2 sentences, fewer than 150 -> 4, otherwise 6.
SENTENCE_STEPS = ((30, 2), (150, 4))
SENTENCE_DEFAULT = 6


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.btrim(_c(col), F.lit(PY_WS_CHARS))


def blank_to_null(col) -> Column:
    """``x.strip() or None``."""
    s = py_strip(col)
    return F.when(s != "", s)


def utf8_text(content) -> Column:
    """Decode bytes as UTF-8, replacing invalid sequences (errors='replace')."""
    return F.make_valid_utf8(_c(content).cast("string"))


def line_count(text) -> Column:
    """``text.count('\\n') + 1`` computed on bytes (LF is one byte)."""
    t = _c(text)
    return (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("int")


def sentence_count(n_lines) -> Column:
    """Sentence budget for a description from the file's line count."""
    n = _c(n_lines)
    expr = None
    for bound, sentences in SENTENCE_STEPS:
        expr = (F.when(n < bound, F.lit(sentences)) if expr is None
                else expr.when(n < bound, F.lit(sentences)))
    return expr.otherwise(F.lit(SENTENCE_DEFAULT))


# A sentence for the stand-in description: starts at a non-space character
# and runs to the next run of . ! or ? (or to the end of the text). Every
# attempt succeeds from its first character, so matching is linear.
SENTENCE_PATTERN = r"[^.!?\t\n\x0b\f\r ][^.!?]*(?:[.!?]+|\z)"


def sentences(text) -> Column:
    """The sentences of the whole text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(SENTENCE_PATTERN), 0)


def longest(found: Column, n) -> Column:
    """The ``n`` longest strings (bytes; ties to the earlier one), in order.
    Sorted are numbers, place - 2^32 * size, by the natural order."""
    n = _c(n)

    def pick(xs: Column) -> Column:
        ranked = F.sort_array(F.transform(xs, lambda s, i: i.cast("long") - F.shiftleft(F.octet_length(s).cast("long"), 32)))
        places = F.sort_array(F.transform(F.slice(ranked, F.lit(1), n), lambda k: k.bitwiseAND(F.lit(2**32 - 1)).cast("int")))
        return F.transform(places, lambda i: F.get(xs, i))
    # bound to a variable, so that it is evaluated once
    return F.get(F.transform(F.array(found), pick), F.lit(0))


def joined(found: Column) -> Column:
    return F.array_join(found, " ")


def salient_sentences(text, n) -> Column:
    """Deterministic stand-in description: the ``n`` longest sentences of the
    whole text, in text order, joined by single spaces ('' without any)."""
    return joined(longest(sentences(text), n))


def longest_line(text) -> Column:
    """The longest line of the whole text, the first among equals."""
    return F.element_at(longest(F.split(_c(text), "\n"), F.lit(1)), 1)


def sha256_hex(content) -> Column:
    """SHA-256 hex digest of the bytes (strings hash as UTF-8)."""
    return F.sha2(_c(content), 256)


def estimate_tokens(text) -> Column:
    """Token estimate used for usage accounting: ceil(utf8 bytes / 4)."""
    t = _c(text)
    return F.floor((F.coalesce(F.octet_length(t), F.lit(0)) + 3) / 4).cast("bigint")
