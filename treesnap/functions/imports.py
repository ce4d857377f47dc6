"""Dependency extractors: column expressions keyed by file extension.

A parser registry maps a lower-case extension (without the dot) to a function
``Column(content) -> Column(array<string>)``. The built-in ones are regexes
that run JVM side. Later registrations win on an extension conflict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesnap.functions.text import PY_WS_CLASS

# Fixed value: relative import targets in JS/TS sources. A quoted path starting
# with '.' or '/' directly after `from`, a bare `import`, or `require(`.
# Whitespace is Python's (see PY_WS_CLASS).
JS_IMPORT_PATTERN = (r"""(?:from{ws}*|import{ws}*|require{ws}*\({ws}*)['"]([./][^'"]+)['"]"""
                     .replace("{ws}", PY_WS_CLASS))

# Fixed value: site-relative links in HTML pages.
HREF_PATTERN = r'href="(/[^"]+)"'

# Extensions handled by the built-in parsers.
JS_PARSER_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
PY_PARSER_EXTENSIONS = (".py",)

Parser = Callable[[Column], Column]


def js_imports(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(JS_IMPORT_PATTERN), 1)


def href_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF_PATTERN), 1)


# Comments and string literals of Python sources, longest quotes first. The
# runs are possessive, so long literals cost no stack and no backtracking.
PY_SKIPPED = (r"""(?s)(\"{3}|'{3}).*?(?:\1|\z)|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"?"""
              r"""|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|#[^\n]*+""")
PY_STATEMENT = r"(?m)(?:^|[;:])[ \t\f]*+(import[ \t]+[^\n;]+|from(?:[ \t]+|(?=\.))[^\s;()#]+(?=[ \t]+import\b))"


def py_imports(content: Column) -> Column:
    """Modules imported by a Python source, in text order: ``import a.b, c``
    gives 'a.b' and 'c', ``from ..x import y`` gives '..x', ``from . import
    z`` nothing. Extraction is lexical: comments and string literals are
    blanked and statements found by pattern, so a source that does not parse
    still gives its well-formed import lines."""
    code = F.regexp_replace(F.regexp_replace(content, PY_SKIPPED, '""'), r"\\\r?\n", " ")
    statements = F.regexp_extract_all(code, F.lit(PY_STATEMENT), 1)
    names = F.flatten(F.transform(statements, lambda s: F.when(
        s.startswith("import"), F.transform(F.split(F.regexp_replace(s, r"^import[ \t]+", ""), ","),
                                            lambda x: F.regexp_extract(x, r"^[\s(]*([^\s,;()]+)", 1)))
        .otherwise(F.array(F.regexp_replace(s, r"^from[ \t]*", "")))))
    return F.filter(names, lambda x: ~x.rlike(r"^\.*$"))


def default_parsers() -> dict[str, Parser]:
    reg: dict[str, Parser] = {}
    for ext in PY_PARSER_EXTENSIONS:
        reg[ext.lstrip(".").lower()] = py_imports
    for ext in JS_PARSER_EXTENSIONS:
        reg[ext.lstrip(".").lower()] = js_imports
    return reg


def build_registry(extra: dict[str, Parser] | None = None) -> dict[str, Parser]:
    """Default parsers plus extras; extras override by extension."""
    reg = default_parsers()
    for ext, fn in (extra or {}).items():
        reg[ext.lower().lstrip(".")] = fn
    return reg


def extract(ext: Column, content: Column, registry: dict[str, Parser]) -> Column:
    """Dispatch on the extension column; files without a parser give NULL.
    Each parser sees only its own rows' content (NULL elsewhere), so a pandas
    UDF parser ships nothing but NULLs for files of other languages."""
    by_parser: dict[int, tuple[Parser, list[str]]] = {}
    for e, fn in registry.items():
        by_parser.setdefault(id(fn), (fn, []))[1].append(e)
    expr = None
    for fn, exts in by_parser.values():
        hit = ext.isin(exts)
        val = fn(F.when(hit, content))
        expr = F.when(hit, val) if expr is None else expr.when(hit, val)
    return expr if expr is not None else F.lit(None).cast("array<string>")
