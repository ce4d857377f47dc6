"""Gitignore-style path patterns as regular expressions, evaluated as
``rlike`` column predicates (JVM side) or matched in Python by the tree reader.

The published rules, as applied to file paths:

- blank lines and lines starting with ``#`` say nothing; trailing blanks go
  unless escaped; a backslash makes the next character literal
- ``!`` in front takes matching paths out again; the last matching rule decides
- a slash at the start or inside binds the rule to the root, otherwise it
  matches at any depth; a slash at the end matches folders only, that is the
  files below them
- ``*``, ``?`` and ``[...]`` match within one name; ``**`` as a whole name
  matches any number of folders, and at the end everything below
- a rule that matches a folder matches what is below it
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    regex: str      # for the whole path, newlines in names included
    include: bool
    source: str

    def matches(self, path: str) -> bool:
        return re.fullmatch(self.regex, path) is not None


# what a pattern is made of, in order of precedence
_PIECES = re.compile(r"""
    (?P<folders>(?:^|(?<=/))\*\*/)      # any number of folders
  | (?P<below>(?<=/)\*\*$)              # everything below
  | (?P<run>\*+)
  | (?P<one>\?)
  | \[(?P<negated>[!^]?)(?P<chars>\]?[^\]]*)\]
  | \\(?P<escaped>.)
  | (?P<plain>.)
""", re.X | re.S)


def _quote(ch: str) -> str:
    """A literal character for Java, Python and RE2 regexes alike."""
    return "\\" + ch if ch in ".^$*+?()[]{}|\\" else ch


def _piece(m: re.Match) -> str:
    kind = m.lastgroup
    if kind == "folders":
        return "(?:[^/]+/)*"
    if kind == "below":
        return ".+"
    if kind == "run":
        return "[^/]*"
    if kind == "one":
        return "[^/]"
    if kind == "chars":
        body = m["chars"].replace("\\", r"\\").replace("[", r"\[").replace("]", r"\]")
        return f"(?!/)[{'^' if m['negated'] else ''}{body}]" if body else ""
    return _quote(m["escaped"] or m["plain"])


def compile_pattern(pattern: str) -> Rule | None:
    """The rule of one line; None for blank lines and comments."""
    text = re.sub(r"(?<!\\) +$", "", pattern.rstrip("\t\r\n"))
    if not text or text.startswith("#"):
        return None
    include = not text.startswith("!")
    body = text if include else text[1:]
    folder = body.endswith("/")
    body = body.removesuffix("/")
    rooted, body = "/" in body, body.removeprefix("/")
    if not body:
        return None
    inner = "".join(_piece(m) for m in _PIECES.finditer(body))
    return Rule(f"(?s){'' if rooted else '(?:.*/)?'}{inner}{'/.+' if folder else '(?:/.*)?'}", include, pattern)


def compile_patterns(patterns: list[str] | tuple[str, ...]) -> list[Rule]:
    if isinstance(patterns, str) or not all(isinstance(p, str) for p in patterns):
        raise TypeError("patterns must be a list of strings")
    return [r for p in patterns if (r := compile_pattern(p))]


def selected(rules: list[Rule], path: str) -> bool:
    """The last matching rule decides; no match is False."""
    return next((r.include for r in reversed(rules) if r.matches(path)), False)


def matches(path, patterns) -> Column:
    """``selected`` as a column."""
    c = F.col(path) if isinstance(path, str) else path
    rules = compile_patterns(patterns)
    if not rules:
        return F.lit(False)
    return F.coalesce(*[F.when(c.rlike(f"^(?:{r.regex})\\z"), r.include) for r in reversed(rules)], F.lit(False))


def select_paths(path, include, exclude=()) -> Column:
    """Include patterns, then exclude patterns (an empty exclude list excludes
    nothing)."""
    keep = matches(path, include)
    return keep & ~matches(path, exclude) if exclude else keep
