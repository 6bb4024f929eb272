"""One spelling of regular expressions for Spark's columns, Python and SQL.

Patterns of this package are Java's, with white space as JavaScript means it: the ASCII blanks, no-break and other
spaces of all scripts. `spaced` spells that out, `python` gives the same pattern to Python's own engine.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

#: What counts as white space, for use inside brackets.
BLANKS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def _each(pattern: str, put) -> str:
    """The pattern with put(escape, whether inside brackets) in place of every escape."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            end = pattern.index("}", at) + 1 if pattern[at + 1] in "pP" else at + 2
            out.append(put(pattern[at:end], inside))
            at = end
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside and out[-1] not in ("[", "[^"):
            inside = False
        if c == "^" and out and out[-1] == "[":
            out[-1] = "[^"
        else:
            out.append(c)
        at += 1
    return "".join(out)


def spaced(pattern: str) -> str:
    r"""The pattern with \s spelled out, for Java and Python."""
    return _each(pattern, lambda e, inside: (BLANKS if inside else f"[{BLANKS}]") if e == r"\s" else e)


def sql(pattern: str) -> str:
    r"""A pattern without look-around for SQL engines that write code points as \x{...}."""
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)


@lru_cache(maxsize=1024)
def python(pattern: str) -> regex.Pattern:
    r"""The pattern for Python: digits ASCII, blanks spelled out, \z as the end."""

    def put(escape: str, inside: bool) -> str:
        if escape in (r"\d", r"\s"):
            own = "0-9" if escape == r"\d" else BLANKS
            return own if inside else f"[{own}]"
        return {r"\z": r"\Z", r"\D": "[^0-9]"}.get(escape, escape)

    return regex.compile(_each(pattern.removeprefix("(?iu)"), put), regex.I if pattern.startswith("(?iu)") else 0)


def any_of(words: list[str] | tuple[str, ...]) -> str:
    """A pattern of literal words that always takes the longest; words with common beginnings share them."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def spell(node: dict) -> str:
        branches = [(re.escape(c).replace(r"\ ", " ") + spell(child)) for c, child in node.items() if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return f"{body}?" if "" in node else body

    return spell(tree) or "(?!)"
