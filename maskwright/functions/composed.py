"""Canonical composition of texts in Catalyst expressions.

The tables come from the character database of Python by rule: pairs that compose, what letters decompose into, and the
classes that order marks. A text without marks is only searched for one; in others, a letter with its marks is looked up
as it stands, and only rare sequences (several marks, marks behind a composed letter) are decomposed, ordered and
composed mark by mark.

Defined results: null stays null; marks without a letter stay; Hangul jamo, signs of class 0 (dependent vowels of Indic
scripts) and characters beyond the basic plane are left as they are.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_ALL = 2**31 - 1
_HANGUL = range(0xAC00, 0xD7A4)


def _plane() -> list[str]:
    return [chr(i) for i in range(0x80, 0x10000) if i not in _HANGUL and not 0xD800 <= i < 0xE000]


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, int], str, str]:
    """What composes, what decomposes, classes of marks, and characters that become another one with that one."""
    composes, decomposes, classes, alone = {}, {}, {}, []
    for c in _plane():
        if rank := unicodedata.combining(c):
            classes[c] = rank
        whole = unicodedata.normalize("NFD", c)
        if whole == c:
            continue
        if len(whole) > 1:
            decomposes[c] = whole
        once = unicodedata.decomposition(c).split()
        if len(once) == 2 and unicodedata.normalize("NFC", c) == c and unicodedata.combining(chr(int(once[1], 16))):
            composes["".join(chr(int(x, 16)) for x in once)] = c
        elif unicodedata.normalize("NFC", c) != c and len(unicodedata.normalize("NFC", c)) == 1:
            alone.append(c)
    return composes, decomposes, classes, "".join(alone), "".join(unicodedata.normalize("NFC", c) for c in alone)


@lru_cache(maxsize=1)
def marks() -> str:
    """A character class of all marks that have an order."""
    return _class(_tables()[2])


def _class(chars, negated: bool = False) -> str:
    """The class of the characters, or of all others. What lies below the first of them is settled by one comparison:
    a class of some hundred ranges is searched range by range, for every letter of a text.
    """
    codes = set(map(ord, chars))
    starts = sorted(c for c in codes if c - 1 not in codes)
    ends = sorted(c for c in codes if c + 1 not in codes)
    ranges = "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in zip(starts, ends))
    return f"[\\u0000-\\u{starts[0] - 1:04X}[^{ranges}]]" if negated else f"[\\u{starts[0]:04X}-\\uFFFF&&[{ranges}]]"


def _table(values: dict) -> Column:
    """A map as one literal."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in values.items())), F.lit("\x01"), F.lit("\x02"))


def composed(text: Column) -> Column:
    """text with letters and their marks in one character where there is one, marks in canonical order."""
    composes, decomposes, classes, alone, becomes = _tables()
    mark = marks()
    pairs, parts, ranks = _table(composes), _table(decomposes), _table(classes)
    letters = "(?s)(?<=.)(?=.)"
    rest = _class(classes, negated=True)

    def sequence(run: Column) -> Column:
        """A letter and marks: decomposed, ordered, then each mark taken in unless one of its class stands between."""
        apart = F.array_join(F.transform(F.split(run, letters), lambda c: F.coalesce(F.element_at(parts, c), c)), "")
        chars = F.split(apart, letters)
        ordered = F.array_sort(F.transform(F.slice(chars, 2, F.size(chars) - 1), lambda c, i: F.struct(F.element_at(ranks, c).cast("int").alias("rank"), i.alias("i"), c.alias("c"))))
        start = F.struct(F.get(chars, F.lit(0)).alias("letter"), F.lit("").alias("left"), F.lit(0).alias("rank"))

        def step(done: Column, m: Column) -> Column:
            whole = F.when(done["rank"] < m["rank"], F.element_at(pairs, F.concat(done["letter"], m["c"])))
            return F.when(whole.isNotNull(), F.struct(whole.alias("letter"), done["left"].alias("left"), done["rank"].alias("rank"))).otherwise(
                F.struct(done["letter"].alias("letter"), F.concat(done["left"], m["c"]).alias("left"), m["rank"].alias("rank"))
            )

        return F.aggregate(ordered, start, step, lambda done: F.concat(done["letter"], done["left"]))

    marked = lambda r: r.rlike(f"(?s)^{rest}{mark}")
    put = lambda r: F.when(r.rlike(f"^{mark}"), F.substring(sequence(F.concat(F.lit("."), r)), 2, _ALL)).when(~marked(r), r).otherwise(F.coalesce(F.element_at(pairs, r), sequence(r)))

    def joined(text: Column) -> Column:
        """A letter with marks, or a run of characters without: each is kept or looked up."""
        runs = F.regexp_extract_all(text, F.lit(f"(?s){rest}{mark}+|(?:{rest}(?!{mark}))++|{mark}+"), F.lit(0))
        return F.when(text.rlike(mark), F.array_join(F.transform(runs, put), "")).otherwise(text)

    def whole(given: Column) -> Column:
        """Most texts hold no character that could change: one search of one range settles that."""
        alike = F.when(given.rlike(_class(alone)), F.translate(given, alone, becomes)).otherwise(given)
        return F.when(given.rlike("[\u0300-\uFAD9]"), F.transform(F.array(alike), joined)[0]).otherwise(given)

    # variables of functions, or every use of the text would work out again how it is made
    return F.transform(F.array(text), whole)[0]
