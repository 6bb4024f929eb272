"""Words and places of texts as tables: later mentions of names, and a gazetteer of any size.

Both work on a positional index of words, one row a word with its place, and on equi-joins, so neither the words of a
text nor the gazetteer must fit into one task.

Defined results: null texts have no words; repeated documents have each their mentions; an empty table gives an empty
result; places are compared in small letters, the longest of those that begin at a place wins and the next is looked
for behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.detectors import GEO_CUE
from maskwright.functions.patterns import spaced
from maskwright.functions.spans import before, scan
from maskwright.operators import intervals

#: A capitalised word of three letters or more.
WORD = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}{2,}(?:-\p{Lu}\p{Ll}+)?(?![\p{L}\p{N}])"
#: A word of a place: places begin and end where such a run does.
RUN = r"[\p{L}\p{M}\p{N}_]+"
#: A gazetteer of at most this many bytes travels to every task; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Characters of a text that are searched at a time, and what is looked at before and after a place.
PART, BEHIND, AFTER = 1024, 32, 64


def word_index(docs: DataFrame, keys: list[str], pattern: str = WORD, text_col: str = "text") -> DataFrame:
    """keys, word, start and end of every match."""
    return docs.select(*keys, F.explode(scan(F.col(text_col), pattern)).alias("w")).select(*keys, F.col("w.text").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def later_mentions(docs: DataFrame, names: DataFrame, keys: list[str], excluded: tuple[str, ...] = (), pattern: str = WORD, text_col: str = "text") -> DataFrame:
    """Words of the accepted names of a document that stand elsewhere in it: keys, start, end, text.

    names: keys, start, end, text. A word counts as elsewhere where its first letter lies in no name.
    """
    own = names.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word")).distinct()
    if excluded:
        own = own.where(~F.lower("word").isin(*excluded))
    known = word_index(docs, keys, pattern, text_col).join(own, [*keys, "word"], "left_semi")
    points = known.select(*keys, "word", "start", (F.col("start") + 1).alias("end"))
    free = intervals.overlap_anti_join(points, names.select(*keys, "start", "end"), keys)
    return free.select(*keys, "start", (F.col("start") + F.length("word")).alias("end"), F.col("word").alias("text"))


def _small(table: DataFrame) -> DataFrame:
    """The table, for every task where its measured size allows that."""
    size = table.agg(F.sum(F.octet_length("place") + F.octet_length("head") + 64)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _parts(docs: DataFrame, keys: list[str], text_col: str, behind: int, ahead: int) -> DataFrame:
    """keys, own, from, part: PART characters of a text from `own` on, with those behind and ahead of them; `part` begins
    at `from`. Characters are counted from the beginning of a string, so words of a long text are cut out of its parts.
    """
    text = F.col(text_col)
    last = F.floor((F.length(text) - 1) / PART).cast("int")
    own = docs.select(*keys, text.alias("__text"), F.explode(F.when(F.length(text) > 0, F.sequence(F.lit(0), last))).alias("nth")).select(*keys, "__text", (F.col("nth") * PART).alias("own"))
    begun = own.withColumn("from", F.greatest(F.lit(0), F.col("own") - behind))
    return begun.select(*keys, "own", "from", F.substring("__text", F.col("from") + 1, F.col("own") - F.col("from") + PART + ahead).alias("part"))


def gazetteer_spans(docs: DataFrame, places: DataFrame, keys: list[str], ambiguous: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """Places of a gazetteer (column place) in the texts: keys, start, end, text.

    A place is looked for under its first word. Ambiguous ones count after a word that announces a place only, and
    not before a capitalised word.
    """
    listed = places.select(F.lower("place").alias("place")).where(F.col("place").rlike(rf"^{RUN}(?s:.*{RUN})?\z")).distinct()
    table = listed.select("place", F.regexp_extract("place", RUN, 0).alias("head"), F.length("place").alias("size"))
    longest = table.agg(F.max("size")).first()[0] or 0
    parts = _parts(docs, keys, text_col, BEHIND, longest + AFTER + 1)
    words = parts.select(*keys, "from", "own", "part", F.explode(scan(F.col("part"), RUN)).alias("w")).where((F.col("from") + F.col("w.start")).between(F.col("own"), F.col("own") + PART - 1))
    text = F.col("part")
    words = words.select(
        *keys, F.lower("w.text").alias("head"), (F.col("from") + F.col("w.start")).alias("start"), F.substring(text, F.col("w.start") + 1, F.lit(longest + 1)).alias("__ahead"),
        before(text, F.col("w"), BEHIND).alias("__behind"), F.substring(text, F.col("w.start") + 1, F.lit(longest + AFTER + 1)).alias("__beyond"),
    )
    met = words.join(_small(table), "head").where(F.lower(F.substring("__ahead", 1, F.col("size"))) == F.col("place"))
    whole = met.where(~F.substring("__ahead", F.col("size") + 1, 1).rlike(RUN))
    found = whole.select(
        *keys, "start", (F.col("start") + F.col("size")).alias("end"), F.substring("__ahead", 1, F.col("size")).alias("text"), "place",
        "__behind", F.substring("__beyond", F.col("size") + 1, AFTER).alias("__after"), F.col("start").cast("double").alias("rung"), F.lit(0).alias("seq"),
    )
    # the leftmost, of those the longest, is the ladder's order with the start as the rung
    won = intervals.arbitrated(found, keys)
    cued = F.col("__behind").rlike(GEO_CUE) & ~F.col("__after").rlike(spaced(r"^\s+\p{Lu}\p{L}+"))
    if ambiguous:
        won = won.where(~F.col("place").isin(*[a.lower() for a in ambiguous]) | cued)
    return won.select(*keys, "start", "end", "text")


def names_of(docs: DataFrame, keys: list[str], pattern: str, text_col: str = "text") -> DataFrame:
    """Matches of a pattern of names: keys, start, end, text."""
    return word_index(docs, keys, pattern, text_col).select(*keys, "start", "end", F.col("word").alias("text"))


def upper_md5(value: Column) -> Column:
    return F.upper(F.md5(value.cast("string")))
