"""Spans as nested arrays: scanning, arbitration and substitution in Catalyst expressions.

Offsets count code points and are half-open. A span is a struct with the fields of SPAN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = (
    "struct<start:int,end:int,category:string,text:string,confidence:double,source:string,rung:double,"
    "pack:string,enabled:boolean,shield:boolean>"
)
_MATCH = "struct<start:int,end:int,text:string>"
#: Matches that are placed in one array before it is joined to the others.
_CHUNK = 128
# The priority ladder; lower wins.
RUNG = {
    "DICTIONARY": 0.0, "SHIELD": 1.0, "VALIDATED_REGEX": 2.0, "ID_CODE": 3.0, "INVALID_ID": 3.5, "MONEY": 3.7, "ADDRESS": 4.0,
    "COMPANY": 5.0, "NER": 5.5, "LOCATION": 5.7, "NAME": 6.0, "COMPANY_ACRONYM": 7.0, "NER_LOW": 8.0,
}


def scan(text: Column, pattern: str, group: int = 0, gate: Column | None = None) -> Column:
    """Matches as structs start, end, text; group 1 must end where the match ends.

    gate is a cheap test that every text with a match passes.
    """
    p = F.lit(pattern)
    named = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("m")]
    if group:
        named.append(F.regexp_extract_all(text, p, F.lit(group)).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["gap"]) + F.length(x["m"])
        taken = x["g"] if group else x["m"]
        one = F.struct((end - F.length(taken)).alias("start"), end.alias("end"), taken.alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(pairs: Column) -> Column:
        """Some matches at a time, as appending to an array copies it."""

        def chunk(done: Column, i: Column) -> Column:
            at = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0))
            start = F.struct(at.alias("at"), F.array().cast(f"array<{_MATCH}>").alias("out"))
            return F.concat(done, F.array(F.aggregate(F.slice(pairs, i * _CHUNK + 1, F.lit(_CHUNK)), start, step)))

        none = F.array().cast(f"array<struct<at:int,out:array<{_MATCH}>>>")
        return F.flatten(F.transform(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _CHUNK).cast("int")), none, chunk), lambda r: r["out"]))

    # a variable of the function, or every chunk would search the text anew; the last gap has no match behind it
    pairs = F.filter(F.arrays_zip(*named), lambda x: x["m"].isNotNull())
    found = F.transform(F.array(pairs), placed)[0]
    # most texts have no match: one search settles that
    some = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(some, found).otherwise(F.array().cast(f"array<{_MATCH}>"))


def before(text: Column, span: Column, n: int) -> Column:
    """The last n characters before a span."""
    return F.substring(text, F.greatest(F.lit(1), span["start"] - (n - 1)), F.least(span["start"], F.lit(n)))


def emit(found: Column, category: str, rung: float, confidence: float = 1.0, pack: str = "common", enabled: bool = True, shield: bool = False) -> Column:
    """Spans of SPAN for scanned matches."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].cast("int").alias("start"),
            m["end"].cast("int").alias("end"),
            F.lit(category).alias("category"),
            m["text"].alias("text"),
            F.lit(float(confidence)).alias("confidence"),
            F.lit("regex").alias("source"),
            F.lit(float(rung)).alias("rung"),
            F.lit(pack).alias("pack"),
            F.lit(enabled).alias("enabled"),
            F.lit(shield).alias("shield"),
        ),
    )


def arbitrate(spans: Column) -> Column:
    """The non-overlapping winners by rung, length, start and order of production, sorted by start.

    Spans are ranked by the ladder and accepted one at a time; quadratic in the spans of one text.
    """
    ranked = F.array_sort(
        F.transform(
            spans,
            lambda s, i: F.struct(s["rung"].alias("r"), (s["start"] - s["end"]).alias("l"), s["start"].alias("b"), i.alias("i"), s.alias("s")),
        )
    )
    none = F.array().cast(f"array<{SPAN}>")

    def take(kept: Column, x: Column) -> Column:
        s = x["s"]
        clash = F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    return F.array_sort(F.aggregate(ranked, none, take))


def substitute(text: Column, spans: Column) -> Column:
    """text with each of the sorted, non-overlapping spans (start, end, put) replaced by its put."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, s["put"])).alias("parts"))

    return F.aggregate(
        spans,
        start,
        step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
