"""Token tables of a named-entity model as spans. The model itself runs elsewhere; its tokens come as rows.

tokens: keys, chunk (start of the window), index, word, entity (B-PER, I-PER, O), score, start, end in the window.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.patterns import spaced
from maskwright.functions.scalars import informative
from maskwright.functions.spans import RUNG
from maskwright.operators.detect import _with
from maskwright.scratch import local_rows

# Windows, the usual limit of confidence, and what each label means; a label without a category is dropped.
WINDOW, OVERLAP, LIMIT = 800, 150, 0.8
LABELS = {"PER": "NAME", "ORG": "COMPANY", "LOC": "LOCATION", "GPE": "LOCATION", "MISC": None}
JOINED = ("NAME", "ADDRESS")
_BLANK = spaced(r"\s")
_WINDOWS = pa.list_(pa.struct([("chunk", pa.int32()), ("text", pa.string())]))


def windows_of(text: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Overlapping windows that begin and end at blanks where they can, and together hold every character."""
    out, start = [], 0
    while True:
        end = min(len(text), start + size)
        if end < len(text):
            cut = next((i for i in range(end - 1, start + size // 2 - 1, -1) if text[i].isspace()), None)
            end = end if cut is None else cut
        out.append((start, text[start:end]))
        if end >= len(text):
            return out
        following = end - overlap
        while following > start and not text[following - 1].isspace():
            following -= 1
        start = following if following > start else end


def windows(docs: DataFrame, keys: list[str], text_col: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """One row per window: keys, chunk, text."""
    cut = lambda text: (windows_of(text or "", size, overlap),)
    made = {"__windows": ("array<struct<chunk:int,text:string>>", _WINDOWS)}
    found = _with(docs.select(*keys, F.col(text_col).alias("__text")), ["__text"], made, lambda: cut)
    return found.select(*keys, F.explode("__windows").alias("w")).select(*keys, "w.*")


def placed(words: list[tuple[int, str]], text: str) -> list[tuple[int, int] | None]:
    """Start and end of each (index, word) in order: a continuation (##) right after the word before, others next on."""
    low = text.lower() if len(text.lower()) == len(text) else text
    out: list[tuple[int, int] | None] = []
    at, before = 0, None
    for index, word in words:
        piece = word[2:] if word.startswith("##") else word.lstrip(" \t\r\n▁")
        same = lambda i: text.startswith(piece, i) or low.startswith(piece.lower(), i)
        start = None
        if not piece:  # a token of blanks takes those that stand here
            end = at
            while end < len(text) and text[end].isspace() and end - at < len(word):
                end += 1
            start = at if end > at else None
        else:
            begin = at
            while not word.startswith("##") and begin < len(text) and text[begin].isspace():
                begin += 1
            if (before is not None and index == before + 1 or word.startswith("##")) and same(begin):
                start = begin
            elif not word.startswith("##"):
                found = text.find(piece, at)
                found = low.find(piece.lower(), at) if found < 0 else found
                start = found if found >= 0 else None
            end = (start or 0) + len(piece)
            before = index
        out.append(None if start is None else (start, end))
        if start is not None:
            at, before = end, index
    return out


def with_offsets(tokens: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """tokens with start and end where their words stand in the window's text; null where they do not."""
    listed = tokens.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("index", "word", "entity", "score"))).alias("ts"))
    find = F.udf(lambda ts, text: placed([(t["index"], t["word"]) for t in ts], text or ""), "array<struct<start:int,end:int>>", useArrow=True)
    rows = listed.join(chunks, [*keys, "chunk"]).withColumn("at", find("ts", "text"))
    rows = rows.select(*keys, "chunk", F.explode(F.arrays_zip("ts", "at")).alias("z"))
    return rows.select(*keys, "chunk", "z.ts.*", "z.at.start", "z.at.end")


def entities(tokens: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run of tokens of one type, grown to whole words: keys, chunk, label, score, start, end, text.

    Gaps and islands over the order of tokens. A token opens a run unless it continues the one before: I- or ##, the
    same type, the next index, and both have a place.
    """
    order = Window.partitionBy(*keys, "chunk").orderBy("index")
    label = F.when(F.col("entity").contains("-"), F.substring_index("entity", "-", -1))
    rows = tokens.withColumn("label", F.when(F.col("start").isNotNull(), label))
    inner = F.col("entity").startswith("I-") | F.col("word").startswith("##")
    follows = inner & (F.lag("label").over(order) == F.col("label")) & (F.lag("index").over(order) == F.col("index") - 1)
    runs = rows.withColumn("run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order)).filter("label is not null")
    whole = runs.groupBy(*keys, "chunk", "run", "label").agg(F.avg("score").alias("score"), F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.join(chunks, [*keys, "chunk"])
    word = r"[\p{L}\p{M}\p{N}]*"
    before = F.length(F.regexp_extract(F.substring("text", F.lit(1), F.col("start")), word + r"\z", 0))
    after = F.length(F.regexp_extract(F.substring("text", F.col("end") + 1, F.length("text")), r"\A" + word, 0))
    whole = whole.withColumn("start", F.col("start") - before).withColumn("end", F.col("end") + after)
    return whole.select(*keys, "chunk", "label", "score", "start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def merged(found: DataFrame, keys: list[str]) -> DataFrame:
    """Entities of all windows at their place in the document; of those that overlap the longer one, then the surer."""
    moved = found.select(*keys, "label", "score", (F.col("start") + F.col("chunk")).alias("start"), (F.col("end") + F.col("chunk")).alias("end"), "text")
    ranked = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("l"), (-F.col("score")).alias("s"), "start", "end", "label", "score", "text")))
    none = F.array().cast("array<struct<l:int,s:double,start:int,end:int,label:string,score:double,text:string>>")

    def take(kept: Column, e: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < e["end"]) & (e["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(e)))

    rows = moved.groupBy(*keys).agg(ranked.alias("es")).select(*keys, F.explode(F.aggregate("es", none, take)).alias("e"))
    return rows.select(*keys, *[F.col(f"e.{c}").alias(c) for c in ("label", "score", "start", "end", "text")])


def spans(found: DataFrame, docs: DataFrame, keys: list[str], labels: dict[str, str | None] = LABELS, limits: dict[str, float] | None = None, text_col: str = "text") -> DataFrame:
    """Candidates of the model: known labels only, unsure ones switched off and on the last rung; neighbours that make
    one name or address, with nothing but blanks between, are joined."""
    policy = local_rows(found.sparkSession, [(k, v, (limits or {}).get(v, LIMIT)) for k, v in labels.items() if v], "label string, category string, limit double")
    rows = found.join(F.broadcast(policy), "label").filter(informative(F.col("text"), F.col("category"))).withColumn("enabled", F.col("score") >= F.col("limit"))
    rows = rows.drop("text").join(docs.select(*keys, F.col(text_col).alias("whole")), keys)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    gap = F.substring("whole", F.lag("end").over(order) + 1, F.col("start") - F.lag("end").over(order))
    joins = (
        F.col("category").isin(*JOINED) & (F.lag("category").over(order) == F.col("category")) & (F.lag("enabled").over(order) == F.col("enabled")) & gap.rlike(r"^[ \t]*\z")
    )
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order))
    one = rows.groupBy(*keys, "run", "category", "enabled").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("confidence"), F.first("whole").alias("whole"))
    return one.select(
        *keys, "start", "end", "category", F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "confidence",
        F.lit("ner").alias("source"), F.when(F.col("enabled"), RUNG["NER"]).otherwise(RUNG["NER_LOW"]).alias("rung"), "enabled",
    )


def shrink(size: int, tokens: int, most: int = 512, least: int = 100) -> int:
    """The size of a window after its text took too many tokens; at least `least`."""
    return max(least, int(size * 0.7)) if tokens > most else size
