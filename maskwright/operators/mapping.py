"""From spans to mappings, and from mappings to masked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.spans import substitute


def render(text: Column, mappings: Column, put=None) -> Column:
    """text with the enabled mappings applied at their occurrences; stale anchors are left alone."""
    put = put or (lambda m: m["placeholder"])
    live = F.filter(mappings, lambda m: m["enabled"])
    spots = F.flatten(
        F.transform(live, lambda m: F.transform(m["occurrences"], lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), put(m).alias("put"), o["text"].alias("was"))))
    )
    fresh = F.filter(spots, lambda s: (s["start"] >= 0) & (F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["was"]))
    return substitute(text, F.array_sort(fresh))


def mapping_rows(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per mapping."""
    return docs.select(*keys, F.explode("mappings").alias("m")).select(*keys, "m.*")


def mapping_table(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The same table from exploded spans without names to cluster: windows over the spans of a document."""
    real = spans.filter(~F.col("shield"))
    per_text = real.groupBy(*keys, "text").agg(
        F.min_by("category", "start").alias("category"), F.min("start").alias("first_start"), F.count(F.lit(1)).alias("n_occurrences"), F.min_by("enabled", "start").alias("enabled")
    )
    number = F.row_number().over(Window.partitionBy(*keys, "category").orderBy("first_start"))
    return per_text.withColumn("number", number).select(
        *keys,
        F.col("text").alias("original_text"),
        "category",
        F.format_string("[[%s_%03d]]", "category", "number").alias("placeholder"),
        "n_occurrences",
        "enabled",
    )


def category_counts(mappings: DataFrame) -> DataFrame:
    """Mappings per category, the most first."""
    return mappings.groupBy("category").agg(F.count(F.lit(1)).alias("n_mappings")).orderBy(F.desc("n_mappings"), F.collate("category", "UNICODE"))


def summary(mappings: DataFrame) -> DataFrame:
    """How many mappings are switched on and off, in all and per category."""
    return mappings.rollup("category").agg(F.count_if("enabled").alias("n_enabled"), F.count_if(~F.col("enabled")).alias("n_disabled"))


def next_counter(mappings: DataFrame, keys: list[str]) -> DataFrame:
    """The next free number per category."""
    return mappings.groupBy(*keys, "category").agg((F.max(F.regexp_extract("id", r"_(\d+)$", 1).cast("int")) + 1).alias("next_number"))


def _number(id_: Column) -> Column:
    return F.regexp_extract(id_, r"_(\d+)$", 1).try_cast("int")


def merge(mappings: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """One mapping of those with the given ids, per document and category: the one of the lowest number keeps its name.

    Spellings stand from the longest, equal ones in the order of the mappings. Where any of them has no anchors the
    result has none. Documents with fewer than two of the ids in a category stay as they are.
    """
    chosen = mappings.filter(F.col("id").isin(ids))
    parts = F.array_sort(F.collect_list(F.struct(_number(F.col("id")).alias("n"), "id", "placeholder", "confidence", "source", "enabled", "variants", "occurrences")))
    grouped = chosen.groupBy(*keys, "category").agg(parts.alias("o")).filter(F.size("o") > 1)
    spelled = F.array_distinct(F.flatten(F.transform("o", lambda x: x["variants"])))
    longest = F.array_sort(F.transform(spelled, lambda v, i: F.struct((-F.length(v)).alias("l"), i.alias("i"), v.alias("v"))))
    anchored = ~F.exists("o", lambda x: x["occurrences"].isNull())
    merged = grouped.withColumn("v", F.transform(longest, lambda x: x["v"])).select(
        *keys, F.col("o")[0]["id"].alias("id"), F.col("v")[0].alias("original_text"), F.col("o")[0]["placeholder"].alias("placeholder"), "category",
        F.col("o")[0]["confidence"].alias("confidence"), F.col("o")[0]["source"].alias("source"), F.col("o")[0]["enabled"].alias("enabled"),
        F.col("v").alias("variants"), F.when(anchored, F.array_sort(F.flatten(F.transform("o", lambda x: x["occurrences"])))).alias("occurrences"),
    )
    gone = grouped.select(*keys, F.explode("o").alias("x")).select(*keys, "x.id")
    return mappings.join(gone, [*keys, "id"], "left_anti").select(*mappings.columns).unionByName(merged)


def toggle(mappings: DataFrame, ids: list[str], on: bool) -> DataFrame:
    """mappings with those of the given ids switched on or off; `render` shows the difference."""
    return mappings.withColumn("enabled", F.when(F.col("id").isin(ids), F.lit(on)).otherwise(F.col("enabled")))


def without_anchors(text: str, mappings: list[dict], put) -> str:
    """text with every spelling of the enabled mappings replaced: one pass, the longest first, whole words only."""
    import regex

    spelled = sorted(((v, put(m)) for m in mappings if m["enabled"] for v in m["variants"] if v), key=lambda x: -len(x[0]))
    if not spelled:
        return text
    wordy = regex.compile(r"[\p{L}\p{N}_]")
    edge = lambda v: (r"(?<![\p{L}\p{N}_])" if wordy.match(v[0]) else "") + regex.escape(v) + (r"(?![\p{L}\p{N}_])" if wordy.match(v[-1]) else "")
    table = dict(reversed(spelled))
    return regex.sub("|".join(edge(v) for v, _ in spelled), lambda m: table[m[0]], text)


def render_old(docs: DataFrame, text_col: str = "text", mappings_col: str = "mappings") -> DataFrame:
    """docs with `masked`, for mappings that were stored without anchors."""
    import pyarrow as pa

    from maskwright.operators.detect import _with

    work = lambda text, found: (without_anchors(text or "", found or [], lambda m: m["placeholder"]),)
    return _with(docs, [text_col, mappings_col], {"masked": ("string", pa.string())}, lambda: work)


def split(mappings: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """The mapping with the given id as one mapping per spelling, numbered after those there are."""
    target = mappings.filter((F.col("id") == id_) & (F.size(F.array_distinct(F.transform("occurrences", lambda o: o["text"]))) > 1))
    parts = target.select("*", F.explode("occurrences").alias("o")).groupBy(*keys, "category", "confidence", "source", "enabled", F.col("o.text").alias("original_text")).agg(F.array_sort(F.collect_list("o")).alias("occurrences"))
    parts = parts.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("occurrences")[0]["start"])) - 1)
    parts = parts.join(next_counter(mappings, keys), [*keys, "category"]).withColumn("n", F.col("n") + F.col("next_number"))
    parts = parts.select(
        *keys, F.concat_ws("_", "category", F.col("n").cast("string")).alias("id"), "original_text", F.format_string("[[%s_%03d]]", "category", "n").alias("placeholder"),
        "category", "confidence", "source", "enabled", F.array("original_text").alias("variants"), "occurrences",
    )
    return mappings.join(target.select(*keys, "id"), [*keys, "id"], "left_anti").select(*mappings.columns).unionByName(parts)
