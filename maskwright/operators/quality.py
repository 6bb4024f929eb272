"""Quality of detection: how much of labelled spans is covered, and how much of a text was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.patterns import spaced


def coverage(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Characters covered by the union of windows (start, end): what each adds beyond the farthest end so far."""
    order = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    far = F.coalesce(F.max("end").over(order), F.lit(0))
    fresh = windows.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), far)))
    return fresh.groupBy(*keys).agg(F.sum("new").cast("long").alias("covered"))


def outcomes(gold: DataFrame, predicted: DataFrame, texts: DataFrame) -> DataFrame:
    """caught, partial or missed for each required gold span, by its characters that are not blank."""
    at = gold.filter(~F.col("optional")).join(texts, "doc_id")
    chars = at.select("doc_id", "start", "end", "category", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"), "text")
    chars = chars.filter(~F.substring("text", F.col("i") + 1, F.lit(1)).rlike(spaced(r"\s"))).drop("text")
    spans = predicted.select("doc_id", F.col("start").alias("a"), F.col("end").alias("z"))
    hit = chars.join(spans, (chars["doc_id"] == spans["doc_id"]) & (F.col("a") <= F.col("i")) & (F.col("i") < F.col("z")), "left_semi")
    have = hit.groupBy("doc_id", "start", "end", "category").agg(F.count(F.lit(1)).alias("have"))
    need = chars.groupBy("doc_id", "start", "end", "category").agg(F.count(F.lit(1)).alias("need"))
    both = need.join(have, ["doc_id", "start", "end", "category"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    outcome = F.when(F.col("have") == F.col("need"), "caught").when(F.col("have") == 0, "missed").otherwise("partial")
    return both.select("doc_id", "start", "end", "category", outcome.alias("outcome"))


def overflags(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted spans that touch no gold span, optional ones included."""
    g = gold.select("doc_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    touches = (predicted["doc_id"] == g["doc_id"]) & (F.col("start") < F.col("g_end")) & (F.col("g_start") < F.col("end"))
    return predicted.join(g, touches, "left_anti")


def scorecard(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per category and in all (null): total, caught, partial, missed, overflags and recall (1 where nothing is to catch)."""
    kinds = [F.count_if(F.col("outcome") == k).alias(k) for k in ("caught", "partial", "missed")]
    scores = found.rollup("category").agg(F.count(F.lit(1)).alias("total"), *kinds)
    more = flagged.rollup("category").agg(F.count(F.lit(1)).alias("overflags"))
    both = scores.join(more.withColumnRenamed("category", "c"), F.col("category").eqNullSafe(F.col("c")), "full")
    zero = [F.coalesce(k, F.lit(0)).alias(k) for k in ("total", "caught", "partial", "missed", "overflags")]
    rows = both.select(F.coalesce("category", "c").alias("category"), *zero)
    return rows.withColumn("recall", F.when(F.col("total") > 0, F.round(F.col("caught") / F.col("total"), 6)).otherwise(1.0))


def table_text(card: DataFrame) -> DataFrame:
    """The scorecard as lines: category, figures right aligned, the sum last."""
    name = F.rpad(F.coalesce("category", F.lit("ALL")), 15, " ")
    figures = [F.lpad(F.col(c).cast("string"), w, " ") for c, w in (("total", 6), ("caught", 7), ("partial", 8), ("missed", 7), ("overflags", 10))]
    share = F.lpad(F.concat(F.round(F.col("recall") * 100).cast("int").cast("string"), F.lit("%")), 7, " ")
    return card.select(F.col("category").isNull().alias("last"), F.concat(name, *figures, share).alias("line")).orderBy("last", "line").select("line")


def _characters(spans: DataFrame, texts: DataFrame, *keep: str) -> DataFrame:
    """One row per character of a span that is not blank."""
    rows = spans.join(texts, "doc_id").select("doc_id", *keep, F.explode(F.sequence("start", F.col("end") - 1)).alias("i"), "text")
    return rows.filter(~F.substring("text", F.col("i") + 1, F.lit(1)).rlike(spaced(r"\s"))).drop("text")


def span_metrics(gold: DataFrame, predicted: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: sensitive characters and how many are masked, exact spans, false merges, unmasked spans, extra characters."""
    need = _characters(gold, texts, "start", "end", "category")
    masked = _characters(predicted, texts).distinct()
    all_masked = _characters(predicted, texts)
    hit = need.join(masked, ["doc_id", "i"], "left_semi")
    sensitive = need.agg(F.count(F.lit(1)).alias("sensitive_chars"))
    covered = hit.agg(F.count(F.lit(1)).alias("masked_sensitive_chars"))
    open_ = need.join(masked, ["doc_id", "i"], "left_anti").select("doc_id", "start", "end", "category").distinct().agg(F.count(F.lit(1)).alias("unmasked_spans"))
    exact = gold.join(predicted.select("doc_id", "start", "end").distinct(), ["doc_id", "start", "end"], "left_semi").agg(F.count(F.lit(1)).alias("exact_spans"))
    g = gold.select("doc_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    touch = predicted.withColumn("k", F.struct("doc_id", "start", "end")).join(g, "doc_id").filter((F.col("start") < F.col("g_end")) & (F.col("g_start") < F.col("end")))
    merges = touch.groupBy("k").count().filter("count >= 2").agg(F.count(F.lit(1)).alias("false_merges"))
    places = gold.select("doc_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("i")).distinct()
    extra = all_masked.join(places, ["doc_id", "i"], "left_anti").agg(F.count(F.lit(1)).alias("extra_chars"))
    sizes = [gold.agg(F.count(F.lit(1)).alias("gold_spans")), predicted.agg(F.count(F.lit(1)).alias("predicted_spans")), all_masked.agg(F.count(F.lit(1)).alias("masked_chars"))]
    out = sensitive
    for one in (covered, open_, exact, merges, extra, *sizes):  # single rows side by side
        out = out.withColumn("k", F.lit(1)).join(one.withColumn("k", F.lit(1)), "k").drop("k")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(1.0)
    return (
        out.withColumn("sensitive_recall", ratio("masked_sensitive_chars", "sensitive_chars"))
        .withColumn("exact_recall", ratio("exact_spans", "gold_spans"))
        .withColumn("exact_precision", ratio("exact_spans", "predicted_spans"))
        .withColumn("extra_share", F.round(F.col("extra_chars") / F.greatest(F.lit(1), F.col("masked_chars")), 6))
    )


LABELLED = r"\{([A-Z_]+)(\??)\|([^{}]+)\}"
ANNOTATED = r"\{\{([A-Z_]+)()\|([^}]*)\}\}"


def labelled(docs: DataFrame, keys: list[str], markup_col: str = "markup", pattern: str = LABELLED) -> DataFrame:
    """keys, text without the markup, and gold (start, end, category, optional, text) of {NAME|Ana} and {NAME?|Ana}."""
    p = F.lit(pattern)
    parts = [F.regexp_extract_all(markup_col, p, F.lit(g)) for g in range(4)]
    zipped = F.arrays_zip(F.slice(F.split(markup_col, pattern, -1), F.lit(1), F.size(parts[0])).alias("gap"), *[x.alias(n) for x, n in zip(parts, ("m", "category", "mark", "text"))])
    none = F.array().cast("array<struct<start:int,end:int,category:string,optional:boolean,text:string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["text"])
        one = F.struct(start.alias("start"), end.alias("end"), x["category"].alias("category"), (x["mark"] == "?").alias("optional"), x["text"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    gold = F.aggregate(zipped, begin, step, lambda acc: acc["out"])
    return docs.select(*keys, F.regexp_replace(markup_col, pattern, "$3").alias("text"), gold.alias("gold"))
