"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Rows are combined three times, each time grouping by the whole normalised text and not by its digest alone:
within each input split (the map side of the first aggregate), then per salt, then over all salts. A group of
copies of any size reaches the last step as one row per salt.

Defined results: a null text counts as empty; all empty texts form one group; a null id is larger than any
other; rows that repeat an id and a text are one document given several times, of which one row stays; an
empty table gives an empty result; columns other than id and text are ignored, pass through `drop_copies` and may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.coalesce(F.regexp_replace(text, BLANKS, " "), F.lit(""))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("body"))
    return rows.select("doc_id", "body", F.sha2("body", 256).alias("sha"), F.xxhash64("body").alias("xx"))


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: sha, xx, keep_id, group_size."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    salted = (
        _keyed(docs, id_col, text_col)
        .withColumn("salt", salt)
        .groupBy("sha", "xx", "salt", "body")
        .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    )
    return (
        salted.groupBy("sha", "xx", "body")
        .agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
        .select("sha", "xx", "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = text_groups(docs, id_col, text_col, salts)
    rows = _keyed(docs, id_col, text_col).groupBy("doc_id", "sha", "xx").agg(F.count(F.lit(1)).alias("times"))
    return (
        rows.join(groups, ["sha", "xx"])
        .withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    # the row is one column, so that no name of it can clash with a key
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = normalised(F.col(f"row.`{text_col}`"))
    tagged = whole.select("row", F.col(f"row.`{id_col}`").alias("id"), F.sha2(body, 256).alias("sha"), F.xxhash64(body).alias("xx"))
    groups = text_groups(docs, id_col, text_col, salts).withColumnsRenamed({"sha": "g_sha", "xx": "g_xx"})
    fits = (F.col("sha") == F.col("g_sha")) & (F.col("xx") == F.col("g_xx")) & F.col("id").eqNullSafe(F.col("keep_id"))
    kept = tagged.join(groups, fits, "left_semi")
    again = docs.groupBy(F.col(f"`{id_col}`")).count().filter("count > 1").limit(1).count()
    if again:
        kept = kept.dropDuplicates(["id", "sha", "xx"])
    return kept.select("row.*")
