"""Spans as intervals of a table: overlap joins, islands and arbitration for texts of any number of spans.

A span is a row with the keys of its text, start and end (half-open). The array forms of `functions.spans` are for
texts of a few dozen spans; these are for tables where one text may hold a third of all spans.

Defined results: spans that only touch do not overlap; empty spans overlap nothing and are islands of their own;
repeated rows count one by one; null keys are a key like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a bucket of the overlap join.
BUCKET = 256


def _bucketed(spans: DataFrame, bucket: int) -> DataFrame:
    """Each span once for every bucket that it reaches into."""
    real = spans.where("end > start")
    return real.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Pairs of overlapping spans of the same keys: keys and the structs l and r.

    An equi-join on keys and bucket. Of the buckets that both reach into, the one where the later of them starts
    gives the pair, so each comes once and none needs a distinct. A hot text is as many keys as it has buckets.
    """

    def side(spans: DataFrame, name: str) -> DataFrame:
        rest = [c for c in spans.columns if c not in keys]
        return _bucketed(spans, bucket).select(*keys, "__bucket", F.struct(*rest).alias(name))

    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = side(left, "l").alias("a").join(side(right, "r").alias("b"), [F.col("a.__bucket") == F.col("b.__bucket"), *on])
    start, end = F.greatest("l.start", "r.start"), F.least("l.end", "r.end")
    return met.where((F.floor(start / bucket) == F.col("a.__bucket")) & (start < end)).select(*[F.col(f"a.{k}") for k in keys], "l", "r")


def overlap_anti_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """The spans of left that overlap none of right: one bucket of right per row of left it reaches."""
    met = _bucketed(right, bucket).select(*keys, F.col("__bucket"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    # a span of left is looked for in all its buckets, and is out if any of them has an overlap
    numbered = left.withColumn("__id", F.struct(*left.columns))
    hit = _bucketed(numbered, bucket).alias("a").join(
        met.alias("b"),
        [F.col("a.__bucket") == F.col("b.__bucket"), *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.col("a.start") < F.col("b.__end"), F.col("b.__start") < F.col("a.end")],
        "left_semi",
    )
    gone = hit.select("__id").distinct()
    return numbered.join(gone, numbered["__id"].eqNullSafe(gone["__id"]), "left_anti").select(*left.columns)


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans with `island`, numbered from 1 within the keys: runs of spans that hang together by overlaps."""
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("__opens", (reached.isNull() | (F.col("start") >= reached)).cast("int"))
    return opens.withColumn("island", F.sum("__opens").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__opens")


def arbitrated(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The winners by rung, length, start and seq: those that overlap no winner before them.

    Spans of different islands never meet, so the choice is made island by island, in the order of the ladder. A task
    keeps only what it has accepted of one island; everything else is the shuffle's sort, which may go to disk.
    """
    ranked = islands(spans, keys).withColumn("__length", F.col("end") - F.col("start"))
    parted = ranked.repartition(*keys).sortWithinPartitions(*keys, "island", "rung", F.col("__length").desc(), "start", "seq")
    schema = spans.schema
    at = [parted.columns.index(c) for c in (*keys, "island", "start", "end")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        starts: list[int] = []
        ends: list[int] = []
        for batch in batches:
            keep = []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in at))):
                group, start, end = row[:-2], row[-2], row[-1]
                if group != current:
                    current, starts, ends = group, [], []
                near = bisect_left(starts, end)  # accepted spans are apart, so only the last one before `end` may overlap
                if start == end or near == 0 or ends[near - 1] <= start:
                    keep.append(i)
                    if start < end:
                        starts.insert(near, start)
                        ends.insert(near, end)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in schema.names], schema.names)

    return parted.mapInArrow(run, schema)
