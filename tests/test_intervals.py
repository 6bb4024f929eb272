"""Overlap joins, islands and arbitration of tables of spans against plain loops."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions.engine import Span, arbitrate
from maskwright.operators import intervals

DDL = "doc long, seq int, start int, end int, rung double, text string"


def spans(seed: int, n: int, docs: int = 4, reach: int = 400, longest: int = 60) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        start = draw.randint(0, reach)
        rows.append((draw.choice([None, *range(docs)]), i, start, start + draw.choice([0, 1, 2, 5, draw.randint(1, longest)]), float(draw.randint(0, 3)), "x"))
    return rows


def overlap(a: tuple, b: tuple) -> bool:
    return a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]


@pytest.mark.parametrize("bucket", [1, 7, 256])
def test_overlap_join_is_the_loop(spark, bucket):
    left, right = spans(1, 80), spans(2, 80)
    pairs = intervals.overlap_join(spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL), ["doc"], bucket)
    got = sorted((r["l"]["seq"], r["r"]["seq"]) for r in pairs.collect())
    assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and overlap(a, b))


@pytest.mark.parametrize("bucket", [1, 7, 256])
def test_overlap_anti_join_is_the_loop(spark, bucket):
    left, right = spans(3, 120), spans(4, 25)
    got = intervals.overlap_anti_join(spark.createDataFrame(left + left[:5], DDL), spark.createDataFrame(right, DDL), ["doc"], bucket)
    want = [a for a in left + left[:5] if not any(a[0] == b[0] and overlap(a, b) for b in right)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_islands_hang_together(spark):
    rows = [r for r in spans(5, 90, reach=900) if r[2] < r[3]]
    got = {r["seq"]: (r["doc"], r["island"]) for r in intervals.islands(spark.createDataFrame(rows, DDL), ["doc"]).collect()}
    joined = {r[1]: r[1] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if a[0] == b[0] and overlap(a, b) and joined[a[1]] != joined[b[1]]:
                    joined[a[1]] = joined[b[1]] = min(joined[a[1]], joined[b[1]])
                    changed = True
    for a in rows:
        for b in rows:
            assert (got[a[1]] == got[b[1]]) == (joined[a[1]] == joined[b[1]])


@pytest.mark.parametrize(("seed", "n"), [(6, 300), (7, 40), (8, 0)])
def test_arbitration_is_the_greedy_choice(spark, seed, n):
    rows = [r for r in spans(seed, n) if r[2] < r[3]]
    got = intervals.arbitrated(spark.createDataFrame(rows, DDL).repartition(3), ["doc"])
    want = []
    for doc in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == doc]
        as_spans = [Span(r[2], r[3], str(r[1]), "x", 1.0, "regex", r[4], None) for r in own]
        want += [(doc, int(s.category)) for s in arbitrate(as_spans)]
    assert sorted(map(repr, [(r["doc"], r["seq"]) for r in got.collect()])) == sorted(map(repr, want))


def test_a_hundred_thousand_spans_of_one_text(spark):
    """One island of all of them: each overlaps its neighbours."""
    rows = spark.range(100_000).select(
        F.lit(1).cast("long").alias("doc"), F.col("id").cast("int").alias("seq"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 5).cast("int").alias("end"),
        (F.col("id") % 4).cast("double").alias("rung"), F.lit("x").alias("text"),
    ).cache()
    rows.count()
    intervals.arbitrated(rows, ["doc"]).count()  # starts the workers
    began = time.time()
    n = intervals.arbitrated(rows, ["doc"]).count()
    assert time.time() - began < 20 and 25_000 <= n <= 75_000
