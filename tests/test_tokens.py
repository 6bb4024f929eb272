"""Tokens of a stream over restarts, and the versioned snapshot table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import snapshots
from maskwright.streaming import tokens

ORIGINALS = "scope string, turn long, place int, category string, original string"


def turns(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    return [(f"c{c}", t, p, draw.choice(["NAME", "CUSTOM"]), draw.choice(["Ana", "Bea", "Carl", "Dora", "Eve"])) for c in range(5) for t in range(6) for p in range(draw.randint(0, 4))]


def plain(rows: list[tuple]) -> list[tuple]:
    known: dict[str, dict] = {}
    out = []
    for scope, turn, place, category, original in sorted(rows):
        own = known.setdefault(scope, {})
        again = (category, original) in own
        number = own.setdefault((category, original), len(own) + 1)
        out.append((scope, turn, place, category, original, number, again))
    return sorted(out)


COLUMNS = ("scope", "turn", "place", "category", "original", "number", "reused")


def test_a_stream_with_restarts_equals_the_table(spark, tmp_path):
    rows = turns(1)
    schema = spark.createDataFrame([], ORIGINALS).schema
    got = []
    for turn in range(6):  # every run is a new query over the same checkpoint
        spark.createDataFrame([r for r in rows if r[1] == turn], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        tokens.tokens_into(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"file://{tmp_path}/out")
    got = sorted(map(tuple, out.select(*COLUMNS).collect()))
    table = tokens.token_table(spark.createDataFrame(rows, schema))
    assert got == plain(rows) == sorted(map(tuple, table.select(*COLUMNS).collect()))
    assert sorted(r["token"] for r in out.collect()) == sorted(r["token"] for r in table.collect())
    assert all(r["token"].startswith("[[V1_") for r in out.collect())


def mapped(spark, rows: list[tuple]):
    """scope, category, original, ordinal, held: as `identified` takes them."""
    frame = spark.createDataFrame(rows, "scope string, category string, original_text string, ordinal int, held array<string>")
    return frame.select("scope", "category", "original_text", F.array("original_text").alias("variants"), "ordinal", F.lit(True).alias("enabled"), F.lit("0:1").alias("anchors"), "held")


A, B = "A" * 32, "B" * 32


def numbers(frame) -> list[tuple]:
    return sorted((r["scope"][0], r["original_text"], r["number"], r["reused"]) for r in frame.collect())


def test_versions_reuse_count_on_and_skip_what_the_text_holds(spark, tmp_path):
    log = snapshots.SnapshotLog(spark, f"file://{tmp_path}/log")
    assert log.version() == 0 and log.read().count() == 0
    first = snapshots.identified(mapped(spark, [(A, "NAME", "Ana", 1, None), (A, "NAME", "Bea", 2, None), (B, "NAME", "Ana", 1, None)]), log)
    assert log.commit(first, 0) == 1
    second = snapshots.identified(mapped(spark, [(A, "NAME", "Carl", 1, None), (A, "NAME", "Bea", 2, None), (B, "NAME", "Ana", 1, [f"[[V1_{B}_NAME_1]]"]), (B, "NAME", "Eve", 2, [f"[[V1_{B}_ID_7]]"])]), log)
    assert numbers(second) == [("A", "Bea", 2, True), ("A", "Carl", 3, False), ("B", "Ana", 8, False), ("B", "Eve", 9, False)]
    assert log.commit(second, 1) == 2
    assert sorted({r["version"] for r in log.read().collect()}) == [1, 2]
    log.revoke(2)
    log.revoke(2)
    assert {r["version"] for r in log.read().collect()} == {1} and log.read(2).count() == 0
    third = snapshots.identified(mapped(spark, [(A, "NAME", "Carl", 1, None), (A, "NAME", "Ana", 2, None)]), log)
    assert numbers(third) == [("A", "Ana", 1, True), ("A", "Carl", 4, False)]  # 3 was given out and stays used


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    log = snapshots.SnapshotLog(spark, f"file://{tmp_path}/log")
    rows = snapshots.identified(mapped(spark, [(A, "NAME", "Ana", 1, None)]), log)
    log.commit(rows, 0)
    with pytest.raises(snapshots.Conflict):
        log.commit(rows, 0)
    late = snapshots.SnapshotLog(spark, f"file://{tmp_path}/log")
    seen = iter([1, 2])
    monkeypatch.setattr(late, "version", lambda: next(seen))  # looked before the other writer, who commits meanwhile
    log.commit(rows, 1)
    with pytest.raises(snapshots.Conflict):
        late.commit(rows, 1)
    assert sorted(log.entries()) == [1, 2]
    left = [s.getPath().getName() for s in log.files.listStatus(log._at("data"))]
    assert sorted(left) == sorted(e["folder"] for e in log.entries().values())


def test_a_switch_stays_where_the_anchors_do(spark, tmp_path):
    log = snapshots.SnapshotLog(spark, f"file://{tmp_path}/log")
    off = snapshots.identified(mapped(spark, [(A, "NAME", "Ana", 1, None), (A, "NAME", "Bea", 2, None)]).withColumn("enabled", F.lit(False)), log)
    log.commit(off, 0)
    moved = mapped(spark, [(A, "NAME", "Ana", 1, None), (A, "NAME", "Bea", 2, None)]).withColumn("anchors", F.when(F.col("original_text") == "Bea", "9:12").otherwise(F.col("anchors")))
    got = {r["original_text"]: r["enabled"] for r in snapshots.identified(moved, log).collect()}
    assert got == {"Ana": False, "Bea": True}


def test_tokens_that_a_text_holds(spark):
    text = f"x [[V1_{A}_NAME_12]] [[V1_{B}_NAME_99]] [[V1_{A}_CUSTOM_X_3]] [[NAME_500]]"
    row = spark.createDataFrame([(text, A), ("none", A), (None, A)], "text string, scope string").select(snapshots.held_tokens(F.col("text"), F.col("scope")).alias("held"))
    got = [(r[0], r[1]) for r in row.select("held", snapshots.highest(F.col("held"))).collect()]
    assert got == [([f"[[V1_{A}_NAME_12]]", f"[[V1_{A}_CUSTOM_X_3]]"], 12), ([], None), (None, None)]
