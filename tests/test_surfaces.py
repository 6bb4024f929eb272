"""The artifact source, the detector table function and sanitised pages."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from maskwright.functions import udtf
from maskwright.functions.engine import Engine, Span
from maskwright.operators import sanitise
from maskwright.sources import artifacts

ROWS = [
    ("a", "masked a", '{"k":1}', [], [], None), ("b", "masked b", '{"k":2}', [], ["links"], True), ("c", "no", '{"k":3}', [], ["links"], False),
    ("d", "no", '{"k":4}', ["empty"], [], True), ("e", "é\n😀", None, None, None, None), ("e", "again", None, [], [], True),
]


def save(rows, path):
    rows.write.format("artifacts").option("path", f"file://{path}/out").option("private", f"file://{path}/kept").mode("append").save()


def left_in(path) -> list[str]:
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() or p.name.startswith("."))


def test_artifacts_leave_and_their_undoing_stays_apart(spark, tmp_path):
    artifacts.register(spark)
    rows = spark.createDataFrame(ROWS, artifacts.WRITTEN)
    save(rows.repartition(3), tmp_path)
    save(rows.where("name = 'a'"), tmp_path)
    got = spark.read.format("artifacts").option("path", f"file://{tmp_path}/out").load().collect()
    assert sorted(map(tuple, got)) == sorted([("a", "masked a"), ("a", "masked a"), ("b", "masked b"), ("e", "again"), ("e", "é\n😀")])
    kept = spark.read.json(f"{tmp_path}/kept").collect()
    assert sorted(str(json.loads(r["snapshot"])["k"]) for r in kept if r["snapshot"]) == ["1", "1", "2"]
    assert all("/part-" in f"/{name}" for name in left_in(tmp_path))
    assert b"masked" not in b"".join(__import__("gzip").decompress(p.read_bytes()) for p in (tmp_path / "kept").glob("part-*"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    artifacts.register(spark)
    rows = spark.createDataFrame([(f"n{i}", "t", "{}", [], [], True) for i in range(50)] + [(None, "t", "{}", [], [], True)], artifacts.WRITTEN)
    with pytest.raises(Exception, match="without a name"):
        save(rows.repartition(4), tmp_path)
    assert left_in(tmp_path) == []
    none = spark.read.format("artifacts").option("path", f"file://{tmp_path}/out").load()
    assert none.count() == 0
    with pytest.raises(Exception, match="never overwritten|private"):
        rows.write.format("artifacts").option("path", f"file://{tmp_path}/out").option("private", "x").mode("overwrite").save()


def test_detectors_from_sql(spark):
    texts = [(1, "a@b.com y 12345678Z"), (2, None), (3, "tel 600 000 000, XYZ-7")]
    spark.createDataFrame(texts, "id int, text string").createOrReplaceTempView("texts_for_detect")
    udtf.register_detector(spark, "codes", lambda t: [Span(m, m + 5, "CODE", "XYZ-7", 1.0, "regex", 3.0, None) for m in [t.find("XYZ-7")] if m >= 0])
    got = spark.sql("SELECT t.id, s.category, s.text FROM texts_for_detect t, LATERAL detect(t.text, 'codes,EMAIL') s").collect()
    assert sorted(map(tuple, got)) == [(1, "EMAIL", "a@b.com"), (3, "CODE", "XYZ-7")]
    every = spark.sql("SELECT t.id, s.seq, s.category, s.start FROM texts_for_detect t, LATERAL detect(t.text, '*') s").collect()
    want = [(i, k, s.category, s.start) for i, t in texts for k, s in enumerate(Engine().candidates(t or ""))]
    assert sorted(map(tuple, every)) == sorted(want)


PAGES = [
    ("<p onclick='x()' title=\"t\">a<script>if (a<b) document.write('</p><div>')</script>b</p>", '<p title="t">ab</p>'),
    ("a<svg><g><svg><b>in</b></svg>still</g></svg>b", "ab"),
    ("a</svg></form>b<form><p>no</p>", "ab"),
    ('<a href="javascript:x">1</a><a href="/p?q=1">2</a><a href=https://e.org>3</a><a href="data:text/html,x">4</a>', '<a>1</a><a href="/p?q=1">2</a><a href=https://e.org>3</a><a>4</a>'),
    ('x <img src="http://h/?q=1" alt="a cat"> y<img src=z>', "x a cat y"),
    ("1 < 2 <!-- <p> --> & <b style='background:url(x)'>z", "1 &lt; 2  & <b>z"),
    ("<STYLE>p{}</STYLE><IFRAME src=x></IFRAME><P CLASS=a>k", "<p CLASS=a>k"),
    (None, ""), ("", ""),
]


def test_pages_without_what_runs_or_loads(spark):
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "page_id int, html string")
    got = {r["page_id"]: r["clean"] for r in sanitise.sanitised(pages, ["page_id"]).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAGES)}
    assert sanitise.sanitised(pages.limit(0), ["page_id"]).count() == 0
    hostile = pages.select(F.lit(1).alias("page_id"), F.expr("repeat('<svg>', 200000)").alias("html")).limit(1)
    assert sanitise.sanitised(hostile, ["page_id"]).first()["clean"] == ""
