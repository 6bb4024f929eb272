"""Long runs of words that a pattern might read again and again: time grows with the text, in Python and in columns."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions import detectors as D
from maskwright.functions.engine import Engine

UNITS = ["ABC DEF ", "Calle Mayor ", "Rua Mayor ", "ABC SA ", "Grupo Grupo ", "Calle de la ", "Av. Mayor ", "1 A, B "]


@pytest.mark.parametrize("unit", UNITS)
def test_a_text_four_times_as_long_takes_about_four_times_as_long(unit):
    engine = Engine(languages=("en", "es", "pt"), jurisdictions=("ES", "PT"))
    took = []
    for size in (60_000, 240_000):
        text = unit * (size // len(unit))
        began = time.process_time()
        engine.detect(text)
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.1)


def test_columns_read_long_runs(spark):
    rows = spark.createDataFrame([(u * (100_000 // len(u)),) for u in UNITS] + [("vende Acme SA Beta S.L. hoy, y Rúa Mayor 3",)], "text string")
    began = time.time()
    spans = F.concat(D.company(F.col("text")), D.address(F.col("text")), D.pt_address(F.col("text")))
    got = rows.select(F.explode(spans).alias("s")).groupBy("s.category").count().collect()
    assert time.time() - began < 120
    assert {r["category"] for r in got} == {"COMPANY", "ADDRESS"}


CASES = [
    ("trabaja en Acme SA, y", ["Acme SA"]),
    ("Acme SA Beta SL", ["Acme SA Beta SL"]),
    ("Acme S.L. Beta Gamma SA", ["Acme S.L.", "Beta Gamma SA"]),
    ("Nord A/S Beta SA", ["Nord A/S", "Beta SA"]),
    ("A/S Inc.", ["S Inc."]),
    ("iPhone SA; Acme, Inc.", ["Phone SA", "Acme, Inc."]),
    ("Acme S.L.x y SLx", []),
    ("Grupo Zeta Norte y Banco", ["Grupo Zeta Norte"]),
]


@pytest.mark.parametrize(("text", "wanted"), CASES)
def test_companies(spark, text, wanted):
    engine = Engine(settings={"COMPANY_ACRONYM": False})
    assert [s.text for s in engine.candidates(text) if s.category == "COMPANY"] == wanted
    got = spark.createDataFrame([(text,)], "text string").select(D.company(F.col("text")).alias("s")).first()["s"]
    assert [s["text"] for s in got] == wanted
