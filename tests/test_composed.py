"""Canonical composition against the character database."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from maskwright.functions.composed import composed
from maskwright.operators import language


def test_random_letters_and_marks_compose_as_the_database_says(spark):
    draw = random.Random(11)
    letters = "aeinoucsAEONCZ łñçéüõαωЕи .\n"
    marks = "̧̨̣̱̀́̂̃̈̊̇̈́ͅ"
    texts = ["".join(draw.choice(letters if draw.random() < 0.6 else marks) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    texts += ["ÅΩά", "Å", "q̣̇", "́x", "ế \U0001f600", "plain", "", "ᾴ", "é" * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", composed(F.col("t")).alias("c")).collect()}
    assert got.pop(-1) is None
    assert got == {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_decomposed_texts_have_the_evidence_of_composed_ones(spark):
    text = "A canção não é só uma canção porque também há já hoje três orações e razões para não as ouvir. " * 3
    rows = spark.createDataFrame([(0, text), (1, unicodedata.normalize("NFD", text))], "i int, text string")
    for find in (language.lang_scores, language.evidence):
        got = find(rows, ["i"]).collect()
        sides = [sorted((r["lang"], r["score"], r["n_matches"]) for r in got if r["i"] == i) for i in (0, 1)]
        assert sides[0] and sides[0] == sides[1]
    assert {(tuple(r["languages"]), r["status"]) for r in language.detected(rows, ["i"]).collect()} == {(("pt",), "detected")}


def test_the_text_is_made_once_whatever_looks_at_it(spark):
    from pyspark.sql import functions as F

    from maskwright.functions.composed import composed

    made = spark.createDataFrame([("é",)], "text string").select(composed(F.replace("text", F.lit("e"), F.lit("o"))).alias("c"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("replace(text") == 1
    assert made.first()[0] == "ó"
