"""Evidence of languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.operators import language


def test_points_of_many_paragraphs_add_up_exactly(spark):
    """18 thirds are the 6 points that a decision needs, and a paragraph without evidence adds its words."""
    text = "\n\n".join(["para"] * 9 + ["una"] * 9 + ["zzz zzz"])
    rows = spark.createDataFrame([(1, text), (2, text[: -len(" zzz")]), (3, text.replace("una", "uno")), (4, None)], "i int, text string")
    got = {r["i"]: (r["languages"], r["status"]) for r in language.detected(rows, ["i"]).collect()}
    assert got == {1: (["es"], "detected"), 2: ([], "undetermined"), 3: ([], "undetermined"), 4: ([], "undetermined")}


def test_paragraphs_of_two_languages_are_both_found(spark):
    spanish, english = "también nuestro cuando pero esta como porque " * 4, "the report and document with your that from " * 3
    rows = spark.createDataFrame([(1, f"{english}\r\n \r\n{spanish}"), (1, None)], "i int, text string")
    got = language.detected(rows, ["i"]).collect()
    assert [(sorted(r["languages"]), r["status"]) for r in got] == [(["en", "es"], "mixed")] * 2


def test_no_hint_is_missed_by_the_test_before_the_patterns(spark):
    words = ["año", "canción", "canciones", "cancións", "ação", "põe", "ny", "any", "ç", "çà", "àb", "txt", "atz", "œuf", "lì", "groß", "cion", "ciones", "cionesa", "n", "xt", "l·l"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    whole = (F.length("w") > 1) & F.col("w").rlike("|".join(language.HINTS.values()))
    assert [r[0] for r in rows.select(language.hinting(F.col("w"))).collect()] == [r[0] for r in rows.select(whole).collect()]
