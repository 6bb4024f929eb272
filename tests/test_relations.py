"""Shared names, later mentions and the gazetteer join against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import engine
from maskwright.functions.engine import Engine
from maskwright.functions.lexicon import AMBIGUOUS_PLACES, PLACES
from maskwright.functions.names import cluster_names
from maskwright.operators import mentions, shared_names


def clusters(spellings: list[str]) -> dict[str, frozenset]:
    """The classes of the one-document clustering: every spelling with all of its class."""
    named = cluster_names(spellings)
    return {s: frozenset(t for t in spellings if named[t] == named[s]) for s in spellings}


@pytest.mark.parametrize("hot", [10_000, 2])
def test_shared_names_are_the_classes_of_one_large_document(spark, monkeypatch, hot):
    monkeypatch.setattr(shared_names, "HOT", hot)
    draw = random.Random(4)
    words = ["Ana", "Bea", "Carla", "Prieto", "Souto", "Varela", "Ríos", "Núñez", "Nu\u0301n\u0303ez", "de", "Ortega", "Sr."]
    names = sorted({" ".join(draw.sample(words, draw.choice([1, 2, 2, 3, 4]))) for _ in range(60)})
    rows = [(draw.randint(0, 9), n, i) for i, n in enumerate(names)] + [(10, names[0], 3), (10, None, 4), (11, " de la ", 5)]
    got = shared_names.shared_names(spark.createDataFrame(rows, "doc long, name string, place int")).collect()
    assert {r["name"] for r in got} == {*names, " de la "}
    by_class: dict[str, set] = {}
    for r in got:
        by_class.setdefault(r["canonical"], set()).add(r["name"])
    want = clusters([*names, " de la "])
    for r in got:
        assert by_class[r["canonical"]] == want[r["name"]]
        assert len(r["canonical"]) == max(map(len, want[r["name"]])) and r["n_spellings"] == len(want[r["name"]])
    assert {r["name"]: r["n_documents"] for r in got}[names[0]] == len({d for d, n, _ in rows if n == names[0]})
    assert shared_names.shared_names(spark.createDataFrame([], "doc long, name string, place int")).count() == 0


def test_long_chains_and_stars_are_one_component(spark):
    nodes = [(f"{i:04d}",) for i in range(120)] + [("z",)]
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(59)] + [("0119", f"{i:04d}") for i in range(60, 119)]
    got = shared_names.components(spark.createDataFrame(nodes, "id string"), spark.createDataFrame(edges, "small string, big string")).collect()
    assert {r["id"]: r["label"] for r in got} == {f"{i:04d}": "0000" if i < 60 else "0060" for i in range(120)} | {"z": "z"}


TEXTS = [
    "Antía Varela Souto veu. A Antía evoluciona; Varela di que Soutomaior non. Antía-Rosa, xAntía, Antía.",
    "Dear Clara Vance, thank you. Regards, Vance. The Clara case; clara; CLARA.",
    None, "", "no names here",
]


def test_later_mentions_are_the_engines(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[0])], "doc_id long, text string")
    one = Engine(languages=("es", "en", "gl"))
    names, want = [], []
    for i, text in enumerate(TEXTS):
        winners = engine.arbitrate(one.candidates(text or ""))
        names += [(i, s.start, s.end, s.text) for s in winners if s.category == "NAME"]
        want += [(i, s.start, s.end, s.text) for s in one.later_mentions(text or "", winners)]
    accepted = spark.createDataFrame(names, "doc_id long, start int, end int, text string")
    got = mentions.later_mentions(docs.where("doc_id != 1 or text like 'Dear%'"), accepted, ["doc_id"], tuple(one.excluded)).select("doc_id", "start", "end", "text").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("size", [8 << 20, 0])
def test_gazetteer_join_is_the_engines(spark, monkeypatch, size):
    monkeypatch.setattr(mentions, "BROADCAST_BYTES", size)  # 0: the gazetteer is shuffled
    draw = random.Random(6)
    words = [*draw.sample(PLACES, 40), "Santiago de Compostela", "Madrid", "Comunidad de Madrid", "Paris", "in Paris", "in Paris Hilton", "Georgia", "from Georgia", "MADRID", "Madrids", "la", "de", "New", "x_Vigo", "Vigo-Lugo"]
    texts = ["", None] + [draw.choice([" ", ", ", "\n"]).join(draw.choices(words, k=draw.randint(1, 14))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = spark.createDataFrame([(p,) for p in [*PLACES, None, "", "--"]], "place string")
    got = mentions.gazetteer_spans(docs, places, ["doc_id"], tuple(AMBIGUOUS_PLACES)).select("doc_id", "start", "end", "text").collect()
    want = [(i, *h) for i, t in enumerate(texts) for h in engine._locations(t or "", tuple(PLACES))]
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_no_documents_or_no_places(spark):
    docs = spark.createDataFrame([(1, "Madrid")], "doc_id long, text string")
    none = spark.createDataFrame([], "place string")
    assert mentions.gazetteer_spans(docs, none, ["doc_id"]).count() == 0
    assert mentions.gazetteer_spans(docs.limit(0), none.union(docs.select(F.lit("Madrid"))), ["doc_id"]).count() == 0


def test_places_of_a_long_text_are_cut_out_of_its_parts(spark):
    from maskwright.operators import mentions

    at = [0, 1015, 1018, 1024, 2040, 2047, 3071, 4096, 5000]
    texts = ["ñ" * (k - 1) + (" " if k else "") + "Vila Nova, " + "\U0001f600 " * 700 for k in at] + ["xVila Nova" * 300, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    places = spark.createDataFrame([("vila nova",), ("nova",)], "place string")
    got = sorted(tuple(r) for r in mentions.gazetteer_spans(docs, places, ["doc_id"]).collect())
    assert [g for g in got if g[0] < len(at)] == [(i, k, k + 9, "Vila Nova") for i, k in enumerate(at)]
    # words that begin before a part are none of its own: "nova" stands at the end of "xvila nova" only
    assert all(texts[i][a - 1] == " " and b - a == 4 for i, a, b, _ in got if i == len(at)) and {i for i, *_ in got} <= set(range(len(at) + 1))
    sizes = mentions._parts(docs, ["doc_id"], "text", 32, 100).selectExpr("max(length(part)) as n", "count(*) as c").first()
    assert sizes["n"] <= 1024 + 132
