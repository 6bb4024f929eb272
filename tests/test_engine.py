from __future__ import annotations

import random

import pytest

from maskwright.functions import checks
from maskwright.functions.engine import Engine, Span, apply, arbitrate, mappings, restore


def masked(text: str, **profile) -> str:
    return apply(text, mappings(text, Engine(**profile).detect(text)))


@pytest.mark.parametrize(
    "text, expected",
    [
        (
            "Hola, soy Oscar Beiro. Mi correo es oscar@example.com y vivo en Rúa Fernando Olmedo 12, Pontevedra.",
            "Hola, soy [[NAME_001]]. Mi correo es [[EMAIL_001]] y vivo en [[ADDRESS_001]].",
        ),
        ("Dear Clara Vance, thank you. Regards, Clara Vance.", "Dear [[NAME_001]], thank you. Regards, [[NAME_001]]."),
        ("mi dni es 76.123.312-M gracias", "mi dni es [[DNI_001]] gracias"),
        ("a@b.com, a@b.com", "[[EMAIL_001]], [[EMAIL_001]]"),
        ("el 2026.09.18 13:42:10", "el 2026.09.18 13:42:10"),
        ("pago 1.234,56 € y mil euros", "pago [[MONEY_001]] y [[MONEY_002]]"),
        ("Muchas gracias por todo.", "Muchas gracias por todo."),
        ("", ""),
    ],
)
def test_masks(text, expected):
    assert masked(text) == expected


def test_comma_form_clusters_under_the_given_name_first():
    text = "Ferreiro Iglesias, Laura firmó. Laura Ferreiro Iglesias vino."
    (only,) = mappings(text, Engine().detect(text))
    assert only["original_text"] == "Laura Ferreiro Iglesias"
    assert only["variants"] == ["Laura Ferreiro Iglesias", "Ferreiro Iglesias, Laura"]


def test_switches_and_rules():
    assert masked("a@b.com", settings={"EMAIL": False}) == "a@b.com"
    rules = [{"term_or_pattern": "a.b", "is_regex": False, "replacement_type": "CATEGORY", "target_category": "CODE"}]
    assert masked("x a.b y axb", rules=rules, languages=()) == "x [[CODE_001]] y axb"


@pytest.mark.parametrize(
    "check, good, bad",
    [
        (checks.luhn, "4111111111111111", "4111111111111112"),
        (checks.iban, "ES91 2100 0418 4502 0005 1332", "ES91 2100 0418 4502 0005 1333"),
        (checks.cif, "B12345674", "B12345675"),
        (checks.nif_pt, "501442600", "501442601"),
    ],
)
def test_checks(check, good, bad):
    assert check(good) and not check(bad)


def test_arbitration_equals_an_exhaustive_scan():
    draw = random.Random(5)
    for _ in range(200):
        spans = []
        for _ in range(draw.randint(0, 30)):
            a = draw.randint(0, 60)
            spans.append(Span(a, a + draw.randint(1, 12), "X", "", 1.0, "regex", float(draw.randint(0, 3)), None))
        kept = []
        for i in sorted(range(len(spans)), key=lambda i: (spans[i].rung, spans[i].start - spans[i].end, spans[i].start, i)):
            if not any(k.start < spans[i].end and spans[i].start < k.end for k in kept):
                kept.append(spans[i])
        assert arbitrate(spans) == sorted(kept, key=lambda s: s.start)


def test_restores_tolerantly_and_reports():
    text = "Dear Clara Vance, write to a@b.com."
    table = mappings(text, Engine().detect(text))
    got = restore("[[NAME_001]] [name 1] [[EMAIL_1]] [[NAME_009]] NAME_1", table)
    assert got["text"] == "Clara Vance Clara Vance a@b.com [[NAME_009]] NAME_1"
    assert got["restored"] == 3 and got["unknown"] == ["[[NAME_009]]"]


def test_batches_are_read_in_small_slices():
    import pyarrow as pa

    from maskwright.operators.detect import SLICE_BYTES, slices

    texts = [("x" * n) for n in [2 * SLICE_BYTES, 0, 5, *[1000] * 9000, 3 * SLICE_BYTES, 7]]
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])], ["row"])
    parts = list(slices(batch))
    assert [r["row"]["text"] for p in parts for r in p.to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= SLICE_BYTES for p in parts) and len(parts) > 10
    assert list(slices(batch.slice(0, 0)))[0].num_rows == 0


def test_no_more_than_a_slice_of_rows_is_python_objects_at_a_time(spark):
    from maskwright.operators.detect import _with

    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 2000) as text").coalesce(1)

    def start():
        seen = []

        def work(text):
            import sys

            f = sys._getframe(1)
            seen.append(len(f.f_locals["row"]) if "row" in f.f_locals else 0)
            return (max(seen),)

        return work

    import pyarrow as pa

    most = _with(docs, ["text"], {"rows": ("int", pa.int32())}, start).agg({"rows": "max"}).first()[0]
    assert 0 < most < 1000
