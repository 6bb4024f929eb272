"""Detectors on texts whose spans are known: the engine's pass, and the column form where there is one, must both find them."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import detectors as D
from maskwright.operators import detect as ops
from maskwright.plans.registry import ORACLES, inline, query
from maskwright.scratch import local_rows
from maskwright.sources import tables

#: name: (categories, profile, column form or None, [(text, [(span, category, confidence), ...]), ...])
CASES: dict[str, tuple] = {
    "dni": (("DNI", "INVALID_ID"), {}, D.dni, [
        ("mi dni es 76.123.312-M gracias", [("76.123.312-M", "DNI", 1.0)]),
        ("DNI: 12345678A", [("12345678A", "INVALID_ID", 0.9)]),
        ("ref 12345678A aquí", [("12345678A", "INVALID_ID", 0.5)]),
        ("http://e.org/12345678A", []),
        ("12345678Z y 12345678z", [("12345678Z", "DNI", 1.0), ("12345678z", "DNI", 1.0)]),
        ("A12345678Z", []),
    ]),
    "nie": (("NIE", "INVALID_ID"), {}, D.nie, [
        ("NIE X1234567L vale", [("X1234567L", "NIE", 1.0)]),
        ("NIE: X1234567A", [("X1234567A", "INVALID_ID", 0.9)]),
        ("XX1234567L", []),
    ]),
    "vat": (("VAT_NUMBER",), {"jurisdictions": ()}, None, [
        ("VAT DE123456789.", [("DE123456789", "VAT_NUMBER", 0.75)]),
        ("ATU12345678 and FR12345678901", [("ATU12345678", "VAT_NUMBER", 0.75), ("FR12345678901", "VAT_NUMBER", 0.75)]),
        ("DE123456789 123", []),
        ("CIF: B12345674", [("B12345674", "VAT_NUMBER", 0.9)]),
        ("CIF: B12345675", [("B12345675", "VAT_NUMBER", 0.65)]),
    ]),
    "iban": (("IBAN",), {"jurisdictions": ()}, None, [
        ("cuenta ES91 2100 0418 4502 0005 1332.", [("ES91 2100 0418 4502 0005 1332", "IBAN", 1.0)]),
        ("ES91 2100 0418 4502 0005 1332", [("ES91 2100 0418 4502 0005 1332", "IBAN", 1.0)]),
        ("ES9121000418450200051332 EUR", [("ES9121000418450200051332", "IBAN", 1.0)]),
        ("ES9121000418450200051333", []),
    ]),
    "card": (("CREDIT_CARD",), {"jurisdictions": ()}, D.card, [
        ("pay 4111 1111 1111 1111 now", [("4111 1111 1111 1111 ", "CREDIT_CARD", 1.0)]),
        ("pay 4111111111111111.", [("4111111111111111", "CREDIT_CARD", 1.0)]),
        ("pay 4111111111111112.", []),
    ]),
    "masked_id": (("MASKED_ID",), {}, D.masked_id, [
        ("id 76****12E fin", [("76****12E", "MASKED_ID", 1.0)]),
        ("a*b, x1, **", []),
        ("••••1234", [("••••1234", "MASKED_ID", 1.0)]),
    ]),
    "phone": (("PHONE",), {}, D.phone, [
        ("llame al 600 000 000 ya", [("600 000 000", "PHONE", 1.0)]),
        ("600 000 000", [("600 000 000", "PHONE", 1.0)]),
        ("+34 981-123-456", [("+34 981-123-456", "PHONE", 1.0)]),
        ("12 34 56", []),
    ]),
    "id_code": (("ID_CODE",), {}, D.id_code, [
        ("Colegiada T-09310", [("T-09310", "ID_CODE", 1.0)]),
        ("expediente: 2024/118", [("2024/118", "ID_CODE", 1.0)]),
        ("nº 2", []),
    ]),
    "money": (("MONEY",), {"jurisdictions": ()}, D.money, [
        ("pago 1.234,56 € y $1,234.56", [("1.234,56 €", "MONEY", 1.0), ("$1,234.56", "MONEY", 1.0)]),
        ("(1.200 €) o 30 €)", [("(1.200 €)", "MONEY", 1.0), ("30 €", "MONEY", 1.0)]),
        ("2,5 millones de euros; mil euros", [("2,5 millones de euros", "MONEY", 1.0), ("mil euros", "MONEY", 1.0)]),
        ("1 234,56 €", [("1 234,56 €", "MONEY", 1.0)]),
        ("EUR 500 y -3 USD", [("EUR 500", "MONEY", 1.0), ("-3 USD", "MONEY", 1.0)]),
        ("hay 1234 cosas", []),
    ]),
    "address": (("ADDRESS",), {}, D.address, [
        ("vivo en Rúa Fernando Olmedo 12, Pontevedra.", [("Rúa Fernando Olmedo 12, Pontevedra", "ADDRESS", 1.0)]),
        ("rúa do Progreso, 5, 2º esquerda", [("rúa do Progreso, 5, 2º esquerda", "ADDRESS", 1.0)]),
        ("at 10 Downing Street, London SW1A 2AA", [("10 Downing Street, London SW1A 2AA", "ADDRESS", 1.0)]),
        ("12 Main Street, Springfield, IL 62704", [("12 Main Street, Springfield, IL 62704", "ADDRESS", 1.0)]),
        ("la calle es larga", []),
    ]),
    "postcode": (("ADDRESS",), {}, D.address, [
        ("27001 Lugo", [("27001 Lugo", "ADDRESS", 1.0)]),
        ("código postal: 36001", [("36001", "ADDRESS", 1.0)]),
        ("36001 cajas", []),
    ]),
    "location": (("LOCATION",), {"jurisdictions": ()}, D.location, [
        ("viajó a Cáceres y a vigo", [("Cáceres", "LOCATION", 0.9), ("vigo", "LOCATION", 0.9)]),
        ("Jordan Smith in Jordan.", [("Jordan", "LOCATION", 0.9)]),
        ("Vigoroso", []),
    ]),
    "company": (("COMPANY",), {"settings": {"COMPANY_ACRONYM": False}}, D.company, [
        ("con Acme Consulting, S.L. hoy", [("Acme Consulting, S.L.", "COMPANY", 1.0)]),
        ("el Banco Popular paga", [("Banco Popular", "COMPANY", 1.0)]),
        ("una sl cualquiera", []),
    ]),
    "acronym": (("COMPANY",), {}, D.acronym, [("la OTAN y el IVA", [("OTAN", "COMPANY", 0.4)])]),
    "name": (("NAME",), {}, None, [
        ("soy Oscar Beiro de aquí", [("Oscar Beiro", "NAME", 0.6)]),
        ("Psicóloga Ester Cuni", [("Ester Cuni", "NAME", 0.6)]),
        ("José Ángel Núñez Iñárritu", [("José Ángel Núñez Iñárritu", "NAME", 0.6)]),
        ("Punto G. Anexo", []),
        ("Muchas Gracias", []),
        ("INFORME FINAL", []),
        ("Nombre Completo: x", []),
    ]),
    "addressed": (("NAME",), {}, None, [
        ("Hola Marta, pasa", [("Marta", "NAME", 0.6)]),
        ("el Dr. Souto llega", [("Souto", "NAME", 0.6)]),
        ("Hola Buenos, pasa", []),
    ]),
    "later": (("NAME",), {}, None, [
        ("soy Oscar Beiro. Luego vino Beiro.", [("Oscar Beiro", "NAME", 0.6), ("Beiro", "NAME", 0.5)]),
    ]),
    "shield": (("SHIELD",), {}, D.shields, [
        ("según la Ley Orgánica 3/2018 vale", [("Ley Orgánica 3/2018", "SHIELD", 1.0)]),
        ("el Director General firma", [("Director General", "SHIELD", 1.0)]),
        ("la Xunta de Galicia paga", [("Xunta de Galicia", "SHIELD", 1.0)]),
    ]),
    "date": (("SHIELD",), {"languages": ()}, D.date_time, [
        ("el 2026.09.18 13:42:10 fue", [("2026.09.18 13:42:10", "SHIELD", 1.0)]),
        ("18/09/2026 y 13:42:10", [("18/09/2026", "SHIELD", 1.0), ("13:42:10", "SHIELD", 1.0)]),
        ("1.2.3", []),
    ]),
    "pt_nif": (("NIF",), {"jurisdictions": ("PT",)}, D.pt_nif, [
        ("NIF: 501 442 600", [("501 442 600", "NIF", 1.0)]),
        ("o 501442600 veio", [("501442600", "NIF", 0.8)]),
        ("o 501 442 600 veio", []),
        ("NIF 501442601", []),
    ]),
    "pt_card": (("CARTAO_CIDADAO",), {"jurisdictions": ("PT",)}, None, [
        ("cartão 00000000 0 ZZ4", [("00000000 0 ZZ4", "CARTAO_CIDADAO", 1.0)]),
        ("cartão 00000000 0 ZZ5", []),
    ]),
    "pt_phone": (("PHONE",), {"jurisdictions": ("PT",)}, D.pt_phone, [
        ("ligue +351 912 345 678", [("+351 912 345 678", "PHONE", 1.0)]),
        ("ligue 512 345 678", []),
    ]),
    "pt_address": (("ADDRESS",), {"jurisdictions": ("PT",)}, D.pt_address, [
        ("Rua de São Bento, 12, fim", [("Rua de São Bento, 12", "ADDRESS", 1.0)]),
        ("1200-816 Lisboa", [("1200-816 Lisboa", "ADDRESS", 1.0)]),
    ]),
    "languages": (("NAME", "COMPANY"), {"languages": ("en",), "settings": {"COMPANY_ACRONYM": False}}, None, [
        ("the Grupo Pepe Sur thing", [("Grupo Pepe Sur", "NAME", 0.6)]),
        ("Dear Clara Vance, hi", [("Clara Vance", "NAME", 0.6)]),
    ]),
    "portuguese": (("NAME",), {"languages": ("pt",), "jurisdictions": ("PT",)}, None, [
        ("o Relatório de João Mendes Costa", [("João Mendes Costa", "NAME", 0.6)]),
    ]),
}


def _register(name: str, categories, profile, column, cases) -> None:
    texts = [(i, text) for i, (text, _) in enumerate(cases)]
    expected = [(i, text, span, category, sure) for i, (text, found) in enumerate(cases) for span, category, sure in found]
    forms = ["engine", *(["column"] if column else [])]

    def quoted(v) -> str:
        return "'" + v.replace("'", "''") + "'"

    rows = ", ".join(f"({i}, {quoted(t)}, {quoted(s)}, '{c}', {sure!r}::DOUBLE)" for i, t, s, c, sure in expected)
    form_rows = ", ".join(f"('{f}')" for f in forms)
    # the last occurrence: where a text has a span twice, the later one is meant
    at = "CAST(length(t) - length(s) - strpos(reverse(t), reverse(s)) + 1 AS INTEGER)"
    sql = f"""SELECT form, id, {at} AS "start", category, s AS text, confidence
        FROM (VALUES {rows}) AS e(id, t, s, category, confidence), (VALUES {form_rows}) AS f(form)"""
    if not all(t.count(s) == 1 or t.rindex(s) >= 0 for _, t, s, _, _ in expected):
        raise ValueError(name)

    def run(spark, sf_dir):
        docs = local_rows(spark, texts, "id int, text string")
        engine = ops.detect(docs, **profile).select("id", F.explode("spans").alias("s")).filter(F.col("s.category").isin(*categories))
        out = engine.select(F.lit("engine").alias("form"), "id", "s.start", "s.category", "s.text", "s.confidence")
        if column:
            spans = docs.select("id", F.explode(column(F.col("text"))).alias("s"))
            out = out.unionByName(spans.select(F.lit("column").alias("form"), "id", "s.start", "s.category", "s.text", "s.confidence"))
        return out

    inline(sql, f"cases_{name}")(run)


for _name, _case in CASES.items():
    _register(_name, *_case)


#: Detectors that SQL can say too: (category, shield, confidence), column form.
TWINS = {
    "EMAIL": (("EMAIL", 1.0), D.email), "CREDIT_CARD": (("CREDIT_CARD", 1.0), D.card), "PHONE": (("PHONE", 1.0), D.phone),
    "MASKED_ID": (("MASKED_ID", 1.0), D.masked_id), "COMPANY": (("COMPANY", 0.4), D.acronym),
}


def _twins_sql() -> str:
    counts = " UNION ALL ".join(f"SELECT doc_id, category FROM ({ORACLES[q]})" for q in ("email_spans", "card_spans_luhn", "phone_spans", "masked_id_spans", "acronym_spans"))
    return f"SELECT doc_id, category, count(*) AS n_engine, count(*) AS n_columns, count(*) AS n_same FROM ({counts}) GROUP BY ALL"


@query(_twins_sql())
def detector_twins(spark, sf_dir):
    """Spans of the engine's pass and of the column forms over all documents: how many of each, and how many are the same."""
    docs = tables.read(spark, sf_dir, "documents", "doc_id", "text")
    span = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), s["text"].alias("text"), s["confidence"].alias("confidence"))
    wanted = [F.struct(F.lit(c).alias("c"), F.lit(sure).alias("sure")) for (c, sure), _ in TWINS.values()]
    found = ops.candidates(docs).select("doc_id", F.explode("candidates").alias("s")).where(F.struct(F.col("s.category").alias("c"), F.col("s.confidence").alias("sure")).isin(*wanted))
    columns = docs.select("doc_id", F.explode(F.concat(*[form(F.col("text")) for _, form in TWINS.values()])).alias("s"))
    both = found.select("doc_id", span(F.col("s")).alias("s"), F.lit(1).alias("e"), F.lit(0).alias("c")).union(columns.select("doc_id", span(F.col("s")), F.lit(0), F.lit(1)))
    each = both.groupBy("doc_id", "s").agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
    return each.groupBy("doc_id", F.col("s.category").alias("category")).agg(F.sum("e").alias("n_engine"), F.sum("c").alias("n_columns"), F.sum(F.least("e", "c")).alias("n_same"))
