"""Files made here, read back as documents; what leaves, and how it comes back."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.operators import detect, export, identity, mapping, pseudonyms
from maskwright.sources import files, office, rules

W = 'xmlns:w="http://w"'


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


XLSX = packed({
    "xl/workbook.xml": '<workbook xmlns="m"><sheets><sheet name="Data"/><sheet name="Void"/></sheets></workbook>',
    "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>name</t></si><si><r><t>An</t></r><r><t>a</t></r></si></sst>',
    "xl/styles.xml": '<styleSheet xmlns="m"><numFmts><numFmt numFmtId="164" formatCode="0.0%"/><numFmt numFmtId="165" formatCode="yyyy\\-mm"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x|y</t></is></c></row>'
    '<row><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>61</v></c><c r="C2" s="2"><f>A1</f><v>0.25</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"><v>007</v></c></row><row/></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": '<worksheet xmlns="m"><sheetData/></worksheet>',
})
DOCX = packed({
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Report</w:t></w:r></w:p><w:p><w:r><w:t>Ana </w:t></w:r><w:r><w:t>Prieto</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>two</w:t></w:r></w:p>'
    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
})
ODT = packed({
    "content.xml": '<o:c xmlns:o="o" xmlns:t="t" xmlns:d="d"><o:text><t:h t:outline-level="2">Head</t:h><t:p>Some <t:span>text</t:span></t:p>'
    "<t:list><t:list-item><t:p>a</t:p><t:list><t:list-item><t:p>b</t:p></t:list-item></t:list></t:list-item></t:list>"
    "<t:tracked-changes><d:creator>Eva</d:creator></t:tracked-changes><t:p><o:annotation><d:creator>Leo</d:creator><t:p>note</t:p></o:annotation></t:p></o:text></o:c>",
    "meta.xml": '<m xmlns:d="d"><d:creator>Ana Prieto</d:creator></m>',
})
PPTX = packed({
    **{f"ppt/slides/slide{i}.xml": f'<s xmlns:a="a"><spTree><a:sp><a:p><a:t>slide {i}</a:t></a:p></a:sp><a:pic/></spTree></s>' for i in (1, 2, 10)},
    "ppt/slides/_rels/slide2.xml.rels": '<R><Relationship Type="x/notesSlide" Target="../notesSlides/notesSlide7.xml"/></R>',
    "ppt/notesSlides/notesSlide7.xml": '<n xmlns:a="a"><a:p><a:t>say it</a:t></a:p></n>',
})
EML = (
    b"From: Ana <ana@e.org>\r\nTo: Leo <leo@e.org>\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n"
    b"--x\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHello there\r\n--x\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\n%PDF\r\n--x--\r\n"
)


def test_readers():
    text, warnings = office.xlsx(XLSX)
    assert text == "## Data\n\n| name |  | x\\|y |  |  |\n| --- | --- | --- | --- | --- |\n| Ana | 1900-03-01 | 25.0% | TRUE | 007 |"
    assert warnings == ["sheet Void is empty", "formulas were replaced by their last value"]
    assert office.docx(DOCX)[0] == "# Report\n\nAna Prieto\n\n- one\n- two\n\n| a | b |\n| --- | --- |"
    text, warnings = office.odt(ODT)
    assert text.startswith("## Head\n\nSome text\n\n- a\n  - b") and text.endswith("Comments:\n- note")
    assert any("Eva" in w for w in warnings) and any("Leo" in w for w in warnings) and warnings[-1].endswith("Ana Prieto")
    text, warnings = office.pptx(PPTX)
    assert [line for line in text.split("\n") if line.startswith("## ")] == ["## Slide 1", "## Slide 2", "## Slide 3"]
    assert text.index("slide 2") < text.index("say it") < text.index("slide 10") and warnings == ["3 images were left out"]
    text, warnings = office.eml(EML)
    assert text == "From: Ana <ana@e.org>\nTo: Leo <leo@e.org>\nSubject: café\n\nHello there" and warnings == ["1 attachments were left out: a.pdf"]
    with pytest.raises(ValueError):
        office.opened(packed({f"f{i}": "" for i in range(2001)}))


def test_files_are_rows_whatever_they_hold(spark, tmp_path):
    kinds = {"a.xlsx": XLSX, "b.docx": DOCX, "c.odt": ODT, "d.pptx": PPTX, "e.eml": EML, "f.TXT": "plain é".encode(), "g.csv": b"a;b\n1;2\n", "h.html": b"<h1>T</h1><b>x</b>", "i.zip": b"PK", "j.xlsx": b"PK broken", "k.txt": b" \n", "l": b"x", "m.eml": b"no header"}
    for name, data in kinds.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: r for r in files.read(spark, f"file://{tmp_path}").collect()}
    assert {n: r.status for n, r in got.items()} == {
        "a.xlsx": "review", "b.docx": "review", "c.odt": "review", "d.pptx": "review", "e.eml": "review", "f.TXT": "complete", "g.csv": "complete", "h.html": "review",
        "i.zip": "failed", "j.xlsx": "failed", "k.txt": "empty", "l": "failed", "m.eml": "failed",
    }
    assert got["f.TXT"].text == "plain é" and got["h.html"].text == "# T\n\nx"
    files.register(["zip"], lambda content: ("opened", []))
    assert "zip" in files.extensions() and files.read(spark, f"file://{tmp_path}/i.zip").first().text == "opened"


def test_workbook_round_trip(spark):
    text = "## Data\n\n| a | b\\|c |\n| --- | --- |\n| 007 |  |\n\n## data\n\n| x |\n| --- |\n| <&> |"
    docs = spark.createDataFrame([(1, text, "xlsx"), (2, text, "docx"), (3, "no table", "csv"), (4, None, "csv")], "id int, text string, format string")
    got = {r.id: r.workbook for r in export.workbooks(docs).collect()}
    assert office.xlsx(bytes(got[1]))[0] == text.replace("## data", "## data (2)") and got[2] is got[3] is got[4] is None


def test_rules_are_taken_whole_or_not_at_all(spark):
    good = '[{"id":"1","termOrPattern":"a.b","replacementType":"FIXED","isRegex":false},{"id":"2","termOrPattern":"[0-9]+","replacementType":"CATEGORY","targetCategory":"Code","isRegex":true}]'
    given = [(1, good), (2, good.replace("[0-9]+", "(")), (3, "nonsense"), (4, good.replace('"FIXED"', '"OTHER"')), (5, "[]"), (6, None), (7, good[:-1] + ',{"id":"3","termOrPattern":"x","replacementType":"CATEGORY","targetCategory":"CODE","isRegex":false}]')]
    got = {r.id: r for r in rules.read(spark.createDataFrame(given, "id int, json string")).collect()}
    assert [bool(got[i].problem) for i in range(1, 8)] == [False, True, True, True, False, True, True]
    assert [r.termOrPattern for r in got[1].rules] == ["a.b", "[0-9]+"] and got[2].rules == []
    whole = spark.createDataFrame([tuple(r) for r in got[1].rules], "id string, termOrPattern string, replacementType string, targetCategory string, isRegex boolean")
    assert rules.read(rules.write_json(whole)).first().problem is None


def test_stand_ins(spark):
    text = "Ana Prieto Casal pagó 1.250.000 € a Acme, S.L. y Leo Souto Vila nada. ana@e.org"
    docs = detect.mask(spark.createDataFrame([(1, text), (2, None)], "id int, text string"))
    one, two = (sorted(pseudonyms.pseudonymized(docs, "id").collect(), key=lambda r: r.id) for _ in range(2))
    assert one == two and one[1].realistic == ""
    fakes = one[0].pseudonyms
    assert len(set(fakes.values())) == len(fakes) and fakes["EMAIL_1"] == "[[EMAIL_001]]"
    money = int(fakes["MONEY_1"].removesuffix(" €").replace(".", ""))
    assert 0.1 <= abs(money / 1_250_000 - 1) <= 0.25 and money % 10_000 == 0
    assert "Prieto" not in one[0].realistic and fakes["COMPANY_1"].endswith(", S.L.")
    assert pseudonyms.fake_amount("$1,234.56", pseudonyms.draws(5), "ES", (10, 25)).startswith("$1,")
    assert pseudonyms.fake_amount("mil euros", pseudonyms.draws(5), "ES", (10, 25)) is None


def test_tokens_stay_over_revisions(spark):
    scope = "AB" * 16
    docs = detect.mask(spark.createDataFrame([(1, "soy Ana Prieto, a@b.com")], "id int, text string"))
    first = identity.identify(docs.withColumn("scope", F.lit(scope)).withColumn("previous", F.lit(None).cast(f"array<{detect.MAPPING}>")).withColumn("n", F.lit(1)), ["id"], "scope", "previous", "n")
    row = first.first()
    assert row.masked == f"soy [[V1_{scope}_NAME_1]], [[V1_{scope}_EMAIL_2]]" and row.next_counter == 3
    text = f"c@d.org y soy Ana Prieto [[V1_{scope}_EMAIL_3]]"
    again = detect.mask(spark.createDataFrame([(1, text)], "id int, text string"))
    known = first.select("id", F.col("mappings").alias("previous"), F.col("next_counter").alias("n"))
    second = identity.identify(again.join(known, "id").withColumn("scope", F.lit(scope)), ["id"], "scope", "previous", "n").first()
    assert second.masked == f"[[V1_{scope}_EMAIL_4]] y soy [[V1_{scope}_NAME_1]] [[V1_{scope}_EMAIL_3]]" and second.next_counter == 5
    kept = first.select(identity.snapshot_problem(F.lit(scope), F.col("mappings")).alias("own"), identity.snapshot_problem(F.lit("F" * 32), F.col("mappings")).alias("other")).first()
    assert kept.own is None and kept.other
    strict = detect.restored(first.select("masked", "mappings"), tolerant=False, legacy=False).first().result
    assert strict.text == "soy Ana Prieto, a@b.com" and strict.restored == 2


def test_old_mappings_and_switches(spark):
    docs = detect.mask(spark.createDataFrame([(1, "Ana Prieto hizo Análisis. Ana Prieto, a@b.com")], "doc_id int, text string"))
    assert mapping.render_old(docs.drop("masked")).first().masked == "[[NAME_001]] hizo Análisis. [[NAME_001]], [[EMAIL_001]]"
    rows = mapping.toggle(mapping.mapping_rows(docs, ["doc_id"]), ["EMAIL_1"], False)
    assert rows.filter("not enabled").count() == 1


def test_gate_and_sealed_keys(spark):
    docs = detect.mask(spark.createDataFrame([(1, "soy Ana Prieto"), (2, ""), (3, "see http://e.org")], "id int, text string"))
    found = export.findings(F.col("masked"), F.col("text"), F.col("mappings"), F.lit("complete"), F.lit(None).cast("array<string>"), F.lit("ready"), F.lit(0))
    rows = docs.withColumn("findings", found).withColumn("acknowledged", F.col("id") == 3)
    assert {r.id for r in export.released(rows).collect()} == {1, 3} and {r.id for r in export.released(rows, unattended=True).collect()} == {1}
    assert "<mark>[[NAME_001]]</mark>" in docs.filter("id = 1").select(export.page(F.col("masked"), "t").alias("p")).first().p
    plain = spark.createDataFrame([(1, '{"a":1}'), (2, "é"), (3, None)], "id int, snapshot string")
    made = export.seal(plain, "pass", salt=b"0" * 16)
    key = hashlib.pbkdf2_hmac("sha256", b"pass", b"0" * 16, 600_000, 32)
    shown = made._jdf.queryExecution().toString().lower()
    assert key.hex() not in shown and "pass" not in shown.replace("passes", "")
    other = export.seal(plain.where("id = 2").withColumn("id", F.lit(4)), "pass")
    sealed = spark.createDataFrame(made.collect() + other.collect(), made.schema)  # one nonce a row, drawn once
    one = json.loads(sealed.where("id = 1").first().envelope)
    assert list(one) == list(export.FIELDS) and (one["version"], one["iterations"], one["salt"]) == (1, 600_000, "30" * 16)
    assert len(one["nonce"]) == 24 and len(one["ciphertext"]) == 2 * (7 + 16)
    bound = json.dumps([one[f] for f in export.FIELDS[:-1]], separators=(",", ":"))
    again = spark.range(1).select(F.aes_decrypt(F.lit(bytes.fromhex(one["nonce"] + one["ciphertext"])), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bound)).cast("string"))
    assert again.first()[0] == '{"a":1}'
    assert {r.id: r.snapshot for r in export.unseal(sealed, "pass").collect()} == {1: '{"a":1}', 2: "é", 3: None, 4: "é"}
    assert {r.snapshot for r in export.unseal(sealed, "other").collect()} == {None}
    more = sealed.where("id = 1").withColumn("envelope", F.regexp_replace("envelope", r"^\{", '{"x":1,'))
    assert {r.snapshot for r in export.unseal(more, "pass").collect()} == {None}
    broken = sealed.withColumn("envelope", F.regexp_replace("envelope", "600000", "600001"))
    assert {r.snapshot for r in export.unseal(broken, "pass").collect()} == {None}
