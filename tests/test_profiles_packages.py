from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from maskwright.functions.engine import Engine, apply, mappings
from maskwright.operators.detect import candidates, detect, mask
from maskwright.sources import packages

TEXTS = [
    "El NIF 123456789 y el DNI 12345678Z de Acme Sociedade Lda, ONU y DGS.",
    "Dear Mr Smith, NASA and ACME Ltd. wrote to bob@example.com on 2024-01-01.",
    "A empresa Silva Lda. tem NIF 501442600 e o cartão do senhor João Silva.",
    "",
]
PROFILES = [(["en"], [], {}), (["pt"], ["PT"], {"EMAIL": False}), (["es", "gl"], ["ES", "PT"], {"DNI": False}), (["zz"], ["zz"], {}), (None, None, None), ([None, "es"], ["ES"], {"NAME": None})]


def _rows(spark):
    given = [(n * 10 + k, t, *p) for n, t in enumerate([*TEXTS, None]) for k, p in enumerate(PROFILES)]
    schema = "id long, text string, `l.s` array<string>, lands array<string>, switches map<string,boolean>"
    return given, spark.createDataFrame(given, schema)


def _engine(langs, lands, switches) -> Engine:
    clean = lambda xs: tuple(x for x in xs if x is not None)
    given = {"languages": ("es", "en"), "jurisdictions": ("ES",)}
    if langs is not None:
        given |= {"languages": clean(langs), "jurisdictions": clean(lands), "settings": dict(switches)}
    return Engine(**given)


def test_rows_are_masked_under_their_own_profile(spark):
    given, docs = _rows(spark)
    columns = {"languages_col": "l.s", "jurisdictions_col": "lands", "settings_col": "switches"}
    got = {r.id: r for r in mask(docs, **columns).collect()}
    found = {r.id: r for r in detect(docs, **columns).collect()}
    every = {r.id: r for r in candidates(docs, **columns).collect()}
    assert len(got) == len(given)
    kinds = set()
    for i, text, *p in given:
        engine, text = _engine(*p), text or ""
        spans = engine.detect(text)
        assert [tuple(s) for s in got[i].spans] == [tuple(s) for s in spans] == [tuple(s) for s in found[i].spans]
        assert [tuple(s) for s in every[i].candidates] == [tuple(s) for s in engine.candidates(text)]
        assert got[i].masked == apply(text, mappings(text, spans))
        kinds.add(tuple(s.category for s in spans))
    assert len(kinds) > 5  # the profiles differ in what they find


def test_profiles_of_an_empty_table(spark):
    _, docs = _rows(spark)
    assert mask(docs.limit(0), languages_col="l.s").count() == 0


def _sha(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def test_packages_are_taken_whole_or_not_at_all(spark):
    good, other = b"weights", b"tokens!"
    manifest = [
        ("whole", 0, "config.json", 2, _sha(b"{}")),
        ("whole", 1, "onnx/model.onnx", len(good), _sha(good)),
        ("twice", 0, "a/config.json", 2, _sha(b"{}")),
        ("twice", 1, "b/config.json", 2, _sha(b"{}")),
        ("wrong", 0, "model.onnx", len(good), _sha(other)),
        ("wrong", 1, "config.json", 3, _sha(b"{}")),
        ("absent", 0, "vocab.txt", 1, _sha(b"v")),
        ("absent", 1, "none.bin", 1, _sha(b"v")),
        ("absent", 2, "config.json", 9, _sha(b"{}")),
    ]
    files = [
        ("in/z/config.json", b"{}"),
        ("in/a/config.json", b"{ }"),
        ("C:\\models\\onnx\\model.onnx", good),
        ("in/readme.md", b"?"),
        (None, good),
        ("in/vocab.txt", None),
    ]
    m = spark.createDataFrame(manifest, "model string, nth long, path string, bytes long, sha256 string")
    f = spark.createDataFrame(files, "path string, content binary")
    got = {(r.model, r.nth): (r.found, r.status) for r in packages.entries(f, m).collect()}
    assert got == {
        ("whole", 0): ("in/z/config.json", "fits"),
        ("whole", 1): ("C:\\models\\onnx\\model.onnx", "fits"),
        ("twice", 0): ("in/z/config.json", "fits"),
        ("twice", 1): (None, "missing"),
        ("wrong", 0): ("C:\\models\\onnx\\model.onnx", "mismatch"),
        ("wrong", 1): ("in/a/config.json", "mismatch"),
        ("absent", 0): (None, "missing"),
        ("absent", 1): (None, "missing"),
        ("absent", 2): ("in/a/config.json", "mismatch"),
    }
    told = {r.model: tuple(r)[1:] for r in packages.imports(packages.entries(f, m)).collect()}
    assert told == {
        "whole": (True, 2, None, 0, None),
        "twice": (False, 0, "missing", 1, "b/config.json"),
        "wrong": (False, 0, "mismatch", 0, "model.onnx"),
        "absent": (False, 0, "missing", 2, "vocab.txt"),
    }
    kept = packages.stored(f, m)
    assert {(r.model, r.path): bytes(r.content) for r in kept.collect()} == {("whole", "config.json"): b"{}", ("whole", "onnx/model.onnx"): good}
    assert {r.model for r in packages.provisioned(kept, m).filter("provisioned").collect()} == {"whole"}
    assert packages.entries(f, m.limit(0)).count() == 0
    assert {r.status for r in packages.entries(f.limit(0), m).collect()} == {"missing"}


def test_packages_of_a_folder(spark, tmp_path):
    (tmp_path / "p" / "onnx").mkdir(parents=True)
    (tmp_path / "p" / "onnx" / "model.onnx").write_bytes(b"weights")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}")
    m = spark.createDataFrame([("x", 0, "onnx/model.onnx", 7, _sha(b"weights"))], "model string, nth long, path string, bytes long, sha256 string")
    assert packages.imports(packages.entries(f, m)).select("ok", F.col("stored")).first() == (True, 1)
