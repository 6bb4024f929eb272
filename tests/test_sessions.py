from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from maskwright.operators.detect import mask
from maskwright.sources import sessions

GOOD = {
    "sessionId": "s", "createdAt": "2024-01-01", "inputType": "PASTE", "originalFormat": "raw_text", "rawMarkdown": "é😀 bob", "anonymizedMarkdown": "é😀 [[X_001]]",
    "mappings": [{"id": "1", "originalText": "bob", "placeholder": "[[X_001]]", "category": "X", "enabled": True, "confidence": 1, "source": "regex", "occurrences": [{"start": 3, "end": 6, "text": "bob"}]}],
    "tokenCounter": 1, "storageGeneration": "g1", "extra": {"any": [1]},
    "coverage": {"status": "complete", "warnings": [], "structuralWarnings": ["w"]},
    "identity": {"scope": "A" * 32, "documentId": "d", "documentRevision": 0, "policyRevision": 1, "mappingRevision": 2},
    "detectionProfile": {"languages": ["es", "zz"], "jurisdictions": ["ES"]},
}


def _changed(path: str, value) -> str:
    one = copy.deepcopy(GOOD)
    at = one
    *way, last = [int(p) if p.isdigit() else p for p in path.split(".")]
    for p in way:
        at = at[p]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return json.dumps(one)


CASES = [
    (_changed("sessionId", KeyError), "head"),
    (_changed("inputType", "MAIL"), "head"),
    (_changed("originalFormat", None), "head"),
    (_changed("rawMarkdown", None), "text"),
    (_changed("rawMarkdown", "x" * 2_000_001), "text"),
    (_changed("mappings", None), "mappings"),
    (_changed("mappings.0", None), "mappings"),
    (_changed("mappings.0.id", "i" * 201), "mappings"),
    (_changed("mappings.0.enabled", "yes"), "json"),
    (_changed("mappings.0.enabled", None), "mappings"),
    (_changed("mappings.0.source", "guess"), "mappings"),
    (_changed("mappings.0.variants", ["bob", None]), "mappings"),
    (_changed("mappings", GOOD["mappings"] * 2), "placeholders"),
    (_changed("fileName", "n" * 1001), "file name"),
    (_changed("mappings.0.occurrences", [{"start": 2, "end": 5, "text": "bob"}]), "occurrences"),
    (_changed("mappings.0.occurrences", [{"start": 3, "end": 3, "text": ""}]), "occurrences"),
    (_changed("mappings.0.occurrences", [{"start": 3, "end": 7, "text": "bob"}]), "occurrences"),
    (_changed("mappings.0.occurrences", [{"start": -1, "end": 2, "text": "b"}]), "occurrences"),
    (_changed("mappings.0.occurrences", [None]), "occurrences"),
    (_changed("coverage.status", "done"), "coverage"),
    (_changed("coverage.warnings", KeyError), "coverage"),
    (_changed("tokenCounter", 0), "counter"),
    (_changed("tokenCounter", 2**53), "counter"),
    (_changed("identity.scope", "a" * 32), "identity"),
    (_changed("identity.policyRevision", -1), "identity"),
    (_changed("identity.mappingRevision", KeyError), "identity"),
    (_changed("detectionProfile.languages", KeyError), "profile"),
    (_changed("storageGeneration", "g0"), "generation"),
    ("{", "json"),
    ("[]", "json"),
    ("", "json"),
    (None, "json"),
    (" " * 8_000_001, "json"),
    (json.dumps(GOOD), None),
    (_changed("storageGeneration", KeyError), None),
    (_changed("mappings.0.variants", []), None),
    (_changed("mappings.0.variants", ["bob", "Bob"]), None),
    (_changed("mappings.0.occurrences", KeyError), None),
    (_changed("mappings", []), None),
    (_changed("identity", KeyError), None),
    (_changed("detectionProfile", None), None),
]


def test_every_check_tells_its_problem(spark):
    rows = spark.createDataFrame([(n, text, "own", "x") for n, (text, _) in enumerate(CASES)], "n int, `the.json` string, row string, s string")
    got = {r.n: r for r in sessions.read(rows, "the.json", F.lit("g1")).collect()}
    assert {n: r.problem for n, r in got.items()} == {n: problem for n, (_, problem) in enumerate(CASES)}
    assert all((r.session is None) == (r.problem is not None) and (r.row, r.s) == ("own", "x") for r in got.values())
    good = got[[text for text, _ in CASES].index(json.dumps(GOOD))].session
    assert good.mappings[0].variants == ["bob"] and good.mappings[0].occurrences[0].text == "bob"
    assert good.detectionProfile.languages == ["es"] and good.identity.mappingRevision == 2
    kept = [r.session.mappings[0].variants for r in got.values() if r.session and r.session.mappings]
    assert kept.count(["bob", "Bob"]) == 1 and all(kept)


def test_sessions_of_masked_rows_come_back(spark):
    docs = spark.createDataFrame([(1, "Mail bob@example.com 😀 or bob@example.com."), (2, None), (3, ""), (4, "none")], "id long, text string")
    masked = mask(docs)
    made = sessions.of_masked(F.col("id"), F.lit("now"), F.col("text"), F.col("masked"), F.col("mappings"), F.lit("raw_text"), F.lit("g"))
    stored = masked.select(sessions.written(made).alias("json"))
    got = {r.session.sessionId: r.session for r in sessions.read(stored, generation=F.lit("g")).collect()}
    assert got["1"].anonymizedMarkdown == "Mail [[EMAIL_001]] 😀 or [[EMAIL_001]]." and len(got["1"].mappings[0].occurrences) == 2
    assert got["2"].rawMarkdown == got["3"].rawMarkdown == "" and got["4"].mappings == []
    assert {r.problem for r in sessions.read(stored, generation=F.lit("next")).collect()} == {"generation"}
    assert sessions.read(stored.limit(0)).count() == 0
