"""Queries of profiles that documents bring themselves, of the fused pass, of sessions and of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.packs import COUNTRY_LANGUAGES, PACKS, lexicon_of
from maskwright.functions.spans import RUNG
from maskwright.operators import detect as ops
from maskwright.operators import language, profile
from maskwright.plans.catalogue import _DATE_SQL, _TWO_SQL, _docs, _spans_sql
from maskwright.plans.registry import ORACLES, query
from maskwright.plans.review import lang_detected
from maskwright.sources import packages, sessions, tables

_LANDS_SQL = ", ".join(
    f"CASE WHEN list_has_any(string_split(languages, ','), {list(langs)!r}) THEN '{country}' END" for country, langs in COUNTRY_LANGUAGES.items()
)
_PROFILES_SQL = f"""SELECT doc_id, languages, concat_ws(',', {_LANDS_SQL}) AS jurisdictions
    FROM (SELECT doc_id, CASE WHEN languages = '' THEN 'en' ELSE languages END AS languages FROM ({ORACLES[lang_detected.__name__]}))"""


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id with the languages and jurisdictions that its text suggests."""
    found = language.detected(docs, ["doc_id"]).select("doc_id", F.col("languages").alias("detected"))
    return profile.by_profile(found, "detected").drop("detected")


@query(_PROFILES_SQL)
def document_profiles(spark, sf_dir):
    rows = _profiles(_docs(spark, sf_dir))
    return rows.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("languages", "jurisdictions")])


_EXCLUDED = ", ".join(f"('{lang}', '{w}')" for lang in PACKS for w in lexicon_of((lang,))["acronym_exclusions"])


@query(
    f"""WITH s AS ({_spans_sql(r"\b[A-Z]{2,}\b", "COMPANY")}), p AS ({_PROFILES_SQL}), x(lang, word) AS (VALUES {_EXCLUDED})
    SELECT s.doc_id, s."start", s."end", s.text, p.languages FROM s JOIN p USING (doc_id)
    WHERE list_has_any(string_split(p.languages, ','), {list(PACKS)!r})
      AND NOT EXISTS (SELECT 1 FROM x WHERE x.word = s.text AND list_contains(string_split(p.languages, ','), x.lang))"""
)
def profiled_acronyms(spark, sf_dir):
    """Acronyms of every document under the lists of its own languages."""
    docs = _docs(spark, sf_dir)
    own = docs.join(_profiles(docs), "doc_id")
    found = ops.candidates(own, languages_col="languages", jurisdictions_col="jurisdictions").filter(F.size("candidates") > 0)
    rows = found.select("doc_id", F.array_join("languages", ",").alias("languages"), F.explode("candidates").alias("s"))
    return rows.filter(F.col("s.rung") == RUNG["COMPANY_ACRONYM"]).select("doc_id", "s.start", "s.end", "s.text", "languages")


# The fused pass with the switches of what SQL can say: emails, cards, phones, masked ids, behind the shield of dates.
_SAID = dict(languages=(), jurisdictions=("ES",), settings={c: False for c in ("IBAN", "MONEY", "VAT_NUMBER", "DNI", "NIE", "INVALID_ID", "ID_CODE", "ADDRESS", "LOCATION")})
_SAID_SQL = _TWO_SQL.replace('ORDER BY "start" - "end", "start", turn', 'ORDER BY turn > 0, "start" - "end", "start", turn').replace(
    "SELECT *, 1 AS turn", f"SELECT *, 0 AS turn FROM ({_spans_sql(_DATE_SQL, 'SHIELD')}) UNION ALL SELECT *, 1 AS turn", 1
)
_PUT_SQL = _SAID_SQL + """, v AS (SELECT * FROM w WHERE category <> 'SHIELD'), f AS (
      SELECT doc_id, text AS original_text, arg_min(category, "start") AS category, min("start") AS first_start, count(*) AS n FROM v GROUP BY doc_id, text
    ), p AS (SELECT *, '[[' || category || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, category ORDER BY first_start) AS VARCHAR), 3, '0') || ']]' AS placeholder FROM f)"""


@query(_SAID_SQL + ' SELECT doc_id, "start", "end", category, text FROM w')
def fused_spans(spark, sf_dir):
    """Winners of the fused pass, shields included."""
    return ops.exploded(ops.detect(_docs(spark, sf_dir), **_SAID), ["doc_id"]).select("doc_id", "start", "end", "category", "text")


@query(_PUT_SQL + " SELECT doc_id, original_text, category, placeholder, n AS n_occurrences FROM p")
def fused_mappings(spark, sf_dir):
    """Mappings of the fused pass."""
    rows = ops.mask(_docs(spark, sf_dir), **_SAID).select("doc_id", F.explode("mappings").alias("m"))
    return rows.select("doc_id", "m.original_text", "m.category", "m.placeholder", F.size("m.occurrences").cast("long").alias("n_occurrences"))


_ROUND_SQL = _PUT_SQL + """, o AS (SELECT v.doc_id, list(struct_pack(a := v."start", z := v."end", p := p.placeholder) ORDER BY v."start") AS os
      FROM v JOIN p ON p.doc_id = v.doc_id AND p.original_text = v.text GROUP BY v.doc_id),
    b AS (SELECT d.doc_id, coalesce(CASE WHEN o.os IS NULL THEN d.text ELSE
      array_to_string(list_transform(range(1, len(o.os) + 1), lambda i:
        substr(d.text, CASE WHEN i = 1 THEN 1 ELSE o.os[i-1].z + 1 END, o.os[i].a - CASE WHEN i = 1 THEN 0 ELSE o.os[i-1].z END) || o.os[i].p), '')
      || substr(d.text, o.os[len(o.os)].z + 1) END, '') AS masked, coalesce(d.text, '') AS back
    FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id)"""


@query(_ROUND_SQL + " SELECT doc_id, masked, back FROM b")
def fused_round_trip(spark, sf_dir):
    """Texts masked in the fused pass, and what restoring the masked text gives: the text itself, whole."""
    masked = ops.mask(_docs(spark, sf_dir), **_SAID).select("doc_id", "masked", "mappings")
    return ops.restored(masked).select("doc_id", "masked", F.col("result.text").alias("back"))


@query(
    _ROUND_SQL
    + """ SELECT b.doc_id, masked, CAST(NULL AS VARCHAR) AS problem, coalesce(m.n, 0) AS n_mappings, coalesce(m.k, 0) AS n_occurrences
    FROM b LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS k FROM p GROUP BY doc_id) m ON m.doc_id = b.doc_id"""
)
def session_round_trip(spark, sf_dir):
    """Sessions of all documents written as JSON and read back: all checks hold, mappings and texts are there."""
    masked = ops.mask(_docs(spark, sf_dir), **_SAID)
    made = sessions.of_masked(F.col("doc_id"), F.lit("2024-01-01T00:00:00Z"), F.col("text"), F.col("masked"), F.col("mappings"), F.lit("raw_text"))
    back = sessions.read(masked.select("doc_id", sessions.written(made).alias("json")))
    spots = F.aggregate("session.mappings", F.lit(0).cast("long"), lambda n, m: n + F.size(m["occurrences"]))
    return back.select(
        "doc_id", F.col("session.anonymizedMarkdown").alias("masked"), "problem", F.size("session.mappings").cast("long").alias("n_mappings"), spots.alias("n_occurrences")
    )


# A package a source: an entry for each document, named by its length and with the digest of the text with single
# blanks. Texts of equal length share a name, texts of other blanks do not match.
_FILES_SQL = "(SELECT source || '/' || doc_id || '/' || strlen(text) || '.txt' AS file, strlen(text) || '.txt' AS name, strlen(text) AS size, sha256(text) AS digest FROM documents WHERE text IS NOT NULL)"
_MANIFEST_SQL = """(SELECT source AS model, doc_id AS nth, strlen(text) || '.txt' AS path, strlen(plain) AS bytes, sha256(plain) AS sha256,
    row_number() OVER (PARTITION BY source, strlen(text) ORDER BY doc_id) AS turn
    FROM (SELECT source, doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[ \\n]+', ' ', 'g') AS plain FROM documents))"""
_ENTRIES_SQL = f"""WITH f AS {_FILES_SQL}, m AS {_MANIFEST_SQL}, t AS (
      SELECT model, nth, coalesce(max({{'file': f.file, 'size': f.size, 'digest': f.digest}}) FILTER (f.size = m.bytes), min({{'file': f.file, 'size': f.size, 'digest': f.digest}})) AS taken
      FROM m JOIN f ON f.name = m.path WHERE turn = 1 GROUP BY model, nth
    ), e AS (SELECT m.model, m.nth, m.path, taken.file AS found,
      CASE WHEN taken IS NULL THEN 'missing' WHEN taken.size = m.bytes AND taken.digest = m.sha256 THEN 'fits' ELSE 'mismatch' END AS status
      FROM m LEFT JOIN t ON t.model = m.model AND t.nth = m.nth)"""


def _package(spark, sf_dir) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents", "doc_id", "source", "text")
    name = F.concat(F.octet_length("text").cast("string"), F.lit(".txt"))
    files = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string"), name).alias("path"), F.col("text").cast("binary").alias("content"))
    text = docs.withColumn("text", F.coalesce("text", F.lit("")))
    plain = F.regexp_replace("text", r"[ \n]+", " ")
    manifest = text.select(
        F.col("source").alias("model"), F.col("doc_id").alias("nth"), name.alias("path"), F.octet_length(plain).alias("bytes"), F.sha2(plain.cast("binary"), 256).alias("sha256")
    )
    return packages.entries(files, manifest)


@query(_ENTRIES_SQL + " SELECT model, nth, path, found, status FROM e")
def package_entries(spark, sf_dir):
    return _package(spark, sf_dir)


@query(
    _ENTRIES_SQL
    + """ SELECT model, bool_and(status = 'fits') AS ok, CASE WHEN bool_and(status = 'fits') THEN count(*) ELSE 0 END AS stored,
      CASE WHEN bool_or(status = 'missing') THEN 'missing' WHEN bool_or(status = 'mismatch') THEN 'mismatch' END AS reason,
      count(*) FILTER (status = 'missing') AS n_missing,
      coalesce(arg_min(path, nth) FILTER (status = 'missing'), arg_min(path, nth) FILTER (status = 'mismatch')) AS detail
    FROM e GROUP BY model"""
)
def package_imports(spark, sf_dir):
    """Packages of all sources: which would be stored, and why the others would not."""
    return packages.imports(_package(spark, sf_dir))
