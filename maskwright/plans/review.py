"""Queries of profiles, money, stand-ins, identity, exports, models and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import detectors as D
from maskwright.functions import scalars
from maskwright.functions.names import cluster_names
from maskwright.operators import export, identity, language, mapping, models, profile, pseudonyms, quality
from maskwright.operators import detect as ops
from maskwright.plans.catalogue import RULES, _docs, _spans_sql
from maskwright.plans.registry import inline, query, values_sql
from maskwright.scratch import local_rows
from maskwright.sources import rules as rule_source
from maskwright.sources import tables

# names

_NAME = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}"


@query(
    rf"""WITH RECURSIVE m AS (SELECT doc_id, regexp_extract_all(text, '{_NAME}') AS ns FROM documents),
    n AS (SELECT DISTINCT doc_id, name, list_distinct(string_split(lower(name), ' ')) AS tokens, list_position(ns, name) AS k
          FROM (SELECT doc_id, ns, unnest(ns) AS name FROM m)),
    e AS (SELECT a.doc_id, a.name AS x, b.name AS y FROM n a JOIN n b USING (doc_id) WHERE a.name <> b.name
          AND ((len(a.tokens) >= 2 AND list_has_all(b.tokens, a.tokens)) OR (len(b.tokens) >= 2 AND list_has_all(a.tokens, b.tokens)))),
    r AS (SELECT doc_id, name AS x, name AS y FROM n UNION SELECT r.doc_id, r.x, e.y FROM r JOIN e ON r.doc_id = e.doc_id AND r.y = e.x)
    SELECT r.doc_id, r.x AS name, arg_min(r.y, {{'l': -length(r.y), 'k': n.k}}) AS canonical FROM r JOIN n ON n.doc_id = r.doc_id AND n.name = r.y GROUP BY r.doc_id, r.x"""
)
def name_cluster_components(spark, sf_dir):
    """Runs of capitalised words of each document, clustered: one row per document and spelling."""
    found = F.regexp_extract_all("text", F.lit(_NAME), F.lit(0))
    cluster = F.udf(lambda names: list(cluster_names(list(names)).items()), "array<struct<name:string,canonical:string>>", useArrow=True)
    rows = _docs(spark, sf_dir).select("doc_id", found.alias("names")).filter(F.size("names") > 0)
    return rows.select("doc_id", F.explode(cluster("names")).alias("c")).select("doc_id", "c.*")


# languages and profiles

_HINTS_SQL = ", ".join(f"('{lang}', '{p}')" for lang, p in language.HINTS.items())
_ORDER_SQL = ", ".join(f"('{lang}', {i})" for i, lang in enumerate(language.WORDS))
_WEIGHTS_SQL = ", ".join(f"('{a}', '{b}', {c!r}::DOUBLE)" for a, b, c in language.weights())


@query(
    f"""WITH t(lang, word, weight) AS (VALUES {_WEIGHTS_SQL}), h(lang, p) AS (VALUES {_HINTS_SQL}), o(lang, turn) AS (VALUES {_ORDER_SQL}),
    p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{language.PARAGRAPH}')) AS part, generate_subscripts(regexp_split_to_array(text, '{language.PARAGRAPH}'), 1) AS nth FROM documents),
    w AS (SELECT doc_id, nth, unnest(regexp_extract_all(lower(part), '\\p{{L}}+')) AS word FROM p WHERE trim(part) <> ''),
    c AS (SELECT doc_id, nth, word, count(*) AS n FROM w GROUP BY ALL),
    s AS (SELECT doc_id, nth, lang, sum(x) AS score, sum(m) AS matches FROM (
        SELECT doc_id, nth, lang, weight * n AS x, n AS m FROM c JOIN t USING (word)
        UNION ALL SELECT doc_id, nth, lang, 2.0 * n, 0 FROM c JOIN h ON length(word) > 1 AND regexp_matches(word, p)) GROUP BY ALL),
    np AS (SELECT doc_id, nth, sum(n) AS words FROM c GROUP BY ALL), nd AS (SELECT doc_id, sum(n) AS words FROM c GROUP BY ALL),
    d AS (SELECT doc_id, lang, sum(score) AS score, sum(matches) AS matches FROM s GROUP BY ALL),
    rp AS (SELECT s.*, words, row_number() OVER (PARTITION BY doc_id, nth ORDER BY round(score, 6) DESC, turn) AS k, lead(score) OVER (PARTITION BY doc_id, nth ORDER BY round(score, 6) DESC, turn) AS second
           FROM s JOIN np USING (doc_id, nth) JOIN o USING (lang)),
    rd AS (SELECT d.*, words, turn, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, turn) AS k, lead(score) OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, turn) AS second
           FROM d JOIN nd USING (doc_id) JOIN o USING (lang)),
    won AS (SELECT doc_id, lang FROM rp WHERE k = 1 AND words >= 20 AND matches >= 3 AND score >= 6 AND score > 1.25 * coalesce(second, 0) + 1e-9
            UNION SELECT doc_id, lang FROM rd WHERE k = 1 AND words >= 20 AND matches >= 3 AND score >= 6 AND score > 1.25 * coalesce(second, 0) + 1e-9)
    SELECT q.doc_id, coalesce(string_agg(won.lang, ',' ORDER BY rd.k), '') AS languages,
           CASE count(won.lang) WHEN 0 THEN 'undetermined' WHEN 1 THEN 'detected' ELSE 'mixed' END AS status
    FROM documents q LEFT JOIN won ON won.doc_id = q.doc_id LEFT JOIN rd ON rd.doc_id = won.doc_id AND rd.lang = won.lang GROUP BY q.doc_id"""
)
def lang_detected(spark, sf_dir):
    """Languages of whole texts and their paragraphs."""
    found = language.detected(_docs(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", F.array_join("languages", ",").alias("languages"), "status")


_DECISIONS = [("es,en", None, None, "fr"), ("", "gl", "PT", "fr"), ("", None, None, "pt-BR"), ("", None, "XX", "xx"), ("fr", "pt", "ES", "en"), ("eu", "eu", None, "de")]


@inline(
    values_sql(
        [(1, "es,en", "ES"), (2, "gl", "ES,PT"), (3, "pt", "PT"), (4, "en", ""), (5, "fr,pt", "PT,ES"), (6, "eu", "ES")], "id, languages, jurisdictions"
    ).replace("(VALUES", "SELECT * FROM (VALUES", 1)
)
def profile_suggestion(spark, sf_dir):
    rows = local_rows(spark, [(i, *r) for i, r in enumerate(_DECISIONS, 1)], "id int, seen string, pins string, lands string, locale string")
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    p = profile.suggested(listed("seen"), listed("pins"), listed("lands"), F.col("locale"))
    return rows.select("id", F.array_join(p["languages"], ",").alias("languages"), F.array_join(p["jurisdictions"], ",").alias("jurisdictions"))


_PINNED = ['{"languages":["es","xx","es"],"jurisdictions":["PT","FR"]}', '{"languages":["es"]}', "nonsense", None, "[]"]


@inline("SELECT * FROM " + values_sql([(1, "es", "PT"), (2, None, None), (3, None, None), (4, None, None), (5, None, None)], "id, languages, jurisdictions"))
def pinned_profiles(spark, sf_dir):
    rows = local_rows(spark, list(enumerate(_PINNED, 1)), "id int, raw string")
    p = profile.parse_pinned(F.col("raw"))
    return rows.select("id", F.array_join(p["languages"], ",").alias("languages"), F.array_join(p["jurisdictions"], ",").alias("jurisdictions"))


_SETTINGS = ['{"EMAIL":false,"NAME":true,"OTHER":true,"PHONE":"x"}', "{}", "broken", None]


@inline("SELECT * FROM " + values_sql([(1, "EMAIL=false,NAME=true"), (2, ""), (3, ""), (4, "")], "id, switches"))
def category_settings(spark, sf_dir):
    rows = local_rows(spark, list(enumerate(_SETTINGS, 1)), "id int, raw string")
    table = scalars.settings_of(F.col("raw"), ["EMAIL", "NAME", "PHONE"])
    shown = F.transform(F.array_sort(F.map_entries(table)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("id", F.array_join(shown, ",").alias("switches"))


_LOCALES = ["pt-BR", "EN_us", "gl", "xx", "", None]


@inline("SELECT * FROM " + values_sql([(1, "pt"), (2, "en"), (3, "gl"), (4, "en"), (5, "en"), (6, "en")], "id, locale"))
def resolved_locales(spark, sf_dir):
    rows = local_rows(spark, list(enumerate(_LOCALES, 1)), "id int, asked string")
    return rows.select("id", scalars.locale_of(F.col("asked"), profile.LANGUAGES).alias("locale"))


# money and draws

_AMOUNTS = [("1.234,56 €", "EN", 1234.56), ("$1,234.56", "ES", 1234.56), ("1.234 €", "ES", 1234.0), ("1.234 €", "EN", 1.234), ("(1.200 €)", "ES", -1200.0), ("-5 USD", "ES", -5.0),
            ("2,5 millones de euros", "ES", 2500000.0), ("3 mil euros", "ES", 3000.0), ("mil euros", "ES", None), ("1.250.000 €", "EN", 1250000.0)]


@inline("SELECT * FROM " + values_sql([(i, a[2]) for i, a in enumerate(_AMOUNTS)], "id, amount"))
def money_amounts(spark, sf_dir):
    rows = local_rows(spark, [(i, *a[:2]) for i, a in enumerate(_AMOUNTS)], "id int, text string, convention string")
    return rows.select("id", F.round(scalars.money_amount(F.col("text"), F.col("convention")), 6).alias("amount"))


_VOTES = [("pagó 1.234,56 € y 3,50 €", "ES"), ("paid $1,234.56 and $7.25", "EN"), ("1.234 €", "ES"), ("", "ES"), ("$1.25 y 2,75 €", "ES"), ("v1.2.3 and 10.5", "ES")]


@inline("SELECT * FROM " + values_sql([(i, v[1]) for i, v in enumerate(_VOTES)], "id, convention"))
def money_convention_vote(spark, sf_dir):
    rows = local_rows(spark, [(i, v[0]) for i, v in enumerate(_VOTES)], "id int, text string")
    return rows.select("id", scalars.money_convention(F.col("text")).alias("convention"))


_IMUL = "(({a})::HUGEINT * ({b})::HUGEINT % 4294967296)::UBIGINT"


@query(
    f"""WITH s AS (SELECT doc_id, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(lang || chr(0) || CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS UBIGINT))),
       lambda h, c: (xor(h, c) * 16777619::UBIGINT) % 4294967296::UBIGINT) AS UBIGINT) AS seed FROM documents),
    a AS (SELECT doc_id, seed, (seed + 1831565813::UBIGINT) % 4294967296::UBIGINT AS a FROM s),
    b AS (SELECT *, {_IMUL.format(a="xor(a, a >> 15)", b="a | 1::UBIGINT")} AS t FROM a),
    c AS (SELECT *, xor(t, (t + {_IMUL.format(a="xor(t, t >> 7)", b="t | 61::UBIGINT")}) % 4294967296::UBIGINT) AS u FROM b)
    SELECT doc_id, CAST(seed AS BIGINT) AS seed, CAST(xor(u, u >> 14) AS BIGINT) AS draw FROM c"""
)
def random_draws(spark, sf_dir):
    """The seed of each document and the first number drawn from it."""
    docs = tables.read(spark, sf_dir, "documents", "doc_id", "lang")
    seed = scalars.seed_of(F.col("lang"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", seed.alias("seed")).select("doc_id", "seed", scalars.draw(F.col("seed")).alias("draw"))


@query()
def pseudonymized_documents(spark, sf_dir):
    """Masked documents with stand-ins in place of placeholders."""
    masked = ops.mask(_docs(spark, sf_dir)).select("doc_id", "text", "mappings", scalars.money_convention(F.col("text")).alias("convention"))
    return pseudonyms.pseudonymized(masked, "doc_id", convention_col="convention").select("doc_id", "realistic", F.size("pseudonyms").alias("n_pseudonyms"))


# sheets and escapes


@inline(
    """SELECT CAST(i AS INTEGER) AS i, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) WHEN i < 702 THEN chr(CAST(64 + i // 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER))
       ELSE chr(CAST(65 + (i - 702) // 676 AS INTEGER)) || chr(CAST(65 + (i - 702) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (i - 702) % 26 AS INTEGER)) END AS letters,
       i AS index_again, strftime(DATE '1899-12-31' + CAST(CASE WHEN i >= 60 THEN i - 1 ELSE i END AS INTEGER), '%Y-%m-%d') AS serial_date FROM range(16384) r(i)"""
)
def sheet_references(spark, sf_dir):
    """Columns of a sheet by number and letters, and dates by their number."""
    rows = spark.range(16384).select(F.col("id").cast("int").alias("i"))
    named = rows.withColumn("letters", scalars.column_letters(F.col("i")))
    return named.select("i", "letters", scalars.column_index(F.concat("letters", F.lit("12"))).alias("index_again"), scalars.serial_date(F.col("i")).alias("serial_date"))


@query(
    """SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'),
       '(\\[\\[[A-Z][A-Z0-9_]*\\]\\])', '<mark>\\1</mark>', 'g')) AS html_md5 FROM documents"""
)
def highlighted_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(export.highlighted(F.col("text"))).alias("html_md5"))


@query(
    r"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'no readable content' ELSE '' END AS blocked,
       CASE WHEN regexp_matches(text, 'https?://|[0-9A-Za-z_.+-]+@[0-9A-Za-z_.-]+\.[A-Za-z]{2,}|\b(?:[0-9][ -]?){13,19}(?:[^0-9A-Za-z_]|$)|\b(?:[0-9][ -]?){12,18}[0-9]\b')
            THEN 'links, addresses or long numbers remain' ELSE '' END AS review FROM documents"""
)
def output_findings(spark, sf_dir):
    """What would hold back every document if it left as it is."""
    none = F.array().cast(f"array<{ops.MAPPING}>")
    found = export.findings(F.col("text"), F.col("text"), none, F.lit("complete"), F.array().cast("array<string>"), F.lit("ready"), F.lit(0))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(found["blocked"], "; ").alias("blocked"), F.array_join(found["review"], "; ").alias("review"))


# identity and edits

_SCOPE = "0123456789ABCDEF" * 2
_EVIDENCE = [(None,) * 6, (_SCOPE, "d", 1, 1, 1, "x"), (_SCOPE, "d", 2, 1, 1, "x"), (_SCOPE, None, 1, 1, 1, "x"), ("F" * 32, None, None, None, None, None)]


@inline("SELECT * FROM " + values_sql([(0, "unverifiable"), (1, "verified"), (2, "mismatched"), (3, "unverifiable"), (4, "mismatched")], "id, status"))
def snapshot_revision_status(spark, sf_dir):
    columns = "scope string, document_id string, document_revision int, policy_revision int, mapping_revision int, export_id string"
    rows = local_rows(spark, [(i, *e) for i, e in enumerate(_EVIDENCE)], f"id int, {columns}")
    own = F.struct(*[F.lit(v).alias(n) for n, v in zip(identity.FIELDS, (_SCOPE, "d", 1, 1, 1, "x"))])
    given = F.when(F.col("id") > 0, F.struct(*identity.FIELDS))
    return rows.select("id", identity.revision_status(own, given).alias("status"))


@query(
    f"""SELECT conv_id, '[[V1_{_SCOPE}_CUSTOM_1]]' AS token, '[[V1_{_SCOPE}_CUSTOM_1]]' || substr(text, length(regexp_extract(text, '[A-Za-z]+')) + 1) AS masked, CAST(2 AS BIGINT) AS next_counter
    FROM conversations WHERE turn = (SELECT min(turn) FROM conversations) AND regexp_matches(text, '^[A-Za-z]+')"""
)
def identified_tokens(spark, sf_dir):
    """The first word of the first turn of each conversation under a stable token."""
    turns = tables.read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    first = turns.join(F.broadcast(turns.agg(F.min("turn").alias("turn"))), "turn").withColumn("word", F.regexp_extract("text", "^[A-Za-z]+", 0)).filter("word <> ''")
    spot = F.array(F.struct(F.lit(0).alias("start"), F.length("word").alias("end"), F.col("word").alias("text")))
    one = F.struct(
        F.lit("CUSTOM_1").alias("id"), F.col("word").alias("original_text"), F.lit("[[CUSTOM_001]]").alias("placeholder"), F.lit("CUSTOM").alias("category"),
        F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"), F.lit(True).alias("enabled"), F.array("word").alias("variants"), spot.alias("occurrences"),
    )
    rows = first.select("conv_id", "text", F.array(one).alias("mappings"), F.lit(_SCOPE).alias("scope"), F.lit(None).cast(f"array<{ops.MAPPING}>").alias("previous"), F.lit(1).cast("long").alias("following"))
    out = identity.identify(rows, ["conv_id"], "scope", "previous", "following")
    return out.select("conv_id", F.col("mappings")[0]["placeholder"].alias("token"), "masked", "next_counter")


def _edited(spark):
    """Ten mappings of one document, two spellings and anchors each."""
    rows = spark.range(1, 11).select(F.lit(1).alias("doc_id"), F.col("id").alias("n"))
    spelled = lambda mark: F.concat(F.lit("n"), F.col("n").cast("string"), F.lit(mark))
    spots = F.array(*[F.struct((F.col("n") * 100 + k).cast("int").alias("start"), (F.col("n") * 100 + k + 2).cast("int").alias("end"), spelled(m).alias("text")) for k, m in ((0, "aa"), (50, "b"))])
    return rows.select(
        "doc_id", F.concat(F.lit("NAME_"), F.col("n").cast("string")).alias("id"), spelled("aa").alias("original_text"), F.format_string("[[NAME_%03d]]", "n").alias("placeholder"),
        F.lit("NAME").alias("category"), F.lit(0.6).alias("confidence"), F.lit("regex").alias("source"), F.lit(True).alias("enabled"), F.array(spelled("aa"), spelled("b")).alias("variants"), spots.alias("occurrences"),
    )


@inline("SELECT * FROM " + values_sql([("NAME_2", "[[NAME_002]]", "n10aa", "n10aa,n2aa,n10b,n2b", 4)] + [(f"NAME_{i}", f"[[NAME_{i:03d}]]", f"n{i}aa", f"n{i}aa,n{i}b", 2) for i in (1, 3, 4, 5, 6, 7, 8, 9)], "id, placeholder, original_text, variants, n_occurrences"))
def merged_mappings(spark, sf_dir):
    rows = mapping.merge(_edited(spark), ["doc_id"], ["NAME_10", "NAME_2"])
    return rows.select("id", "placeholder", "original_text", F.array_join("variants", ",").alias("variants"), F.size("occurrences").alias("n_occurrences"))


@inline("SELECT * FROM " + values_sql([(f"NAME_{i}", f"n{i}aa", 2) for i in range(2, 11)] + [("NAME_11", "n1aa", 1), ("NAME_12", "n1b", 1)], "id, original_text, n_occurrences"))
def split_mappings(spark, sf_dir):
    rows = mapping.split(_edited(spark), ["doc_id"], "NAME_1")
    return rows.select("id", "original_text", F.size("occurrences").alias("n_occurrences"))


@inline("SELECT 'NAME' AS category, 11 AS next_number")
def next_counters(spark, sf_dir):
    return mapping.next_counter(_edited(spark), ["doc_id"]).select("category", "next_number")


_RULES = [("1", "a", "CATEGORY", "Code"), ("2", "b", "CATEGORY", "CODE"), ("3", "c", "CATEGORY", "Other"), ("4", "d", "FIXED", "code"), ("5", "e", "CATEGORY", "Other")]


@inline(
    f"""SELECT lower(a.t) AS lowered, string_agg(DISTINCT a.t, ',' ORDER BY a.t) AS spellings FROM {values_sql([(r[0], r[3], r[2]) for r in _RULES], "id, t, kind").replace("AS t(", "AS a(")}
    WHERE kind = 'CATEGORY' GROUP BY lower(a.t) HAVING count(DISTINCT a.t) > 1"""
)
def rule_case_clashes(spark, sf_dir):
    rows = local_rows(spark, [(*r,) for r in _RULES], "id string, termOrPattern string, replacementType string, targetCategory string")
    return rule_source.case_clashes(rows).select("lowered", F.array_join("spellings", ",").alias("spellings"))


_TOKENS = [("[[NAME_001]] [name 1] [[EMAIL_1]]", "Ana Ana a@b.c", 3, "", ""), ("[[NAME_009]] NAME_1", "[[NAME_009]] NAME_1", 0, "[[NAME_009]]", ""), ("[Name_02] [[NAME", "[Name_02] [[NAME", 0, "", ""), ("", "", 0, "", "")]


@inline("SELECT * FROM " + values_sql([(i, *t[1:4]) for i, t in enumerate(_TOKENS)], "id, text, restored, unknown"))
def restore_report(spark, sf_dir):
    rows = local_rows(spark, [(i, t[0]) for i, t in enumerate(_TOKENS)], "id int, masked string")
    one = lambda id_, token, original, category: F.struct(
        F.lit(id_).alias("id"), F.lit(original).alias("original_text"), F.lit(token).alias("placeholder"), F.lit(category).alias("category"), F.lit(1.0).alias("confidence"),
        F.lit("regex").alias("source"), F.lit(True).alias("enabled"), F.array(F.lit(original)).alias("variants"), F.array().cast(f"array<{ops.OCCURRENCE}>").alias("occurrences"),
    )
    rows = rows.withColumn("mappings", F.array(one("NAME_1", "[[NAME_001]]", "Ana", "NAME"), one("EMAIL_1", "[[EMAIL_001]]", "a@b.c", "EMAIL")))
    return ops.restored(rows).select("id", "result.text", "result.restored", F.array_join("result.unknown", ",").alias("unknown"))


# models

_TEXT = "Ana Prieto visita Acme en Lugo."
_MODEL = [(0, "Ana", "B-PER", 0.9), (1, "Pri", "I-PER", 0.7), (2, "##eto", "B-PER", 0.8), (4, "A", "B-ORG", 0.9), (5, "##cm", "I-ORG", 0.9), (7, "Lugo", "B-LOC", 0.5), (9, "Ana", "B-MISC", 0.9)]


def _model_rows(spark):
    tokens = local_rows(spark, [(1, 0, *t) for t in _MODEL], "doc_id int, chunk int, index int, word string, entity string, score double")
    chunks = local_rows(spark, [(1, 0, _TEXT)], "doc_id int, chunk int, text string")
    return models.with_offsets(tokens, chunks, ["doc_id"]), chunks


@inline("SELECT * FROM " + values_sql([("PER", 0, 10, "Ana Prieto", 0.8), ("ORG", 18, 22, "Acme", 0.9), ("LOC", 26, 30, "Lugo", 0.5)], "label, \"start\", \"end\", text, score"))
def model_entities(spark, sf_dir):
    found = models.entities(*_model_rows(spark), ["doc_id"])
    return found.select("label", "start", "end", "text", F.round("score", 6).alias("score"))


@inline("SELECT * FROM " + values_sql([(0, 10, "NAME", 0.8, True), (18, 22, "COMPANY", 0.9, True), (26, 30, "LOCATION", 0.5, False)], "\"start\", \"end\", category, confidence, enabled"))
def model_spans(spark, sf_dir):
    tokens, chunks = _model_rows(spark)
    found = models.merged(models.entities(tokens, chunks, ["doc_id"]), ["doc_id"])
    return models.spans(found, chunks, ["doc_id"]).select("start", "end", "category", F.round("confidence", 6).alias("confidence"), "enabled")


@query("""SELECT doc_id, length(text) AS n_chars, true AS whole FROM documents""")
def model_windows(spark, sf_dir):
    """Windows of every document: together they hold every character."""
    docs = _docs(spark, sf_dir)
    cut = models.windows(docs, ["doc_id"]).select("doc_id", F.col("chunk").alias("start"), (F.col("chunk") + F.length("text")).alias("end"))
    covered = quality.coverage(cut, ["doc_id"])
    return docs.join(covered, "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"), (F.col("covered") == F.length("text")).alias("whole"))


# quality


@query(
    f"""WITH s AS ({_spans_sql(D.EMAIL, "EMAIL")} UNION ALL SELECT * FROM ({_spans_sql("[a-z]+tion", "PROJECT")}) UNION ALL SELECT * FROM ({_spans_sql("the", "CUSTOM")})),
    c AS (SELECT doc_id, unnest(range("start", "end")) AS i FROM s)
    SELECT doc_id, CAST(count(DISTINCT i) AS BIGINT) AS covered FROM c GROUP BY doc_id"""
)
def coverage_union(spark, sf_dir):
    """Characters of each document that any span of e-mail or dictionary rules covers."""
    t = F.col("text")
    found = _docs(spark, sf_dir).select("doc_id", F.explode(F.concat(D.email(t), D.dictionary(t, RULES))).alias("s"))
    return quality.coverage(found.select("doc_id", "s.start", "s.end"), ["doc_id"])


_MARKED = [(1, "{NAME|Ana Prieto} lives in {LOCATION|Lugo}, writes to {EMAIL|a@b.com}"), (2, "call {PHONE|600 000 000} now, {NAME?|Bob}"), (3, "nothing here")]
_PREDICTED = [(1, 0, 3, "NAME"), (1, 4, 10, "NAME"), (1, 36, 43, "EMAIL"), (2, 5, 12, "PHONE"), (2, 21, 24, "NAME"), (3, 0, 7, "NAME")]


@inline("SELECT * FROM " + values_sql([(1, 0, 10, "NAME", False, "Ana Prieto"), (1, 20, 24, "LOCATION", False, "Lugo"), (1, 36, 43, "EMAIL", False, "a@b.com"), (2, 5, 16, "PHONE", False, "600 000 000"), (2, 22, 25, "NAME", True, "Bob")], 'doc_id, "start", "end", category, optional, text'))
def labelled_corpus(spark, sf_dir):
    rows = local_rows(spark, _MARKED, "doc_id int, markup string")
    return quality.labelled(rows, ["doc_id"]).select("doc_id", F.explode("gold").alias("g")).select("doc_id", "g.*")


def _graded(spark):
    read = quality.labelled(local_rows(spark, _MARKED, "doc_id int, markup string"), ["doc_id"])
    gold = read.select("doc_id", F.explode("gold").alias("g")).select("doc_id", "g.start", "g.end", "g.category", "g.optional")
    return gold, local_rows(spark, _PREDICTED, "doc_id int, start int, end int, category string"), read.select("doc_id", "text")


@inline("SELECT * FROM " + values_sql([(1, 0, 10, "NAME", "caught"), (1, 20, 24, "LOCATION", "missed"), (1, 36, 43, "EMAIL", "caught"), (2, 5, 16, "PHONE", "partial")], 'doc_id, "start", "end", category, outcome'))
def score_outcomes(spark, sf_dir):
    return quality.outcomes(*_graded(spark))


@inline("SELECT * FROM " + values_sql([("EMAIL", 1, 1, 0, 0, 0, 1.0), ("LOCATION", 1, 0, 0, 1, 0, 0.0), ("NAME", 1, 1, 0, 0, 1, 1.0), ("PHONE", 1, 0, 1, 0, 0, 0.0), (None, 4, 2, 1, 1, 1, 0.5)], "category, total, caught, partial, missed, overflags, recall"))
def scorecard(spark, sf_dir):
    gold, predicted, texts = _graded(spark)
    return quality.scorecard(quality.outcomes(gold, predicted, texts), quality.overflags(gold, predicted))


@inline(
    "SELECT * FROM " + values_sql([(32, 24, 5, 6, 1, 0, 3, 7, 31)], "sensitive_chars, masked_sensitive_chars, gold_spans, predicted_spans, exact_spans, false_merges, unmasked_spans, extra_chars, masked_chars")
)
def span_metrics(spark, sf_dir):
    gold, predicted, texts = _graded(spark)
    m = quality.span_metrics(gold, predicted, texts)
    return m.select("sensitive_chars", "masked_sensitive_chars", "gold_spans", "predicted_spans", "exact_spans", "false_merges", "unmasked_spans", "extra_chars", "masked_chars")
