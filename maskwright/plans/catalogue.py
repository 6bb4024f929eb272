"""Registered queries of the masking engine and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import checks, scalars
from maskwright.functions import detectors as D
from maskwright.functions.lexicon import ACRONYM_EXCLUSIONS
from maskwright.functions.patterns import sql
from maskwright.functions.spans import arbitrate, substitute
from maskwright.operators import detect as ops
from maskwright.operators import language, mapping
from maskwright.plans.registry import ORACLES, QUERIES, query
from maskwright.sources import pages as page_source
from maskwright.sources import tables

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents", "doc_id", "text")


def _spans(docs: DataFrame, found: Column, key: str = "doc_id") -> DataFrame:
    rows = docs.select(key, F.explode(found).alias("s"))
    return rows.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.category").alias("category"), F.col("s.text").alias("text"))


def _spans_sql(pattern: str, category: str, keep: str = "true", table: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    """Offsets of matches: lengths of the gaps and matches before each."""
    p = sql(pattern).replace("'", "''")
    return f"""
    WITH m AS (
      SELECT {key}, regexp_extract_all({column}, '{p}') AS ms, regexp_split_to_array({column}, '{p}') AS gaps FROM {table}
      WHERE regexp_matches({column}, '{p}')
    ), e AS (SELECT {key}, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM m), s AS (
      SELECT {key}, ms[i] AS t, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS a
      FROM e
    )
    SELECT {key}, a AS "start", CAST(a + length(t) AS INTEGER) AS "end", '{category}' AS category, t AS text FROM s WHERE {keep}"""


_DIGITS = "length(regexp_replace(t, '[^0-9]', '', 'g'))"
_LUHN = """(list_sum(list_transform(range(1, {n} + 1), lambda i:
    CASE WHEN ({n} - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS INTEGER)
         ELSE (2 * CAST(substr({d}, i, 1) AS INTEGER)) // 10 + (2 * CAST(substr({d}, i, 1) AS INTEGER)) % 10 END)) % 10 = 0)""".format(
    n=_DIGITS, d="regexp_replace(t, '[^0-9]', '', 'g')"
)


@query(_spans_sql(D.EMAIL, "EMAIL"))
def email_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), D.email(F.col("text")))


@query(_spans_sql(D.PHONE, "PHONE", f"{_DIGITS} BETWEEN 9 AND 15"))
def phone_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), D.phone(F.col("text")))


@query(_spans_sql(r"\b(?:\d[ -]?){13,19}\b", "CREDIT_CARD", f"{_DIGITS} BETWEEN 13 AND 19 AND {_LUHN}"))
def card_spans_luhn(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), D.card(F.col("text")))


_MASK_TOKENS, _MASK_KEEP = "[0-9A-Za-z*•_]+", "regexp_matches(t, '[*xX•_]{2}') AND length(regexp_replace(t, '[*xX•_]', '', 'g')) >= 4"


@query(_spans_sql(_MASK_TOKENS, "MASKED_ID", _MASK_KEEP))
def masked_id_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), D.masked_id(F.col("text")))


_EXCLUDED_SQL = ", ".join(f"'{w}'" for w in ACRONYM_EXCLUSIONS)


@query(_spans_sql(r"\b[A-Z]{2,}\b", "COMPANY", f"t NOT IN ({_EXCLUDED_SQL})"))
def acronym_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), D.acronym(F.col("text")))


_DATE_SQL = (
    r"\b(?:\d{4}[.\-/]\d{2}[.\-/]\d{2}(?:[ \t]+\d{2}:\d{2}(?::\d{2})?)?|\d{2}[.\-/]\d{2}[.\-/]\d{4}(?:[ \t]+\d{2}:\d{2}(?::\d{2})?)?"
    r"|\d{2}:\d{2}:\d{2})\b"
)


@query(_spans_sql(_DATE_SQL, "SHIELD"))
def date_shields(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), D.date_time(F.col("text")))


@query(_spans_sql(D.EMAIL, "EMAIL", table="pages", key="page_id", column="html"))
def html_pages_email_spans(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "pages", "page_id", "html").withColumnRenamed("html", "text")
    return _spans(rows, D.email(F.col("text")), "page_id")


RULES = [
    {"term_or_pattern": "the", "is_regex": False, "replacement_type": "FIXED", "target_category": None},
    {"term_or_pattern": r"[a-z]+tion", "is_regex": True, "replacement_type": "CATEGORY", "target_category": "PROJECT"},
]


@query(_spans_sql("the", "CUSTOM") + " UNION ALL " + f"SELECT * FROM ({_spans_sql('[a-z]+tion', 'PROJECT')})")
def dictionary_spans(spark, sf_dir):
    return _spans(_docs(spark, sf_dir), D.dictionary(F.col("text"), RULES))


@query(
    f"""WITH a AS ({_spans_sql(D.EMAIL, "EMAIL")}), b AS ({_spans_sql(r"[a-z]+tion", "PROJECT")})
    SELECT a.doc_id, a."start" AS a_start, a."end" AS a_end, b."start" AS b_start, b."end" AS b_end
    FROM a JOIN b ON a.doc_id = b.doc_id AND a."start" < b."end" AND b."start" < a."end" """
)
def span_overlap_pairs(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    both = docs.select("doc_id", D.email(F.col("text")).alias("a"), D.dictionary(F.col("text"), RULES[1:]).alias("b"))
    near = F.filter("b", lambda b: (F.col("a.start") < b["end"]) & (b["start"] < F.col("a.end")))  # pairs that do not meet are never rows
    pairs = both.select("doc_id", F.explode("a").alias("a"), "b").select("doc_id", "a", F.explode(near).alias("b"))
    return pairs.select("doc_id", *[F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in "ab" for y in ("start", "end")])


def _kinds(docs: DataFrame) -> DataFrame:
    """Emails, cards, phones and masked ids, arbitrated in the expression."""
    t = F.col("text")
    found = arbitrate(F.concat(D.email(t), D.card(t), D.phone(t), D.masked_id(t)))
    # behind a generator, or every later use of the spans would work them out anew
    return docs.select("*", F.explode(F.array(found)).alias("spans"))


_TWO_SQL = f"""WITH RECURSIVE c AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start" - "end", "start", turn) AS k FROM (
        SELECT *, 1 AS turn FROM ({_spans_sql(D.EMAIL, "EMAIL")}) UNION ALL
        SELECT *, 2 AS turn FROM ({_spans_sql(r"\b(?:\d[ -]?){13,19}\b", "CREDIT_CARD", f"{_DIGITS} BETWEEN 13 AND 19 AND {_LUHN}")}) UNION ALL
        SELECT *, 3 AS turn FROM ({_spans_sql(D.PHONE, "PHONE", f"{_DIGITS} BETWEEN 9 AND 15")}) UNION ALL
        SELECT *, 4 AS turn FROM ({_spans_sql(_MASK_TOKENS, "MASKED_ID", _MASK_KEEP)}))
    ), r AS (
      SELECT doc_id, k, [{{'a': "start", 'z': "end"}}] AS kept, true AS taken, "start", "end", category, text FROM c WHERE k = 1
      UNION ALL
      SELECT c.doc_id, c.k, CASE WHEN x.free THEN list_append(r.kept, {{'a': c."start", 'z': c."end"}}) ELSE r.kept END, x.free,
             c."start", c."end", c.category, c.text
      FROM r JOIN c ON c.doc_id = r.doc_id AND c.k = r.k + 1,
      LATERAL (SELECT len(list_filter(r.kept, lambda s: s.a < c."end" AND c."start" < s.z)) = 0 AS free) x
    ), w AS (SELECT doc_id, "start", "end", category, text FROM r WHERE taken)"""


@query(_TWO_SQL + ' SELECT doc_id, "start", "end", category, text FROM w')
def arbitrated_spans(spark, sf_dir):
    return _spans(_kinds(_docs(spark, sf_dir)), F.col("spans"))


_MAPPING_SQL = (
    _TWO_SQL
    + """, f AS (
      SELECT doc_id, text AS original_text, arg_min(category, "start") AS category, min("start") AS first_start, count(*) AS n FROM w GROUP BY doc_id, text
    ), p AS (
      SELECT doc_id, original_text, category, n,
             '[[' || category || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id, category ORDER BY first_start) AS VARCHAR), 3, '0') || ']]' AS placeholder
      FROM f
    )"""
)


def _two_table(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    return mapping.mapping_table(rows, ["doc_id"])


@query(_MAPPING_SQL + " SELECT doc_id, original_text, category, placeholder, n AS n_occurrences FROM p")
def mapping_table(spark, sf_dir):
    return _two_table(_kinds(_docs(spark, sf_dir))).drop("enabled")


@query(
    _MAPPING_SQL
    + """, o AS (
      SELECT w.doc_id, list(struct_pack(a := w."start", z := w."end", p := p.placeholder) ORDER BY w."start") AS os
      FROM w JOIN p ON p.doc_id = w.doc_id AND p.original_text = w.text GROUP BY w.doc_id
    )
    SELECT d.doc_id, CASE WHEN o.os IS NULL THEN d.text ELSE
      list_aggregate(list_transform(range(1, len(o.os) + 1), lambda i:
        substr(d.text, CASE WHEN i = 1 THEN 1 ELSE o.os[i-1].z + 1 END, o.os[i].a - CASE WHEN i = 1 THEN 0 ELSE o.os[i-1].z END) || o.os[i].p), 'string_agg', '')
      || substr(d.text, o.os[len(o.os)].z + 1) END AS masked
    FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id"""
)
def masked_text(spark, sf_dir):
    """Spans, placeholders and masked text of a row in the row itself: nothing is shuffled."""
    docs = _kinds(_docs(spark, sf_dir))
    texts = F.transform("spans", lambda s: s["text"])
    first = F.filter("spans", lambda s, i: F.array_position(texts, s["text"]) == i + 1)
    rows = docs.select("*", F.explode(F.array(first)).alias("first"))
    so_far = lambda s, i: F.size(F.filter(F.slice("first", F.lit(1), i + 1), lambda x: x["category"] == s["category"]))
    named = F.transform("first", lambda s, i: F.struct(s["text"].alias("k"), F.format_string("[[%s_%03d]]", s["category"], so_far(s, i)).alias("v")))
    rows = rows.select("*", F.explode(F.array(F.map_from_entries(named))).alias("put"))
    spots = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at("put", s["text"]).alias("put")))
    return rows.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(substitute(F.col("text"), spots)).alias("masked"))


@query(_MAPPING_SQL + " SELECT category, count(*) AS n_mappings FROM p GROUP BY category")
def category_counts(spark, sf_dir):
    return mapping.category_counts(_two_table(_kinds(_docs(spark, sf_dir))))


@query(_MAPPING_SQL + " SELECT category, count(*) AS n_enabled, CAST(0 AS BIGINT) AS n_disabled FROM p GROUP BY ROLLUP (category)")
def mapping_summary(spark, sf_dir):
    return mapping.summary(_two_table(_kinds(_docs(spark, sf_dir))))


@query()
def detected_spans(spark, sf_dir):
    """All rules in one pass."""
    return ops.exploded(ops.detect(_docs(spark, sf_dir)), ["doc_id"])


@query()
def masked_documents(spark, sf_dir):
    """All rules, mappings and masked text in one pass."""
    return ops.mask(_docs(spark, sf_dir)).select("doc_id", "masked", F.size("mappings").alias("n_mappings"))


@query("SELECT doc_id, true AS same, CAST(0 AS BIGINT) AS n_unknown FROM documents")
def restored_documents(spark, sf_dir):
    """What masking took out comes back, names in the spelling of their mapping: the text with every occurrence of an
    enabled mapping as its original is what restoring the masked text gives."""
    masked = ops.mask(_docs(spark, sf_dir))
    expected = mapping.render(F.coalesce("text", F.lit("")), F.col("mappings"), lambda m: m["original_text"])
    back = ops.restored(masked.select("doc_id", "masked", "mappings", expected.alias("expected")))
    return back.select("doc_id", (F.col("result.text") == F.col("expected")).alias("same"), F.size("result.unknown").cast("long").alias("n_unknown"))


@query()
def masked_pages(spark, sf_dir):
    """Pages as text, masked."""
    pages = page_source.from_table(tables.read(spark, sf_dir, "pages"))
    return ops.mask(pages).select("page_id", "masked")


# Numbers with check digits, made of the keys of customers and orders: the tables hold none of their own. Each is
# spelled in SQL that both engines read, `{s}` being their name of strings.
_N = "(c_custkey * 7919 + 12345)"
_LETTER = f"substr('{checks.ID_LETTERS}', CAST(({{n}} + c_custkey % 3) % 23 AS INTEGER) + 1, 1)"
_EIGHT, _SEVEN = f"{_N} % 100000000", f"{_N} % 10000000"
_IDS = (
    f"CASE c_custkey % 5 WHEN 0 THEN concat('X', lpad(CAST({_SEVEN} AS {{s}}), 7, '0'), {_LETTER.format(n=_SEVEN)}) "
    f"WHEN 1 THEN concat(lpad(CAST({_EIGHT} AS {{s}}), 8, '0'), '-', lower({_LETTER.format(n=_EIGHT)})) "
    f"WHEN 2 THEN lpad(CAST({_EIGHT} AS {{s}}), 8, '0') ELSE concat(lpad(CAST({_EIGHT} AS {{s}}), 8, '0'), {_LETTER.format(n=_EIGHT)}) END"
)
_IBANS = "concat('ES', lpad(CAST(o_orderkey % 97 + 2 AS {s}), 2, '0'), ' ', lpad(CAST(o_custkey * 1000003 + o_orderkey AS {s}), 20, '0'))"
_CIFS = "concat(substr('ABKQNSJ', CAST(o_orderkey % 7 AS INTEGER) + 1, 1), lpad(CAST((o_orderkey * 7919) % 10000000 AS {s}), 7, '0'), substr('0123456789JABCDEFGHI', CAST(o_custkey % 20 AS INTEGER) + 1, 1))"
_NIFS = "lpad(CAST((o_orderkey * 104729 + o_custkey) % 1000000000 AS {s}), 9, '0')"


def _made(spark, sf_dir, table: str, key: str, value: str) -> DataFrame:
    return tables.read(spark, sf_dir, table).selectExpr(key, f"{value.format(s='string')} as value")


def _made_sql(table: str, key: str, value: str) -> str:
    return f"(SELECT {key}, {value.format(s='VARCHAR')} AS value FROM {table})"


@query(
    f"""SELECT c_custkey, value, coalesce(CASE WHEN regexp_full_match(n, '[XYZ0-9][0-9]{{7}}[A-Z]')
        THEN substr('{checks.ID_LETTERS}', CAST(translate(substr(n, 1, 8), 'XYZ', '012') AS INTEGER) % 23 + 1, 1) = substr(n, 9, 1) END, false) AS valid
    FROM (SELECT c_custkey, value, upper(regexp_replace(value, '[\\s.-]', '', 'g')) AS n FROM {_made_sql('customer', 'c_custkey', _IDS)})"""
)
def dni_check(spark, sf_dir):
    return _made(spark, sf_dir, "customer", "c_custkey", _IDS).select("c_custkey", "value", checks.identity_col(F.col("value")).alias("valid"))


@query(
    f"""SELECT o_orderkey, value, regexp_full_match(n, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') AND CAST(array_to_string(list_transform(string_split(substr(n, 5) || substr(n, 1, 4), ''),
        lambda c: CASE WHEN ascii(c) >= 65 THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '') AS HUGEINT) % 97 = 1 AS valid
    FROM (SELECT o_orderkey, value, replace(value, ' ', '') AS n FROM {_made_sql('orders', 'o_orderkey', _IBANS)})"""
)
def iban_check(spark, sf_dir):
    return _made(spark, sf_dir, "orders", "o_orderkey", _IBANS).select("o_orderkey", "value", checks.iban_col(F.col("value")).alias("valid"))


def _nth(i: int) -> str:
    return f"CAST(substr(n, {i}, 1) AS INTEGER)"


_CONTROL = "(10 - (" + " + ".join([_nth(i) for i in (3, 5, 7)] + [f"(2 * {_nth(i)}) // 10 + (2 * {_nth(i)}) % 10" for i in (2, 4, 6, 8)]) + ") % 10) % 10"


@query(
    f"""SELECT o_orderkey, value, CASE WHEN NOT regexp_full_match(n, '[ABCDEFGHJNPQRSUVW][0-9]{{7}}[A-Z0-9]') THEN false
      WHEN substr(n, 1, 1) IN ('K','P','Q','R','S','N','W') THEN substr('{checks.CIF_LETTERS}', {_CONTROL} + 1, 1) = substr(n, 9, 1)
      WHEN substr(n, 1, 1) IN ('A','B','E','H') THEN CAST({_CONTROL} AS VARCHAR) = substr(n, 9, 1)
      ELSE CAST({_CONTROL} AS VARCHAR) = substr(n, 9, 1) OR substr('{checks.CIF_LETTERS}', {_CONTROL} + 1, 1) = substr(n, 9, 1) END AS valid
    FROM (SELECT o_orderkey, value, upper(value) AS n FROM {_made_sql('orders', 'o_orderkey', _CIFS)})"""
)
def cif_check(spark, sf_dir):
    return _made(spark, sf_dir, "orders", "o_orderkey", _CIFS).select("o_orderkey", "value", checks.cif_col(F.col("value")).alias("valid"))


_NIF_SUM = " + ".join(f"{_nth(i + 1)} * {9 - i}" for i in range(8))


@query(
    f"""SELECT o_orderkey, value, CASE WHEN regexp_full_match(n, '[0-9]{{9}}') THEN
      CASE WHEN 11 - ({_NIF_SUM}) % 11 >= 10 THEN 0 ELSE 11 - ({_NIF_SUM}) % 11 END = {_nth(9)} ELSE false END AS valid
    FROM (SELECT o_orderkey, value, value AS n FROM {_made_sql('orders', 'o_orderkey', _NIFS)})"""
)
def nif_check(spark, sf_dir):
    return _made(spark, sf_dir, "orders", "o_orderkey", _NIFS).select("o_orderkey", "value", checks.nif_pt_col(F.col("value")).alias("valid"))


@query(
    """SELECT doc_id, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(source, ''), lambda c: CAST(unicode(c) AS UBIGINT))),
       lambda h, c: (xor(h, c) * 16777619::UBIGINT) % 4294967296::UBIGINT) AS BIGINT) AS seed FROM documents"""
)
def fnv1a_hash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", checks.fnv1a_col(F.col("source")).alias("seed"))


QUERIES["lang_scores"], ORACLES["lang_scores"] = language.lang_scores_query, language.LANG_SCORES_SQL
QUERIES["lang_decision"], ORACLES["lang_decision"] = language.lang_decision_query, language.LANG_DECISION_SQL
@query(
    """SELECT conv_id, arg_max(text, turn) AS last_text, max(turn) AS last_turn, count(*) AS n_turns FROM conversations GROUP BY conv_id"""
)
def latest_turns(spark, sf_dir):
    """The latest revision of each conversation wins."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n_turns"))


@query(
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS counter,
       '[[V1_' || upper(md5(CAST(conv_id AS VARCHAR))) || '_CUSTOM_' || CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) || ']]' AS token
       FROM conversations"""
)
def minted_tokens(spark, sf_dir):
    """Stable tokens counted within a conversation, the scope of a round trip."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("counter"))
    return rows.withColumn("token", scalars.token(F.upper(F.md5(F.col("conv_id").cast("string"))), F.lit("CUSTOM"), F.col("counter")))
