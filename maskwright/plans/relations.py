"""Queries of spans, names and tokens as relations: joins, islands, components, versions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from maskwright.functions import detectors as D
from maskwright.functions.composed import composed
from maskwright.functions.lexicon import AMBIGUOUS_PLACES, PLACES
from maskwright.functions.names import _skipped
from maskwright.operators import export, intervals, language, markdown, mentions, sanitise, shared_names, snapshots
from maskwright.plans.catalogue import _TWO_SQL, _docs, _spans_sql
from maskwright.plans.registry import query
from maskwright.scratch import folder, local_rows
from maskwright.sources import tables
from maskwright.streaming import tokens


@query(_TWO_SQL + ' SELECT doc_id, "start", "end", category, text FROM w')
def island_arbitrated_spans(spark, sf_dir):
    """Emails, cards, phones and masked ids as rows, arbitrated island by island."""
    t = F.col("text")
    found = F.concat(D.email(t), D.card(t), D.phone(t), D.masked_id(t))
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(found).alias("seq", "s")).select("doc_id", "seq", "s.*")
    return intervals.arbitrated(rows, ["doc_id"]).select("doc_id", "start", "end", "category", "text")


_LEFT, _RIGHT = "[a-z]*th[a-z]*", "[a-z]+tion"


@query(
    f"""WITH a AS ({_spans_sql(_LEFT, "A")}), b AS ({_spans_sql(_RIGHT, "B")})
    SELECT a.doc_id, a."start" AS a_start, a."end" AS a_end, b."start" AS b_start, b."end" AS b_end
    FROM a JOIN b ON a.doc_id = b.doc_id AND a."start" < b."end" AND b."start" < a."end" """
)
def bucketed_overlap_pairs(spark, sf_dir):
    """Overlapping matches of two patterns, by the bucketed interval join."""
    docs = _docs(spark, sf_dir)
    left, right = (mentions.names_of(docs, ["doc_id"], p) for p in (_LEFT, _RIGHT))
    met = intervals.overlap_join(left, right, ["doc_id"])
    return met.select("doc_id", *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for n, s in (("a", "l"), ("b", "r")) for c in ("start", "end")])


_CAPITAL = "[A-Z][a-z]{3,}"
_WORDS_SQL = f"""w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{_CAPITAL}')) AS original,
      generate_subscripts(regexp_extract_all(text, '{_CAPITAL}'), 1) AS place FROM conversations)"""


def _originals(spark, sf_dir):
    """Capitalised words of every turn, with their place."""
    turns = tables.read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    found = F.posexplode(F.regexp_extract_all("text", F.lit(_CAPITAL), F.lit(0)))
    return turns.select("conv_id", "turn", found.alias("place", "original"))


@query(
    f"""WITH {_WORDS_SQL}, f AS (SELECT conv_id, original, min(turn * 1000000 + place) AS spot FROM w GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY spot) AS number FROM f)
    SELECT w.conv_id, w.turn, CAST(w.place AS INTEGER) AS place, w.original, w.turn * 1000000 + w.place > n.spot AS reused,
           '[[V1_' || upper(md5(CAST(w.conv_id AS VARCHAR))) || '_NAME_' || CAST(n.number AS VARCHAR) || ']]' AS token
    FROM w JOIN n USING (conv_id, original)"""
)
def conversation_tokens(spark, sf_dir):
    """Tokens of the capitalised words of each conversation: what the stream with keyed state gives turn by turn."""
    rows = _originals(spark, sf_dir).select(F.col("conv_id").cast("string").alias("scope"), "turn", (F.col("place") + 1).alias("place"), F.lit("NAME").alias("category"), "original")
    found = tokens.token_table(rows)
    return found.select(F.col("scope").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "place", "original", "reused", "token")


@query(
    f"""WITH {_WORDS_SQL}, v AS (SELECT conv_id, CASE WHEN turn < 1 THEN 1 WHEN turn < 2 THEN 2 ELSE 3 END AS version, original, min(turn * 1000000 + place) AS spot FROM w GROUP BY ALL),
    f AS (SELECT conv_id, original, min(version) AS first_version, min(spot) AS spot FROM v GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_version, spot) AS number FROM f)
    SELECT upper(md5(CAST(conv_id AS VARCHAR))) AS scope, v.version, original, v.version > n.first_version AS reused,
           '[[V1_' || upper(md5(CAST(conv_id AS VARCHAR))) || '_NAME_' || CAST(n.number AS VARCHAR) || ']]' AS token
    FROM v JOIN n USING (conv_id, original)"""
)
def snapshot_tokens(spark, sf_dir):
    """Three versions of a snapshot table over all conversations: the first turn, the second, the others. What comes
    again keeps its token; what is new counts on."""
    log = snapshots.SnapshotLog(spark, folder(spark, "snapshots"))
    rows = _originals(spark, sf_dir).withColumn("version", F.when(F.col("turn") < 1, 1).when(F.col("turn") < 2, 2).otherwise(3))
    for version in (1, 2, 3):
        first = rows.where(F.col("version") == version).groupBy("conv_id", "original").agg(F.min(F.struct("turn", "place")).alias("at"), F.count(F.lit(1)).alias("n"))
        current = first.select(
            mentions.upper_md5(F.col("conv_id")).alias("scope"), F.lit("NAME").alias("category"), F.col("original").alias("original_text"), F.array("original").alias("variants"),
            F.row_number().over(Window.partitionBy("conv_id").orderBy("at")).alias("ordinal"), F.lit(True).alias("enabled"), F.col("n").cast("string").alias("anchors"),
            F.lit(None).cast("array<string>").alias("held"),
        )
        log.commit(snapshots.identified(current, log), version - 1)
    return log.read().select("scope", "version", F.col("original_text").alias("original"), "reused", "token")


_SKIPPED_SQL = ", ".join(f"'{w}'" for w in sorted(_skipped()))
_NAME = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}"


@query(
    rf"""WITH RECURSIVE m AS (SELECT doc_id, regexp_extract_all(text, '{_NAME}') AS ns FROM documents),
    o AS (SELECT doc_id, unnest(ns) AS name, generate_subscripts(ns, 1) AS place FROM m),
    z AS (SELECT name, count(DISTINCT doc_id) AS n_documents, min({{'d': doc_id, 'p': place}}) AS first, list_sort(list_filter(list_distinct(string_split(lower(name), ' ')), lambda w: w NOT IN ({_SKIPPED_SQL}))) AS words FROM o GROUP BY name),
    s AS (SELECT name, n_documents, first, CASE WHEN len(words) >= 2 THEN words ELSE ['alone:' || name] END AS words FROM z),
    t AS (SELECT DISTINCT words FROM s),
    e AS (SELECT a.words AS x, b.words AS y FROM t a JOIN t b ON a.words <> b.words
          WHERE (len(a.words) >= 2 AND list_has_all(b.words, a.words)) OR (len(b.words) >= 2 AND list_has_all(a.words, b.words))),
    r AS (SELECT words AS x, words AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    c AS (SELECT x AS words, min(y) AS label FROM r GROUP BY x),
    k AS (SELECT label, arg_min(name, {{'l': -length(name), 'f': first, 'n': name}}) AS canonical, count(*) AS n_spellings FROM s JOIN c USING (words) GROUP BY label)
    SELECT name, canonical, n_documents, n_spellings FROM s JOIN c USING (words) JOIN k USING (label)"""
)
def shared_name_components(spark, sf_dir):
    """Runs of capitalised words of all documents, clustered across documents."""
    names = mentions.names_of(_docs(spark, sf_dir), ["doc_id"], _NAME)
    return shared_names.shared_names(names.select(F.col("doc_id").alias("doc"), F.col("text").alias("name"), F.col("start").alias("place")))


@query(
    rf"""WITH n AS ({_spans_sql(_NAME, "NAME")}),
    k AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS word FROM n) WHERE regexp_full_match(word, '[A-Z][a-z]{{2,}}')),
    i AS (SELECT * FROM ({_spans_sql(r"[\p{L}\p{N}]+", "WORD")}) WHERE regexp_full_match(text, '[A-Z][a-z]{{2,}}'))
    SELECT i.doc_id, i."start", i."end", i.text FROM i JOIN k ON k.doc_id = i.doc_id AND k.word = i.text
    WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = i.doc_id AND n."start" <= i."start" AND i."start" < n."end")"""
)
def later_mentions(spark, sf_dir):
    """Words of capitalised runs that stand elsewhere in their document."""
    docs = _docs(spark, sf_dir)
    names = mentions.names_of(docs, ["doc_id"], _NAME)
    return mentions.later_mentions(docs, names, ["doc_id"], pattern=r"(?<![\p{L}\p{N}])[A-Z][a-z]{2,}(?![\p{L}\p{N}])")


_PHRASE = r"^\w+ \w+ \w+"
_PLACES_SQL = ", ".join("('" + p.replace("'", "''") + "')" for p in PLACES)


@query(
    rf"""WITH places AS (SELECT DISTINCT lower(p) AS p FROM (
        SELECT unnest(g) AS p FROM (SELECT [x[1] FOR x IN [{_PLACES_SQL.replace("(", "[").replace(")", "]")}]] AS g)
        UNION ALL SELECT regexp_extract(text, '{_PHRASE}') FROM benchmark) WHERE p <> ''),
    i AS ({_spans_sql(r"[\p{L}\p{M}\p{N}_]+", "WORD")}),
    h AS (SELECT i.doc_id, i."start" AS a, i."start" + length(p) AS z, substr(d.text, i."start" + 1, length(p)) AS text
          FROM i JOIN documents d USING (doc_id) JOIN places ON regexp_extract(p, '[\p{{L}}\p{{M}}\p{{N}}_]+') = lower(i.text)
          WHERE lower(substr(d.text, i."start" + 1, length(p))) = p AND NOT regexp_matches(substr(d.text, i."start" + length(p) + 1, 1), '[\p{{L}}\p{{M}}\p{{N}}_]')),
    b AS (SELECT doc_id, a, max(z) AS z, arg_max(text, z) AS text FROM h GROUP BY doc_id, a)
    SELECT doc_id, CAST(a AS INTEGER) AS "start", CAST(z AS INTEGER) AS "end", text FROM b
    WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.a < b.a AND b.a < c.z)"""
)
def gazetteer_spans(spark, sf_dir):
    """Places, and the first three words of every benchmark passage, found by the join with a gazetteer table."""
    named = local_rows(spark, [(p,) for p in PLACES], "place string")
    phrases = tables.read(spark, sf_dir, "benchmark", "text").select(F.regexp_extract("text", _PHRASE, 0).alias("place")).where("place != ''")
    return mentions.gazetteer_spans(_docs(spark, sf_dir), named.union(phrases), ["doc_id"], tuple(AMBIGUOUS_PLACES))


@query(f'SELECT doc_id, "start", "end", category, text FROM ({_spans_sql(D.EMAIL, "EMAIL")}) UNION ALL SELECT * FROM ({_spans_sql("[a-z]+tion", "PROJECT")})')
def lateral_spans(spark, sf_dir):
    """SQL with the table function: a built-in detector and one of one's own, beside each other."""
    from maskwright.functions.engine import Span
    from maskwright.functions.udtf import register_detector

    def projects(text):
        import re

        return [Span(*m.span(), "PROJECT", m[0], 1.0, "regex", 3.0, None) for m in re.finditer("[a-z]+tion", text)]

    register_detector(spark, "projects", projects)
    _docs(spark, sf_dir).createOrReplaceTempView("documents_for_detect")
    return spark.sql("SELECT d.doc_id, s.start, s.end, s.category, s.text FROM documents_for_detect d, LATERAL detect(d.text, 'EMAIL,projects') s")


_HELD_SQL = ", ".join(f"'{t}'" for t in sanitise.HOLDING)
_GONE_SQL = ", ".join(f"'{t}'" for t in (*sanitise.HOLDING, *sanitise.EMPTY))
_KEPT_SQL = rf"""'(?i)\s((?:{"|".join(sanitise.KEPT)})\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))'"""


@query(
    rf"""WITH t AS (SELECT page_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{sanitise.TOKEN}') AS ts FROM pages)),
    n AS (SELECT *, nullif(lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)), '') AS tag FROM t),
    o AS (SELECT *, CASE WHEN tag IN ({_HELD_SQL}) AND NOT regexp_matches(token, '(?is)/>\z|^<(?:script|style)\b.*</(?:script|style)\s*>\z')
                    THEN CASE WHEN token LIKE '</%' THEN -1 ELSE 1 END ELSE 0 END AS opens FROM n),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY page_id ORDER BY pos) AS total FROM o),
    d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM s),
    w AS (SELECT page_id, pos, CASE WHEN tag = 'img' THEN regexp_extract(token, '(?i)\salt\s*=\s*"([^"]*)"', 1) WHEN tag IN ({_GONE_SQL}) OR regexp_matches(token, '^<[!?]') THEN ''
              WHEN token LIKE '</%' THEN '</' || tag || '>'
              WHEN tag IS NOT NULL THEN '<' || tag || coalesce(array_to_string([' ' || a FOR a IN regexp_extract_all(token, {_KEPT_SQL}, 1) IF NOT regexp_matches(a, '(?i)^href\s*=\s*["'']?\s*(?:javascript|data|vbscript):')], ''), '') || '>'
              ELSE replace(token, '<', '&lt;') END AS put FROM d WHERE depth = 0 AND opens = 0)
    SELECT p.page_id, md5(coalesce(string_agg(w.put, '' ORDER BY w.pos), '')) AS clean_md5, length(coalesce(string_agg(w.put, '' ORDER BY w.pos), '')) AS n_chars
    FROM pages p LEFT JOIN w USING (page_id) GROUP BY p.page_id"""
)
def sanitised_pages(spark, sf_dir):
    """Pages without what runs or loads."""
    pages = tables.read(spark, sf_dir, "pages", "page_id", "html")
    return sanitise.sanitised(pages, ["page_id"]).select("page_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("n_chars"))


_LONG = "[A-Z][a-z]{5,}"
#: The lines of a reply in turn: heading, item, quotation, paragraph, numbered item, code.
_FORMS = (("## ", ""), ("- ", ""), ("> ", ""), ("", ""), ("7. ", ""), ("```\n", "\n```"))


def _reply(text, closing):
    """text as a Markdown reply: its lines in six forms, and a closing line."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda r: F.trim(r)), lambda r: r != "")

    def formed(r, i):
        one = F.lit("")
        for k, (a, b) in enumerate(_FORMS):
            one = F.when(i % len(_FORMS) == k, F.concat(F.lit(a), r, F.lit(b))).otherwise(one)
        return one

    return F.array_join(F.concat(F.transform(rows, formed), F.array(closing)), "\n\n")


_LINES_SQL = """l AS (SELECT doc_id, r, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i FROM (
      SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS r, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents) WHERE r <> ''),
    x AS (SELECT *, replace(replace(replace(replace(replace(r, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS e FROM l),
    w AS (SELECT doc_id, i,
      CASE i % 6 WHEN 0 THEN '<h2>' || e || '</h2>' WHEN 1 THEN '<ul><li>' || e || '</li></ul>' WHEN 2 THEN '<blockquote><p>' || e || '</p></blockquote>'
        WHEN 3 THEN '<p>' || e || '</p>' WHEN 4 THEN '<ol start="7"><li>' || e || '</li></ol>' ELSE '<pre><code>' || e || '</code></pre>' END AS html,
      CASE i % 6 WHEN 0 THEN '## ' || r WHEN 1 THEN '- ' || r WHEN 2 THEN '> ' || r WHEN 3 THEN r WHEN 4 THEN '7. ' || r ELSE '```' || chr(10) || r || chr(10) || '```' END AS markdown,
      CASE i % 6 WHEN 1 THEN '• ' || r WHEN 4 THEN '7. ' || r ELSE r END AS plain FROM x)"""


@query(
    rf"""WITH {_LINES_SQL},
    k AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '{_LONG}')), 0) AS n, coalesce(nullif(regexp_extract(text, '{_LONG}'), ''), 'none') AS first,
          '[[V1_' || upper(md5(CAST(doc_id AS VARCHAR))) || '_NAME_0]]' AS lost FROM documents),
    a AS (SELECT doc_id, i, html, markdown, plain FROM w UNION ALL SELECT doc_id, 1e9, '<p>' || first || ' ' || lost || '</p>', first || ' ' || lost, first || ' ' || lost FROM k)
    SELECT a.doc_id, md5(string_agg(html, chr(10) || chr(10) ORDER BY i)) AS html_md5, md5(string_agg(markdown, chr(10) || chr(10) ORDER BY i)) AS markdown_md5,
           md5(string_agg(plain, chr(10) || chr(10) ORDER BY i)) AS plain_md5, CAST(any_value(k.n) + CASE WHEN any_value(k.n) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_restored,
           CAST(1 AS BIGINT) AS n_unknown, CAST(1 AS BIGINT) AS inert
    FROM a JOIN k USING (doc_id) GROUP BY a.doc_id"""
)
def structured_restore(spark, sf_dir):
    """Documents as masked Markdown replies with their long capitalised words put back: in headings, items, quotations,
    code and the text of a link, not in its destination; a token of no mapping stays."""
    t = F.coalesce("text", F.lit(""))
    scope = F.upper(F.md5(F.col("doc_id").cast("string")))
    words = F.regexp_extract_all("text", F.lit(_LONG), F.lit(0))
    docs = _docs(spark, sf_dir).select("doc_id", t.alias("text"), scope.alias("scope"))
    found = docs.select("doc_id", "text", "scope", words.alias("words")).withColumn("names", F.array_distinct("words"))
    token = lambda n: F.concat(F.lit("[[V1_"), F.col("scope"), F.lit("_NAME_"), n.cast("string"), F.lit("]]"))
    # what stands before each word, and the word's token; behind the last gap there is none
    between = F.arrays_zip(F.split("text", _LONG, -1).alias("gap"), F.col("words").alias("word"))
    masked = F.array_join(F.transform(between, lambda x: F.concat(x["gap"], F.when(x["word"].isNull(), "").otherwise(token(F.array_position("names", x["word"]))))), "")
    first = F.when(F.size("names") > 0, token(F.lit(1))).otherwise("none")
    closing = F.concat(F.lit("["), first, F.lit("](http://host/"), first, F.lit(") "), token(F.lit(0)))
    replies = found.select("doc_id", _reply(masked, closing).alias("text"))
    mapping = found.select("doc_id", "scope", F.posexplode("names").alias("n", "original")).select("doc_id", token(F.col("n") + 1).alias("token"), "original")
    views = markdown.structured(replies, mapping, ["doc_id"])
    return views.select("doc_id", *[F.md5(c).alias(f"{c}_md5") for c in ("html", "markdown", "plain")], "n_restored", "n_unknown", "inert")


@query(
    rf"""WITH {_LINES_SQL},
    a AS (SELECT doc_id, i, html, plain FROM w UNION ALL
      SELECT doc_id, 1e9, '<p><strong>' || doc_id || '</strong> <a href="http://host/' || doc_id || '">page</a></p>', doc_id || ' page (http://host/' || doc_id || ')' FROM documents)
    SELECT doc_id, md5(string_agg(html, chr(10) || chr(10) ORDER BY i)) AS html_md5, md5(string_agg(plain, chr(10) || chr(10) ORDER BY i)) AS plain_md5 FROM a GROUP BY doc_id"""
)
def markdown_views(spark, sf_dir):
    """Documents as Markdown replies, as pages and as plain texts, with the destinations of links."""
    number = F.col("doc_id").cast("string")
    closing = F.concat(F.lit("**"), number, F.lit("** [page](http://host/"), number, F.lit(")"))
    replies = _docs(spark, sf_dir).select("doc_id", _reply(F.coalesce("text", F.lit("")), closing).alias("text"))
    none = replies.select("doc_id", F.lit("").alias("token"), F.lit("").alias("original")).where("false")
    views = markdown.structured(replies, none, ["doc_id"], linked=True)
    return views.select("doc_id", F.md5("html").alias("html_md5"), F.md5("plain").alias("plain_md5"))


#: Latin letters with one mark, by rule.
_ACCENTED = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(i))) == 2}


def _decomposed(text):
    """text with its accented letters taken apart: a pass for each letter that it holds."""
    apart = F.create_map(*[F.lit(x) for pair in _ACCENTED.items() for x in pair])
    held = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{''.join(_ACCENTED)}]"), F.lit(0)))
    return F.aggregate(held, text, lambda done, letter: F.replace(done, letter, F.element_at(apart, letter)))


@query(
    f"""SELECT doc_id, md5(nfc_normalize(coalesce(text, ''))) AS composed_md5,
           CAST(length(regexp_replace(nfc_normalize(coalesce(text, '')), '[^{"".join(_ACCENTED)}]', '', 'g')) AS INTEGER) AS n_marks FROM documents"""
)
def composed_texts(spark, sf_dir):
    """Documents whose letters and marks were taken apart, put together again."""
    docs = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    apart = docs.select("doc_id", "text", _decomposed(F.col("text")).alias("apart"))
    return apart.select("doc_id", F.md5(composed(F.col("apart"))).alias("composed_md5"), (F.length("apart") - F.length(composed(F.col("text")))).alias("n_marks"))


@query(language.LANG_SCORES_SQL)
def decomposed_lang_scores(spark, sf_dir):
    """Language evidence of documents whose letters and marks were taken apart: that of the documents themselves."""
    return language.lang_scores(_docs(spark, sf_dir).withColumn("text", _decomposed(F.col("text"))), ["doc_id"])


@query(
    rf"""WITH {_LINES_SQL},
    k AS (SELECT doc_id, '[[V1_' || upper(md5(CAST(doc_id AS VARCHAR))) || '_NAME_1]]' AS token FROM documents),
    a AS (SELECT doc_id, i, html, markdown FROM w UNION ALL SELECT doc_id, 1e9, '<p><em>to</em> <mark>' || token || '</mark></p>', '*to* ' || token FROM k),
    f AS (SELECT doc_id, string_agg(html, chr(10) || chr(10) ORDER BY i) AS html, string_agg(markdown, chr(10) || chr(10) ORDER BY i) AS markdown FROM a GROUP BY doc_id)
    SELECT doc_id, 'document-sanitized.' || kind AS file_name, md5(CASE kind WHEN 'html' THEN '<!doctype html>' || chr(10)
      || '<html><head><meta charset="utf-8"><title>document-sanitized</title><style>pre{{white-space:pre-wrap}}</style></head>' || chr(10) || '<body>' || chr(10) || html
      || chr(10) || '</body></html>' || chr(10) ELSE markdown END) AS content_md5
    FROM f, (VALUES ('txt'), ('md'), ('html')) AS t(kind)"""
)
def exported_forms(spark, sf_dir):
    """Documents as replies with a token, as text, Markdown and a page."""
    closing = F.concat(F.lit("*to* [[V1_"), F.upper(F.md5(F.col("doc_id").cast("string"))), F.lit("_NAME_1]]"))
    replies = _docs(spark, sf_dir).select("doc_id", _reply(F.coalesce("text", F.lit("")), closing).alias("text"))
    return export.exported(replies, ["doc_id"]).select("doc_id", "file_name", F.md5("content").alias("content_md5"))
