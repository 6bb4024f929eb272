"""Language evidence by function words: a small weighted table joined to the words of a text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.composed import composed
from maskwright.scratch import local_rows
from maskwright.sources import tables

# Frequent words of each language; the order settles ties.
WORDS = {
    "en": "the and with this that from for is are not was have has will please your you our their which report document",
    "es": "el la los las del que para por con una este esta como pero cuando también porque sus nuestro tiene ha su se es",
    "gl": "o a os as do da dos das que para por con unha non xa hoxe tamén cando porque noso voso súa seu ten foi coa coas polo pola son é",
    "pt": "o a os as do da dos das que para por com uma um não já hoje também quando porque nosso nossa seu sua seus suas tem são foi é em "
    "no na nos nas ao aos pelo pela você vocês",
    "ca": "la els les dels per amb una això també quan perquè nostre nostra seva té és són molt però aquest aquesta aquests hem han ens "
    "vostè gràcies sense doncs als",
    "eu": "eta da dira ez bat hau hori zen du dute izan egin baina ere edo nire gure zure beren honetan honek batean zuen dago daude gaur "
    "mesedez agur kaixo dugu duzu zuek gutxi asko ondo oso bezala eskerrik",
    "fr": "le la les des du de un une et avec ce cette ces pour par est sont pas nous vous notre vos votre leur leurs qui que dans dont "
    "quand avez veuillez",
    "it": "il lo la i gli le un una di del della delle che e con per è sono non questo questa questi queste nostro nostra vostro vostri "
    "quando anche si avete dei dati",
    "de": "der die das den dem des und mit für ist sind nicht ein eine einer einem einen sie wir unser unsere ihre ihren diese dieser bitte "
    "wenn auch zu von",
}


def weights() -> list[tuple[str, str, float]]:
    """(language, word, weight): a word of one language counts 3, or 1 if it is short; a shared word 1 over its languages."""
    lists = {lang: list(dict.fromkeys(text.split())) for lang, text in WORDS.items()}
    shared: dict[str, int] = {}
    for words in lists.values():
        for w in words:
            shared[w] = shared.get(w, 0) + 1
    return [(lang, w, (1.0 if len(w) <= 2 else 3.0) if shared[w] == 1 else 1 / shared[w]) for lang, words in lists.items() for w in words]


def _words(text: Column) -> Column:
    """Words in small letters; letters and their marks count as one letter."""
    return F.regexp_extract_all(F.lower(composed(text)), F.lit(r"\p{L}+"), F.lit(0))


def lang_scores(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Score and matched words per document and language with any match. The table of words has a fixed size."""
    table = local_rows(docs.sparkSession, weights(), "lang string, word string, weight double")
    words = docs.select(*keys, F.explode(_words(F.col(text_col))).alias("word"))
    hits = words.join(F.broadcast(table), "word")  # most words go here, before anything is shuffled
    return hits.groupBy(*keys, "lang").agg(F.round(F.sum("weight"), 6).alias("score"), F.count(F.lit(1)).alias("n_matches"))


# Letters and endings that speak for a language, two points a word.
HINTS = {
    "es": "ñ|(?:ción|ciones)$", "gl": "ñ|cións?$", "pt": "(?:ção|ções)$|ã|õ", "ca": "l·l|ny|ç|[àèò]", "eu": "tx|tz", "fr": "ç|œ", "it": "[èìòù]",
    "de": "[ßäöü]",
}
#: What words of ASCII letters alone need for a hint; all other hints have a letter beyond ASCII.
PLAIN_HINTS = ("ny", "tx", "tz", "ciones")
PARAGRAPH = r"\r?\n[^\S\r\n]*\r?\n(?:[^\S\r\n]*\r?\n)*"


def paragraphs(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, nth, text: the parts of a text between blank lines that are not blank themselves."""
    parts = docs.select(*keys, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), PARAGRAPH)).alias("nth", "text"))
    return parts.filter(F.trim("text") != "")


#: All weights and hints are whole multiples of a point over this, so sums of points are exact.
_UNIT = math.lcm(*range(1, len(WORDS) + 1))
#: In the place of a language: the number of words.
_ALL_WORDS = -1


def hinting(word: Column) -> Column:
    """Whether a word has a hint; words of ASCII letters without PLAIN_HINTS, which are most, meet no pattern."""
    may = F.octet_length(word) > F.length(word)
    for plain in PLAIN_HINTS:
        may = may | word.contains(plain)
    return (F.length(word) > 1) & may & word.rlike("|".join(HINTS.values()))


def points(parts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, lang (its place in WORDS), points (in _UNIT), n_matches: known words and hints of each language with any.

    A row of _ALL_WORDS has the number of words as its points. Words are cut out of a text once and most of them go
    before anything is shuffled; those that stay are summed by text where they are found.
    """
    turn = {lang: i for i, lang in enumerate(WORDS)}
    table = local_rows(parts.sparkSession, [(w, turn[lang], round(x * _UNIT)) for lang, w, x in weights()], "word string, lang int, points long")
    hit = lambda lang, points, n: F.struct(F.lit(lang).cast("int").alias("lang"), points.cast("long").alias("points"), F.lit(n).cast("long").alias("n_matches"))
    known = table.groupBy("word").agg(F.collect_list(hit(F.col("lang"), F.col("points"), 1)).alias("known"))
    # no word is empty: the empty one behind the last carries their number
    counted = F.transform(F.array(_words(F.col(text_col))), lambda w: F.struct(F.size(w).alias("n_words"), F.concat(w, F.array(F.lit(""))).alias("words")))
    words = parts.select(*keys, F.inline(counted)).select(*keys, "n_words", F.explode("words").alias("word"))
    word = F.col("word")
    cued = hinting(word)
    cues = F.array_compact(F.array(*[F.when(word.rlike(p), hit(turn[lang], F.lit(2 * _UNIT), 0)) for lang, p in HINTS.items()]))
    none = F.array().cast("array<struct<lang:int,points:bigint,n_matches:bigint>>")
    found = F.when(word == "", F.array(hit(_ALL_WORDS, F.col("n_words"), 0))).otherwise(F.concat(F.coalesce("known", none), F.when(cued, cues).otherwise(none)))
    telling = words.join(F.broadcast(known), "word", "left").filter((word == "") | F.col("known").isNotNull() | cued)
    hits = telling.select(*keys, F.inline(found))
    return hits.groupBy(*keys, "lang").agg(F.sum("points").alias("points"), F.sum("n_matches").alias("n_matches"))


def evidence(parts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, lang, score, n_matches: known words and hints of each language with any."""
    found = points(parts, keys, text_col).filter(F.col("lang") != _ALL_WORDS)
    lang = F.get(F.array(*[F.lit(name) for name in WORDS]), F.col("lang"))
    return found.select(*keys, lang.alias("lang"), F.round(F.col("points") / _UNIT, 6).alias("score"), "n_matches")


def _winner(ranked: Column, n_words: Column) -> Column:
    """The first of (-points, lang, n_matches) if it has enough and leads, else null."""
    first, second = F.get(ranked, F.lit(0)), F.coalesce(-F.get(ranked, F.lit(1))["less"], F.lit(0))
    enough = (n_words >= LEAST_WORDS) & (first["n_matches"] >= LEAST_MATCHES) & (-first["less"] >= int(LEAST_SCORE * _UNIT))
    return F.when(enough & (-first["less"] * 100 > second * int(LEAD * 100)), first["lang"])


def detected(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, languages, status: the winners of the whole text and of its paragraphs, in the order of the text's ranking.

    A winner has LEAST_WORDS words, LEAST_MATCHES matches, LEAST_SCORE points and LEAD over the second. status is detected, mixed or undetermined; documents without any evidence are undetermined.
    """
    by = [*keys, "nth"]
    spoken = F.col("lang") != _ALL_WORDS
    n_words = F.sum(F.when(~spoken, F.col("points"))).alias("n_words")

    def ranked(*more: str) -> Column:
        """The languages with any evidence, best first; ties in the order of WORDS."""
        return F.array_sort(F.collect_list(F.when(spoken, F.struct((-F.col("points")).alias("less"), "lang", "n_matches", *more)))).alias("ranked")

    parts = points(paragraphs(docs, keys, text_col), by).groupBy(*by).agg(ranked(), n_words)
    # a row for each language of a paragraph, and one for its words
    each = F.concat(F.col("ranked"), F.array(F.struct((-F.col("n_words")).alias("less"), F.lit(_ALL_WORDS).alias("lang"), F.lit(0).cast("long").alias("n_matches"))))
    rows = parts.select(*keys, _winner(F.col("ranked"), F.col("n_words")).alias("best"), F.explode(each).alias("e"))
    totals = rows.groupBy(*keys, F.col("e.lang").alias("lang")).agg(
        (-F.sum("e.less")).alias("points"), F.sum("e.n_matches").alias("n_matches"), F.max(F.coalesce(F.col("best") == F.col("e.lang"), F.lit(False))).alias("won")
    )
    whole = totals.groupBy(*keys).agg(ranked("won"), n_words).withColumn("best", _winner(F.col("ranked"), F.col("n_words")))
    names = F.array(*[F.lit(lang) for lang in WORDS])
    won = F.filter("ranked", lambda r: r["won"] | F.coalesce(r["lang"] == F.col("best"), F.lit(False)))
    listed = whole.select(*keys, F.transform(won, lambda r: F.get(names, r["lang"])).alias("l"))
    out = docs.select(*keys).join(listed, keys, "left").withColumn("languages", F.coalesce("l", F.array().cast("array<string>")))
    status = F.when(F.size("languages") > 1, "mixed").when(F.size("languages") == 1, "detected").otherwise("undetermined")
    return out.select(*keys, "languages", status.alias("status"))


def lang_scores_query(spark, sf_dir: str) -> DataFrame:
    return lang_scores(tables.read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])


LANG_SCORES_SQL = f"""
WITH t(lang, word, weight) AS (VALUES {", ".join(f"('{a}', '{b}', {c!r}::DOUBLE)" for a, b, c in weights())}),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, lang, round(sum(weight * n), 6) AS score, CAST(sum(n) AS BIGINT) AS n_matches FROM c JOIN t USING (word) GROUP BY doc_id, lang
"""


# What a decision needs.
LEAST_WORDS, LEAST_MATCHES, LEAST_SCORE, LEAD = 20, 3, 6.0, 1.25


def decide(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, language: the best-scored language of each text with enough evidence and a clear lead, else null.

    A tie goes to no language, since neither leads. Only texts with any known word give a row.
    """
    words = F.size(_words(F.col(text_col))).alias("n_words")
    scores = lang_scores(docs, keys, text_col)
    best = F.reverse(F.array_sort(F.collect_list(F.struct("score", "n_matches", "lang")))).alias("best")
    ranked = scores.groupBy(*keys).agg(best).join(docs.select(*keys, words), keys)
    first, second = F.col("best")[0], F.coalesce(F.get("best", F.lit(1))["score"], F.lit(0.0))
    enough = (F.col("n_words") >= LEAST_WORDS) & (first["n_matches"] >= LEAST_MATCHES) & (first["score"] >= LEAST_SCORE)
    return ranked.select(*keys, F.when(enough & (first["score"] > LEAD * second), first["lang"]).alias("language"))


def lang_decision_query(spark, sf_dir: str) -> DataFrame:
    return decide(tables.read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])


LANG_DECISION_SQL = f"""
WITH s AS ({LANG_SCORES_SQL}), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n_matches DESC, lang DESC) AS k FROM s
)
SELECT a.doc_id, CASE WHEN len(regexp_extract_all(lower(d.text), '\\p{{L}}+')) >= {LEAST_WORDS} AND a.n_matches >= {LEAST_MATCHES}
  AND a.score >= {LEAST_SCORE} AND a.score > {LEAD}::DOUBLE * coalesce(b.score, 0) THEN a.lang END AS language
FROM r a LEFT JOIN r b ON b.doc_id = a.doc_id AND b.k = 2 JOIN documents d ON d.doc_id = a.doc_id WHERE a.k = 1
"""
