"""Which languages and countries a document's rules come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.packs import COUNTRY_CATEGORIES, COUNTRY_LANGUAGES, PACKS
from maskwright.functions.scalars import locale_of
from maskwright.operators.language import WORDS

LANGUAGES = list(WORDS)


def _list(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def suggested(detected: Column, pinned_languages: Column, pinned_countries: Column, locale: Column) -> Column:
    """languages and jurisdictions: what was detected and pinned, else the user's language; countries follow from both."""
    pinned = F.array_distinct(F.coalesce(pinned_languages, _list([])))
    seen = F.array_distinct(F.coalesce(detected, _list([])))
    languages = (
        F.when(F.size(seen) > 0, F.array_union(seen, pinned)).when(F.size(pinned) > 0, pinned).otherwise(F.array(locale_of(locale, LANGUAGES)))
    )
    return F.struct(languages.alias("languages"), countries_of(languages, pinned_countries).alias("jurisdictions"))


def countries_of(languages: Column, pinned: Column) -> Column:
    """The known countries that any of the languages brings in, then the pinned ones."""
    own = [F.when(F.arrays_overlap(languages, _list(langs)), F.lit(country)) for country, langs in COUNTRY_LANGUAGES.items()]
    known = F.filter(F.coalesce(pinned, _list([])), lambda c: c.isin(list(COUNTRY_LANGUAGES)))
    return F.array_union(F.array_compact(F.array(*own)), known)


def parse_pinned(raw: Column) -> Column:
    """Languages and countries of a stored choice, known ones only; null where it is none."""
    given = F.from_json(raw, "struct<languages:array<string>,jurisdictions:array<string>>")
    known = lambda c, names: F.array_distinct(F.filter(c, lambda x: x.isin(names)))
    whole = given["languages"].isNotNull() & given["jurisdictions"].isNotNull()
    return F.when(
        whole,
        F.struct(known(given["languages"], LANGUAGES).alias("languages"), known(given["jurisdictions"], list(COUNTRY_LANGUAGES)).alias("jurisdictions")),
    )


def with_presets(settings: Column, before: Column, after: Column) -> Column:
    """Switches with the categories of newly chosen countries turned on."""
    out = settings
    for country, categories in COUNTRY_CATEGORIES.items():
        on = F.create_map(*[x for c in categories for x in (F.lit(c), F.lit(True))])
        added = F.array_contains(after, country) & ~F.array_contains(before, country)
        merged = F.map_concat(F.map_filter(out, lambda k, v: ~k.isin(list(categories))), on)
        out = F.when(added, merged).otherwise(out)
    return out


def document_languages(detected: Column) -> Column:
    """Languages whose rules run on a document: the detected ones that have a pack; Spanish and Galician come together."""
    packed = F.filter(detected, lambda x: x.isin(list(PACKS)))
    pair = lambda a, b: F.array_contains(packed, a) & ~F.array_contains(packed, b)
    joined = F.when(pair("es", "gl"), F.concat(packed, _list(["gl"]))).when(pair("gl", "es"), F.concat(packed, _list(["es"]))).otherwise(packed)
    return F.when(F.size(packed) == 0, _list(["en", "es", "gl"])).otherwise(joined)


def by_profile(docs: DataFrame, detected_col: str) -> DataFrame:
    """docs with `languages` and `jurisdictions` from the detected languages of each."""
    profile = suggested(F.col(f"`{detected_col}`"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit("en"))
    return docs.withColumn("languages", profile["languages"]).withColumn("jurisdictions", profile["jurisdictions"])
