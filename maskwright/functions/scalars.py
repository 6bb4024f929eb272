"""Scalar functions of the engine as columns: money, random draws, escapes, sheets, locales, settings.

Values that a JSON document or a user gives are checked at this boundary; what does not fit becomes null or the default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import detectors as D
from maskwright.functions.checks import fnv1a_col

NUMERAL = r"\d(?:[\d., \u00A0\u202F]*\d)?"


# money


def own_convention(numeral: Column) -> Column:
    """ES (1.234,56), EN (1,234.56) or null: what the separators of a numeral say about themselves."""
    dots = F.length(numeral) - F.length(F.replace(numeral, F.lit(".")))
    commas = F.length(numeral) - F.length(F.replace(numeral, F.lit(",")))
    tail = F.length(F.regexp_extract(numeral, r"[.,]([^.,]*)$", 1))
    last = F.regexp_extract(numeral, r"([.,])[^.,]*$", 1)
    return (
        F.when((dots > 0) & (commas > 0), F.when(last == ".", "EN").otherwise("ES"))
        .when(dots + commas > 1, F.when(dots > 0, "ES").otherwise("EN"))
        .when((dots + commas == 1) & (tail != 3), F.when(dots > 0, "EN").otherwise("ES"))
    )


def money_convention(text: Column) -> Column:
    """The convention of most unambiguous amounts of a text; ES on a tie."""
    amounts = F.regexp_extract_all(text, F.lit(D.MONEY), F.lit(0))
    votes = F.transform(amounts, lambda a: own_convention(F.regexp_extract(a, NUMERAL, 0)))
    count = lambda kind: F.size(F.filter(votes, lambda v: v == kind))
    return F.when(count("EN") > count("ES"), "EN").otherwise("ES")


# Words of magnitude, the first that occurs counts.
MAGNITUDES = ((r"(?iu)mil\s+millones|billion", 1e9), (r"(?iu)billones|bill[óo]n", 1e12), (r"(?iu)millones|mill[óo]n|million", 1e6), (r"(?iu)(?<!\p{L})mil(?!\p{L})", 1e3))


def money_amount(text: Column, convention: Column) -> Column:
    """The signed value of an amount in figures; null for one in words."""
    numeral = F.regexp_extract(text, NUMERAL, 0)
    style = F.coalesce(own_convention(numeral), convention)
    bare = F.regexp_replace(numeral, r"[ \u00A0\u202F]", "")
    plain = F.when(style == "ES", F.translate(bare, ",.", ".")).otherwise(F.replace(bare, F.lit(",")))
    rest = F.call_function("substring_index", text, numeral, F.lit(-1))
    times = F.lit(1.0)
    for pattern, value in reversed(MAGNITUDES):
        times = F.when(rest.rlike(pattern), value).otherwise(times)
    negative = text.rlike("[-−]") | (text.startswith("(") & text.endswith(")"))
    value = plain.try_cast("double") * times
    return F.when(numeral != "", F.when(negative, -value).otherwise(value))


def money_range(low: Column, high: Column, default: tuple[float, float] = (10.0, 25.0), most: float = 90.0) -> Column:
    """A band of percentages within 0 and `most`, the smaller first; what is no number takes the default."""
    clean = lambda v, d: F.when(v.isNull() | F.isnan(v), F.lit(d)).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(most)))
    a, b = clean(low.cast("double"), default[0]), clean(high.cast("double"), default[1])
    return F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max"))


# random draws: 32-bit arithmetic in 64-bit columns

_WORD = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The product modulo 2**32 of two 32-bit values, in halves so that nothing overflows."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD))


def draw(seed: Column, nth: int = 1) -> Column:
    """The nth 32-bit draw of the small generator that a seed starts."""
    a = (seed + F.lit(0x6D2B79F5 * nth % (1 << 32))).bitwiseAND(F.lit(_WORD))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_WORD)))
    return t.bitwiseXOR(F.shiftright(t, 14))


def pick(seed: Column, pool: list[str], nth: int = 1) -> Column:
    """An entry of the pool by the nth draw."""
    at = F.floor(draw(seed, nth) * F.lit(len(pool)) / F.lit(float(1 << 32)))
    return F.element_at(F.array(*[F.lit(p) for p in pool]), (at + 1).cast("int"))


def seed_of(*parts: Column) -> Column:
    """The 32-bit hash of the parts, with a null character between them."""
    return fnv1a_col(F.concat_ws("\0", *parts))


# escapes and sheets


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def escape_xml(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def column_letters(index: Column) -> Column:
    """A, B, ... Z, AA, ... for 0, 1, ...; up to three letters, as sheets have."""
    letter = lambda n: F.char(F.lit(65) + n)
    n = index.cast("long")
    two, three = n - 26, n - 26 - 676
    return (
        F.when(n < 26, letter(n))
        .when(two < 676, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def column_index(reference: Column) -> Column:
    """0, 1, ... for the letters in front of a cell's reference; no letters count as A."""
    letters = F.split(F.regexp_extract(reference, "^[A-Z]+", 0), "")
    number = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.greatest(number - 1, F.lit(0))


def serial_date(serial: Column) -> Column:
    """The date of a sheet's day number; sheets count a 29 February 1900 that never was."""
    days = F.floor(F.when(serial >= 60, serial - 1).otherwise(serial)).cast("int")
    return F.date_format(F.date_add(F.lit("1899-12-31").cast("date"), days), "yyyy-MM-dd")


def locale_of(requested: Column, available: list[str], fallback: str = "en") -> Column:
    """The available locale asked for: the same one, its language, else the fallback."""
    norm = lambda c: F.lower(F.replace(F.trim(c), F.lit("_"), F.lit("-")))
    asked = norm(F.coalesce(requested, F.lit("")))
    have = F.array(*[F.lit(a) for a in available])
    found = lambda key: F.get(F.filter(have, lambda a: norm(a) == key), F.lit(0))
    return F.coalesce(found(asked), found(F.substring_index(asked, "-", 1)), found(F.lit(fallback.lower())), F.lit(fallback))


def settings_of(raw: Column, known: list[str]) -> Column:
    """The switches of a JSON text: known categories with a true or false; anything else is left out."""
    table = F.coalesce(F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"}), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(table, lambda k, v: k.isin(known) & v.isin("true", "false"))
    return F.transform_values(kept, lambda k, v: v == "true")


def informative(text: Column, category: Column) -> Column:
    """Whether a model's hit says enough: names, companies and places need two letters in a row."""
    return ~category.isin("NAME", "COMPANY", "LOCATION") | text.rlike(r"\p{L}{2,}")


def token(scope: Column, category: Column, counter: Column) -> Column:
    """A stable token of a scope of 32 hexadecimal digits; null where scope or counter cannot be one's."""
    label = F.regexp_replace(F.upper(category), "[^A-Z0-9_]", "_")
    label = F.substring(F.when(label.rlike("^[A-Z]"), label).otherwise(F.concat(F.lit("CUSTOM_"), label)), 1, 64)
    made = F.concat(F.lit("[[V1_"), scope, F.lit("_"), label, F.lit("_"), counter.cast("string"), F.lit("]]"))
    return F.when(scope.rlike(r"^[A-F0-9]{32}\z") & (counter >= 1), made)


TOKEN = r"^\[\[V1_[A-F0-9]{32}_[A-Z][A-Z0-9_]{0,63}_[1-9][0-9]*\]\]\z"


def _accents() -> tuple[str, str]:
    """Letters that are a letter with marks on it, and those letters, by the rule of canonical decomposition."""
    import unicodedata

    marked = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f")
        if base != c and len(base) == 1:
            marked[c] = base
    return "".join(marked), "".join(marked.values())


ACCENTED, BARE = _accents()


def without_accents(text: Column) -> Column:
    """Composed and decomposed letters without their marks: Latin, Greek and the letters added for Vietnamese."""
    return F.translate(F.regexp_replace(text, "[\u0300-\u036f]", ""), ACCENTED, BARE)
