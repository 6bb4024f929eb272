"""Detectors as Catalyst expressions: text column in, array of spans out.

Patterns are Java regular expressions. A word boundary is spelled out over ASCII letters, digits and the low
line, whatever the text's script.
"""

from __future__ import annotations

import regex as re
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import checks
from maskwright.functions.lexicon import AMBIGUOUS_PLACES, LOCALITIES, PLACES
from maskwright.functions.packs import lexicon_of
from maskwright.functions.patterns import any_of, spaced
from maskwright.functions.spans import RUNG, SPAN, before, emit, scan

B = r"(?<![A-Za-z0-9_])"  # before a word
E = r"(?![A-Za-z0-9_])"  # after a word
WS = r"[ \t]"
LOOK_BACK = 40

# Shapes that must find what existing documents were masked by.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = spaced(r"(?:\+\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?){2,5}\d{2,4}")
DNI = B + r"\d{2}\.?\d{3}\.?\d{3}-?[A-Za-z]" + E
NIE = B + r"[XYZxyz]\d{7}[A-Za-z]" + E
CARD = B + r"(?:\d[ -]?){13,19}(?:(?<=\d)(?![A-Za-z0-9_])|(?<=[ -])(?=[A-Za-z0-9_]))"
MASKED = r"(?<![0-9A-Za-z*•_])(?=[0-9A-Za-z*•_]*?[*xX•_]{2})[0-9A-Za-z*•_]+"
DATE_TIME = (
    B + r"(?:\d{4}[.\-/]\d{2}[.\-/]\d{2}(?:[ \t]+\d{2}:\d{2}(?::\d{2})?)?"
    r"|\d{2}[.\-/]\d{2}[.\-/]\d{4}(?:[ \t]+\d{2}:\d{2}(?::\d{2})?)?|\d{2}:\d{2}:\d{2})" + E
)
ACRONYM = B + r"[A-Z]{2,}" + E
ID_CODE = (
    r"(?iu)(?<![A-Za-z0-9_])(?:Nº[ \t]+de[ \t]+afiliación|Nº[ \t]+Colegiado|Colegiada|Colegiado|Expediente|Referencia|Ref\.|Matrícula|NUSS"
    r"|Historia[ \t]+clínica|Protocolo|Núm\.|Nº)[ \t]*[:\-]?[ \t]*([A-Z]{0,3}[-/]?\d[\dA-Z/-]*)"
)
ID_LABEL = (
    r"(?iu)(?:D\.?N\.?I\.?|N\.?I\.?E\.?|N\.?I\.?F\.?|documento|identidad)(?:[ \t]+(?:es|son|num(?:\.|ero)?|número))?"
    r"[ \t]*(?:n[ºo°]\.?)?[ \t]*[:\-]?[ \t]*\z"
)
NUM = r"(?:\d{1,3}(?:[.,\u00A0\u202F]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
_CUR = r"[€$£¥]"
_ISO = r"(?:EUR|USD|GBP|JPY|CHF|CAD|AUD|MXN|ARS|COP|CLP|PEN|BRL|CNY)"
_WORD = r"(?:euros?|d[óo]lares|d[óo]lar|dollars?)"
_MAG = r"(?:mil\s+millones|millones|mill[óo]n|billones|bill[óo]n|mil|million|billion)(?!\p{L})"
_END = r"(?!\p{N}|[.,]\p{N})"
MONEY = spaced(
    rf"(?<![\p{{L}}\p{{N}}.,])(?:\(?[-−]?(?:{_CUR}|{_ISO}(?!\p{{L}}))[ \u00A0\u202F]?[-−]?{NUM}{_END}(?:\s+{_MAG})?\)?"
    rf"|\(?[-−]?{NUM}{_END}(?:\s+{_MAG})?(?:\s+de)?[ \u00A0\u202F]?(?:{_CUR}|(?:{_ISO}|{_WORD})(?![\p{{L}}\p{{N}}]))\)?)"
)
_NUMBER_WORD = (
    r"(?:un|uno|una|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|diecis[ée]is|diecisiete|dieciocho"
    r"|diecinueve|veinte|veinti\p{L}+|treinta|cuarenta|cincuenta|sesenta|setenta|ochenta|noventa|cien|ciento"
    r"|(?:dos|tres|cuatro|seis|sete|ocho|nove)cient[oa]s|quinient[oa]s|mil|mill[óo]n|millones|bill[óo]n|billones)"
)
MONEY_WORDS = spaced(rf"(?iu)(?<!\p{{L}}){_NUMBER_WORD}(?:\s+(?:y\s+)?{_NUMBER_WORD})*\s+(?:de\s+)?{_WORD}(?!\p{{L}})")
#: Every amount has one of these, the words in small letters.
CURRENCIES = (*_CUR[1:-1], *_ISO[3:-1].split("|"))
CURRENCY_WORDS = ("euro", "dólar", "dolar", "dollar")
PT_NIF = r"(?<![\d\-.,])(?:\d{3}[ .]?\d{3}[ .]?\d{3})(?!\d|[ .]?\d)"
PT_NIF_LABEL = spaced(r"(?iu)(?:(?<![A-Za-z0-9_])NIF|(?<![A-Za-z0-9_])N\.?I\.?F\.?|(?<![A-Za-z0-9_])NIPC|(?<![A-Za-z0-9_])contribuinte)[\s:.nºo°-]*\z")
PT_CARD = r"(?<![\dA-Za-z])(?:\d{8} ?\d ?[A-Za-z]{2} ?\d)(?![\dA-Za-z])"
PT_PHONE = (
    r"(?<![A-Za-z0-9_])(?:(?:\+|00)351[ .-]?)?(?:(?:9[1236]\d|2\d{2})[ .-]?\d{3}[ .-]?\d{3}|(?:2\d)[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:9[1236])[ .-]?\d{3}[ .-]?\d{4})(?!\d)"
)
PT_POSTCODE = r"(?<![\d-])\d{4}-\d{3}(?:[ \t]+\p{Lu}\p{L}*+(?:[ \t]++(?:de|do|da|dos|das|\p{Lu}\p{L}*+))*+)?"
# Streets: a match without group 1 is a street whose words end before any number. It takes the words with it, so no word
# is read once for every street before it; what a run of words has taken it never gives back.
_PT_WORDS = (
    r"(?<!\p{L})(?:Rua|Avenida|Av\.|Praça|Largo|Travessa|Alameda|Estrada|Beco|Calçada)[ \t]++(?:(?:de|do|da|dos|das)[ \t]++)?+(?!Av\.)\p{Lu}\p{L}*+"
    r"(?:[ \t]++(?!Av\.)(?:de|do|da|dos|das|e|\p{Lu}\p{L}*+))*+"
)
PT_STREET = rf"({_PT_WORDS}[ \t]*,?[ \t]*\d+[A-Za-zº.]*(?:[ ,\t]*\d+\.?º[ \t]*(?:Esq|Dto|Esq\.|Dto\.)?)?)|{_PT_WORDS}"
_PARTICLE = r"(?:de|do|da|dos|das|del|la|las|los|el|o|a|os|as)"
STREETS = (
    "Rúa", "Rua", "Calle", "C/", "Avenida", "Avda", "Plaza", "Praza", "Camiño", "Street", "Avenue", "Road", "Rd", r"Avda\.", r"Av\.",
    r"Pza\.", "Camino", "Estrada", "Carretera", r"Ctra\.", "Lugar", "Travesía", "Travesia", "Rolda", "Ronda", "Paseo", "Pasaxe", "Pasaje",
    "Glorieta", "Urbanización", "Polígono", "Barrio", "Bairro",
)
_STREET = "|".join(f"[{s[0].upper()}{s[0].lower()}]{s[1:]}" for s in sorted(STREETS, key=len, reverse=True))
_AREA = rf"\p{{Lu}}\p{{L}}*(?:[ \t]+(?:{_PARTICLE}[ \t]+)?\p{{Lu}}\p{{L}}*){{0,3}}"
_DOOR = (
    r"(?:\d{1,2}[ºª°](?:[ \t]*(?:[A-Z](?![A-Za-z0-9_])|esquerda|dereita|izquierda|derecha|izda\.?|dcha\.?|centro|ext\.?|int\.?))?"
    r"|baixo|bajo|entresuelo|entreplanta|ático|atico|planta[ \t]+\d+|porta[ \t]+[A-Za-z0-9_]+|puerta[ \t]+[A-Za-z0-9_]+|piso[ \t]+[A-Za-z0-9_]+)"
)
_SHORT = "(?!" + "|".join(f"[{k[0].upper()}{k[0].lower()}]{k[1:]}" for k in STREETS if not k.isalpha()) + ")"
_STREET_WORDS = (
    rf"(?<!\p{{L}})(?:{_STREET})(?:[ \t]++{_PARTICLE}(?=[ \t]))*+[ \t]++{_SHORT}\p{{Lu}}\p{{L}}*+(?:[ \t]++(?:{_PARTICLE}[ \t]++)*+{_SHORT}\p{{Lu}}\p{{L}}*+)*+"
)
ADDRESS = (
    rf"({_STREET_WORDS},?[ \t]*(?:(?:n[ºo°]\.?[ \t]*)?\d+[A-Za-z]?{E}|km\.?[ \t]*\d+(?:[.,]\d+)?|s/n)(?:,?[ \t]*{_DOOR}){{0,2}}"
    rf"(?:,?[ \t]*\d{{5}}(?:[ \t]+{_AREA})?|,[ \t]*{_AREA})?)|{_STREET_WORDS}"
)
UK_ADDRESS = (
    B + r"\d+[A-Za-z]?[ \t]+(?:\p{Lu}\p{L}*[ \t]+){1,3}(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Grove|Close|Drive|Dr|Way|Place|Terrace|Crescent"
    r"|Gardens|Square|Court|Row|Hill|Walk|Mews)" + E + r"(?:,[ \t]*\p{Lu}\p{Ll}+(?:[ \t]+\p{Lu}\p{Ll}+)?)?"
    r"(?:,?[ \t]*[A-Z]{1,2}\d[A-Z\d]?[ \t]?\d[A-Z]{2}" + E + ")?"
)
US_ADDRESS = (
    B + r"\d+[ \t]+\p{Lu}\p{L}*(?:[ \t]+\p{Lu}\p{L}*){0,3},[ \t]*\p{Lu}\p{L}*+(?:[ \t]++\p{Lu}\p{L}*+)*+,[ \t]*[A-Z]{2}[ \t]+\d{5}(?:-\d{4})?" + E
)
POSTCODE_PLACE = rf"(?iu){B}\d{{5}}[ \t]+(?:{any_of(LOCALITIES)}){E}"
POSTCODE_LABEL = spaced(rf"(?iu){B}(?:CP|C\.?P\.?|código\s+postal|postal\s+code)\s*:?\s*(\d{{5}}){E}")


def place_pattern(places: list[str] | tuple[str, ...] = tuple(PLACES)) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{M}}\p{{N}}_])(?:{any_of(places)})(?![\p{{L}}\p{{M}}\p{{N}}_])"


GEO_CUE = spaced(
    r"(?iu)(?:(?<![A-Za-z0-9_])(?:in|from|to|at|near|within|around|visiting|en|desde|hacia|provincia|ciudad|país|países|estado|región|cidade|na|para|em)\s+"
    r"|(?<![A-Za-z0-9_])(?:city|country|province|state|region)\s+(?:of\s+)?|(?<![A-Za-z0-9_])(?:país|provincia|cidade|estado|región)\s+de\s+)\z"
)
_COMPANY_END = spaced(r"(?=[\s.,;:!?)]|\z)")


def _or(words) -> str:
    return "|".join(words) or "(?!)"


_CAPITALS = r"\p{Lu}\p{L}*+(?:[ \t]++\p{Lu}\p{L}*+)*+"


def company_patterns(lexicon: dict) -> tuple[str, str, str]:
    """A run of capitalised words with the legal form at its end, if any; a legal form in such a run; a
    run after an opening word. The last form of a run ends the name. A run is read once and gives nothing back."""
    forms = lexicon["company_suffixes"]
    # a form like S.L. is begun by a word of the run and goes on behind it
    broken = [re.fullmatch(r"(\p{L}+)(\P{L}.*)", f) for f in forms]
    after = rf",?[ \t]++(?:{_or(forms)}){_COMPANY_END}"
    behind = "".join(rf"|(?<=[ \t]{m[1]}){m[2]}{_COMPANY_END}" for m in broken if m)
    run = rf"\p{{Lu}}\p{{L}}*+(?:(?:[ \t]++\p{{Lu}}\p{{L}}*+)++(?:{after}{behind})?+|{after})?+"
    return run, rf"(?<=\p{{L}}),?[ \t]+(?:{_or(forms)}){_COMPANY_END}", rf"{B}(?:{_or(lexicon['company_prefixes'])})[ \t]+{_CAPITALS}"


def shield_patterns(lexicon: dict) -> tuple[str, str, str]:
    """Legal citations, professional titles and public bodies."""
    return tuple(
        rf"{B}(?:{_or(lexicon[heads])})(?:[ \t]+(?:{_or(lexicon[more])}))*"
        for heads, more in (("legal_heads", "legal_continuation"), ("titles", "title_qualifiers"), ("institutions", "institution_continuation"))
    )


V, I = RUNG["VALIDATED_REGEX"], RUNG["ID_CODE"]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _with_digits(t: Column, least: int) -> Column:
    """Whether a text has that many digits, in one pass without a way back."""
    return t.rlike(f"(?:[0-9][^0-9]*+){{{least}}}")


def email(t: Column) -> Column:
    return emit(scan(t, EMAIL, gate=F.contains(t, F.lit("@"))), "EMAIL", V)


def phone(t: Column) -> Column:
    return emit(F.filter(scan(t, PHONE, gate=_with_digits(t, 9)), lambda m: F.length(digits(m["text"])).between(9, 15)), "PHONE", V, pack="ES")


def card(t: Column) -> Column:
    ok = lambda m: F.length(digits(m["text"])).between(13, 19) & checks.luhn_col(digits(m["text"]))
    return emit(F.filter(scan(t, CARD, gate=_with_digits(t, 13)), ok), "CREDIT_CARD", V)


def masked_id(t: Column) -> Column:
    ok = lambda m: m["text"].rlike("[*xX•_]{2}") & (F.length(F.regexp_replace(m["text"], "[*xX•_]", "")) >= 4)
    return emit(F.filter(scan(t, MASKED, gate=t.rlike("[*xX•_]{2}")), ok), "MASKED_ID", V, pack="ES")


def identity(t: Column, pattern: str, category: str) -> Column:
    """Valid numbers, and those with a wrong letter as INVALID_ID unless a URL character stands before them."""
    found = scan(t, pattern)
    valid = emit(F.filter(found, lambda m: checks.identity_col(m["text"])), category, V, pack="ES")
    wrong = F.filter(found, lambda m: ~checks.identity_col(m["text"]) & ~before(t, m, LOOK_BACK).rlike(r"[/=&?#]\z"))
    labelled = F.filter(wrong, lambda m: before(t, m, LOOK_BACK).rlike(ID_LABEL))
    bare = F.filter(wrong, lambda m: ~before(t, m, LOOK_BACK).rlike(ID_LABEL))
    rung = RUNG["INVALID_ID"]
    return F.concat(valid, emit(labelled, "INVALID_ID", rung, 0.9, "ES"), emit(bare, "INVALID_ID", rung, 0.5, "ES"))


def dni(t: Column) -> Column:
    return identity(t, DNI, "DNI")


def nie(t: Column) -> Column:
    return identity(t, NIE, "NIE")


def id_code(t: Column) -> Column:
    return emit(F.filter(scan(t, ID_CODE, 1), lambda m: ~m["text"].rlike(r"^\d{1,2}\z")), "ID_CODE", I, pack="ES")


def _balanced(found: Column) -> Column:
    """Without a bracket at an edge that has no partner at the other."""

    def fix(m: Column) -> Column:
        opened, closed = m["text"].startswith("("), m["text"].endswith(")")
        a = F.when(opened & ~closed, 1).otherwise(0)
        z = F.when(closed & ~opened, 1).otherwise(0)
        inner = F.substring(m["text"], a + 1, F.length(m["text"]) - a - z)
        return F.struct((m["start"] + a).alias("start"), (m["end"] - z).alias("end"), inner.alias("text"))

    return F.transform(found, fix)


def _apart(first: Column, second: Column) -> Column:
    """first, and what of second overlaps none of it."""
    free = F.filter(second, lambda s: ~F.exists(first, lambda f: (f["start"] < s["end"]) & (s["start"] < f["end"])))
    return F.concat(first, free)


def money(t: Column) -> Column:
    return emit(_apart(_balanced(scan(t, MONEY)), _balanced(scan(t, MONEY_WORDS))), "MONEY", RUNG["MONEY"])


def _numbered(found: Column) -> Column:
    return F.filter(found, lambda m: m["text"] != "")


def address(t: Column) -> Column:
    us = scan(t, US_ADDRESS)
    uk = F.filter(scan(t, UK_ADDRESS), lambda u: ~F.exists(us, lambda a: (a["start"] < u["end"]) & (u["start"] < a["end"])))
    all_ = F.concat(_numbered(scan(t, ADDRESS, 1)), us, uk, scan(t, POSTCODE_PLACE), scan(t, POSTCODE_LABEL, 1))
    return emit(all_, "ADDRESS", RUNG["ADDRESS"], pack="ES")


def location(t: Column) -> Column:
    def ok(m: Column) -> Column:
        cued = before(t, m, 32).rlike(GEO_CUE) & ~F.substring(t, m["end"] + 1, 64).rlike(spaced(r"^\s+\p{Lu}\p{L}+"))
        return ~F.lower(m["text"]).isin(*[p.lower() for p in AMBIGUOUS_PLACES]) | cued

    return emit(F.filter(scan(t, place_pattern()), ok), "LOCATION", RUNG["LOCATION"], 0.9)


DEFAULT = ("es", "en")


def company(t: Column, languages: tuple[str, ...] = DEFAULT) -> Column:
    run, form, opening = company_patterns(lexicon_of(languages))

    def cut(m: Column) -> Column:
        text = F.regexp_extract(F.concat(m["text"], F.substring(t, m["end"] + 1, 1)), r"(?s)\A.*" + form, 0)
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(text)).alias("end"), text.alias("text"))

    formed = F.filter(F.transform(scan(t, run), cut), lambda m: m["text"] != "")
    return emit(F.concat(formed, scan(t, opening)), "COMPANY", RUNG["COMPANY"], pack=None)


def acronym(t: Column, languages: tuple[str, ...] = DEFAULT) -> Column:
    kept = F.filter(scan(t, ACRONYM), lambda m: ~m["text"].isin(*lexicon_of(languages)["acronym_exclusions"]))
    return emit(kept, "COMPANY", RUNG["COMPANY_ACRONYM"], 0.4, None, enabled=False)


def date_time(t: Column) -> Column:
    return emit(scan(t, DATE_TIME), "SHIELD", RUNG["SHIELD"], shield=True)


def shields(t: Column, languages: tuple[str, ...] = DEFAULT) -> Column:
    return emit(F.concat(*[scan(t, p) for p in shield_patterns(lexicon_of(languages))]), "SHIELD", RUNG["SHIELD"], pack=None, shield=True)


def pt_nif(t: Column) -> Column:
    found = F.filter(scan(t, PT_NIF), lambda m: checks.nif_pt_col(digits(m["text"])))
    near = lambda m: before(t, m, 24).rlike(PT_NIF_LABEL)
    bare = lambda m: ~near(m) & digits(m["text"]).rlike("^[13568]") & ~m["text"].rlike("[ .]")
    return F.concat(emit(F.filter(found, near), "NIF", V, pack="PT"), emit(F.filter(found, bare), "NIF", V, 0.8, "PT"))


def pt_phone(t: Column) -> Column:
    return emit(scan(t, PT_PHONE), "PHONE", V, pack="PT")


def pt_address(t: Column) -> Column:
    def trimmed(m: Column) -> Column:
        text = F.regexp_replace(m["text"], r"[ ,.\t]+\z", "")
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(text)).alias("end"), text.alias("text"))

    return emit(F.concat(F.transform(_numbered(scan(t, PT_STREET, 1)), trimmed), scan(t, PT_POSTCODE)), "ADDRESS", RUNG["ADDRESS"], pack="PT")


def dictionary(t: Column, rules: list[dict]) -> Column:
    """Spans of the user's rules (term_or_pattern, is_regex, replacement_type, target_category), case-sensitive."""
    out = F.array().cast(f"array<{SPAN}>")
    for r in rules:
        pattern = r["term_or_pattern"] if r.get("is_regex") else "".join("\\" + c if c in r".*+?^${}()|[]\/-" else c for c in r["term_or_pattern"])
        category = r.get("target_category") if r.get("replacement_type") == "CATEGORY" and r.get("target_category") else "CUSTOM"
        hits = F.filter(scan(t, pattern), lambda m: m["end"] > m["start"])
        spans = F.transform(emit(hits, category, RUNG["DICTIONARY"]), lambda s: s.withField("source", F.lit("dictionary")))
        out = F.concat(out, spans)
    return out
