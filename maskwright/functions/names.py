"""Procedural detectors: people's names, VAT numbers and account numbers.

They need loops that no built-in expression has (peeling words off a candidate until nothing changes, shrinking a
number until its check fits), so they run in one vectorised function over a batch of texts.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import regex

from maskwright.functions import checks
from maskwright.functions.lexicon import LEXICON
from maskwright.functions.packs import lexicon_of
from maskwright.functions.patterns import BLANKS

Found = tuple[int, int, str, float]  # start, end, text, confidence
WS = r"[ \t]"
TOKEN = r"(?:\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?|\p{Lu}\.)"
MAX_TOKENS = 6

# National shapes of VAT numbers after their prefix.
VAT = {
    "AT": r"U\d{8}", "BE": r"[01]\d{9}", "BG": r"\d{9,10}", "CY": r"\d{8}[A-Z]", "CZ": r"\d{8,10}", "DE": r"\d{9}", "DK": r"\d{8}",
    "EE": r"\d{9}", "EL": r"\d{9}", "ES": r"[ABCDEFGHJNPQRSUVWXYZ]\d{7}[A-Z0-9]|\d{8}[A-Z]", "FI": r"\d{8}", "FR": r"[A-HJ-NP-Z0-9]{2}\d{9}",
    "HR": r"\d{11}", "HU": r"\d{8}", "IE": r"\d{7}[A-W][A-I]?", "IT": r"\d{11}", "LT": r"\d{9}|\d{12}", "LU": r"\d{8}", "LV": r"\d{11}",
    "MT": r"\d{8}", "NL": r"\d{9}B\d{2}", "PL": r"\d{10}", "PT": r"\d{9}", "RO": r"\d{2,10}", "SE": r"\d{12}", "SI": r"\d{8}", "SK": r"\d{10}",
}
VAT_REACH = 26
_PREFIX = regex.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(VAT)})")
_VAT = {k: regex.compile(v) for k, v in VAT.items()}
_BODY = regex.compile(r"[A-Za-z0-9 \t./-]{1,26}")
_CIF_LABEL = regex.compile(
    r"(?<![A-Za-z0-9_])(?:CIF(?:/NIF)?|NIF(?:-IVA)?|VAT|IVA)(?![A-Za-z0-9_])[ \t:./-]*((?:ES)?[ABCDEFGHJNPQRSUVW]\d[\d \t./-]{5,10}[A-Z0-9])(?![A-Za-z0-9_])",
    regex.I,
)
_IBAN = regex.compile(rf"(?<![A-Za-z0-9_])[A-Z]{{2}}[0-9]{{2}}(?:[{BLANKS}]?[A-Z0-9]{{1,4}}){{2,7}}(?![A-Za-z0-9_])")
_LAST_GROUP = regex.compile(rf"[{BLANKS}]?[A-Z0-9]{{1,4}}\Z")


def ibans(text: str) -> list[Found]:
    """Groups at the end are given up one by one until the check fits."""
    out = []
    for m in _IBAN.finditer(text):
        value = m[0]
        while value and not checks.iban(value):
            cut = _LAST_GROUP.search(value)
            value = value[: cut.start()] if cut and cut.start() > 4 else ""
        if value:
            out.append((m.start(), m.start() + len(value), value, 1.0))
    return out


def _vat_fits(prefix: str, value: str) -> bool:
    compact = "".join(c for c in value[2:].upper() if c.isascii() and c.isalnum())
    if not _VAT[prefix].fullmatch(compact):
        return False
    company = prefix == "ES" and compact[0] in "ABCDEFGHJNPQRSUVW" and compact[1:8].isdigit() and len(compact) == 9
    return checks.cif(compact) if company else True


def vat_numbers(text: str) -> list[Found]:
    best: dict[tuple[int, int], Found] = {}
    for m in _PREFIX.finditer(text):
        body = _BODY.match(text, m.end())
        if not body:
            continue
        for size in range(len(body[0]), 0, -1):
            value = text[m.start() : m.end() + size].rstrip(" \t./-")
            after = text[m.start() + len(value) :][: VAT_REACH + 2]
            if after[:1].isascii() and after[:1].isalnum() or len(value) <= 2:
                continue
            if after[:1] in tuple(" \t./-") and after.lstrip()[:1].isdigit():
                continue
            if _vat_fits(m[0], value):
                best[m.start(), m.start() + len(value)] = (m.start(), m.start() + len(value), value, 0.75)
                break
    for m in _CIF_LABEL.finditer(text):
        value = m[1]
        sure = 0.9 if checks.cif(value.upper().removeprefix("ES")) else 0.65
        if best.get(m.span(1), (0, 0, "", 0.0))[3] < sure:
            best[m.span(1)] = (*m.span(1), value, sure)
    return list(best.values())


def _alt(words: list[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True)) or "(?!)"


DEFAULT = ("es", "en")


@lru_cache(maxsize=64)
def _rules(languages: tuple[str, ...]) -> dict:
    lex = {kind: list(words) for kind, words in lexicon_of(languages).items()}
    stop, titles, heads, particles = lex["stopwords"], lex["titles"], lex["structure_heads"], lex["name_particles"]
    name = rf"{TOKEN}(?:{WS}+(?:(?:{'|'.join(particles) or '(?!)'}){WS}+)?{TOKEN}){{0,{MAX_TOKENS - 1}}}"
    edge = r"(?![A-Za-z0-9_])"
    return {
        "name": regex.compile(name),
        "particles": set(particles),
        "stop": {w.lower() for w in stop},
        "lettered": {w.lower() for w in lex["lettered_heads"] + heads},
        # what may be peeled off the front, in the order it is tried
        "peel": [
            regex.compile(rf"(?:{_alt(titles + stop)}){edge}{WS}*"),
            regex.compile(rf"(?:{'|'.join(lex['honorifics'])})\.{WS}*"),
            regex.compile(rf"(?:{_alt(heads)}){edge}{WS}*", regex.I),
            regex.compile(rf"(?:{'|'.join(lex['institutions'])})(?:{WS}+[ye])?{WS}+"),
            regex.compile(rf"(?:{'|'.join(particles)}){edge}{WS}*"),
        ],
        "not_given": regex.compile(
            rf",{WS}*(?:{'|'.join(lex['company_suffixes'])}|{_alt(titles + stop)}|{'|'.join(heads)}|DNI|NIE|NIF|CIF|NUSS|IBAN)(?=[{BLANKS}.,;:!?)]|\Z)", regex.I
        ),
        "given": regex.compile(rf",{WS}*({TOKEN}(?:{WS}+{TOKEN})?)"),
        "caps": regex.compile(rf"(?:DE|DEL|DA|DO|DAS|DOS|AL|LA|LAS|LOS|EL|Y|E){WS}"),
        "initial": regex.compile(r"\p{Lu}\."),
        "attached": regex.compile(r"[\p{L}\p{N}*·•_]"),
        "line_start": regex.compile(r"(?:^|\n)[ \t\-*•·]*\Z"),
        "excluded": {w.lower() for w in stop + heads + titles + particles},
    }


_BLANK = regex.compile(f"[{BLANKS}]")


def _sentence_start(text: str, at: int) -> bool:
    while at and _BLANK.match(text, at - 1):
        at -= 1
    return not at or text[at - 1] in ".!?"


class Candidate(NamedTuple):
    """A run of capitalised words after peeling, and where it stands."""

    text: str
    start: int
    value: str
    words: list[str]

    @property
    def end(self) -> int:
        return self.start + len(self.value)


def _lettered(run: str, r: dict) -> bool:
    """An item like "Punto G." or "I. Que": an initial beside a word that heads items or opens sentences."""
    words = run.split()
    return any(r["initial"].fullmatch(w) for w in words) and any(w.lower() in r["lettered"] or w.lower() in r["stop"] for w in words)


def _peeled(run: str, start: int, r: dict) -> tuple[str, int]:
    """The run without labels, titles, headings, bodies and particles in front, as long as there are any."""
    at = 0
    while m := next((m for rule in r["peel"] if (m := rule.match(run, at))), None):
        at = m.end()
    return run[at:], start + at


# what a candidate must pass, beside being no lettered item
CHECKS = (
    lambda c, r: sum(w not in r["particles"] for w in c.words) >= 2,
    lambda c, r: not r["caps"].match(c.value),
    lambda c, r: not (any(w.lower() in r["stop"] for w in c.words) and _sentence_start(c.text, c.start)),
    lambda c, r: not (c.start and r["attached"].match(c.text, c.start - 1)),
)


def _is_label(c: Candidate, r: dict) -> bool:
    """A field name: it opens its line and a colon follows."""
    return c.text[c.end : c.end + 1] == ":" and bool(r["line_start"].search(c.text[max(0, c.start - 40) : c.start]))


def names(text: str, languages: tuple[str, ...] = DEFAULT) -> list[Found]:
    """Runs of two to six capitalised words that pass CHECKS; "Surname, Given" is one name, given name first."""
    r = _rules(languages)
    out = []
    for m in r["name"].finditer(text):
        if " " not in m[0] and "\t" not in m[0] or _lettered(m[0], r):
            continue
        value, start = _peeled(m[0], m.start(), r)
        c = Candidate(text, start, value, value.split())
        if not all(check(c, r) for check in CHECKS):
            continue
        given = None if r["not_given"].match(text, c.end) else r["given"].match(text, c.end)
        if given:
            out.append((c.start, given.end(), f"{given[1]} {value}", 0.6))
        elif not _is_label(c, r):
            out.append((c.start, c.end, value, 0.6))
    return out


# Openings of letters and forms of address.
SALUTATIONS = [
    "Ola", "Hola", "Hi", "Hello", "Hey", "Dear", "Querido", "Querida", "Benquerido", "Benquerida", "Estimado", "Estimada", "Bos días",
    "Bo día", "Boas tardes", "Buenos días", "Buenas tardes", "Good morning",
]
ADDRESSED = [
    r"Sra\.", r"Srta\.", r"Sr\.", r"Dra\.", r"Dr\.", "Dª", r"D\.ª", r"D\.", r"Mrs\.?", r"Mr\.?", r"Ms\.?", r"Dr(?=[ \t])", "señor", "señora",
    "señorita", "Señor", "Señora", "don", "doña", "dona", "Don", "Doña", "Dona",
]
_ONE = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_RUN = rf"{_ONE}(?:{WS}+(?:(?:de|del|da|do|dos|das|la|y|e){WS}+)?{_ONE}){{0,3}}"
_GREETED = regex.compile(rf"(?<!\p{{L}})(?:{_alt(SALUTATIONS)})(?:{WS}+(?:{_alt(ADDRESSED)}))?{WS}+({_RUN})(?={WS}*(?:[,:;!\n]|\Z))")
_TITLED = regex.compile(rf"(?<!\p{{L}})(?:{_alt(ADDRESSED)}){WS}+({_RUN})")
WORD = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}{2,}(?:-\p{Lu}\p{Ll}+)?(?![\p{L}\p{N}])"


def addressed_names(text: str, languages: tuple[str, ...] = DEFAULT) -> list[Found]:
    excluded = _rules(languages)["excluded"]
    out: dict[tuple[int, int], Found] = {}
    for rule in (_GREETED, _TITLED):
        for m in rule.finditer(text):
            if m[1].split()[0].lower() not in excluded:
                out.setdefault(m.span(1), (*m.span(1), m[1], 0.6))
    return list(out.values())


def strip_accents(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")


@lru_cache(maxsize=1)
def _skipped() -> frozenset:
    words = [w for p in LEXICON["name_particles"] for w in p.split()] + ["D.", "Dª", "D.ª", "Sr.", "Sra.", "Srta.", "Don", "Doña"]
    return frozenset(strip_accents(w).lower().removesuffix(".") for w in words)


def name_tokens(name: str) -> frozenset:
    """The words of a name that tell people apart, without accents, case or final dots."""
    return frozenset(t for w in name.split() if (t := strip_accents(w).lower().removesuffix(".")) and t not in _skipped())


def cluster_names(found: list[str]) -> dict[str, str]:
    """Canonical spelling of every name: the longest, then first, of those linked through shared words.

    Two names are linked if the words of one, two at least, are all words of the other.
    """
    names_ = list(dict.fromkeys(found))
    words = [name_tokens(n) for n in names_]
    group = list(range(len(names_)))
    by_word: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for t in w:
            by_word.setdefault(t, []).append(i)

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, w in enumerate(words):
        if len(w) >= 2:
            rarest = min(w, key=lambda t: len(by_word[t]))
            for j in by_word[rarest]:
                if w <= words[j]:
                    group[root(i)] = root(j)
    members: dict[int, list[int]] = {}
    for i in range(len(names_)):
        members.setdefault(root(i), []).append(i)
    return {names_[i]: names_[min(g, key=lambda k: (-len(names_[k]), k))] for g in members.values() for i in g}
