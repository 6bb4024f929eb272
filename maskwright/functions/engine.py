"""The detectors of one text in Python, for the fused pass over many documents.

The patterns are the ones of the column detectors; a fused pass reads every text once, where some twenty nested
column expressions would each scan it again and take longer to plan than most inputs take to process.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import regex

from maskwright.functions import checks
from maskwright.functions import detectors as D
from maskwright.functions import names as N
from maskwright.functions.lexicon import AMBIGUOUS_PLACES, PLACES
from maskwright.functions.packs import lexicon_of
from maskwright.functions.patterns import python as compiled
from maskwright.functions.spans import RUNG


class Span(NamedTuple):
    start: int
    end: int
    category: str
    text: str
    confidence: float
    source: str
    rung: float
    pack: str | None
    enabled: bool = True
    shield: bool = False


def _hits(pattern: str, text: str, group: int = 0) -> list[tuple[int, int, str]]:
    return [(*m.span(group), m[group]) for m in compiled(pattern).finditer(text) if m[group] is not None]


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _some_digits(text: str, least: int) -> bool:
    return sum(map(text.count, "0123456789")) >= least


def _needs_digits(least: int, detector):
    """The detector, left out where a text has too few digits for any of its spans."""
    return lambda text: detector(text) if _some_digits(text, least) else []


def _balance(hit: tuple[int, int, str]) -> tuple[int, int, str]:
    a, b, t = hit
    if t.startswith("(") != t.endswith(")"):
        return (a + 1, b, t[1:]) if t.startswith("(") else (a, b - 1, t[:-1])
    return hit


def _clear(hits: list, taken: list) -> list:
    """The hits that overlap none of the taken ones, which are sorted and apart."""
    starts = [t[0] for t in taken]

    def free(h) -> bool:
        at = bisect_left(starts, h[1])
        return at == 0 or taken[at - 1][1] <= h[0]

    return [h for h in hits if free(h)]


_PLAIN_START = regex.compile(r"(?:[^\\\[(?*+{|]|\\[./])+")


def _cue(patterns, before: str = ""):
    """Whether a text has the literal beginning of any pattern at the start of a word: one pass, no backtracking."""
    starts = {m[0].replace("\\", "") for p in patterns if (m := _PLAIN_START.match(p))}
    begins = ahocorasick.Automaton()
    for word in starts:
        begins.add_word(before + word, len(before + word))
    if not starts:
        return lambda text: False
    begins.make_automaton()

    def found(text: str) -> bool:
        for at, n in begins.iter(text):
            prior = text[at - n] if at >= n else " "
            if before or not (prior.isascii() and prior.isalnum()):
                return True
        return False

    return found


_in_street = _cue([c + s[1:] for s in D.STREETS for c in (s[0].upper(), s[0].lower())])


def _money(text: str) -> list:
    low = text.lower()
    worded = any(w in low for w in D.CURRENCY_WORDS)
    figures = [_balance(x) for x in _hits(D.MONEY, text)] if worded or any(c in text for c in D.CURRENCIES) else []
    written = [_balance(x) for x in _hits(D.MONEY_WORDS, text)] if worded else []
    return figures + _clear(written, figures)


def _address(text: str) -> list:
    streets = _hits(D.ADDRESS, text, 1) if _in_street(text) else []
    if not _some_digits(text, 1):
        return streets
    us = _hits(D.US_ADDRESS, text)
    return streets + us + _clear(_hits(D.UK_ADDRESS, text), us) + _hits(D.POSTCODE_PLACE, text) + _hits(D.POSTCODE_LABEL, text, 1)


def _cards(text: str) -> list:
    return [h for h in _hits(D.CARD, text) if 13 <= len(_digits(h[2])) <= 19 and checks.luhn(_digits(h[2]))]


def _phones(text: str) -> list:
    return [h for h in _hits(D.PHONE, text) if 9 <= len(_digits(h[2])) <= 15]


_AMBIGUOUS = {p.lower() for p in AMBIGUOUS_PLACES}
_FOLLOWED = compiled(r"\s+\p{Lu}\p{L}+")


@lru_cache(maxsize=8)
def _gazetteer(places: tuple[str, ...]) -> tuple[ahocorasick.Automaton, regex.Pattern]:
    """All places in small letters, and the pattern of whole ones."""
    found = ahocorasick.Automaton()
    for place in places:
        found.add_word(place.lower(), len(place))
    if places:
        found.make_automaton()
    return found, compiled(D.place_pattern(places))


def _locations(text: str, places: tuple[str, ...]) -> list:
    """Places of the gazetteer, whole words in any case; one pass finds where any of them may begin."""
    begins, pattern = _gazetteer(places)
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form has another length
        hits = [(*m.span(), m[0]) for m in pattern.finditer(text)]
    else:
        hits, end = [], 0
        for start in sorted({at - n + 1 for at, n in begins.iter(low)} if places else ()):
            if start >= end and (m := pattern.match(text, start)):
                hits.append((*m.span(), m[0]))
                end = m.end()

    def stands(h) -> bool:
        if h[2].lower() not in _AMBIGUOUS:
            return True
        return bool(compiled(D.GEO_CUE).search(text[max(0, h[0] - 32) : h[0]])) and not _FOLLOWED.match(text, h[1])

    return [h for h in hits if stands(h)]


_ID_CUES = ("afiliación", "colegiad", "expediente", "referencia", "ref.", "matrícula", "nuss", "historia", "protocolo", "núm.", "nº")


def _id_codes(text: str) -> list:
    low = text.lower()
    if not any(cue in low for cue in _ID_CUES):
        return []
    return [h for h in _hits(D.ID_CODE, text, 1) if not (h[2].isdigit() and len(h[2]) <= 2)]


def _shields(lexicon: dict):
    kinds = [(_cue(lexicon[k]), p) for k, p in zip(("legal_heads", "titles", "institutions"), D.shield_patterns(lexicon))]
    return lambda text: [h for has, p in kinds if has(text) for h in _hits(p, text)]


_in_address = _cue(N.SALUTATIONS + N.ADDRESSED)


_MASK_RUN = regex.compile("[*xX•_]{2,}")
_MASK_TOKEN = regex.compile("[0-9A-Za-z*•_]*")
_MASK_BEFORE = regex.compile("(?r)[0-9A-Za-z*•_]*")


def _masked_ids(text: str) -> list:
    """Whole tokens around a run of mask signs."""
    out, end = [], 0
    for run in _MASK_RUN.finditer(text):
        if run.start() >= end:
            start = _MASK_BEFORE.match(text, 0, run.start()).start()
            end = _MASK_TOKEN.match(text, run.start()).end()
            if len(regex.sub("[*xX•_]", "", text[start:end])) >= 4:
                out.append((start, end, text[start:end]))
    return out


def _companies(lexicon: dict):
    runs, form, opening = D.company_patterns(lexicon)
    whole = compiled(form)
    has_form = [_cue(lexicon["company_suffixes"], blank) for blank in " \t"]
    has_opening = _cue(lexicon["company_prefixes"])

    def run(text: str) -> list:
        found = []
        if any(has(text) for has in has_form):
            for a, b, t in _hits(runs, text):
                end = max((m.end() for m in whole.finditer(t + text[b : b + 1])), default=0)
                if end:
                    found.append((a, a + end, t[:end]))
        return found + (_hits(opening, text) if has_opening(text) else [])

    return run


def _identity(pattern: str, category: str, text: str) -> list[Span]:
    out = []
    for a, b, t in _hits(pattern, text):
        kind = checks.identity_kind(t)
        if kind and kind[1]:
            out.append(Span(a, b, category, t, 1.0, "regex", RUNG["VALIDATED_REGEX"], "ES"))
        elif kind:
            lead = text[max(0, a - D.LOOK_BACK) : a]
            if lead[-1:] not in tuple("/=&?#"):
                sure = 0.9 if compiled(D.ID_LABEL).search(lead) else 0.5
                out.append(Span(a, b, "INVALID_ID", t, sure, "regex", RUNG["INVALID_ID"], "ES"))
    return out


def _pt_nif(text: str) -> list[Span]:
    out = []
    for a, b, t in _hits(D.PT_NIF, text):
        labelled = bool(compiled(D.PT_NIF_LABEL).search(text[max(0, a - 24) : a]))
        if checks.nif_pt(_digits(t)) and (labelled or (t.isdigit() and t[0] in "13568")):
            out.append(Span(a, b, "NIF", t, 1.0 if labelled else 0.8, "regex", RUNG["VALIDATED_REGEX"], "PT"))
    return out


def _pt_address(text: str) -> list:
    streets = [(a, a + len(t.rstrip(" ,.\t")), t.rstrip(" ,.\t")) for a, _, t in _hits(D.PT_STREET, text, 1)]
    return streets + _hits(D.PT_POSTCODE, text)


def _plain(category: str, rung: str, pack: str | None, find, confidence: float = 1.0, enabled: bool = True, shield: bool = False):
    def run(text: str) -> list[Span]:
        return [Span(h[0], h[1], category, h[2], h[3] if len(h) > 3 else confidence, "regex", RUNG[rung], pack, enabled, shield) for h in find(text)]

    return run


def _either(*patterns: str):
    return lambda text: [h for p in patterns for h in _hits(p, text)]


# (categories, detector), in the order that settles ties
COMMON = [
    (("SHIELD",), _plain("SHIELD", "SHIELD", "common", _needs_digits(6, _either(D.DATE_TIME)), shield=True)),
    (("EMAIL",), _plain("EMAIL", "VALIDATED_REGEX", "common", _either(D.EMAIL))),
    (("IBAN",), _plain("IBAN", "VALIDATED_REGEX", "common", _needs_digits(2, N.ibans))),
    (("CREDIT_CARD",), _plain("CREDIT_CARD", "VALIDATED_REGEX", "common", _needs_digits(13, _cards))),
    (("MONEY",), _plain("MONEY", "MONEY", "common", _money)),
    (("VAT_NUMBER",), _plain("VAT_NUMBER", "ID_CODE", "common", _needs_digits(2, N.vat_numbers))),
]
COUNTRY = {
    "ES": [
        (("DNI", "INVALID_ID"), lambda t: _identity(D.DNI, "DNI", t)),
        (("NIE", "INVALID_ID"), lambda t: _identity(D.NIE, "NIE", t)),
        (("MASKED_ID",), _plain("MASKED_ID", "VALIDATED_REGEX", "ES", _masked_ids)),
        (("ID_CODE",), _plain("ID_CODE", "ID_CODE", "ES", _id_codes)),
        (("PHONE",), _plain("PHONE", "VALIDATED_REGEX", "ES", _needs_digits(9, _phones))),
        (("ADDRESS",), _plain("ADDRESS", "ADDRESS", "ES", _address)),
    ],
    "PT": [
        (("NIF",), _pt_nif),
        (("CARTAO_CIDADAO",), _plain("CARTAO_CIDADAO", "VALIDATED_REGEX", "PT", lambda t: [h for h in _hits(D.PT_CARD, t) if checks.citizen_card_pt(h[2])])),
        (("PHONE",), _plain("PHONE", "VALIDATED_REGEX", "PT", _either(D.PT_PHONE))),
        (("ADDRESS",), _plain("ADDRESS", "ADDRESS", "PT", _pt_address)),
    ],
}


def _language(languages: tuple[str, ...]) -> list:
    """The detectors of all languages that have a pack, over their lists together."""
    lexicon = lexicon_of(languages)
    excluded = frozenset(lexicon["acronym_exclusions"])
    acronyms = lambda t: [h for h in _hits(D.ACRONYM, t) if h[2] not in excluded]
    return [
        ("SHIELD", _plain("SHIELD", "SHIELD", None, _shields(lexicon), shield=True)),
        ("COMPANY", _plain("COMPANY", "COMPANY", None, _companies(lexicon))),
        ("NAME", _plain("NAME", "NAME", None, lambda t: N.names(t, languages))),
        ("NAME", _plain("NAME", "NAME", None, lambda t: N.addressed_names(t, languages) if _in_address(t) else [])),
        ("COMPANY_ACRONYM", _plain("COMPANY", "COMPANY_ACRONYM", None, acronyms, 0.4, enabled=False)),
    ]


def arbitrate(spans: list[Span]) -> list[Span]:
    """Winners by rung, length, start and order of production, sorted by start."""
    rank = sorted(range(len(spans)), key=lambda i: (spans[i].rung, spans[i].start - spans[i].end, spans[i].start, i))
    kept: list[tuple[int, int, int]] = []
    for i in rank:
        s = spans[i]
        at = bisect_left(kept, (s.start,))
        if (at == 0 or kept[at - 1][1] <= s.start) and (at == len(kept) or kept[at][0] >= s.end):
            insort(kept, (s.start, s.end, i))
    return [spans[i] for _, _, i in kept]


@dataclass
class Engine:
    """Detection with a profile, switches and rules; built once per task."""

    languages: tuple[str, ...] = ("es", "en")
    jurisdictions: tuple[str, ...] = ("ES",)
    settings: dict[str, bool] = field(default_factory=dict)
    rules: list[dict] = field(default_factory=list)
    places: tuple[str, ...] = tuple(PLACES)

    def __post_init__(self) -> None:
        languages = tuple(self.languages)
        packed = lexicon_of(languages) is not None
        places = tuple(self.places)
        plan = [*COMMON, (("LOCATION",), _plain("LOCATION", "LOCATION", "common", lambda t: _locations(t, places), 0.9))]
        for country in dict.fromkeys(self.jurisdictions):
            plan += COUNTRY.get(country, [])
        if "ES" not in self.jurisdictions:  # a number whose check fits is evidence anywhere
            plan.append((("DNI",), lambda t: [s for s in _identity(D.DNI, "DNI", t) if s.category == "DNI"]))
            plan.append((("NIE",), lambda t: [s for s in _identity(D.NIE, "NIE", t) if s.category == "NIE"]))
        self.plan = []
        for categories, detector in plan:
            on = {c for c in categories if self.on(c)}
            if on:
                self.plan.append((detector, on if len(on) < len(categories) else None))
        for switch, detector in _language(languages) if packed else ():
            if self.on(switch) and (switch != "COMPANY_ACRONYM" or self.on("COMPANY")):
                self.plan.append((detector, None))
        self.propagates = packed and self.on("NAME")
        self.excluded = N._rules(languages)["excluded"] if packed else frozenset()
        self.terms = []
        for r in self.rules:
            literal = regex.escape(r["term_or_pattern"], special_only=True)
            category = r.get("target_category") if r.get("replacement_type") == "CATEGORY" and r.get("target_category") else "CUSTOM"
            if self.on(category):
                self.terms.append((regex.compile(r["term_or_pattern"] if r.get("is_regex") else literal), category))

    def on(self, category: str) -> bool:
        """Switches default to on; shields cannot be switched off."""
        return category == "SHIELD" or self.settings.get(category, True)

    def candidates(self, text: str) -> list[Span]:
        out = [
            Span(*m.span(), category, m[0], 1.0, "dictionary", RUNG["DICTIONARY"], None)
            for term, category in self.terms
            for m in term.finditer(text)
            if m[0]
        ]
        for detector, only in self.plan:
            found = detector(text)
            out += found if only is None else [s for s in found if s.category in only]
        return out

    def later_mentions(self, text: str, winners: list[Span]) -> list[Span]:
        """Words of accepted names that stand elsewhere in the text."""
        people = [s for s in winners if s.category == "NAME" and not s.shield]
        if not people:
            return []
        word = compiled(N.WORD)
        known = {w for s in people for w in word.findall(text[s.start : s.end]) if w.lower() not in self.excluded}
        starts = [s.start for s in people]
        out = []
        for m in word.finditer(text) if known else ():
            if m[0] not in known:
                continue
            at = bisect_right(starts, m.start()) - 1
            if not (at >= 0 and m.start() < people[at].end):
                out.append(Span(*m.span(), "NAME", m[0], 0.5, "regex", RUNG["NAME"], None))
        return out

    def detect(self, text: str, manual: list[Span] | None = None) -> list[Span]:
        """Winners of both phases, shields included."""
        found = (manual or []) + self.candidates(text)
        winners = arbitrate(found)
        more = self.later_mentions(text, winners) if self.propagates else []
        return arbitrate(found + more) if more else winners


def mappings(text: str, spans: list[Span]) -> list[dict]:
    """Mappings of sorted winners: the first span of a text, or of a person, names it; numbers count per category."""
    real = [s for s in spans if not s.shield]
    one = N.cluster_names([s.text for s in real if s.category == "NAME"])
    spelled: dict[str, list[str]] = {}
    for spelling, canonical in one.items():
        spelled.setdefault(canonical, []).append(spelling)
    by_key: dict[str, dict] = {}
    count: dict[str, int] = {}
    for s in real:
        key = one.get(s.text, s.text) if s.category == "NAME" else s.text
        m = by_key.get(key)
        if m is None:
            n = count[s.category] = count.get(s.category, 0) + 1
            spellings = sorted(spelled[key], key=len, reverse=True) if s.category == "NAME" else []
            m = by_key[key] = {
                "id": f"{s.category}_{n}", "original_text": key, "placeholder": f"[[{s.category}_{n:03d}]]", "category": s.category,
                "confidence": s.confidence, "source": s.source, "enabled": s.enabled, "variants": spellings or [key], "occurrences": [],
            }
        surface = text[s.start : s.end]
        if surface not in m["variants"]:
            m["variants"].append(surface)
        m["occurrences"].append({"start": s.start, "end": s.end, "text": surface})
    return list(by_key.values())


def apply(text: str, found: list[dict], put=lambda m: m["placeholder"]) -> str:
    """text with the enabled mappings in place; occurrences whose text has changed are left alone."""
    spots = sorted((o["start"], o["end"], o["text"], put(m)) for m in found if m["enabled"] for o in m["occurrences"])
    parts, at = [], 0
    for a, b, was, new in spots:
        if a >= at and text[a:b] == was:
            parts += [text[at:a], new]
            at = b
    return "".join([*parts, text[at:]])


_TOKEN = regex.compile(r"\[{1,2}[^\]\[\r\n]{1,200}\]{1,2}")
_KNOWN_SHAPE = regex.compile(r"\[\[(?:V1_|[A-Za-z][A-Za-z0-9_]*_[0-9])")
_LIKE = regex.compile(r"\[.*(?:V1_|[A-Z]+[_ ][0-9])")
_OPEN = regex.compile(r"\[\[(?:V1_|[A-Z][A-Z0-9_]*_[0-9])[^\]\r\n]*(?:\Z|\r?\n)")


def token_key(inner: str) -> str:
    """What a token's spellings have in common: case, separators and leading zeros do not count."""
    head, _, number = regex.sub(r"[\s_]+", "_", inner).rpartition("_")
    return f"{head.lower()}_{int(number)}" if number.isascii() and number.isdigit() else ""


def restore(response: str, found: list[dict], tolerant: bool = True, legacy: bool = True) -> dict:
    """Originals back in place of tokens, and a report. Restored text is not searched again."""
    live = [m for m in found if m["enabled"] and (legacy or m["placeholder"].startswith("[[V1_"))]
    table: dict[str, set] = {}
    for m in live:
        key = token_key(m["placeholder"][2:-2]) if tolerant else m["placeholder"]
        table.setdefault(key, set()).add((m["placeholder"], m["original_text"]))
    report: dict = {"restored": 0, "unknown": [], "ambiguous": [], "malformed": [m[0].rstrip() for m in _OPEN.finditer(response)]}

    def put(m) -> str:
        token = m[0]
        hits = table.get(token_key(token.strip("[]")) if tolerant else token, set())
        if len(hits) > 1:
            report["ambiguous"].append(token)
        elif hits:
            report["restored"] += 1
            return next(iter(hits))[1]
        elif _KNOWN_SHAPE.match(token):
            report["unknown"].append(token)
        elif _LIKE.match(token):
            report["malformed"].append(token)
        return token

    return {"text": _TOKEN.sub(put, response), **report}
