"""Secret scans: fixed shapes, and random strings told from identifiers by character Markov models.

Two first-order Markov models over the characters of strings (letters in both cases, digits and a few signs, with a
state for start and end) are trained from labelled samples: random strings drawn from the usual alphabets of keys,
and ordinary identifiers. Candidates are all runs of at least LEAST such characters, cut at slashes. The evidence of a candidate is its whole log-likelihood ratio, so longer
strings may be less striking a character; it is a secret where the evidence passes a limit: odds of 1 to FALSE at
least, and more where that is what keeps out all but FALSE of the identifiers made of words that training has not
seen. Neighbours on both sides of a slash that are random too are part of the same secret, so a key with slashes
stays whole and a key at the end of a path is found.

The model is one of strings of LEAST = 12 characters or more: both kinds of samples are, and below that too few keys
reach the limit. Shorter runs are no candidates.

Base spans come from fixed shapes and always stay; model spans are added where they overlap none of them.

Defined results: null counts as empty and has no spans; offsets are code points, ends are exclusive; ids pass as
they are, null ones too; repeated rows give the same spans; an empty table gives an empty result; other columns are
ignored; every whole text is scanned in one pass.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
LEAST = 12
#: Every run is scored, whatever its characters; the model alone decides.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_=-]{12,}")
FALSE = 0.001
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# The words that the ordinary samples are made of.
WORDS = (
    "abort access account action active add address admin after agent alias all allow any api append apply archive area array async attach "
    "auth auto back balance base batch before begin binary block board body boot bound branch break bridge buffer build bulk bundle button "
    "cache call cancel card cart case cell chain change channel check child clear client clock close cloud cluster code column command "
    "commit common compare config connect content context copy core count create current cursor data date debug decode default delete "
    "delta depth detail device direct disk display document domain download draft drive edge edit email empty enable encode end engine "
    "entry error event exit export factory field file filter final find first flag flush font form format frame from function gateway get "
    "global graph group handle header health hidden home host image import index info init input insert install item job join kernel key"
).split()


def random_samples(n: int = 4000, seed: int = 7) -> list[str]:
    """Strings labelled random: uniform draws from the alphabets that keys use."""
    draw = random.Random(seed)
    hexes, letters = "0123456789abcdef", LETTERS[:62]
    kinds = (letters, letters + "+", letters + "-_", hexes, letters[26:], letters[:26] + letters[52:])
    return ["".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(LEAST, 48))) for i in range(n)]


def identifier_samples(n: int = 6000, seed: int = 11, words: list[str] = WORDS[1::2]) -> list[str]:
    """Strings labelled ordinary: words, joined as identifiers, options, versions and dates are."""
    draw = random.Random(seed)
    out = []
    while len(out) < n:
        parts = draw.choices(words, k=draw.randint(2, 6))
        number = str(draw.randint(0, 99999))
        year = f"{draw.randint(1970, 2030)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}"
        style = len(out) % 10
        if style == 0:
            one = "_".join(parts) + draw.choice(["", number])
        elif style == 1:
            one = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 2:
            one = "-".join([*parts, number])
        elif style == 3:
            one = f"{'-'.join(parts)}-{year}"
        elif style == 4:
            one = "_".join(parts).upper() + draw.choice(["", f"_{number}"])
        elif style == 5:
            one = "".join(p.title() for p in parts) + number
        elif style == 6:
            one = f"{parts[0]}{number}{parts[1]}_{draw.randint(0, 99)}"
        elif style == 7:
            one = f"{year}-{parts[0]}-{number}{number}"
        elif style == 8:
            one = f"{year}T{draw.randint(0, 23):02d}{draw.choice(['', number])}"
        else:
            one = f"{parts[0]}={draw.randint(10**8, 10**14)}"
        if len(one) >= LEAST:
            out.append(one)
    return out


class Markov:
    """Log-likelihood ratio of the two models per transition."""

    def __init__(self, ratio: np.ndarray, limit: float):
        self.ratio, self.limit = ratio, limit
        self.code = np.zeros(128, np.int64)
        for i, c in enumerate(LETTERS):
            self.code[ord(c)] = i

    @staticmethod
    def _logs(samples: list[str]) -> np.ndarray:
        """Log probability of each next character: half from pairs of characters, half from the kinds of both.

        The half from kinds speaks for words that no sample has; signs and the end are kinds of their own.
        """
        size = len(LETTERS) + 1  # the last state is both start and end
        kind = np.array([0] * 26 + [1] * 26 + [2] * 10 + list(range(3, 3 + size - 62)))
        counts = np.zeros((size, size))
        place = {c: i for i, c in enumerate(LETTERS)}
        for s in samples:
            path = np.array([size - 1, *(place[c] for c in s), size - 1])
            np.add.at(counts, (path[:-1], path[1:]), 1)
        kinds = np.zeros((kind.max() + 1, kind.max() + 1))
        np.add.at(kinds, (kind[:, None], kind[None, :]), counts)
        kinds = (kinds + 0.5) / (kinds + 0.5).sum(1, keepdims=True)
        own = counts.sum(0) + 1
        within = own / np.bincount(kind, own)[kind]
        pairs = (counts + 0.01) / (counts + 0.01).sum(1, keepdims=True)
        return np.log(0.5 * pairs + 0.5 * kinds[kind][:, kind] * within)

    @classmethod
    def trained(
        cls, random_strings: list[str] | None = None, identifiers: list[str] | None = None, unseen: list[str] | None = None, false: float = FALSE
    ) -> Markov:
        """The limit is chosen on `unseen`, made of words that `identifiers` do not have."""
        random_strings = random_samples() if random_strings is None else random_strings
        identifiers = identifier_samples() if identifiers is None else identifiers
        unseen = identifier_samples(6000, 12, WORDS[::2]) if unseen is None else unseen
        model = cls(cls._logs(random_strings) - cls._logs(identifiers), 0.0)
        plain = np.sort([model.evidence(s) for s in unseen])
        model.limit = max(-math.log(false), float(plain[min(len(plain) - 1, math.ceil(len(plain) * (1 - false)))]))
        return model

    def evidence(self, s: str) -> float:
        """Log-likelihood ratio of random against ordinary."""
        path = self.code[np.frombuffer(s.encode("ascii"), np.uint8)]
        end = len(LETTERS)
        return float(self.ratio[np.r_[end, path], np.r_[path, end]].sum())

    def is_random(self, s: str) -> bool:
        return self.evidence(s) > self.limit


_SEGMENT = re.compile(r"[A-Za-z0-9+_=-]+")


def _grown(text: str, a: int, b: int, model: Markov) -> tuple[int, int]:
    """The span with the neighbours across slashes that speak for random strings as well."""
    while a >= 2 and text[a - 1] == "/":
        at = a - 1
        while at and _SEGMENT.match(text[at - 1]):
            at -= 1
        if at == a - 1 or model.evidence(text[at : a - 1]) <= 0:
            break
        a = at
    while text[b : b + 1] == "/":
        more = _SEGMENT.match(text, b + 1)
        if not more or model.evidence(more[0]) <= 0:
            break
        b = more.end()
    return a, b


def all_spans(text: str, model: Markov, base: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int, str]]:
    base = base_spans(text) if base is None else base
    taken = sorted((a, b) for a, b, _ in base)
    added: list[tuple[int, int, str]] = []
    for m in CANDIDATE.finditer(text):
        if added and m.start() < added[-1][1] or not model.is_random(m[0]):
            continue
        a, b = _grown(text, *m.span(), model)
        near = bisect.bisect_left(taken, (b,))
        if not any(e > a for _, e in taken[max(0, near - len(KINDS)) : near]):  # a kind's own spans do not overlap
            added.append((a, b, "markov"))
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if added else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("found", T.ArrayType(T.StringType())),
    ]
)


def secret_scan(docs: DataFrame, model: Markov | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every row: one pass, no shuffle. `found` holds the matched strings."""
    model = model or Markov.trained()
    ratio, limit = model.ratio, model.limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Markov(ratio, limit)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = all_spans(text, own, base)
                n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*n, digest, joined(spans), [text[a:b] for a, b, _ in spans]))
            types = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.list_(pa.string())]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], OUT.names)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(run, OUT)
