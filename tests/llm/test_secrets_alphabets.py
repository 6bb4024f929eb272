"""Keys of every alphabet are judged by the model alone; added spans against a ratio worked out again."""

from __future__ import annotations

import math
import random
import re
import string

import pytest

from maskwright.llm import secrets

MODEL = secrets.Markov.trained()
HEX, LETTERS = "0123456789abcdef", string.ascii_letters


@pytest.mark.parametrize(
    ("alphabet", "size", "least"),
    [
        (string.ascii_lowercase, 16, 0.66), (string.ascii_lowercase, 32, 0.9), (string.ascii_uppercase, 16, 0.88), (string.ascii_uppercase, 32, 0.96),
        (LETTERS + string.digits, 16, 0.97), (LETTERS + string.digits, 32, 0.99), (HEX, 20, 0.94), (LETTERS, 20, 0.97),
    ],
)
def test_keys_of_an_alphabet(alphabet, size, least):
    draw = random.Random(3)
    keys = ["".join(draw.choices(alphabet, k=size)) for _ in range(400)]
    texts = [f"see {k} there" for k in keys]
    found = sum(any(kind == "markov" and t[a:b] == k for a, b, kind in secrets.all_spans(t, MODEL)) or bool(secrets.base_spans(t)) for t, k in zip(texts, keys))
    assert found >= least * len(keys)


def test_ordinary_words_and_headings_stay():
    draw = random.Random(4)
    words = secrets.WORDS[::2]  # not among the words of the training samples
    runs = ["".join(draw.choices(words, k=draw.randint(2, 4))) for _ in range(3000)]
    runs = [r for r in runs if len(r) >= secrets.LEAST]
    for shaped in (runs, [r.upper() for r in runs], [r.title() for r in runs]):
        assert sum(map(MODEL.is_random, shaped)) < 0.01 * len(shaped)


def test_added_spans_by_a_ratio_worked_out_again():
    """Runs without slashes: a span is added just where the sum of the transitions' ratios passes the limit."""
    draw = random.Random(5)
    place = {c: i for i, c in enumerate(secrets.LETTERS)}
    end = len(secrets.LETTERS)
    pieces = ["the", "configurationname", "QXZKWJVYPLMR", "a9f3k2m1q8z7", "transformations", "x" * 14, "short", "kqjxzvwypbgdf", "2021-03-04-backup"]
    for _ in range(200):
        text = " ".join(draw.choice(pieces) for _ in range(12))
        wanted = []
        for m in re.finditer(r"[A-Za-z0-9+_=-]+", text):
            path = [end, *(place[c] for c in m[0]), end]
            ratio = math.fsum(MODEL.ratio[a, b] for a, b in zip(path, path[1:]))
            if len(m[0]) >= secrets.LEAST and ratio > MODEL.limit:
                wanted.append((*m.span(), "markov"))
        assert [s for s in secrets.all_spans(text, MODEL) if s[2] == "markov"] == wanted
