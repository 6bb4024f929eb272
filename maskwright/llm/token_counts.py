"""Exact token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; each batch holds its distinct pre-tokens as one flat array of symbols with row
bounds. A round finds every row's lowest-rank adjacent pair and merges all its occurrences at once; rows without
a known pair are done. The number of symbols left is the number of tokens. Counts of pre-tokens already seen by a
worker are looked up; that memory is emptied when it is full, which costs time and no result.

Defined results: null counts as empty, an empty text has no tokens, special strings inside a text count as one
token each (the library's default), ids pass as they are, null ones too, repeated rows are counted alike, an empty
table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The pattern that cuts texts into pre-tokens in the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY = 400_000
CHUNK = 20_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    letters.update({chr(256 + i): b for i, b in enumerate(rest)})
    return letters


class RankMerger:
    """Counts the symbols that are left of byte strings after all merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.width = len(vocab) + 1
        self.byte_id = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.byte_id[byte] = vocab[letter]
        keys, made = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] * self.width + vocab[b])
            made.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pairs = np.array(keys, np.int64)[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array(made, np.int64)
        self.none = len(keys)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; words are merged in chunks of bounded size."""
        out = np.zeros(len(words), np.int64)
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or (end - at < CHUNK and size + len(words[end]) <= 1 << 20)):
                size += len(words[end])
                end += 1
            out[at:end] = self._merge(words[at:end])
            at = end
        return out

    def _merge(self, words: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        row = np.repeat(np.arange(len(words)), lengths)
        done = np.zeros(len(words), np.int64)
        while len(symbols):
            pair = symbols[:-1] * self.width + symbols[1:]
            pair[row[:-1] != row[1:]] = -1
            found = np.searchsorted(self.pairs, pair)
            found[found == self.none] = 0
            rank = np.where(self.pairs[found] == pair, self.ranks[found], self.none)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(np.r_[rank, self.none], first)
            size = np.diff(np.r_[first, len(row)])
            finished = best == self.none
            done[row[first[finished]]] = size[finished]
            hit = np.r_[rank == np.repeat(best, size)[:-1], False]
            hit &= np.repeat(~finished, size)
            # runs of the same symbol: of overlapping hits every second one merges
            index = np.flatnonzero(hit)
            if len(index) > 1:
                joined = np.r_[False, (np.diff(index) == 1)]
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(index))))
                index = index[(np.arange(len(index)) - start) % 2 == 0]
            symbols[index] = self.made[rank[index]]
            keep = np.repeat(~finished, size)
            keep[index + 1] = False
            symbols, row = symbols[keep], row[keep]
        return done


class TokenCounter:
    """Token counts of whole texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        import regex

        self.merger = RankMerger(path)
        self.find = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, self.merger.specials))) if self.merger.specials else None
        self.known: dict[str, int] = {}

    def _pre_tokens(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not any(s in text for s in self.merger.specials):
            return self.find(text), 0
        pieces = self.special.split(text)
        return [w for piece in pieces for w in self.find(piece)], len(pieces) - 1

    def count(self, texts: list[str]) -> list[int]:
        out = []
        at = 0
        while at < len(texts):  # some texts at a time, so that pre-tokens in memory stay bounded
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= 1 << 20):
                group.append(self._pre_tokens(texts[at]))
                size += len(texts[at])
                at += 1
            known = self.known
            new = {w for words, _ in group for w in words if w not in known}
            if new:
                if len(known) + len(new) > MEMORY:
                    known.clear()
                    new = {w for words, _ in group for w in words}
                listed = list(new)
                known.update(zip(listed, self.merger.counts([w.encode("utf-8") for w in listed]).tolist()))
            look = known.__getitem__
            out.extend(sum(map(look, words)) + extra for words, extra in group)
        return out


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = np.array(counter.count(texts), np.int64)
            sizes = np.array([len(t.encode("utf-8")) for t in texts], np.int64)
            # the ids stay Arrow columns: a null beside them must not turn them into floats
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(n), pa.array(n > limit)], OUT.names)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(run, OUT)
