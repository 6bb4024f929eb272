"""Ids of plain words under a lower-casing byte-level BPE with an end-of-word suffix, merged many words at a time.

Plain words have at most LONGEST bytes, characters below LIMIT only, no apostrophe (contractions are cut otherwise) and no `<|`
(special strings). No character below LIMIT composes with another, so each is lower-cased and classed by itself, as
the library says of it when a worker starts. A word is cut where the class changes and around digits. All words of a
batch lie in one flat array of symbols with row bounds; a round finds every row's lowest-rank adjacent pair and
merges all its occurrences, which is the library's order where a symbol's own merge comes before those that use it.
"""

from __future__ import annotations

import json

import numpy as np

from maskwright.llm.token_counts import byte_letters

#: The only pattern and normalizer whose cuts are known here; other vocabularies have no plain words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SUFFIX = "</w>"
LIMIT = 0x250
#: Longer words would take a round for every merge of the longest.
LONGEST = 64
LETTER, DIGIT, OTHER = 1, 2, 3
SLOTS = 18


class PlainWords:
    """`encode` gives the ids of those words that are plain, and says which are."""

    def __init__(self, tokenizer, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.usable = self._known(spec) and self._merges(spec["model"])
        if self.usable:
            self._characters(tokenizer)

    @staticmethod
    def _known(spec: dict) -> bool:
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        split, letters = [*cut.get("pretokenizers", []), {}, {}][:2]
        return (
            model["type"] == "BPE"
            and model["end_of_word_suffix"] == SUFFIX
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and (spec["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": PATTERN}, "Removed", True)
            and (letters.get("type"), letters.get("add_prefix_space"), letters.get("use_regex")) == ("ByteLevel", False, False)
            and len(cut["pretokenizers"]) == 2
            and all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        )

    def _merges(self, model: dict) -> bool:
        """The tables of symbols and pairs; whether rounds merge as the library does."""
        vocab = model["vocab"]
        letters = byte_letters()
        if not all(x in vocab and x + SUFFIX in vocab for x in letters):
            return False
        self.symbol = np.zeros((2, 256), np.int64)
        for letter, byte in letters.items():
            self.symbol[:, byte] = vocab[letter], vocab[letter + SUFFIX]
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in side], np.int64) for side in (*zip(*pairs), [a + b for a, b in pairs]))
        self.width = max(vocab.values()) + 1
        self.none = len(pairs)
        self.made = np.r_[made, 0]
        rank = np.arange(self.none)
        born = np.full(self.width, -1)
        born[made] = rank
        keys = left * self.width + right
        if len(np.unique(made)) < self.none or len(np.unique(keys)) < self.none or (np.maximum(born[left], born[right]) >= rank).any():
            return False
        # open addressing, at most one slot in five taken
        slots = 1 << max(SLOTS, (5 * self.none).bit_length())
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.slot_key = np.full(slots + 1024, -1, np.int64)
        self.slot_rank = np.full(slots + 1024, self.none, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slot_key[at] < 0
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], rank[put]
            keys, rank, at = (np.delete(x, put) for x in (keys, rank, at + 1))
        return True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.slot_key[at]
        ranks = self.slot_rank[at]
        astray = np.flatnonzero(held != keys)
        ranks[astray] = self.none
        astray = astray[held[astray] >= 0]
        at = at[astray]
        while len(astray):
            at = at + 1
            held = self.slot_key[at]
            hit = held == keys[astray]
            ranks[astray[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (held >= 0)
            astray, at = astray[on], at[on]
        return ranks

    def _characters(self, tokenizer) -> None:
        """For every character below LIMIT its lower case and class (0: not plain); LIMIT stands for all others."""
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str
        self.lower = np.zeros(LIMIT + 1, np.int64)
        self.kind = np.zeros(LIMIT + 1, np.int8)
        for c in range(LIMIT):
            low = tokenizer.normalizer.normalize_str(chr(c))
            if chr(c).isspace() or c == ord("'") or len(low) != 1 or ord(low) >= 0x800:
                continue
            letter, digit, other = (len(pieces(x)) for x in (f"a{low}a", low + low, f"!{low}!"))
            self.lower[c] = ord(low)
            self.kind[c] = LETTER if letter == 1 else DIGIT if digit == 2 else OTHER if other == 1 else 0

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the plain ones of the words (without white space, none empty), how many ids each has, and their ids."""
        given = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) <= LONGEST)
        text = np.frombuffer(b" ".join([words[k] for k in given]).decode("utf-8").encode("utf-32-le"), np.uint32)
        word = np.cumsum(text == 32)
        point = np.minimum(text, LIMIT).astype(np.int64)
        odd = self.kind[point] == 0
        odd[:-1] |= (text[:-1] == ord("<")) & (text[1:] == ord("|"))
        plain = np.ones(len(given), bool)
        plain[word[odd & (text != 32)]] = False
        take = plain[word] & (text != 32)
        point, word = point[take], word[take]
        plain = given[plain]
        if not len(point):
            return plain, np.zeros(0, np.int64), np.zeros(0, np.uint32)
        kind, low = self.kind[point], self.lower[point]
        begin = np.r_[True, (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)]
        row = np.cumsum(begin) - 1
        # UTF-8: two bytes from 0x80 on
        two = low >= 0x80
        place = np.arange(len(low)) + np.cumsum(two)
        data = np.empty(len(low) + int(two.sum()), np.int64)
        data[place] = np.where(two, 0x80 | (low & 0x3F), low)
        data[place[two] - 1] = 0xC0 | (low[two] >> 6)
        rows = np.repeat(row, 1 + two)
        last = np.r_[rows[1:] != rows[:-1], True]
        size, ids = self._merge(self.symbol[last.astype(np.int8), data], rows)
        own = word[begin]
        return plain, np.add.reduceat(size, np.flatnonzero(np.r_[True, own[1:] != own[:-1]])), ids

    def _merge(self, symbols: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of symbols left in each row after all merges, and all that are left in the rows' order."""
        place = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        left = np.zeros(len(place), np.int64)
        out = np.full(len(symbols), -1, np.int64)
        while len(symbols):
            rank = np.append(self._ranks(symbols[:-1] * self.width + symbols[1:]), np.int32(self.none))
            edge = np.append(row[1:] != row[:-1], True)
            rank[edge] = self.none
            size = np.diff(np.flatnonzero(edge), prepend=-1)
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, first)
            ended = best == self.none
            if ended.any():
                own = row[first[ended]]
                left[own] = size[ended]
                over = np.repeat(ended, size)
                nth = np.arange(len(row)) - np.repeat(first, size)
                out[place[row[over]] + nth[over]] = symbols[over]
                best[ended] = -1
            else:
                over = None
            index = np.flatnonzero(rank == np.repeat(best, size))
            if len(index) > 1:  # runs of one symbol: of overlapping hits every second one merges
                joined = np.r_[False, np.diff(index) == 1]
                if joined.any():
                    start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(index))))
                    index = index[(np.arange(len(index)) - start) % 2 == 0]
            symbols[index] = self.made[rank[index]]
            keep = np.ones(len(symbols), bool) if over is None else ~over
            keep[index + 1] = False
            symbols, row = symbols[keep], row[keep]
        return left, out[out >= 0].astype(np.uint32)
