"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model crosses from a letter into a white-space marker, a text falls into marked words, each of
which is segmented by itself. A batch's marked words are numbered through a table of distinct ones; only those that
the worker has not met are segmented, all together in ragged arrays, and the ids are joined back by position. The
table is one of each task, not of the corpus: a corpus-wide one would send every occurrence of every word over the
network to save segmentations that cost less. It is emptied when it is full, which costs time and no result. A model
whose pieces do cross markers, or which changes texts before it cuts them, is refused.

A word's segmentation is the best pair first: of all neighbours whose union is a piece, the one of the highest score,
of equals the leftmost, is merged, until none is left. Characters that are no piece become their UTF-8 bytes' pieces.

Defined results: null counts as empty, whose ids are the begin and end ids alone; special strings in a text are
ordinary text; a marker in a text (U+2581) is decoded to a space, as the library does; ids pass as they are, null
ones too; repeated rows are encoded alike; very long words take a queue instead of arrays; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Words in a worker's table, and their characters, before it is emptied.
MEMORY, MEMORY_CHARS = 300_000, 6_000_000
#: Characters of texts that are cut into words at a time, and of words in one array.
GROUP, CHUNK = 1 << 20, 1 << 17
#: Words of more characters are segmented one at a time with a queue.
LONG = 48


class Model:
    """The pieces of a model, and the segmentation of marked words."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = norm.name == "identity" and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback or not plain:
            raise ValueError("only BPE models with byte fallback and an identity normalizer are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in spec.pieces):
            raise ValueError("a piece crosses a white-space marker: marked words cannot be segmented by themselves")
        ids = SentencePieceProcessor(model_file=path)
        self.begin, self.end = ids.bos_id(), ids.eos_id()
        self.pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        #: What each id stands for when it is decoded: control ids nothing, byte pieces their byte.
        self.stands_for = [
            b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
            else spec.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.encode()
            for p in spec.pieces
        ]
        self.is_byte = np.array([p.type == kinds.BYTE for p in spec.pieces])
        self._pairs({self.pieces[p.piece]: p.score for p in spec.pieces if p.type == kinds.NORMAL})

    def _pairs(self, score: dict[int, float]) -> None:
        """Every pair of symbols whose union is a piece, ordered for binary search, with the piece and its rank."""
        symbols = dict(self.pieces)
        for piece in self.pieces:
            for c in piece:
                symbols.setdefault(c, len(self.stands_for) + len(symbols))
        self.symbols = symbols
        #: Symbols that are no piece: they end as bytes.
        self.width = max(symbols.values()) + 2
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        found = {}
        for piece, made in self.pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * self.width + right] = (made, rank[score[made]])
        self.joins = found
        self.keys = np.array(sorted(found), np.int64)
        self.made = np.array([found[k][0] for k in self.keys], np.int64)
        self.rank = np.array([found[k][1] for k in self.keys], np.int64)
        self.none = len(rank)
        top = max((ord(c) for c in symbols if len(c) == 1), default=0)
        #: The symbol of each code point; the last one stands for those that are in no piece.
        self.symbol_of = np.full(top + 2, self.width - 1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i

    def segment(self, words: list[str]) -> list[bytes]:
        """The ids of each marked word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._ids(self._by_queue(w), w)
            else:
                short.append(i)
        for at in range(0, len(short), CHUNK // 16):
            some = short[at : at + CHUNK // 16]
            for i, ids in zip(some, self._by_arrays([words[i] for i in some])):
                out[i] = ids
        return out

    def _by_arrays(self, words: list[str]) -> Iterator[bytes]:
        """Each round merges the best pair of every word at once."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol = self.symbol_of[np.minimum(points, len(self.symbol_of) - 1)]
        row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        ends, rows, places = [], [], []  # symbols of finished words
        place = np.arange(len(symbol))
        while len(symbol):
            pair = symbol[:-1] * self.width + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (row[:-1] == row[1:]), self.rank[at], self.none)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(np.r_[rank, self.none], first)
            size = np.diff(np.r_[first, len(row)])
            live = np.repeat(best < self.none, size)
            if not live.all():
                ends.append(symbol[~live]), rows.append(row[~live]), places.append(place[~live])
            hit = np.flatnonzero(live & (np.r_[rank, self.none] == np.repeat(best, size)))
            hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]] if len(hit) else hit  # the leftmost
            symbol[hit] = self.made[at[hit]]
            live[hit + 1] = False
            symbol, row, place = symbol[live], row[live], place[live]
        symbol, row, place = np.concatenate(ends), np.concatenate(rows), np.concatenate(places)
        order = np.argsort(place, kind="stable")
        symbol, row, place = symbol[order], row[order], place[order]
        loose = symbol >= len(self.stands_for)
        bounds = np.searchsorted(row, np.arange(len(words) + 1))
        packed = symbol.astype("<u4").tobytes()
        spelled = set(row[loose].tolist())
        for i in range(len(words)):
            if i in spelled:
                offset = place[bounds[i]]
                own = slice(bounds[i], bounds[i + 1])
                yield self._ids(list(zip(symbol[own].tolist(), (place[own] - offset).tolist())), words[i])
            else:
                yield packed[4 * bounds[i] : 4 * bounds[i + 1]]

    def _by_queue(self, word: str) -> list[tuple[int, int]]:
        """The same for one long word: (symbol, place) left after all merges, by a queue of pairs."""
        symbol = [self.symbols.get(c, self.width - 1) for c in word]
        after = list(range(1, len(symbol))) + [-1]
        before = list(range(-1, len(symbol) - 1))
        gone = bytearray(len(symbol))
        queue: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0:
                joined = self.joins.get(symbol[left] * self.width + symbol[right])
                if joined:
                    heapq.heappush(queue, (joined[1], left, symbol[left], symbol[right]))

        for i in range(len(symbol)):
            offer(i)
        while queue:
            _, left, a, b = heapq.heappop(queue)
            right = after[left]
            if gone[left] or right < 0 or symbol[left] != a or symbol[right] != b:
                continue
            symbol[left] = self.joins[a * self.width + b][0]
            gone[right] = 1
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [(s, i) for i, s in enumerate(symbol) if not gone[i]]

    def _ids(self, symbols: list[tuple[int, int]], word: str) -> bytes:
        """Ids of the symbols, those that are no piece by their bytes."""
        ids: list[int] = []
        for s, place in symbols:
            ids.extend([s] if s < len(self.stands_for) else [self.bytes[b] for b in word[place].encode("utf-8")])
        return np.array(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids: one leading marker goes, the others are spaces, broken bytes U+FFFD."""
        raw = b"".join(map(self.stands_for.__getitem__, ids.tolist()))
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        return text.removeprefix(MARK).replace(MARK, " ")

    def _decode_broken(self, ids: np.ndarray) -> str:
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.stands_for[i]
                continue
            while run:
                size = next((n for n in (1, 2, 3, 4) if _whole(run[:n])), 0)
                out.append(run[:size].decode("utf-8") if size else "�")
                run = run[size or 1 :]
            if i is not None:
                out.append(self.stands_for[i].decode("utf-8"))
        return "".join(out)


def _whole(raw: bytes) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    """One model for all tasks of a worker."""
    return Model(path)


_marked = re.compile(f"{MARK}+[^{MARK}]*")


def marked_words(text: str) -> Iterator[list[str]]:
    """The marked words of a text, some at a time, so that those in memory stay bounded."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > GROUP:
            end = text.find(" ", at + GROUP)
            while end > 0 and text[end - 1] in " " + MARK:
                end = text.find(" ", end + 1)
            end = end if end > 0 else len(text)
        part = text[at:end] if at == 0 else text[at + 1 : end]  # the space at the cut is this part's first marker
        if "  " in part or MARK in part or part[:1] == " ":
            yield _marked.findall(MARK + part.replace(" ", MARK))
        else:
            yield [MARK + w for w in part.split(" ")]
        at = end


class Encoder:
    """Ids of whole texts, with the worker's table of distinct marked words."""

    def __init__(self, path: str):
        self.model = model(path)
        self.table: dict[str, bytes] = {}
        self.chars = 0
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.begin, self.model.end))

    def _joined(self, groups: list[list[str]]) -> list[bytes]:
        """The ids of each group of words."""
        table = self.table
        new = {w for words in groups for w in words if w not in table}
        if new:
            size = sum(map(len, new))
            if len(table) + len(new) > MEMORY or self.chars + size > MEMORY_CHARS:
                table.clear()
                self.chars = 0
                new = {w for words in groups for w in words}
                size = sum(map(len, new))
            listed = list(new)
            table.update(zip(listed, self.model.segment(listed)))
            self.chars += size
        look = table.__getitem__
        return [b"".join(map(look, words)) for words in groups]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[self.begin] for _ in texts]
        groups: list[list[str]] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            for words in marked_words(text):
                groups.append(words)
                owners.append(i)
                size += min(len(text), GROUP)
                if size >= GROUP:
                    for k, ids in zip(owners, self._joined(groups)):
                        out[k].append(ids)
                    groups, owners, size = [], [], 0
        for k, ids in zip(owners, self._joined(groups)):
            out[k].append(ids)
        return [b"".join(parts) + self.end for parts in out]


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
DECODED = T.StructType([*ENCODED.fields, T.StructField("text", T.StringType())])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some 16 MB each, a larger row by itself."""
    sizes = np.array([len(v) if v else 0 for v in batch.column(column).to_pylist()], np.int64)
    part = np.cumsum(sizes) // (1 << 24)
    for first, last in zip(*(np.flatnonzero(e) for e in (np.r_[True, part[1:] != part[:-1]], np.r_[part[1:] != part[:-1], True]))):
        yield batch.slice(first, last - first + 1)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (packed little-endian unsigned 32-bit) of every text: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            for part in _slices(batch, "text") if batch.num_rows else ():
                ids = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ENCODED.names)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows of `encode` with the text that their ids stand for; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(model_path)
        for batch in batches:
            for part in _slices(batch, "ids") if batch.num_rows else ():
                texts = [None if raw is None else known.decode(np.frombuffer(raw, "<u4")) for raw in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], DECODED.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)
