"""Best-fit packing by the configuration program over the length histogram, rounded.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest sequences whose
configurations cover every length as often as it occurs. Only the histogram of lengths is needed, of at most
`capacity` entries whatever the corpus holds, so the driver solves it, for the exact lengths:

1. Multiplicative weights: lengths carry weights that fall as they are covered. Each round prices a length by its
   weight over its count, finds the dearest configurations by a knapsack dynamic program, and adds some of them. The
   amounts are a fractional solution; the prices of every round give a lower bound on any packing.
2. Rounding: amounts are rounded down and the program is solved again for the pieces left over, whose columns count
   once where they are nearly full; the few pieces that no whole amount takes go in by best fit. `plan` says the sequences, the bound and whether the program converged.

Pieces are numbered within their length across the cluster (a running number inside each written part plus the
counts of the parts before it), and the plan turns a piece's length and number into a sequence and a place.

Defined results: null counts as empty and is the single end token; repeated rows and null ids are packed like any
other row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.plain_words import PlainWords
from maskwright.scratch import materialize

#: A round adds the configurations that are worth this much less than the dearest at most.
SLACK = 1e-3
#: Value and bound of the program this close together count as converged.
CLOSE = 2e-3
#: So many words are kept; a group of texts that begins below may go beyond.
MEMORY = 800_000
#: New words are encoded so many at a time.
CHUNK = 20_000
#: A word of one token that only words with this character contain.
SEPARATOR = "~"
END = 0


class Numbers(dict):
    """Numbers words as they are looked up, from 0."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def taken(self) -> list[bytes]:
        """The words numbered since the last call."""
        new, self.new = self.new, []
        return new


class WordIds:
    """Token ids of whole texts, from a bounded memory of the ids of white-space separated words.

    Words of this vocabulary never reach over ASCII white space, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        sep = self._encode([SEPARATOR])[0]
        self.separator = sep[0] if len(sep) == 1 else None
        self.plain = PlainWords(self.tokenizer, path)
        self._clear()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # without offsets where there is a choice
        return [e.ids for e in run(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the words, the number of ids of each in that order, and all ids in that order.

        Plain words are merged here, the others by the library, many in one text, with a word between them whose id
        no other word contains.
        """
        order, lengths, flat = [], [], []
        rest = np.arange(len(words))
        if self.plain.usable:
            plain, size, ids = self.plain.encode(words)
            order.append(plain)
            lengths.append(size)
            flat.append(ids)
            rest = np.delete(rest, plain)
        mark = SEPARATOR.encode()
        alone = np.array([self.separator is None or mark in words[k] or b"<|" in words[k] for k in rest], bool)
        joint, apart = rest[~alone], rest[alone]
        order += [joint, apart]
        between = b" " + mark + b" "
        texts = [between.join([words[k] for k in joint[a : a + 400]]).decode("utf-8") for a in range(0, len(joint), 400)]
        for ids in self._encode(texts):
            ids = np.array(ids, np.uint32)
            cuts = np.r_[-1, np.flatnonzero(ids == self.separator), len(ids)]
            lengths.append(np.diff(cuts) - 1)
            flat.append(ids[ids != self.separator])
        for ids in self._encode([words[k].decode("utf-8") for k in apart]):
            lengths.append(np.array([len(ids)]))
            flat.append(np.array(ids, np.uint32))
        return np.concatenate(order), np.concatenate(lengths), np.concatenate(flat)

    def _clear(self) -> None:
        self.place = Numbers()
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, words: list[bytes], first: int) -> None:
        """Keep the ids of words that are numbered from `first`."""
        order, lengths, flat = self._encode_words(words)
        total = len(flat)
        while first + len(words) > len(self.start):
            self.start, self.length = np.r_[self.start, self.start * 0], np.r_[self.length, self.length * 0]
        while self.used + total > len(self.flat):
            self.flat = np.r_[self.flat, self.flat * 0]
        here = first + order
        self.length[here] = lengths
        self.start[here] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + total] = flat
        self.used += total

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        at = 0
        while at < len(texts):
            words, bounds, size = [], [0], 0
            while at < len(texts) and (len(bounds) == 1 or size + len(texts[at]) <= 1 << 20):
                words += texts[at].encode("utf-8").split()
                bounds.append(len(words))
                size += len(texts[at])
                at += 1
            if len(self.place) > MEMORY:
                self._clear()
            which = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            new = self.place.taken()
            for a in range(0, len(new), CHUNK):
                self._learn(new[a : a + CHUNK], len(self.place) - len(new) + a)
            length = self.length[which]
            ends = np.cumsum(length)
            shift = np.repeat(self.start[which] - (ends - length), length)
            flat = self.flat[shift + np.arange(len(shift))]
            bounds = np.r_[0, ends][bounds]
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield flat[a:b]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks that a Python worker runs in turn."""
    return WordIds(path)


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens, numbered by length within each part; their ids if asked for."""
    schema = T.StructType([*PIECE.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        words = word_ids(tokenizer_path)
        end = np.array([END], "<u4")
        for batch in batches:
            rows, given = [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), words.ids(texts)):
                ids = np.concatenate((body, end))
                for k, a in enumerate(range(0, len(ids), capacity)):
                    own = ids[a : a + capacity]
                    n = len(own)
                    rows.append((doc_id, k, a, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
                    if with_ids:
                        given.append(own.astype(np.int32))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(given, pa.list_(pa.int32()))] if with_ids else [])], schema.names)

    return docs.mapInArrow(run, schema)


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list]:
    """Best value for every space, and the decisions that lead there: (size's index, copies, room, where taken).

    Sizes go from the dearest per token down, in doubled copies. One that is worth no more than what already fits
    its room is never needed.
    """
    best = np.zeros(capacity + 1)
    steps = []
    for i in np.argsort(-prices / sizes, kind="stable"):
        size, price, copies = int(sizes[i]), float(prices[i]), 1
        if price <= best[size]:
            continue
        while size * copies <= capacity:
            value = best[: capacity + 1 - size * copies] + price * copies
            taken = value > best[size * copies :]
            if taken.any():
                steps.append((i, copies, size * copies, taken))
                best[size * copies :] = np.where(taken, value, best[size * copies :])
            copies *= 2
    return best, steps


def _contents(steps: list, spaces: np.ndarray, width: int) -> np.ndarray:
    """How often each size is in the best filling of each of the spaces."""
    space = spaces.copy()
    used = np.zeros((len(space), width), np.int64)
    for i, copies, room, taken in reversed(steps):
        hit = np.flatnonzero(space >= room)
        hit = hit[taken[space[hit] - room]]
        used[hit, i] += copies
        space[hit] -= room
    return used


class Program(NamedTuple):
    """A fractional solution: rows of `columns` say how often each size is in a configuration."""

    columns: np.ndarray
    amounts: np.ndarray
    bound: float  # no packing, fractional or whole, has fewer sequences
    rounds: int

    @property
    def value(self) -> float:
        return float(self.amounts.sum())


def weigh(sizes: np.ndarray, need: np.ndarray, capacity: int, rate: float, step: float) -> Program:
    """The configuration program by multiplicative weights.

    A size's weight falls with the share of its need that is covered, by the factor exp(-rate) over the whole need.
    A round prices sizes by weight over need, finds the dearest configuration that has each size by one knapsack
    program, and adds those within SLACK of the dearest of all, each size by at most `step` of its need and never
    beyond it. So all sizes run out together, and the columns use the needs exactly.
    """
    m = len(sizes)
    start = need * sizes / float((need * sizes).sum())
    done = np.zeros(m)
    bound = float((need * sizes).sum() / capacity)
    mean = np.zeros(m)
    found: dict[bytes, list] = {}
    rounds = 0
    while True:
        live = np.flatnonzero(done < 1 - 1e-9)
        if not len(live):
            break
        rounds += 1
        weight = start * np.exp(-rate * (done - done.min()))
        price = weight / need
        own = sizes[live]
        best, steps = _knapsack(own, price[live], capacity)
        if len(live) == m:  # weak duality: prices over the dearest configuration are a dual solution
            bound = max(bound, float(weight.sum() / best[capacity]))
            mean += weight / weight.sum()
        value = price[live] + best[capacity - own]
        near = np.flatnonzero(value >= (1 - SLACK) * value.max())
        near = near[np.argsort(done[live][near], kind="stable")]
        used = _contents(steps, capacity - own[near], len(live))
        used[np.arange(len(near)), near] += 1
        room = np.minimum(step, 1 - done[live]) * need[live]
        for row in used:
            k = np.flatnonzero(row)
            amount = float((room[k] / row[k]).min())
            if amount > 1e-9:
                room[k] -= amount * row[k]
                done[live[k]] += amount * row[k] / need[live[k]]
                column = np.zeros(m, np.int64)
                column[live[k]] = row[k]
                found.setdefault(column.tobytes(), [column, 0.0])[1] += amount
    best, _ = _knapsack(sizes, mean / need, capacity)  # so are their means, which swing less
    bound = max(bound, float(mean.sum() / best[capacity]))
    columns = np.array([c for c, _ in found.values()]).reshape(-1, m)
    return Program(columns, np.array([x for _, x in found.values()]), bound, rounds)


def solve(sizes: np.ndarray, need: np.ndarray, capacity: int) -> Program:
    """Finer and finer runs of `weigh`, until the best value is within CLOSE of the best bound, or of the fewest whole sequences.

    Every histogram gets the same runs, however many lengths it has; `Plan.converged` says whether value and bound have met.
    """
    best = None
    bound = 0.0
    for rate, step in ((1.0, 1.0), (4.0, 1 / 10), (8.0, 1 / 80), (32.0, 1 / 320), (64.0, 1 / 640)):
        one = weigh(sizes, need, capacity, rate, step)
        bound = max(bound, one.bound)
        if best is None or one.value < best.value:
            best = one
        if best.value <= max((1 + CLOSE) * bound, math.ceil(bound - 1e-6)):
            break
    return best._replace(bound=bound)


class Plan(NamedTuple):
    """configurations: (times, [(length, multiplicity), ...]); together they use the counts exactly."""

    configurations: list[tuple[int, list[tuple[int, int]]]]
    bound: float  # no packing has fewer sequences
    value: float  # of the fractional solution

    @property
    def sequences(self) -> int:
        return sum(times for times, _ in self.configurations)

    @property
    def converged(self) -> bool:
        return self.value <= (1 + CLOSE) * self.bound


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """The program of the histogram, rounded: counts[i] is how often length i occurs.

    Amounts are rounded down, and the program is solved again for the pieces left over, until no amount reaches one
    whole sequence and no column is nearly full. What is left then goes in by best fit, longest first.
    """
    left = counts.astype(np.int64).copy()
    full = int(left[capacity])
    out = [(full, [(capacity, 1)])] if full else []
    left[capacity] = 0
    bound = value = float(full)
    first = True
    while left.any():
        sizes = np.flatnonzero(left)
        need = left[sizes].astype(float)
        program = solve(sizes, need, capacity) if first else weigh(sizes, need, capacity, 1.0, 1.0)
        if first:
            bound, value = bound + program.bound, value + program.value
        order = np.argsort(-program.amounts, kind="stable")
        taken = sum(_take(left, sizes, program.columns[j], math.floor(program.amounts[j] + 1e-6), out) for j in order)
        if not first or not taken:  # of the pieces left over, whole configurations with hardly any room free
            tight = program.columns @ sizes >= (1 - SLACK) * capacity
            taken += sum(_take(left, sizes, program.columns[j], 1, out) for j in order[tight[order]])
        if not taken:
            _best_fit(left, capacity, out)
        first = False
    return Plan(out, math.ceil(bound - 1e-6), value)


def _take(left: np.ndarray, sizes: np.ndarray, column: np.ndarray, times: int, out: list) -> int:
    """Use a column up to `times` times, as far as its pieces are left."""
    k = np.flatnonzero(column)
    times = min(times, int((left[sizes[k]] // column[k]).min()))
    if times > 0:
        left[sizes[k]] -= times * column[k]
        out.append((times, [(int(x), int(c)) for x, c in zip(sizes[k][::-1], column[k][::-1])]))
    return max(0, times)


def _best_fit(left: np.ndarray, capacity: int, out: list) -> None:
    """The pieces left, longest first, each with the longest ones that still fit beside it."""
    for longest in range(capacity, 0, -1):
        while left[longest]:
            used: dict[int, int] = {}
            space, x = capacity, longest
            while x > 0:
                n = min(int(left[x]) - used.get(x, 0), space // x)
                if n:
                    used[x] = used.get(x, 0) + n
                    space -= n * x
                fitting = np.flatnonzero(left[1 : min(x - 1, space) + 1])
                x = int(fitting[-1]) + 1 if len(fitting) else 0
            times = min(int(left[x]) // n for x, n in used.items())
            for x, n in used.items():
                left[x] -= times * n
            out.append((times, list(used.items())))


def layout(configurations: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as runs: numbers `slot`.. of a length go to sequences from `first`, `each` at a time, from `offset`."""
    taken: dict[int, int] = {}
    rows = []
    first = 0
    for times, lengths in configurations:
        offset = 0
        for length, m in lengths:
            slot = taken.get(length, 0)
            rows.append((length, slot, first, m, offset))
            taken[length] = slot + times * m
            offset += m * length
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "slot", "first", "each", "offset"), table.T.copy()))


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    given = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    # written once: the running numbers must not be drawn anew
    cut = materialize(pieces(given, tokenizer_path, capacity, with_ids), "pieces")
    parts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    runs = docs.sparkSession.sparkContext.broadcast(layout(plan(counts, capacity).configurations))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(before, ["length", "part"]).withColumn("number", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        keys = (r["length"] << 44) | r["slot"]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, (length << 44) | number, side="right") - 1
            nth = number - r["slot"][at]
            sequence = r["first"][at] + nth // r["each"][at]
            offset = r["offset"][at] + nth % r["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], schema.names)

    fields = {f.name: f for f in cut.schema.fields}
    schema = T.StructType([*(fields[n] for n in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.select(*names, "number").mapInArrow(place, schema)
