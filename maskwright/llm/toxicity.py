"""Toxicity scores: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

An n-gram is a run of 3, 4 or 5 bytes of the lower-cased text, hashed to one of 2**18 columns. Training takes
the log ratio of smoothed document frequencies in toxic and other documents, and fits a logistic regression on
counts within a window times that ratio. A score is the largest over overlapping windows of the text, so that a
short insult in a long text counts as much as in a short one; every window of the whole text is scored.

Only training looks at labels, and only at those whose fold crc32(id) mod 5 is not 0. It uses at most SAMPLE
labelled rows per class, the ones with the smallest hash of the id, and of these the texts of at most LONGEST bytes,
so what reaches the driver is bounded in rows and bytes; scoring covers all rows and whole texts.

Defined results: null and empty texts get the score of a text without n-grams; where a class has no labels, all
scores are 0; null ids are held out by the fold of the empty string; repeated rows score alike; labels of ids
that repeat are all used; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.scratch import local_rows

BITS = 18
SIZES = (3, 4, 5)
#: Labelled rows per class that training uses at most.
SAMPLE = 1200
#: Bytes of a text that training uses at most; longer texts are scored, not learned from.
LONGEST = 1 << 15
#: Bytes of a window, and how far the next one starts.
WINDOW, STEP = 256, 128
FOLDS = 5
_MULT = np.uint32(2654435761)


def fold(id_col: Column) -> Column:
    """0 for held-out rows."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))


def grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n-grams that start at each byte but the last n - 1."""
    if len(raw) < n:
        return np.zeros(0, np.uint32)
    wide = raw.astype(np.uint32)
    h = np.full(len(raw) - n + 1, n, np.uint32)
    for i in range(n):
        h = (h ^ wide[i : len(raw) - n + 1 + i]) * np.uint32(16777619)
    return (h * _MULT) >> np.uint32(32 - BITS)


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class Model:
    """weights by n-gram column and a bias, for windows."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability for every text, from its best window."""
        raws = [lowered(t) for t in texts]
        out = np.zeros(len(raws))
        at = 0
        while at < len(raws):
            end, size = at, 0
            while end < len(raws) and (end == at or size + len(raws[end]) <= 1 << 20):
                size += len(raws[end]) + max(SIZES)
                end += 1
            out[at:end] = self._best(raws[at:end])
            at = end
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    def _best(self, raws: list[bytes]) -> np.ndarray:
        gap = bytes(max(SIZES))
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        starts = np.cumsum(np.r_[0, lengths[:-1] + len(gap)])
        flat = np.frombuffer(gap.join(raws) + gap, np.uint8)
        total = np.zeros(len(flat) + 1)
        each = np.zeros(len(flat))
        for n in SIZES:
            value = self.weights[grams(flat, n)]
            if n > 1:  # n-grams that reach into a gap do not count
                inside = np.zeros(len(flat) + 1, np.int32)
                last = np.maximum(lengths - n + 1, 0)
                np.add.at(inside, starts, 1)
                np.add.at(inside, starts + last, -1)
                value = value * (np.cumsum(inside)[: len(value)] > 0)
            each[: len(value)] += value
        np.cumsum(each, out=total[1:])
        windows = np.maximum(1, -(-(lengths - (WINDOW - STEP)) // STEP))
        row = np.repeat(np.arange(len(raws)), windows)
        first = np.cumsum(np.r_[0, windows[:-1]])
        nth = np.arange(len(row)) - first[row]
        begin = starts[row] + nth * STEP
        stop = np.minimum(begin + WINDOW, starts[row] + lengths[row])
        logit = total[np.maximum(begin, stop)] - total[begin] + self.bias
        return np.round(np.maximum.reduceat(logit, first), 6)  # equal texts score alike in any batch


def _presence(text: str) -> np.ndarray:
    raw = np.frombuffer(lowered(text), np.uint8)
    return np.unique(np.concatenate([grams(raw, n) for n in SIZES]))


def fit(texts: list[str], labels: np.ndarray, rounds: int = 12) -> Model | None:
    """Train on documents that carry one label each; None if a class is missing.

    A toxic document is mostly ordinary text, so windows are the examples. All windows of ordinary documents are
    negative; of each toxic document the window that the current weights find worst is positive, beginning with
    the naive Bayes ratios of whole documents.
    """
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return None
    width = 1 << BITS
    with_label = [np.zeros(width), np.zeros(width)]
    n = [int((labels == c).sum()) for c in (0, 1)]
    for text, y in zip(texts, labels):
        with_label[int(y)][_presence(text)] += 1
    rate = [(with_label[c] + 0.5) / (n[c] + 1) for c in (0, 1)]
    ratio = np.log(rate[1] / rate[0])
    # a ratio counts by how far it lies outside chance
    spread = np.sqrt(1 / (with_label[1] + 0.5) + 1 / (with_label[0] + 0.5))
    ratio *= np.maximum(0, 1 - 2.5 * spread / np.maximum(np.abs(ratio), 1e-9))

    used = np.flatnonzero(ratio)
    if not len(used):
        return Model(np.zeros(width), np.log(n[1] / n[0]))
    small = np.full(width, -1, np.int32)
    small[used] = np.arange(len(used), dtype=np.int32)

    # windows as lists of the columns in use, counted with repetition
    cols, win, doc = [], [], []
    windows = 0
    for i, t in enumerate(texts):
        raw = np.frombuffer(lowered(t), np.uint8)
        for a in range(0, max(1, len(raw) - (WINDOW - STEP)), STEP):
            part = raw[a : a + WINDOW]
            c = small[np.concatenate([grams(part, k) for k in SIZES])]
            c = c[c >= 0]
            cols.append(c)
            win.append(np.full(len(c), windows, np.int32))
            doc.append(i)
            windows += 1
    cols, win, doc = np.concatenate(cols), np.concatenate(win), np.array(doc)
    first = np.searchsorted(doc, np.arange(len(texts)))
    scale = ratio[used]
    value = scale[cols]
    w = np.full(len(used), 1.0)
    bias = 0.0
    y_doc = labels.astype(float)
    weight = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0])
    m_w, v_w, m_b, v_b = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    start = np.bincount(win, value * w[cols], windows)
    best = np.maximum.reduceat(start, first)
    shift = (np.median(best[labels == 0]) + np.median(best[labels == 1])) / 2
    gain = 4 / max(1e-6, np.median(best[labels == 1]) - np.median(best[labels == 0]))
    if gain > 0:
        w *= gain
        bias = -shift * gain
    step = 0
    for _ in range(rounds):
        logit = np.bincount(win, value * w[cols], windows) + bias
        worst = first + np.array([int(np.argmax(logit[a:b])) for a, b in zip(first, np.r_[first[1:], windows])])
        chosen = np.zeros(windows, bool)
        chosen[worst] = True
        take = chosen[win]
        c, owner, v = cols[take], doc[win[take]], value[take]
        for _ in range(15):
            step += 1
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, v * w[c], len(texts)) + bias, -40, 40)))
            err = (p - y_doc) * weight
            g = np.bincount(c, v * err[owner], len(used)) + 1e-5 * w
            gb = err.sum()
            m_w, v_w = 0.9 * m_w + 0.1 * g, 0.99 * v_w + 0.01 * g * g
            m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.99 * v_b + 0.01 * gb * gb
            fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            w -= 0.03 * fix * m_w / (np.sqrt(v_w) + 1e-8)
            bias = min(-1.0, bias - 0.03 * fix * m_b / (np.sqrt(v_b) + 1e-8))  # a text without evidence is not toxic
    full = np.zeros(width)
    full[used] = scale * w
    return Model(full, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> Model | None:
    """Fit on the labelled rows outside the held-out fold, at most `sample` per class."""
    known = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
        .filter(fold(F.col("__id")) != 0)
    )
    # the smallest hashes of each class: a bounded top-k, done per class without a shuffle of all rows
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = {(r[0], r[1]) for r in chosen.collect()}
    if not ids:
        return None
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    picked = local_rows(spark, sorted(ids), f"__id {kind}, __y int")
    # the sample is bounded by 2 x sample ids, so it may be broadcast; ids may repeat in docs, so its rows are bounded again
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = rows.filter(F.octet_length("__text") <= longest).join(F.broadcast(picked), "__id")
    found = found.orderBy(F.xxhash64("__id"), "__id", "__y", "__text").limit(2 * sample).collect()
    texts = [r["__text"] for r in found]
    return fit(texts, np.array([r["__y"] for r in found]))


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
    ]
)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row: one pass, no shuffle."""
    given = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if given.value is None else Model(*given.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            s = np.zeros(len(texts)) if own is None else own.scores(texts)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, OUT.names)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(run, OUT)


def clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns of any name, in one pass."""
    given = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.weights, model.bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if given.value is None else Model(*given.value)
        for batch in batches:
            if own is None:
                yield batch
                continue
            texts = [t or "" for t in pc.struct_field(batch.column(0), at).to_pylist()]
            yield batch.filter(pa.array(own.scores(texts) < 0.5))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.mapInArrow(run, whole.schema).select("row.*")
