"""Hard negatives by product quantisation with stored residual norms.

A vector of whole numbers is its nearest centroids, one of each group of components, and a residual whose norm is
stored. The product with an anchor is then a sum of table entries, give or take the residual's norm times the
anchor's: bounds that hold for every row, whatever the codebooks are. Rows whose bounds cannot reach an anchor's best
so far, or its window, are left out without a look at their components; the others are scored exactly, in whole
numbers, and complete the window. So codebooks, which are fitted on a bounded sample of rows, decide the speed and
never the result.

Coded rows are written once. Anchors are taken a block at a time, of a size that may travel to every task; each block
passes over all coded rows twice, first for its positives, then, with their scores known, for the negatives. A task
keeps the best few of each anchor, so what is shuffled is a few rows an anchor and task.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part, nor do rows whose
whole numbers' products could leave 63 bits; shorter vectors are filled up with zeros; a row without an id is neither
anchor nor moved to another label and stands last among ties; rows that share an id stand for the same row where an
anchor looks for others, and count one by one elsewhere; an empty table has no result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.scratch import discard, local_rows, materialize

SCALE = 256
#: Components of a group, and centroids of it.
GROUP, CENTROIDS = 2, 64
#: Rows that codebooks are fitted on, at most: those of the smallest hashes of id and vector.
SAMPLE = 8192
#: Anchors of a block, and entries of one array of bounds.
BLOCK, CELLS = 4096, 1 << 20
#: The largest sum of squares of a vector whose products stay exact.
MOST = float(1 << 62)
#: Products below this are exact in doubles too.
IN_DOUBLES = float(1 << 52)

CODED = "vec_id long, label int, vector array<bigint>"


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the whole-number vector of the rows that take part."""
    part = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    fits = part.where("label is not null and e is not null").where(
        F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    )
    scaled = fits.withColumn("q", F.transform("e", lambda x: F.floor(F.lit(float(SCALE)) * F.when(F.abs(x) < 1e15, x).otherwise(F.lit(1e15)))))
    size = F.aggregate("q", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return scaled.where(size < MOST).select("vec_id", "label", F.col("q").alias("vector"))


@dataclass
class Codebooks:
    """centroids[group, centroid, component] of whole numbers."""

    centroids: np.ndarray

    @property
    def width(self) -> int:
        return self.centroids.shape[0] * GROUP

    def code(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row, and its residual's norm, never too small."""
        groups = q.reshape(len(q), -1, GROUP).astype(float)
        codes = np.empty(groups.shape[:2], np.uint8)
        left = np.zeros(len(q))
        for g, centers in enumerate(self.centroids.astype(float)):
            apart = ((groups[:, g, None, :] - centers[None]) ** 2).sum(2)
            codes[:, g] = apart.argmin(1)
            left += apart[np.arange(len(q)), codes[:, g]]
        return codes, np.sqrt(left) * (1 + 1e-9) + 1e-9

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """Products of every centroid with the anchors: [group, centroid, anchor]."""
        return np.einsum("gkc,agc->gka", self.centroids.astype(float), anchors.reshape(len(anchors), -1, GROUP).astype(float))


def fit(rows: DataFrame, rounds: int = 8) -> Codebooks | None:
    """Codebooks of at most SAMPLE rows; None of an empty table."""
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).select("vector").toPandas()["vector"]
    q = padded([np.asarray(v, np.int64) for v in sample], -(-max(width, 1) // GROUP) * GROUP).astype(float)
    draw = np.random.default_rng(7)
    books = []
    for points in q.reshape(len(q), -1, GROUP).transpose(1, 0, 2):
        centers = points[draw.integers(0, len(points), CENTROIDS)]
        for _ in range(rounds):
            near = ((points[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
            count = np.bincount(near, minlength=CENTROIDS)[:, None]
            total = np.stack([np.bincount(near, points[:, c], CENTROIDS) for c in range(GROUP)], 1)
            centers = np.where(count > 0, total / np.maximum(count, 1), centers)
        books.append(np.rint(centers))
    return Codebooks(np.stack(books))


def padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


_CODED = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("residual", T.DoubleType()),
        T.StructField("vector", T.BinaryType()),
    ]
)
_ARROW = [pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.binary()]


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """rows with their codes, residual norms and packed vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                q = padded([np.asarray(v, np.int64) for v in some.column("vector").to_pylist()], books.width)
                codes, residual = books.code(q)
                columns = [some.column("vec_id"), some.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual), pa.array([v.tobytes() for v in q], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, _CODED.names)

    return rows.mapInArrow(run, _CODED)


@dataclass
class Tile:
    """Coded rows as arrays; rows without an id are marked, as ids of any value may occur."""

    ids: np.ndarray
    unnamed: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    residual: np.ndarray
    q: np.ndarray


def tiles(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[Tile]:
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, rows):
            b = whole_batch.slice(at, rows)
            n = b.num_rows
            ids = b.column("vec_id")
            yield Tile(
                ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False),
                np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(n, width // GROUP),
                b.column("residual").to_numpy(zero_copy_only=False),
                np.frombuffer(b"".join(b.column("vector").to_pylist()), np.int64).reshape(n, width),
            )


@dataclass
class Anchors:
    """A block of anchors; windows are the positives of each, as far as they are known."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray

    def bounds(self, books: Codebooks, tile: Tile, tables: np.ndarray, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the rows and own anchors, the least and the greatest that their product can be."""
        middle = np.zeros((len(rows), len(own)))
        for g in range(tables.shape[0]):
            middle += tables[g][:, own][tile.codes[rows, g]]
        norms = np.sqrt((self.q[own].astype(float) ** 2).sum(1)) * (1 + 1e-9) + 1e-9
        # whole numbers of doubles' size are summed without loss; beyond them the sums' own error joins the bound
        slack = tile.residual[rows][:, None] * norms[None] + np.abs(middle) * 1e-12 + (np.abs(tables).max(1).sum(0)[own] * 1e-13)[None] + 1e-6
        return middle - slack, middle + slack

    def exact(self, tile: Tile, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Products of pairs (rows[i], own[i]) in whole numbers."""
        a, b = tile.q[rows], self.q[own]
        top = max(float(np.abs(a).max(initial=0)), 1.0) * max(float(np.abs(b).max(initial=0)), 1.0) * a.shape[1]
        if top < IN_DOUBLES:
            return np.einsum("ij,ij->i", a.astype(float), b.astype(float)).astype(np.int64)
        return np.einsum("ij,ij->i", a, b)


class Best:
    """The k best (score, id) of each of n lists."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.key = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.unnamed = np.zeros(0, bool)
        #: Scores below it cannot enter a list any more.
        self.floor = np.full(n, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        key, score = np.r_[self.key, key], np.r_[self.score, score]
        ids, unnamed = np.r_[self.ids, ids], np.r_[self.unnamed, unnamed]
        order = np.lexsort((ids, unnamed, -score, key))
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.key, self.score, self.ids, self.unnamed = np.r_[self.key[:0], key[place < self.k]], score[keep], ids[keep], unnamed[keep]
        self.floor[key[place == self.k - 1]] = score[last]


_FOUND = T.StructType(
    [
        T.StructField("anchor", T.IntegerType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("score", T.LongType()),
    ]
)


def _found(best: Best, slots: int) -> pa.RecordBatch:
    ids = pa.array(best.ids, pa.int64(), mask=best.unnamed)
    columns = [pa.array((best.key // slots).astype(np.int32)), pa.array((best.key % slots).astype(np.int32)), ids, pa.array(best.score)]
    return pa.RecordBatch.from_arrays(columns, _FOUND.names)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and slot over all tasks."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(index: DataFrame, books: Codebooks, anchors: Anchors, k: int) -> DataFrame:
    """The k best other rows of each anchor's own label: anchor (its place in the block), rank, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, best = books.tables(anchors.q), Best(len(anchors.ids), k)
        by_label = {v: np.flatnonzero(anchors.labels == v) for v in np.unique(anchors.labels)}
        for tile in tiles(batches, books.width, max(64, CELLS // max(1, len(anchors.ids)))):
            for label, own in by_label.items():
                rows = np.flatnonzero(tile.labels == label)
                if not len(rows):
                    continue
                _, most = anchors.bounds(books, tile, tables, rows, own)
                other = tile.unnamed[rows][:, None] | (tile.ids[rows][:, None] != anchors.ids[own][None])
                r, a = np.nonzero((most >= best.floor[own][None]) & other)
                r, a = rows[r], own[a]
                best.add(a, anchors.exact(tile, r, a), tile.ids[r], tile.unnamed[r])
        yield _found(best, 1)

    return _first(index.mapInArrow(run, _FOUND), k)


def negatives(index: DataFrame, books: Codebooks, anchors: Anchors, scores: np.ndarray, known: np.ndarray, k: int, low: int, high: int) -> DataFrame:
    """The first k rows of another label in each window: low * score <= 100 * product <= high * score.

    scores[anchor, slot] are the positives' and known tells which slots are filled; slots are the positives' places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, slots = books.tables(anchors.q), scores.shape[1]
        best = Best(len(anchors.ids) * slots, k)
        # the least and the greatest whole product of each window, by whole numbers of any size
        least = np.array([[-(-low * int(s) // 100) for s in row] for row in scores], np.int64).reshape(scores.shape)
        most_wanted = np.array([[high * int(s) // 100 for s in row] for row in scores], np.int64).reshape(scores.shape)
        every = np.arange(len(anchors.ids))
        for tile in tiles(batches, books.width, max(64, CELLS // max(1, len(anchors.ids)))):
            rows = np.arange(len(tile.ids))
            least_of, most_of = anchors.bounds(books, tile, tables, rows, every)
            differs = tile.labels[:, None] != anchors.labels[None]
            floors = best.floor.reshape(len(every), slots)
            wanted = [
                differs & known[:, s][None] & (most_of >= np.maximum(floors[:, s], least[:, s])[None]) & (least_of <= most_wanted[:, s][None])
                for s in range(slots)
            ]
            r, a = np.nonzero(np.logical_or.reduce(wanted)) if wanted else (np.zeros(0, int),) * 2
            score = anchors.exact(tile, r, a)
            for s in range(slots):
                hit = known[a, s] & (score >= least[a, s]) & (score <= most_wanted[a, s])
                best.add(a[hit] * slots + s, score[hit], tile.ids[r[hit]], tile.unnamed[r[hit]])
        yield _found(best, slots)

    return _first(index.mapInArrow(run, _FOUND), k)


def _blocks(index: DataFrame, every: int, width: int, block: int) -> Iterator[Anchors]:
    """Anchors, a block at a time; the driver holds one block and one partition of anchors."""
    ids: list[int] = []
    labels: list[int] = []
    vectors: list[bytes] = []

    def made() -> Anchors:
        return Anchors(np.array(ids, np.int64), np.array(labels, np.int64), np.frombuffer(b"".join(vectors), np.int64).reshape(len(ids), width))

    for row in index.where(F.col("vec_id") % every == 0).select("vec_id", "label", "vector").toLocalIterator():
        ids.append(row[0]), labels.append(row[1]), vectors.append(bytes(row[2]))
        if len(ids) == block:
            yield made()
            ids, labels, vectors = [], [], []
    if ids:
        yield made()


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK
) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by every.

    vectors: vec_id, label, embedding. A negative's product lies between low and high percent of the positive's.
    """
    spark = vectors.sparkSession
    rows = whole(vectors)
    books = fit(rows)
    if books is None:
        return spark.createDataFrame([], OUT)
    index = materialize(coded(rows, books), "pq-index")
    written = []
    for anchors in _blocks(index, every, books.width, block):
        # bounded: n_positives rows an anchor of the block
        near = positives(index, books, anchors, n_positives).select("anchor", "rank", "vec_id", "score").collect()
        scores = np.zeros((len(anchors.ids), n_positives), np.int64)
        known = np.zeros(scores.shape, bool)
        for r in near:
            scores[r["anchor"], r["rank"] - 1], known[r["anchor"], r["rank"] - 1] = r["score"], True
        pairs = local_rows(
            spark, [(r["anchor"], r["rank"] - 1, int(anchors.ids[r["anchor"]]), r["vec_id"], r["score"]) for r in near], "anchor int, slot int, anchor_id long, positive_id long, positive_score long"
        )
        found = negatives(index, books, anchors, scores, known, n_negatives, low, high)
        named = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(pairs), ["anchor", "slot"])
        written.append(materialize(named.select(*[c.split()[0] for c in OUT.split(", ")]), "pq-found"))
    discard(index)
    if not written:
        return spark.createDataFrame([], OUT)
    return spark.read.schema(written[0].schema).parquet(*[w._scratch_path for w in written])


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """vectors, every so many ids moved to the next label."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))
