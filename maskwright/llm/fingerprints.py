"""Document fingerprints: threshold-scaled sketches of character shingles.

A sketch holds the hash of every run of SHINGLE code points whose 32-bit value lies below 2**32 / SCALE. That
share is the same for all documents, so the sketch of a union is the union of sketches, and the share of one
sketch found in another estimates how much of one document is contained in the other, however unequal they are.
A text with fewer than LEAST such hashes keeps its LEAST smallest ones. So each sketch has a limit below which it
lacks no hash of its text, and two sketches are compared below the lower of their limits only: likeness is always
an estimate, exact for texts of fewer than LEAST shingles, and containment is not a number where the smaller text
has no hash there. The smallest hashes of a union are among those of its parts, so merged sketches stay the
sketches of merged documents.

Defined results: null counts as empty; a text shorter than a shingle is one shingle; an empty text has an empty
sketch, which is alike to an empty sketch only; documents that share an id stand in the order of their text;
null ids come last; ids that many rows share, and null ones, are dealt to several tasks, but for rows that begin alike; the single document of a table is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.scratch import local_rows

SHINGLE = 16
SCALE = 16
LEAST = 64
#: Code points of a text that parts are cut at where one id fills several.
BEGINNING = 64
_U = np.uint32


def shingle_hashes(points: np.ndarray) -> np.ndarray:
    """32-bit hashes of all runs of SHINGLE code points, by doubling: 1, 2, 4, 8, 16."""
    h = points.astype(np.uint32) * _U(2654435761) + _U(97)
    h ^= h >> _U(15)
    if len(h) < SHINGLE:
        total = _U(len(h))
        for x in h:
            total = _U(((int(total) ^ int(x)) * 2246822519 + 3266489917) & 0xFFFFFFFF)
        return np.array([total], np.uint32)
    width = 1
    while width < SHINGLE:
        h = h[:-width] * _U(2246822519) + h[width:] * _U(3266489917)
        h ^= h >> _U(13)
        width *= 2
    h *= _U(0x85EBCA6B)
    h ^= h >> _U(16)
    h *= _U(0xC2B2AE35)
    return h ^ (h >> _U(16))


def sketch(text: str) -> np.ndarray:
    """Sorted hashes below the threshold, or the LEAST smallest ones."""
    if not text:
        return np.zeros(0, np.uint32)
    h = shingle_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    low = np.unique(h[h < _U((1 << 32) // SCALE)])
    return low if len(low) >= LEAST else np.unique(h)[:LEAST]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both documents together."""
    both = np.union1d(a, b)
    return both[: max(LEAST, int(np.searchsorted(both, (1 << 32) // SCALE)))]


def limit(s: np.ndarray) -> int:
    """The value below which the sketch has every hash of its text."""
    return 1 << 32 if len(s) < LEAST else max((1 << 32) // SCALE, int(s[-1]) + 1)


def comparable(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How many hashes each sketch, and both, have below the lower limit."""
    top = min(limit(a), limit(b))
    a, b = a[: np.searchsorted(a, top)], b[: np.searchsorted(b, top)]
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller document's shingles that the other has; nan where no hash can tell."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    own, other, both = comparable(a, b)
    return both / min(own, other) if min(own, other) else float("nan")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    own, other, both = comparable(a, b)
    return both / (own + other - both)


def written(s: np.ndarray) -> str:
    """Eight hexadecimal digits a hash, ascending."""
    return s.astype(">u4").tobytes().hex()


def read(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_sequence(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in descending order of the id, in parts whose first row is repeated at the end of the part before.

    Rows have part, turn (0, or 1 for the repeated row), doc_id and text. Text moves once. Parts begin at quantiles of
    the ids; an id, or the absence of one, that fills several parts is cut at the beginnings of its texts as well.
    Each part's first row is found by an aggregate over ids, and over beginnings where ids are cut.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"coalesce(`{text_col}`, '') as text")
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, beginning = _cuts(rows, parts)
    placed = rows.withColumn("beginning", beginning)
    part = _part_of(cuts)
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "beginning")
    firsts = placed.groupBy(part.alias("part")).agg(F.min(at).alias("top")).collect()
    tops = {r["part"]: r["top"] for r in firsts}
    present = sorted(tops)
    before = {p: present[i - 1] for i, p in enumerate(present)}  # the first part follows the last
    # one entry per part: bounded by the number of partitions
    found = [(p, None if tops[p]["none"] else ~tops[p]["down"], tops[p]["beginning"], before[p]) for p in present]
    heads = local_rows(spark, found, "part int, top long, opening string, earlier int")
    tagged = placed.withColumn("part", part.cast("int")).join(F.broadcast(heads), "part")
    twice = F.when(
        F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("beginning") == F.col("opening")),
        F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("turn")), F.struct(F.col("earlier").alias("p"), F.lit(1).alias("turn"))),
    ).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("turn"))))
    spread = tagged.select("doc_id", "text", F.explode(twice).alias("to")).select(F.col("to.p").alias("part"), F.col("to.turn").alias("turn"), "doc_id", "text")
    return spread.repartition(F.col("part")).sortWithinPartitions(
        "part", "turn", F.col("doc_id").desc_nulls_last(), "text"
    )


def _cuts(rows: DataFrame, parts: int) -> tuple[list[tuple[int | None, str]], Column]:
    """Where parts after the first begin, in the order of the rows, and the column that cuts within an id compare.

    A cut is an id and the beginning of a text. Ids that several quantiles fall on are cut at quantiles of the
    beginnings of 64 * parts of their rows at most, drawn at random: they only bound the parts, whatever was drawn.
    """
    shares = [i / parts for i in range(1, parts)] or [0.5]
    seen = rows.agg(
        F.percentile_approx("doc_id", shares, 100 * parts).alias("at"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    falls: dict[int | None, int] = dict(Counter(seen["at"] or []))
    if seen["nulls"] * parts >= seen["n"] > 0:
        falls[None] = seen["nulls"] * parts // seen["n"]
    heavy = {i: m for i, m in falls.items() if m > 1}
    cuts = {(i, "") for i in falls}
    beginning = F.lit("")
    if heavy:
        known = F.col("doc_id").isin([i for i in heavy if i is not None])
        among = F.when(F.col("doc_id").isNull(), F.lit(None in heavy)).otherwise(known)
        beginning = F.when(among, F.left("text", F.lit(BEGINNING))).otherwise("")
        drawn = rows.filter(among).select("doc_id", F.left("text", F.lit(BEGINNING)).alias("b")).orderBy(F.rand(9)).limit(64 * parts)
        of: dict[int | None, list[str]] = {}
        for r in drawn.collect():
            of.setdefault(r["doc_id"], []).append(r["b"])
        for i, texts in of.items():
            texts.sort()
            cuts |= {(i, texts[k * len(texts) // heavy[i]]) for k in range(1, heavy[i])}
    return sorted(cuts, key=lambda c: (c[0] is None, -(c[0] or 0), c[1])), beginning


def _part_of(cuts: list[tuple[int | None, str]]) -> Column:
    """How many cuts a row stands behind, by a decision tree over them: part 0 has the largest ids, null ones come last."""

    def behind(cut: tuple[int | None, str]) -> Column:
        own, text = cut
        here = F.lit(True) if text == "" else F.col("beginning") >= F.lit(text)
        if own is None:
            return F.col("doc_id").isNull() & here
        return F.col("doc_id").isNull() | (F.col("doc_id") < F.lit(own)) | ((F.col("doc_id") == F.lit(own)) & here)

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(behind(cuts[middle]), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(cuts))


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def fingerprint_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness."""

    arrow = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for the one after it
        for batch in batches:
            rows = []
            for part, turn, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "turn", "doc_id", "text"))):
                own = sketch(text)
                if last is not None and last[0] == part:
                    _, prior_id, prior, prior_sketch = last
                    changed = edited(prior, text)
                    other = sketch(changed)
                    rows.append(
                        (
                            prior_id,
                            len(prior),
                            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            written(prior_sketch),
                            written(other),
                            likeness(prior_sketch, other),
                            likeness(prior_sketch, own),
                        )
                    )
                # a repeated row only ends its part; of several with the same id the first one does
                last = None if turn == 1 else (part, doc_id, text, own)
            columns = list(zip(*rows)) or [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return in_sequence(docs, id_col=id_col, text_col=text_col).mapInArrow(run, OUT)
