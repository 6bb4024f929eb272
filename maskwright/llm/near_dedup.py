"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

1. One pass turns every text into its set of word shingles (64-bit hashes) and its signature. Two fixed
   permutations of the 64-bit integers make all coordinates: sigma scatters the shingle hashes, and coordinate k
   is the least value of pi(sigma(x) - k), the same permutation shifted circularly by k.
2. Texts with the same set are one class, told apart by a 128-bit digest of the set and its size; a class goes on
   as its smallest pair of id and hash of the text, so thousands of copies cost one row.
3. Bands of ROWS coordinates are buckets. There are enough bands that a pair at the threshold misses all of them
   with a chance below MISS. Each member of a bucket is compared with the bucket's smallest pair, never all with
   all; the links that hold give a first set of components.
4. Members of buckets that still hold several components are searched for further links with a prefix filter over
   their whole sets: shingles ordered from the rarest, two sets above the threshold must share one among the first
   few, at places that leave room for the overlap they need. Only pairs of different components that pass are
   compared, so a large group of near copies causes no pairs of its own, and no link between candidates is lost.
5. Components are the smallest pair reachable over all links, named by its id, by repeated shortcutting until nothing changes.

Every comparison uses the whole sets. Candidates' sets are rebuilt from their texts, which move once.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with nothing; a
text of fewer words than a shingle is one shingle; a null id forms its own component with id null; repeated rows
share their component, and `keep_one` keeps all rows of the document it keeps; rows that share an id but not their
text are documents of their own; an empty table gives an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.scratch import discard, materialize

ROWS = 4
MISS = 1e-7
WORDS = 400_000
BLOCK = 1 << 15
#: Parts of a class of equal sets when its rows are given their component.
SALTS = 32

_U = np.uint64
_SIGMA = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_PI = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))
_POLY = (_U(0x2545F4914F6CDD1D), _U(0xD6E8FEB86659FD93))


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands after which a pair at the threshold shares none with a chance of at most `miss`."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows))) if threshold < 1 else 1


def sigma(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit integers."""
    x = x + _SIGMA[0]
    x = (x ^ (x >> _U(30))) * _SIGMA[1]
    x = (x ^ (x >> _U(27))) * _SIGMA[2]
    return x ^ (x >> _U(31))


def pi(x: np.ndarray) -> np.ndarray:
    """The permutation whose circular shifts make the coordinates."""
    x = x * _PI[0]
    x ^= x >> _U(29)
    x *= _PI[1]
    return x


class Words(dict):
    """64-bit hashes of words; a full memory is emptied between texts."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; A-Z lower-cased, words split at ASCII white space."""
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(words) > WORDS:
        words.clear()
    ids = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    size = min(size, len(ids))
    h = np.full(len(ids) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ ids[i : len(ids) - size + 1 + i]) * _POLY[0]
        h ^= h >> _U(32)
    return np.unique(sigma(h * _POLY[1]))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One hash per non-empty set and band; all coordinates come from shifts of one permutation."""
    out = np.zeros((len(sets), bands), np.uint64)
    at = 0
    while at < len(sets):  # a block of whole sets at a time, small enough for the processor's cache
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= BLOCK):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        first = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        for k in range(bands * rows):
            least = np.minimum.reduceat(pi(flat - _U(k)), first)
            b = k // rows
            out[at:end, b] = (out[at:end, b] ^ least) * _POLY[0] + _U(k + 1)
        at = end
    return out ^ (out >> _U(31))


SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, set size, set digest and band hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = Words()
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                sets = [shingle_set(t, size, words) for t in part.column("text").to_pylist()]
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                full = [s for s in sets if len(s)]
                flat = signatures(full, bands, rows).view(np.int64).ravel() if full else np.zeros(0, np.int64)
                ends = np.cumsum(np.where(n > 0, bands, 0), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends], pa.int32()), pa.array(flat))
                digest = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                mask = (1 << 64) - 1
                high, low = (np.array(d, np.uint64).view(np.int64) for d in ([d >> 64 for d in digest], [d & mask for d in digest]))
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(n), pa.array(high), pa.array(low), lists]
                yield pa.RecordBatch.from_arrays(columns, SKETCH.names)

    return docs.mapInArrow(run, SKETCH)


def _sets_of(docs: DataFrame, size: int) -> DataFrame:
    """id (doc_id and text_key) and whole shingle set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                sets = [shingle_set(t, size, words).view(np.int64) for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "s"])

    sets = docs.mapInArrow(run, "doc_id long, text_key long, s array<long>")
    return sets.select(F.struct("doc_id", "text_key").alias("id"), "s")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both"))
        .filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """id, root for every id in links(a, b): the smallest id reachable.

    Each round gives every id the least root among itself and its neighbours and then its root's root, so paths
    shorten by a factor each time. Ends when no root changes.
    """
    edges = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    roots = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hop = roots.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = roots.select(F.col("id").alias("mid"), F.col("root").alias("far"))
        new = materialize(
            hop.join(jump, "mid").select("id", "old", F.least("mid", "far").alias("root")), "roots"
        )
        discard(roots)
        roots = new
        if not roots.filter("root <> old").limit(1).count():
            discard(edges)
            return roots.select("id", "root")


def near_groups(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    miss: float = MISS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Links hold where 100 * |A & B| >= percent * |A | B| over sets of `size`-word shingles.
    """
    return keyed_groups(docs, size, percent, rows, miss, id_col, text_col).drop("text_key")


def text_key(text_col: str) -> str:
    """SQL of the hash that tells apart the texts of one id."""
    return f"xxhash64(coalesce(`{text_col}`, ''))"


def keyed_groups(docs: DataFrame, size: int, percent: int, rows: int, miss: float, id_col: str, text_col: str) -> DataFrame:
    """near_groups with the text_key of each row."""
    given = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"{text_key(text_col)} as text_key", f"`{text_col}` as text")
    bands = bands_for(percent / 100, rows, miss)
    sketch = materialize(sketches(given, size, bands, rows), "sketch")
    filled = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("n_shingles", "d1", "d2").agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep"),
        F.any_value("bands").alias("bands"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _salt())).alias("salts"),
        F.count(F.lit(1)).alias("n"),
    )
    members = materialize(
        classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "bucket")), "members"
    )
    # as a table of its own, so that a bucket with very many members can be split in the join
    shared = materialize(
        members.groupBy("band", "bucket")
        .agg(F.min("rep").alias("lead"), F.min_by("n_shingles", "rep").alias("lead_n"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n"),
        "shared",
    )
    crowded = materialize(members.join(shared, ["band", "bucket"]), "crowded")
    discard(members, shared)
    star = (
        crowded.filter("rep <> lead")
        .filter(_may_link("n_shingles", "lead_n", percent))
        .select(F.col("lead").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )
    star = materialize(star, "star")
    wanted = crowded.select("rep.doc_id", "rep.text_key").distinct()
    texts = given.filter("doc_id is not null").join(wanted, ["doc_id", "text_key"], "left_semi")
    texts = texts.groupBy("doc_id", "text_key").agg(F.min("text").alias("text"))  # repeated rows have one set
    sets = materialize(_sets_of(texts, size), "sets")
    links = materialize(_linked(star, sets, percent), "links")
    first = materialize(components(links), "first")

    rest = materialize(_rest(crowded, first, sets, percent), "rest")
    more = materialize(_linked(rest, sets, percent), "more")
    final = components(links.unionByName(more)) if more.limit(1).count() else first
    roots = materialize(final, "final")
    discard(sets, crowded, star, rest, links, more, first)

    # classes whose rows do not name themselves, once for each salt among their rows: no class is one task's
    named = (
        classes.select("n_shingles", "d1", "d2", "rep", "salts", "n")
        .join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
        .filter("n > 1 or root is not null")
        .select("n_shingles", "d1", "d2", F.coalesce("root", "rep")["doc_id"].alias("root"), F.explode(_salts_in("salts")).alias("salt"))
    )
    marks = sketch.select("doc_id", "text_key", "n_shingles", "d1", "d2", _salt().alias("salt"))
    return (
        marks.join(named, ["n_shingles", "d1", "d2", "salt"], "left")
        .withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def _salt():
    return F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")


def _salts_in(mask: str):
    """The salts whose bits are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("getbit", F.col(mask), i) == 1)


def _may_link(x: str, y: str, percent: int):
    """Set sizes that leave the threshold within reach."""
    return (100 * F.least(x, y) >= percent * F.greatest(x, y))


def _rest(crowded: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that may reach the threshold, among members of buckets with several."""
    rooted = crowded.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select(
        "band", "bucket", F.col("rep").alias("id"), F.coalesce("root", "rep").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    mixed = rooted.groupBy("band", "bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
    mixed = materialize(mixed.select("band", "bucket"), "mixed")
    open_ = rooted.join(mixed, ["band", "bucket"]).select("id", "root").distinct()
    own = materialize(sets.join(open_, "id"), "open")

    # places of the shingles that other sets have too, ordered from the rarest; the others come first
    each = own.select("id", "root", F.size("s").cast("long").alias("n"), F.explode("s").alias("g"))
    shared = materialize(each.groupBy("g").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "common")
    by_doc = Window.partitionBy("id")
    placed = each.join(shared, "g").select(
        "id",
        "root",
        "n",
        "g",
        (F.col("n") - F.count(F.lit(1)).over(by_doc) + F.row_number().over(by_doc.orderBy("f", "g")) - 1).alias("at"),
    )
    least = F.ceil(F.col("n") * percent / F.lit(100.0) - F.lit(1e-9))
    prefix = materialize(placed.filter(F.col("at") <= F.col("n") - least), "prefix")

    # one side is never of the component that has most of a shingle's rows
    per_root = prefix.groupBy("g", "root").agg(F.count(F.lit(1)).alias("c"))
    per_g = per_root.groupBy("g").agg(F.max_by("root", "c").alias("major"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    split = materialize(prefix.join(materialize(per_g.select("g", "major"), "major"), "g"), "split")
    x = split.filter("root <> major").select("g", "major", *[F.col(c).alias(f"{c}_x") for c in ("id", "root", "n", "at")])
    y = split.select("g", *[F.col(c).alias(f"{c}_y") for c in ("id", "root", "n", "at")])
    room = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    pairs = x.join(y, "g").filter(
        (F.col("root_x") != F.col("root_y"))
        & ((F.col("root_y") == F.col("major")) | (F.col("id_x") < F.col("id_y")))
        & _may_link("n_x", "n_y", percent)
        & ((100 + percent) * room >= percent * (F.col("n_x") + F.col("n_y")))
    )
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns."""
    groups = keyed_groups(docs, size, percent, ROWS, MISS, id_col, text_col)
    gone = groups.filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__gone_key")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    keyed = whole.select("__row", F.col(f"__row.`{id_col}`").cast("long").alias("__id"), F.expr(text_key(f"__row`.`{text_col}")).alias("__key"))
    return keyed.join(gone, (F.col("__id") == F.col("__gone")) & (F.col("__key") == F.col("__gone_key")), "left_anti").select("__row.*")
