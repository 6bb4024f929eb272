"""Prefix trie of conversations by chained digests.

Each conversation is a chain of digests, each of the one before and of a turn, so equal digests mean equal prefixes.
Every prefix of every conversation is a row; rows of one digest are a node, named by its smallest member and its
depth. As members only get fewer down a path, the nodes that one member names are a run of its own last turns. Such a
run is summed first; then each run is exploded to all the runs above it, at the node where it leaves them, and a
running sum along each run gives every node its subtree. That explodes as many rows as there are prefixes at most;
node by node it would be the square of a conversation's length.

Turns cross the network as digests and sizes, not as texts. Prefixes are grouped and joined under a salt, so a prefix
of a third of all conversations is nobody's single task. A chain is sequential by nature: one conversation is streamed
by one task, some 60 bytes a turn, sorted on disk where it must. Members of a node are written in blocks of 2**14
neighbouring ids, and the blocks are hashed as a stream.

Defined results: rows without a conversation id take no part; a null turn comes first, turns that tie stand in the
order of their digests; null role and text are empty; repeated rows are turns of their own; ids of any sign keep their
`%` of SQL; other columns are ignored; an empty table has no node. A list of ids without members hashes as empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.scratch import discard, materialize

SALTS = 64
BLOCK_BITS = 14
#: Conversations are rebuilt on the first turns of the one at the start of their family.
FAMILY, MOST_SHARED = 5, 8
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def _bytes_of(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest of role and text, n_bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps role and text apart
    framed = F.concat(F.encode(F.concat(_bytes_of(role).cast("string"), F.lit(":")), "UTF-8"), F.encode(role, "UTF-8"), F.encode(text, "UTF-8"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.unhex(F.sha2(framed, 256)).alias("digest"), _bytes_of(text).alias("n_bytes")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "n_bytes")


def rebuilt(own: DataFrame, most: int = MOST_SHARED, family: int = FAMILY) -> DataFrame:
    """Rows of each conversation rebuilt on the shared beginning of its family: conv_id, pos, digest, n_bytes.

    h = crc32(id) % (most + 1) turns come from the family's first conversation, the rest are its own. pos 0 without a
    digest marks that the conversation exists. A turn is needed by one family's members only, so rows grow by a bounded
    number.
    """

    def shared(conv: Column) -> Column:
        return F.crc32(F.encode(conv.cast("string"), "UTF-8")) % F.lit(most + 1)

    conv, pos = F.col("conv_id"), F.col("pos")
    none = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("n_bytes"))
    here = F.struct("pos", "digest", "n_bytes")
    kept = F.filter(
        F.array(F.when(pos == 1, F.struct(conv.alias("conv_id"), none.alias("row"))), F.when(pos > shared(conv), F.struct(conv.alias("conv_id"), here.alias("row")))),
        lambda x: x.isNotNull(),
    )
    members = F.filter(
        F.array(*[F.try_add(conv, F.lit(i).cast("long")) for i in range(1 - family, family)]),
        lambda to: to.isNotNull() & ((to - to % family) == conv) & (pos <= shared(to)),
    )
    lent = F.when((conv % family == 0) & (pos <= most), F.transform(members, lambda to: F.struct(to.alias("conv_id"), here.alias("row")))).otherwise(F.array().cast(_MOVED))
    return own.select(F.explode(F.concat(kept.cast(_MOVED), lent.cast(_MOVED))).alias("to")).select("to.conv_id", "to.row.*")


_MOVED = "array<struct<conv_id:bigint,row:struct<pos:bigint,digest:binary,n_bytes:bigint>>>"
_CHAINED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("depth", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("is_end", T.BooleanType()),
    ]
)


def chained(rows: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, chained digest, bytes of the last text, whether it is whole.

    rows as of `rebuilt`; rows whose conversation does not exist go. One task streams a conversation; no more than a
    row of it is kept at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, exists, digest, depth = None, False, b"", 0
        held: tuple | None = None  # the last prefix, which may turn out to be the end
        for batch in batches:
            out: list[tuple] = []
            for conv, pos, turn, n_bytes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "digest", "n_bytes"))):
                if conv != current:
                    if held:
                        out.append((*held, True))
                    current, exists, held = conv, pos == 0, None
                    if exists:
                        digest, depth = hashlib.sha256(b"").digest(), 0
                        held = (conv, 0, digest, 0)
                    continue  # a lent turn before any marker: the conversation does not exist
                if exists:
                    digest, depth = hashlib.sha256(digest + turn).digest(), depth + 1
                    out.append((*held, False))
                    held = (conv, depth, digest, n_bytes)
            yield _batch(out)
        if held:
            yield _batch([(*held, True)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _CHAINED.names)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, _CHAINED)


def named(prefixes: DataFrame) -> DataFrame:
    """prefixes with their node: rep (its smallest member) and n_convs.

    Salted twice over: a node is summed by salt and then as a whole, and goes back to the salts that it has members of.
    """
    salted = prefixes.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("digest", "salt").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"))
    # at most SALTS entries a node
    nodes = parts.groupBy("digest").agg(F.min("rep").alias("rep"), F.sum("n_convs").alias("n_convs"), F.collect_list("salt").alias("salts"))
    back = nodes.select("digest", "rep", "n_convs", F.explode("salts").alias("salt"))
    return salted.join(back, ["digest", "salt"]).select("conv_id", "depth", "rep", "n_convs", "n_bytes", "is_end")


_HASHED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("ends_sha256", T.StringType())])


def ends(prefixes: DataFrame) -> DataFrame:
    """conv_id, depth and the hash of the ascending ids that end at the node, for nodes with such ids.

    A block holds ids of one range of 2**BLOCK_BITS, so it is bounded; blocks of a node are hashed one after another.
    """
    blocks = (
        prefixes.where("is_end")
        .groupBy("rep", "depth", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for rep, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids"))):
                if (rep, depth) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (rep, depth), hashlib.sha256(ids.encode())
            yield _batch(out)
        if key is not None:
            yield _batch([(*key, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], _HASHED.names)

    return blocks.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "block").select("rep", "depth", "ids").mapInArrow(run, _HASHED)


def trie(prefixes: DataFrame) -> DataFrame:
    """Nodes of the prefixes of `chained`, with members, children, subtree sums and hashes of their ends."""
    marked = materialize(named(prefixes), "trie-named")
    discard(prefixes)
    nodes = marked.where("conv_id = rep").select("conv_id", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    # a conversation that names a node, its own run and the runs above it
    above = marked.groupBy("conv_id", "rep").agg(
        F.max("depth").alias("last"), F.sum(F.when(F.col("conv_id") == F.col("rep"), (F.col("n_convs") - 1) * F.col("n_bytes"))).alias("saved")
    )
    own = F.max(F.when(F.col("conv_id") == F.col("rep"), F.struct("saved"))).over(Window.partitionBy("conv_id"))
    runs = materialize(above.withColumn("own", own).where("own is not null").drop("saved"), "trie-runs")
    under = runs.where("rep != conv_id")
    starts = under.groupBy("conv_id").agg(F.max_by("rep", "last").alias("parent"), (F.max("last") + 1).alias("depth"))
    branches = starts.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    # a run ends in a leaf unless another one hangs at its last node
    whole = branches.join(runs.where("rep = conv_id").select("conv_id", F.col("last").alias("depth")), ["conv_id", "depth"], "left_semi")
    endless = whole.select("conv_id", F.lit(0).cast("long").alias("leaf"))
    up = under.join(endless, "conv_id", "left").select(
        F.col("rep").alias("conv_id"), F.col("last").alias("depth"), F.col("own.saved").alias("saved"), F.coalesce("leaf", F.lit(1).cast("long")).alias("leaves")
    )
    hung = up.groupBy("conv_id", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    nil = F.lit(None).cast("long")
    pieces = (
        nodes.select("conv_id", "depth", "n_convs", "saved", nil.alias("leaves"), nil.alias("children"), nil.alias("parent"), F.lit(None).cast("string").alias("ends_sha256"))
        .unionByName(hung, allowMissingColumns=True)
        .unionByName(branches, allowMissingColumns=True)
        .unionByName(starts.select("conv_id", "depth", "parent"), allowMissingColumns=True)
        .unionByName(ends(marked), allowMissingColumns=True)
        .repartition("conv_id")
    )
    joined = pieces.groupBy("conv_id", "depth").agg(
        F.max("n_convs").alias("n_convs"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"),
        F.coalesce(F.sum("children"), F.lit(0)).alias("branches"), F.max("parent").alias("parent"), F.max("ends_sha256").alias("ends_sha256"),
    )
    down = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    onward = F.lag("depth").over(down).isNotNull().cast("long")  # the run goes on below this node
    with_children = joined.withColumn("n_children", F.col("branches") + onward)
    below = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_leaf = (F.col("n_children") == 0).cast("long")
    return with_children.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", F.col("conv_id"))).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.sum(F.col("leaves") + own_leaf).over(below).alias("n_leaves"),
        F.sum("saved").over(below).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    own = turns(conversations)
    marks = own.where("pos = 1").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("n_bytes"))
    return trie(materialize(chained(own.unionByName(marks)), "trie-chains"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt on the shared beginnings of their families."""
    return trie(materialize(chained(rebuilt(turns(conversations))), "trie-chains"))
