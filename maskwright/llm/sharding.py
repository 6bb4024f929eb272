"""Sharding by histogram sort, in DataFrame functions only.

Rows are ordered by a hash of their text, so equal texts are neighbours. The driver looks for the keys at which
one shard ends and the next begins: each round counts the exact bytes below 4096 evenly spaced candidate keys
inside every interval that is still open, and keeps the one interval in which the sought byte count lies, until
the count at a candidate is within the tolerance. Then rows move once, to their shard.

Texts whose copies together weigh more than the tolerance times a shard are placed beforehand, largest first, on
the lightest shard (at most shards / tolerance such texts exist, so their list is bounded); the splitters fill
what each shard has left. Copies of one text share a shard, save a group heavier than a whole shard: its rows are
numbered without gaps and each of its shards takes one run of numbers, equally many to a row.

Defined results: a null text has no bytes and the group of the empty text; null ids share the hash of null;
repeated rows each take a slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.scratch import local_rows, materialize

TOLERANCE = 0.01
ROW_BYTES = 16
LEVEL_BITS = 12
PARTS = 64


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def find_splitters(light: DataFrame, targets: list[float], slack: float) -> list[int]:
    """Keys k_i with |bytes of rows below k_i - targets[i]| <= slack, or as near as single keys allow.

    light has key and size. Each round is one aggregate over the rows of the open intervals.
    """
    lowest = -(1 << 63)
    open_ = {i: (0, 0.0) for i in range(len(targets))}  # prefix of the interval, bytes below it
    found: dict[int, int] = {}
    shift = 64
    unsigned = F.col("key").bitwiseXOR(F.lit(lowest))
    while open_:
        below, shift = shift, max(0, shift - LEVEL_BITS)
        rows = light
        if below < 64:
            prefixes = sorted({p for p, _ in open_.values()})
            rows = rows.filter(F.shiftrightunsigned(unsigned, below).isin(prefixes))
        counted = rows.groupBy(F.shiftrightunsigned(unsigned, shift).alias("cell")).agg(F.sum("size").alias("bytes"))
        cells: dict[int, list[tuple[int, int]]] = {}
        for cell, size in sorted((r["cell"], r["bytes"]) for r in counted.collect()):
            cells.setdefault(cell >> (below - shift) if below < 64 else 0, []).append((cell, size))
        still = {}
        for i, (prefix, base) in open_.items():
            total, last = base, None
            for cell, size in cells.get(prefix, []):
                last = (cell, size, total)
                if total + size >= targets[i]:
                    break
                total += size
            if last is None:
                found[i] = prefix << below
                continue
            cell, size, total = last
            under, over = abs(targets[i] - total), abs(total + size - targets[i])
            if min(under, over) <= slack or shift == 0:
                found[i] = (cell if under <= over else cell + 1) << shift
            else:
                still[i] = (cell, total)
        open_ = still
    top = (1 << 64) - 1
    keys, floor = [], 0
    for i in range(len(targets)):
        floor = max(floor, min(found[i], top))
        keys.append(floor + lowest)
    return keys


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of nearly equal bytes."""
    rows = materialize(sized(docs, id_col, text_col), "sharding")
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > tolerance * share).collect()

    load = [(0.0, i) for i in range(shards)]
    placed: dict[int, int] = {}
    spread: dict[int, list[int]] = {}
    weights = [0.0] * shards
    for row in sorted(heavy, key=lambda r: (-r["bytes"], r["key"])):
        key, size = row["key"], row["bytes"]
        parts = 1 if size <= share * (1 + tolerance) else -int(-size // share)
        taken = [heapq.heappop(load) for _ in range(min(parts, shards))]
        for weight, i in taken:
            weights[i] = weight + size / len(taken)
            heapq.heappush(load, (weights[i], i))
        if len(taken) == 1:
            placed[key] = taken[0][1]
        else:
            spread[key] = [i for _, i in taken]

    light_total = total - sum(r["bytes"] for r in heavy)
    room = [max(0.0, share - w) for w in weights]
    scale = light_total / sum(room) if sum(room) else 0.0
    targets, reached = [], 0.0
    for r in room[:-1]:
        reached += r * scale
        targets.append(reached)

    # at most shards / tolerance rows, whatever the input's size
    spark = docs.sparkSession
    lookup = local_rows(spark, [(k, placed.get(k)) for k in [*placed, *spread]], "key long, home int")
    light = rows.join(F.broadcast(lookup), "key", "left_anti").select("key", "size")
    keys = find_splitters(light, targets, tolerance * share / 4) if light_total else [0] * (shards - 1)
    passed = sum((F.when(F.col("key") >= F.lit(k), 1).otherwise(0) for k in keys), F.lit(0))
    whole = rows.filter(~F.col("key").isin(list(spread))) if spread else rows
    sharded = whole.join(F.broadcast(lookup), "key", "left").select(
        "doc_id", "size", "text_crc32", "key", F.coalesce("home", passed).cast("int").alias("shard"), F.lit(None).cast("long").alias("number")
    )
    if spread:
        sharded = sharded.unionByName(dealt(rows, spread))
    return with_slots(sharded, shards)


def dealt(rows: DataFrame, spread: dict[int, list[int]], parts: int = PARTS) -> DataFrame:
    """The rows of the groups in spread with their number in the group, and the shard whose run holds that number.

    Groups are numbered in parts dealt by a hash of the id, `parts` for each of their shards, whose sizes are summed
    first. An id that alone outweighs a part (null, or repeated) follows in parts of its own, dealt by the written
    row number: its rows are the same, so the result does not depend on which of them takes which number.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    own = rows.filter(F.col("key").isin(list(spread))).withColumn("id", F.xxhash64("doc_id"))
    ids = own.groupBy("key", "id").count()
    total = {r["key"]: r["n"] for r in ids.groupBy("key").agg(F.sum("count").alias("n")).collect()}
    # at most 2 x shards homes in all, as every group is heavier than a shard; fewer than `parts` ids a home are heavy
    groups = [(k, homes, parts * len(homes), total[k]) for k, homes in spread.items()]
    groups = F.broadcast(local_rows(spark, groups, "key long, homes array<int>, parts int, total long"))
    over = ids.join(groups, "key").filter(F.col("count") * F.col("parts") > F.col("total")).orderBy("key", "id").collect()
    heavy = [(r["key"], r["id"], n, -(-r["count"] * r["parts"] // r["total"])) for n, r in enumerate(over, 1)]
    heavy = F.broadcast(local_rows(spark, heavy, "key long, id long, turn int, own_parts int"))
    part = F.when(F.col("turn").isNull(), F.pmod("id", F.col("parts"))).otherwise(F.pmod(F.xxhash64("row"), F.col("own_parts")))
    own = own.join(groups, "key").join(heavy, ["key", "id"], "left")
    own = own.withColumn("part", part.cast("int")).withColumn("turn", F.coalesce("turn", F.lit(0)))
    starts, at = [], dict.fromkeys(spread, 0)
    for r in own.groupBy("key", "turn", "part").count().orderBy("key", "turn", "part").collect():
        starts.append((r["key"], r["turn"], r["part"], at[r["key"]]))
        at[r["key"]] += r["count"]
    first = local_rows(spark, starts, "key long, turn int, part int, first long")
    order = Window.partitionBy("key", "turn", "part").orderBy("doc_id", "row")
    numbered = own.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(first), ["key", "turn", "part"])
    numbered = numbered.withColumn("number", F.col("first") + F.col("nth"))
    run = F.expr("number * size(homes) div total")
    home = F.element_at("homes", (run + 1).cast("int"))
    return numbered.select("doc_id", "size", "text_crc32", "key", home.alias("shard"), "number")


def with_slots(rows: DataFrame, shards: int, parts: int = PARTS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Every shard is numbered in parts dealt by a hash of the id and of the number in a group that was dealt out, whose
    sizes (shards x parts numbers) are summed first; so no task sorts a whole shard.
    """
    from pyspark.sql import Window

    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "key", "number"), F.lit(parts)).cast("int"))
    sizes = {(r["shard"], r["part"]): r["count"] for r in rows.groupBy("shard", "part").count().collect()}
    starts = []
    for shard in range(shards):
        at = 0
        for part in range(parts):
            starts.append((shard, part, at))
            at += sizes.get((shard, part), 0)
    first = local_rows(rows.sparkSession, starts, "shard int, part int, first long")
    order = Window.partitionBy("shard", "part").orderBy("key", "doc_id")
    return (
        rows.withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(first), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))
    )
