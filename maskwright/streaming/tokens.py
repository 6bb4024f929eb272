"""Stable tokens of a stream: keyed state that a restart finds again.

A scope's originals get tokens in the order in which they appear: by turn, then by place in the turn. The state of a
scope is one entry an original and the last number given, so numbers never go back, whatever micro-batch or restart
the rows come in. With a time to live, a scope that was silent for that long forgets its originals but not its last
number: they get new tokens then.

A scope's turns must arrive in their order over the micro-batches; within one they may stand in any.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from maskwright.functions import scalars

#: Fixed settings: the store that keeps state of several columns a key on disk.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "scope string, turn long, place int, category string, original string, number long, reused boolean"


class TokenState(StatefulProcessor):
    """Numbers of one scope's originals."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "number long")
        self.known = handle.getMapState("known", "category string, original string", "number long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        out = []
        for turn, place, category, original in sorted(
            (int(r.turn), int(r.place), r.category, r.original) for part in rows for r in part.itertuples(index=False)
        ):
            name = (category, original)
            reused = self.known.containsKey(name)
            if reused:
                number = int(self.known.getValue(name)[0])
            else:
                last = number = last + 1
            self.known.updateValue(name, (number,))  # a use renews the time to live
            out.append((key[0], turn, place, category, original, number, reused))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def with_tokens(numbered: DataFrame) -> DataFrame:
    """Rows of scope, category and number with their token."""
    return numbered.withColumn("token", scalars.token(F.upper(F.md5("scope")), F.col("category"), F.col("number")))


def token_stream(originals: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of scope, turn, place, category, original with number, reused and token."""
    rows = originals.select(F.col("scope").cast("string").alias("scope"), F.col("turn").cast("long").alias("turn"), F.col("place").cast("int").alias("place"), "category", "original")
    state = rows.groupBy("scope").transformWithStateInPandas(
        statefulProcessor=TokenState(ttl_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )
    return with_tokens(state)


def tokens_into(originals: DataFrame, path: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Write the tokens of a stream as Parquet; with all that is there now read, the query ends, its state kept."""
    originals.sparkSession.conf.set(*STATE_STORE)
    writer = token_stream(originals, ttl_ms).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def token_table(originals: DataFrame) -> DataFrame:
    """What the stream gives for the whole table: numbers by first appearance, for scopes of any size.

    Only the first appearances are numbered; they go back to the other rows by a join on scope and original.
    """
    name = ["scope", "category", "original"]
    rows = originals.select(F.col("scope").cast("string").alias("scope"), F.col("turn").cast("long").alias("turn"), F.col("place").cast("int").alias("place"), "category", "original")
    first = rows.groupBy(*name).agg(F.min(F.struct("turn", "place", "category", "original")).alias("first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("scope").orderBy("first")).cast("long"))
    joined = rows.join(numbered, name)
    again = F.struct("turn", "place") > F.struct("first.turn", "first.place")
    return with_tokens(joined.select("scope", "turn", "place", "category", "original", "number", again.alias("reused")))
