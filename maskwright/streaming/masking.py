"""Masking of a stream of documents, and the latest revision of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.operators.detect import mask


def mask_into(docs: DataFrame, path: str, checkpoint: str, text_col: str = "text", **profile) -> StreamingQuery:
    """Write a stream of documents, masked, as Parquet; with all that is there now read, the query ends.

    Masking is map-only, so it keeps no state; the checkpoint makes every document written once.
    """
    writer = mask(docs, text_col, **profile).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def latest(revisions: DataFrame, keys: list[str], revision_col: str = "revision") -> DataFrame:
    """The row of the highest revision of each key, on a table or a stream (whose state holds one row a key)."""
    others = [c for c in revisions.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    return revisions.groupBy(*keys).agg(F.max_by(row, F.col(revision_col)).alias("row")).select(*keys, "row.*")
