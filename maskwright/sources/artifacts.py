"""Released artifacts as a data source: what may leave on one path, what undoes it on another, both or neither.

    rows.write.format("artifacts").option("path", ...).option("private", ...).mode("append").save()
    spark.read.format("artifacts").option("path", ...).load()

Rows have name, text, snapshot (JSON, private), blocked and review (arrays of findings) and acknowledged. A row leaves
if nothing blocks it and what needs review was acknowledged. Each task writes one part to each path under a name that
nothing reads; the driver's commit gives all parts their names, private ones first, and a failed job's parts are
deleted. Paths are URIs that pyarrow.fs opens where the tasks run: mounted folders, hdfs, s3.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SHOWN = "name string, text string"
WRITTEN = "name string, text string, snapshot string, blocked array<string>, review array<string>, acknowledged boolean"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:", "file://", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def may_leave(blocked: list[str] | None, review: list[str] | None, acknowledged: bool | None) -> bool:
    return not blocked and (not review or bool(acknowledged))


@dataclass
class Part(WriterCommitMessage):
    """A task's parts, and how many rows left and stayed."""

    name: str
    left: int
    stayed: int


@dataclass
class Piece(InputPartition):
    file: str


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Piece]:
        """A partition for each committed part; there is one a task, so their list is short."""
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Piece(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.startswith("part-")] or [Piece("")]

    def read(self, partition: Piece) -> Iterator[tuple]:
        if partition.file:
            with _store(self.path)[0].open_input_stream(partition.file, compression="gzip") as lines:
                held = b""
                while more := lines.read(1 << 20):
                    *whole, held = (held + more).split(b"\n")
                    for line in whole:
                        row = json.loads(line)
                        yield row["name"], row["text"]


class Writer(DataSourceWriter):
    def __init__(self, path: str, private: str):
        self.path, self.private, self.job = path, private, uuid.uuid4().hex

    def _folder(self, uri: str) -> tuple:
        store, root = _store(uri)
        return store, root.rstrip("/"), f"{root.rstrip('/')}/.writing-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Part:
        name, left, stayed = f"part-{uuid.uuid4().hex}.jsonl.gz", 0, 0
        streams = []
        try:
            for uri in (self.private, self.path):
                store, _, writing = self._folder(uri)
                store.create_dir(writing, recursive=True)
                streams.append(store.open_output_stream(f"{writing}/{name}", compression="gzip"))
            for row in iterator:
                if row.name is None:
                    raise ValueError("an artifact without a name")
                if not may_leave(row.blocked, row.review, row.acknowledged):
                    stayed += 1
                    continue
                left += 1
                for stream, shown in zip(streams, ({"name": row.name, "snapshot": row.snapshot}, {"name": row.name, "text": row.text})):
                    stream.write(json.dumps(shown).encode() + b"\n")
        finally:
            for stream in streams:
                stream.close()
        return Part(name, left, stayed)

    def commit(self, messages: list[Part | None]) -> None:
        """Parts get their names, the private ones first: nothing is out whose undoing is not kept."""
        for uri in (self.private, self.path):
            store, root, writing = self._folder(uri)
            for m in messages:
                if m is not None and m.left:
                    store.move(f"{writing}/{m.name}", f"{root}/{m.name}")
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        for uri in (self.private, self.path):
            store, _, writing = self._folder(uri)
            if store.get_file_info(writing).type == fs.FileType.Directory:
                store.delete_dir(writing)


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SHOWN

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("artifacts are appended, never overwritten")
        missing = {f.split()[0] for f in WRITTEN.split(", ")} - set(schema.names)
        if missing or "private" not in self.options:
            raise ValueError(f"missing: {sorted(missing) or 'option private'}")
        return Writer(self.options["path"], self.options["private"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Artifacts)
