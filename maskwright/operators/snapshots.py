"""A versioned table of snapshots: what each export's tokens stand for.

Versions are written once, each to a folder of its own, and count when their entry stands in the log; creating that
entry is atomic, so of two writers that expected the same version one is told of the conflict, and a writer that dies
half way leaves nothing that a reader sees. A version can be revoked: its entry says so from then on and its rows are
deleted; numbers that it gave out stay used.

Tokens of a new version come by a join with the latest mapping of every scope, category, original and spellings. Those
that are new count on from the highest number that any version of the scope gave out, in the order of the mappings,
and from the highest that the text itself holds under the scope.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import scalars

#: What a version holds of each mapping.
MAPPING = "scope string, category string, original_text string, variants array<string>, ordinal int, number long, token string, enabled boolean, anchors string, reused boolean"
NAME = ["scope", "category", "original_text", "variants"]


class Conflict(RuntimeError):
    """Another writer has given out the version that was expected to be free."""


class SnapshotLog:
    """Versions under a folder of any file system that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _put(self, entry: dict, *parts: str) -> None:
        """Create a file with the entry; an error where there is one."""
        out = self.files.create(self._at(*parts), False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()

    def entries(self) -> dict[int, dict]:
        """The log: an entry for each version, with `revoked` where it was. One small file a version."""
        if not self.files.exists(self._at("log")):
            return {}
        found: dict[int, dict] = {}
        listed = sorted(s.getPath().getName() for s in self.files.listStatus(self._at("log")))
        for name in listed:
            number, _, kind = name.partition(".")
            if kind == "json":
                with_text = self.spark.read.text(f"{self.path}/log/{name}", wholetext=True).first()
                found[int(number)] = json.loads(with_text[0]) | {"revoked": f"{number}.revoked" in listed}
        return found

    def version(self) -> int:
        """The latest version, 0 before the first."""
        return max(self.entries(), default=0)

    def commit(self, mappings: DataFrame, expected: int) -> int:
        """Write the next version after the expected one; Conflict where that is not the latest any more."""
        if self.version() != expected:
            raise Conflict(f"version {self.version()} is the latest, not {expected}")
        folder = f"v{expected + 1}-{uuid.uuid4().hex}"
        mappings.select(*[c.split()[0] for c in MAPPING.split(", ")]).write.parquet(f"{self.path}/data/{folder}")
        high = self.read_folder(folder).groupBy("scope").agg(F.max("number").alias("high"))
        high.write.parquet(f"{self.path}/high/{folder}")  # stays when the version is revoked
        try:
            self._put({"folder": folder, "id": uuid.uuid4().hex}, "log", f"{expected + 1:09d}.json")
        except Exception as error:  # noqa: BLE001 - the file system's own error, whose class differs by store
            for part in ("data", "high"):
                self.files.delete(self._at(part, folder), True)
            if self.version() > expected:
                raise Conflict(f"version {expected + 1} was given out meanwhile") from error
            raise
        return expected + 1

    def revoke(self, version: int) -> None:
        """Delete a version's mappings; its tokens can no longer be restored and are not given out again."""
        entry = self.entries()[version]
        if not entry["revoked"]:
            self._put({}, "log", f"{version:09d}.revoked")
        self.files.delete(self._at("data", entry["folder"]), True)

    def read_folder(self, folder: str) -> DataFrame:
        return self.spark.read.schema(MAPPING).parquet(f"{self.path}/data/{folder}")

    def read(self, version: int | None = None) -> DataFrame:
        """Mappings with their version: of one, or of all that are not revoked."""
        live = {v: e["folder"] for v, e in self.entries().items() if not e["revoked"] and version in (None, v)}
        if not live:
            return self.spark.createDataFrame([], f"version int, {MAPPING}")
        rows = self.spark.read.schema(MAPPING).parquet(*[f"{self.path}/data/{f}" for f in live.values()])
        number = F.regexp_extract(F.input_file_name(), r"/data/v(\d+)-[0-9a-f]{32}/", 1).cast("int")
        return rows.select(number.alias("version"), "*")

    def high_water(self) -> DataFrame:
        """The highest number of each scope that any version gave out, revoked ones too."""
        folders = [f"{self.path}/high/{e['folder']}" for e in self.entries().values()]
        if not folders:
            return self.spark.createDataFrame([], "scope string, high long")
        return self.spark.read.schema("scope string, high long").parquet(*folders).groupBy("scope").agg(F.max("high").alias("high"))


def identified(current: DataFrame, log: SnapshotLog) -> DataFrame:
    """Mappings of a new version with their tokens.

    current: scope, category, original_text, variants, ordinal (order within the scope), enabled, anchors (how the
    occurrences stand) and held, the tokens of the scope that the raw text holds already (null: none). A mapping that
    comes again keeps its token unless the text holds it, and its switch where its anchors are the same.
    """
    before = log.read().groupBy(*NAME).agg(F.max_by(F.struct("number", "token", "enabled", "anchors"), "version").alias("old"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in NAME]
    joined = current.alias("c").join(before.alias("p"), on, "left").select("c.*", "old")
    kept = F.col("old").isNotNull() & ~F.coalesce(F.array_contains("held", F.col("old.token")), F.lit(False))
    rows = joined.withColumn("reused", kept).join(log.high_water(), "scope", "left")
    order = Window.partitionBy("scope").orderBy("ordinal")
    news = F.sum((~F.col("reused")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    from_ = F.greatest(F.coalesce("high", F.lit(0).cast("long")), F.coalesce(F.max(highest(F.col("held"))).over(Window.partitionBy("scope")), F.lit(0).cast("long")))
    numbered = rows.withColumn("number", F.when(F.col("reused"), F.col("old.number")).otherwise(from_ + news))
    same = F.col("reused") & F.col("old.anchors").eqNullSafe(F.col("anchors"))
    return numbered.select(
        *NAME, "ordinal", "number",
        F.when(F.col("reused"), F.col("old.token")).otherwise(scalars.token(F.col("scope"), F.col("category"), F.col("number"))).alias("token"),
        F.when(same, F.col("old.enabled")).otherwise(F.col("enabled")).alias("enabled"), "anchors", "reused",
    )


def held_tokens(text: Column, scope: Column) -> Column:
    """The tokens of a scope in a text."""
    shown = F.regexp_extract_all(text, F.lit(r"\[\[V1_[A-F0-9]{32}_[A-Z][A-Z0-9_]{0,63}_[1-9]\d{0,17}\]\]"), F.lit(0))
    return F.filter(shown, lambda t: t.startswith(F.concat(F.lit("[[V1_"), scope, F.lit("_"))))


def highest(held: Column) -> Column:
    """The highest number of some tokens, null where there are none."""
    return F.array_max(F.transform(held, lambda t: F.regexp_extract(t, r"_(\d+)\]\]\z", 1).cast("long")))
