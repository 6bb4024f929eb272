"""Tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(table: DataFrame) -> DataFrame:
    """table, dealt over all cores where it has fewer files than there are cores.

    A file of one row group is one task's, however small the splits are. Only tables of so few files move; a table
    of many files stays where it lies.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table of a folder, those columns only if any are given."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table.select(*columns) if columns else table)
