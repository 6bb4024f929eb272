"""CSV as a text source: the delimiter is found by counting, the rows become a Markdown table."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Delimiters, the earlier wins a tie.
DELIMITERS = (",", ";", "\t")
MANY_ROWS = 5000


def delimiter_of(text: str) -> str:
    """The delimiter that occurs most often outside quotes."""
    outside = "".join(text.split('"')[::2])
    return max(DELIMITERS, key=outside.count)


def rows_of(text: str) -> list[list[str]]:
    """Rows of a CSV text without blank ones; quoted cells may hold line ends."""
    body = text.removeprefix("\ufeff")
    csv.field_size_limit(1 << 30)
    found = csv.reader(io.StringIO(body, newline=""), delimiter=delimiter_of(body))
    return [row for row in found if any(cell.strip() for cell in row)]


def table_of(rows: list[list[str]]) -> str:
    """A Markdown table whose header is the first row; short rows are filled up."""
    if not rows:
        return ""
    width = max(map(len, rows))
    cells = [[" ".join(c.replace("|", "\\|").split("\n")).replace("\r", "").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def from_table(files: DataFrame, content_col: str = "content") -> DataFrame:
    """files with `text` and `warnings` in place of the CSV text; null counts as empty."""

    def work(column: pd.Series) -> pd.DataFrame:
        found = [rows_of(t if isinstance(t, str) else "") for t in column]
        many = [[f"{len(r)} rows: large table"] if len(r) > MANY_ROWS else [] for r in found]
        return pd.DataFrame({"text": [table_of(r) for r in found], "warnings": many})

    parsed = F.pandas_udf(work, "text string, warnings array<string>")(F.col(content_col))
    return files.withColumn("__parsed", parsed).select(*[c for c in files.columns if c != content_col], "__parsed.*")


def read(spark, path: str) -> DataFrame:
    """CSV files, one document per file: path, text, warnings."""
    whole = spark.read.format("binaryFile").load(path)
    return from_table(whole.select("path", F.decode("content", "UTF-8").alias("content")))
