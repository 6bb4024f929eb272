"""Files of any known format as documents: one row per file, with what became of it.

Defined results: a file that cannot be read gives a row with status `failed` and the reason, never a failed job; an
unknown extension, and a file or text beyond its limit, are such files; a file without text is `empty` (files of no
bytes at all are not listed by Spark); one with
warnings, or of a format that may hold what is not text, is for `review`; anything else is `complete`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources import csvs, office, pages

# Bytes of a file, characters of its text.
MOST_BYTES, MOST_CHARACTERS = 20_000_000, 2_000_000
NOTICE = "only extracted text is included; images, attachments and metadata need a look at the source"


def _plain(content: bytes) -> office.Read:
    return content.decode("utf-8", "replace"), []


def _csv(content: bytes) -> office.Read:
    rows = csvs.rows_of(content.decode("utf-8", "replace"))
    return csvs.table_of(rows), [f"{len(rows)} rows: large table"] if len(rows) > csvs.MANY_ROWS else []


def _html(content: bytes) -> office.Read:
    return pages.to_markdown(content.decode("utf-8", "replace")), []


_READERS: dict[str, Callable[[bytes], office.Read]] = {
    "txt": _plain, "md": _plain, "csv": _csv, "html": _html, "htm": _html,
    "xlsx": office.xlsx, "docx": office.docx, "odt": office.odt, "pptx": office.pptx, "eml": office.eml,
}


def register(extensions: list[str], reader: Callable[[bytes], tuple[str, list[str]]]) -> None:
    """A reader of one's own, in this driver's later plans."""
    _READERS.update({e.lower().removeprefix("."): reader for e in extensions})


def extensions() -> list[str]:
    return sorted(_READERS)


OUT = "path string, format string, text string, status string, warnings array<string>"


def from_table(files: DataFrame) -> DataFrame:
    """Documents of a table with path and content."""
    readers = dict(_READERS)

    def one(path: str, content: bytes) -> tuple:
        name = path.rpartition("/")[2]
        kind = name.rpartition(".")[2].lower() if "." in name else ""
        if kind not in readers:
            return path, kind, "", "failed", [f"unsupported; known: {', '.join(sorted(readers))}"]
        if len(content) > MOST_BYTES:
            return path, kind, "", "failed", ["the file is too large"]
        try:
            text, warnings = readers[kind](content)
        except Exception as problem:  # a damaged file is a row
            return path, kind, "", "failed", [f"unreadable: {problem}"]
        if len(text) > MOST_CHARACTERS:
            return path, kind, "", "failed", ["the text is too long"]
        if not text.strip():
            return path, kind, text, "empty", warnings
        if kind not in ("txt", "md", "csv"):
            warnings = [*warnings, NOTICE]
        return path, kind, text, "review" if warnings else "complete", warnings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(p, bytes(c) if c is not None else b"") for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=["path", "format", "text", "status", "warnings"])

    return files.select("path", "content").mapInPandas(run, OUT)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all files under a path; files beyond the limit are told by their size and never read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = from_table(listed.filter(F.col("length") <= MOST_BYTES))
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    large = listed.filter(F.col("length") > MOST_BYTES).select(
        "path", ending.alias("format"), F.lit("").alias("text"), F.lit("failed").alias("status"), F.array(F.lit("the file is too large")).alias("warnings")
    )
    return small.unionByName(large)
