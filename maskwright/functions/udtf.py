"""Detectors for SQL: a table function over text and the name of a detector, and a registry of one's own.

    register(spark)
    SELECT d.doc_id, s.* FROM documents d, LATERAL detect(d.text, 'EMAIL,PHONE') s

A detector of one's own is a function of a text that gives spans; it is registered under a name and found beside the
built-in categories. Registering it makes the table function known anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from maskwright.functions.engine import Engine, Span

OUT = "seq int, start int, end int, category string, text string, confidence double, source string, rung double, pack string, enabled boolean, shield boolean"
OWN: dict[str, Callable[[str], Iterable[Span]]] = {}


def table_function(own: dict[str, Callable[[str], Iterable[Span]]], **profile):
    """The class of a table function with these detectors beside the profile's."""

    @udtf(returnType=OUT)
    class Detect:
        def __init__(self):
            self.engine = Engine(**profile)

        def eval(self, text: str, names: str):
            """Candidates of the named categories and detectors in their order; all of the profile's for '*'."""
            wanted = [n.strip() for n in (names or "").split(",")]
            built_in = {n for n in wanted if n not in own}
            found = [s for s in self.engine.candidates(text or "") if "*" in built_in or s.category in built_in] if built_in else []
            for n in wanted:
                if n in own:
                    found += own[n](text or "")
            for seq, s in enumerate(found):
                yield (seq, *s)

    return Detect


def register(spark: SparkSession, name: str = "detect", **profile) -> None:
    """Make the table function known to SQL with the detectors that are registered now."""
    spark.udtf.register(name, table_function(dict(OWN), **profile))


def register_detector(spark: SparkSession, name: str, detector: Callable[[str], Iterable[Span]], **profile) -> None:
    """Add a detector under a name of its own; a built-in category's name takes its place."""
    OWN[name] = detector
    register(spark, **profile)
