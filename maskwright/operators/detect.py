"""Detection, masking and restoration of documents: one pass each, no shuffle.

Defined results: null counts as empty and has no spans; columns of any name pass through, except that a column named
like a result (`spans`, `mappings`, `masked`, `result`) is replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.engine import Engine, Span, apply, mappings, restore
from maskwright.functions.spans import SPAN

OCCURRENCE = "struct<start:int,end:int,text:string>"
MAPPING = (
    "struct<id:string,original_text:string,placeholder:string,category:string,confidence:double,source:string,enabled:boolean,"
    f"variants:array<string>,occurrences:array<{OCCURRENCE}>>"
)
RESTORED = "struct<text:string,restored:int,unknown:array<string>,ambiguous:array<string>,malformed:array<string>>"
_S, _I, _D, _B = pa.string(), pa.int32(), pa.float64(), pa.bool_()
_SPANS = pa.list_(
    pa.struct(
        [("start", _I), ("end", _I), ("category", _S), ("text", _S), ("confidence", _D), ("source", _S), ("rung", _D), ("pack", _S), ("enabled", _B), ("shield", _B)]
    )
)
_OCCURRENCES = pa.list_(pa.struct([("start", _I), ("end", _I), ("text", _S)]))
_MAPPINGS = pa.list_(
    pa.struct(
        [("id", _S), ("original_text", _S), ("placeholder", _S), ("category", _S), ("confidence", _D), ("source", _S), ("enabled", _B), ("variants", pa.list_(_S)), ("occurrences", _OCCURRENCES)]
    )
)
#: Bytes of rows that are Python objects at a time in one task, however large the batches are that it is sent.
SLICE_BYTES = 1 << 20
_RESULT = pa.struct([("text", _S), ("restored", _I), ("unknown", pa.list_(_S)), ("ambiguous", pa.list_(_S)), ("malformed", pa.list_(_S))])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of SLICE_BYTES at most, single rows of more apart."""
    if batch.num_rows > 1 and batch.nbytes > SLICE_BYTES:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))
    else:
        yield batch


def _with(docs: DataFrame, given: list[str], made: dict[str, tuple[str, pa.DataType]], start: Callable) -> DataFrame:
    """docs with the columns `made` that the function start() returns gives for the values of the columns `given`.

    The rows travel as one column, so their names do not matter.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = [docs.columns.index(c) for c in given]
    types = [t for _, t in made.values()]
    schema = f"row {whole.schema['row'].dataType.simpleString()}" if all(c.isidentifier() for c in docs.columns) else None
    if schema is None:
        quoted = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema)
        schema = f"row struct<{quoted}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in (part for whole in batches for part in slices(whole)):
            row = batch.column(0)
            out = [work(*values) for values in zip(*(pc.struct_field(row, i).to_pylist() for i in at))]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([row, *columns], ["row", *made])

    full = whole.mapInArrow(run, ", ".join([schema, *(f"{n} {ddl}" for n, (ddl, _) in made.items())]))
    keep = [F.col(f"row.`{c}`") for c in docs.columns if c not in made]
    return full.select(*keep, *made)


def _manual(given: list[dict] | None, text: str) -> list[Span]:
    """The caller's spans whose text still stands where it did."""
    return [
        Span(m["start"], m["end"], m["category"], m["text"], 1.0, "manual", 0.0, None)
        for m in given or []
        if 0 <= m["start"] < m["end"] and text[m["start"] : m["end"]] == m["text"]
    ]


def _start(profile: dict, own: dict[str, str | None], each: Callable) -> Callable:
    """What starts a task: each(engine, text, manual spans) with the engine of the row's own profile, built once a task.

    own names the columns that stand for parts of the profile; null means the table's.
    """
    parts = [part for part, column in own.items() if column]

    def start():
        @lru_cache(maxsize=64)
        def engine_of(*values):
            given = {part: dict(v) if part == "settings" else v for part, v in zip(parts, values) if v is not None}
            return Engine(**{**profile, **given})

        def work(text, *rest):
            values = [v if v is None else tuple(x for x in v if x is not None) for v in rest[: len(parts)]]
            return each(engine_of(*values), text or "", *rest[len(parts) :])

        return work

    return start


def _columns(text_col: str, own: dict[str, str | None], manual_col: str | None = None) -> list[str]:
    return [c for c in (text_col, *own.values(), manual_col) if c]


def detect(
    docs: DataFrame,
    text_col: str = "text",
    manual_col: str | None = None,
    languages_col: str | None = None,
    jurisdictions_col: str | None = None,
    settings_col: str | None = None,
    **profile,
) -> DataFrame:
    """docs with `spans`: the winners, shields included, sorted by start. profile: see Engine.

    manual_col names spans (start, end, category, text) of the caller's, replayed where their text still matches. The
    columns of languages, jurisdictions (lists) and settings (a map) give each row its own; null ones the profile's.
    """
    own = {"languages": languages_col, "jurisdictions": jurisdictions_col, "settings": settings_col}
    each = lambda engine, text, manual=None: (engine.detect(text, _manual(manual, text)),)
    return _with(docs, _columns(text_col, own, manual_col), {"spans": (f"array<{SPAN}>", _SPANS)}, _start(profile, own, each))


def candidates(
    docs: DataFrame,
    text_col: str = "text",
    languages_col: str | None = None,
    jurisdictions_col: str | None = None,
    settings_col: str | None = None,
    **profile,
) -> DataFrame:
    """docs with `candidates`: what every detector and rule finds, in the order that settles ties, nothing decided."""
    own = {"languages": languages_col, "jurisdictions": jurisdictions_col, "settings": settings_col}
    each = lambda engine, text: (engine.candidates(text),)
    return _with(docs, _columns(text_col, own), {"candidates": (f"array<{SPAN}>", _SPANS)}, _start(profile, own, each))


def mask(
    docs: DataFrame,
    text_col: str = "text",
    manual_col: str | None = None,
    languages_col: str | None = None,
    jurisdictions_col: str | None = None,
    settings_col: str | None = None,
    **profile,
) -> DataFrame:
    """docs with `spans`, `mappings` and `masked`; columns of profiles as in `detect`."""

    def each(engine, text, manual=None):
        spans = engine.detect(text, _manual(manual, text))
        found = mappings(text, spans)
        return spans, found, apply(text, found)

    own = {"languages": languages_col, "jurisdictions": jurisdictions_col, "settings": settings_col}
    made = {"spans": (f"array<{SPAN}>", _SPANS), "mappings": (f"array<{MAPPING}>", _MAPPINGS), "masked": ("string", _S)}
    return _with(docs, _columns(text_col, own, manual_col), made, _start(profile, own, each))


def restored(responses: DataFrame, text_col: str = "masked", mappings_col: str = "mappings", tolerant: bool = True, legacy: bool = True) -> DataFrame:
    """responses with `result`: the restored text and its report."""

    def start():
        return lambda text, table: (restore(text or "", table or [], tolerant, legacy),)

    return _with(responses, [text_col, mappings_col], {"result": (RESTORED, _RESULT)}, start)


def exploded(docs: DataFrame, keys: list[str], column: str = "spans") -> DataFrame:
    """One row per span: keys, seq and the fields of the span."""
    return docs.select(*keys, F.posexplode(column).alias("seq", "s")).select(*keys, "seq", "s.*")
