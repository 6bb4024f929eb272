"""Sessions: a masked document with its mappings as one JSON text, written and read back with every field checked.

`written` makes the JSON of rows; `read` gives a row for each text, with `problem` naming the first check that it
fails and the session null then, so a damaged session is a row and never a wrong document. A session without variants
on its mappings gets the original as the only one. Snapshots are not part of a session here: `operators.snapshots` keeps them.

Defined results: a null text has the problem `json`; numbers and booleans where text is expected are read as their
text; null where a value is needed fails its check; offsets are code points, half-open; fields that are not named here
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.profile import parse_pinned

_SPOT = "struct<start:long,end:long,text:string>"
_MAPPING = (
    "struct<id:string,originalText:string,placeholder:string,category:string,enabled:boolean,confidence:double,source:string,"
    f"variants:array<string>,occurrences:array<{_SPOT}>>"
)
#: The fields of a session in JSON.
SESSION = (
    "struct<sessionId:string,createdAt:string,inputType:string,originalFormat:string,fileName:string,rawMarkdown:string,anonymizedMarkdown:string,"
    f"mappings:array<{_MAPPING}>,coverage:struct<status:string,warnings:array<string>,structuralWarnings:array<string>>,tokenCounter:long,"
    "identity:struct<scope:string,documentId:string,documentRevision:long,policyRevision:long,mappingRevision:long>,"
    "detectionProfile:struct<languages:array<string>,jurisdictions:array<string>>,storageGeneration:string>"
)
# fixed values: what a session may say, and how long it may be
INPUTS = ("PASTE", "FILE")
FORMATS = ("raw_text", "pdf", "docx", "odt", "csv", "xlsx", "eml", "pptx")
SOURCES = ("regex", "ner", "manual", "dictionary")
STATUSES = ("complete", "review", "empty", "failed")
MOST_JSON, MOST_TEXT, MOST_MAPPINGS, MOST_VARIANTS, MOST_ORIGINAL = 8_000_000, 2_000_000, 10_000, 1_000, 100_000
_EXACT = (1 << 53) - 1


def _short(value: Column, most: int) -> Column:
    return value.isNotNull() & (F.length(value) <= most)


def _every(values: Column, test) -> Column:
    """Whether all of a list pass; a null list has none that fail."""
    return F.coalesce(F.forall(values, lambda x: F.coalesce(test(x), F.lit(False))), values.isNull())


def _mapping(m: Column) -> Column:
    variants = (F.coalesce(F.size(m["variants"]), F.lit(0)) <= MOST_VARIANTS) & _every(m["variants"], lambda v: _short(v, MOST_ORIGINAL))
    return (
        _short(m["id"], 200) & _short(m["originalText"], MOST_ORIGINAL) & _short(m["placeholder"], 200) & _short(m["category"], 64)
        & m["enabled"].isNotNull() & m["confidence"].isNotNull() & m["source"].isin(*SOURCES) & variants
    )


def _stands(text: Column):
    """Whether an occurrence lies in the text and holds what it says."""

    def test(o: Column) -> Column:
        inside = (o["start"] >= 0) & (o["end"] > o["start"]) & (o["end"] <= F.length(text))
        return inside & (F.substring(text, (o["start"] + 1).cast("int"), (o["end"] - o["start"]).cast("int")) == o["text"])

    return test


def checks(s: Column, generation: Column) -> list[tuple[str, Column]]:
    """Name and condition of every check, in the order in which they are told."""
    identity, told = s["identity"], s["coverage"]
    revisions = [identity[f"{kind}Revision"].between(0, _EXACT) for kind in ("document", "policy", "mapping")]
    placeholders = F.transform(s["mappings"], lambda m: m["placeholder"])
    profile = parse_pinned(F.to_json(s["detectionProfile"]))
    return [
        ("generation", s["storageGeneration"].isNull() | s["storageGeneration"].eqNullSafe(generation)),
        ("head", s["sessionId"].isNotNull() & s["createdAt"].isNotNull() & s["inputType"].isin(*INPUTS) & s["originalFormat"].isin(*FORMATS)),
        ("text", _short(s["rawMarkdown"], MOST_TEXT) & s["anonymizedMarkdown"].isNotNull()),
        ("mappings", s["mappings"].isNotNull() & (F.size(s["mappings"]) <= MOST_MAPPINGS) & _every(s["mappings"], _mapping)),
        ("placeholders", F.size(F.array_distinct(placeholders)) == F.size(placeholders)),
        ("file name", s["fileName"].isNull() | (F.length(s["fileName"]) <= 1000)),
        ("occurrences", _every(s["mappings"], lambda m: _every(m["occurrences"], _stands(s["rawMarkdown"])))),
        (
            "coverage",
            told.isNull() | (told["status"].isin(*STATUSES) & told["warnings"].isNotNull() & told["structuralWarnings"].isNotNull()
                             & _every(told["warnings"], lambda w: w.isNotNull()) & _every(told["structuralWarnings"], lambda w: w.isNotNull())),
        ),
        ("counter", s["tokenCounter"].isNull() | s["tokenCounter"].between(1, _EXACT)),
        ("identity", identity.isNull() | (identity["scope"].rlike(r"\A[A-F0-9]{32}\z") & identity["documentId"].isNotNull() & revisions[0] & revisions[1] & revisions[2])),
        ("profile", s["detectionProfile"].isNull() | profile.isNotNull()),
    ]


def read(rows: DataFrame, json_col: str = "json", generation: Column | None = None) -> DataFrame:
    """rows with `session` and `problem` in place of the JSON column; one of the two is null.

    generation is the one that stands: sessions of another one were revoked, those without any are taken.
    """
    given = F.col(f"`{json_col}`")
    generation = F.lit(None).cast("string") if generation is None else generation
    others = [c for c in rows.columns if c not in (json_col, "session", "problem")]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    # any part of another type makes the record a broken one
    parsed = F.from_json(given, f"{SESSION[:-1]},broken:string>", {"columnNameOfCorruptRecord": "broken"})
    whole = F.when(F.length(given) <= MOST_JSON, parsed)
    # behind a generator, or every check would parse the text anew
    held = rows.select(row.alias("row"), generation.alias("now"), F.explode(F.array(whole)).alias("s"))
    s = F.col("s")
    failed = [F.when(~F.coalesce(test, F.lit(False)), name) for name, test in checks(s, F.col("now"))]
    told = held.select("row", "s", F.coalesce(F.when(s.isNull() | s["broken"].isNotNull(), "json"), *failed).alias("problem"))
    own = F.transform("s.mappings", lambda m: m.withField("variants", F.when(F.size(m["variants"]) > 0, m["variants"]).otherwise(F.array(m["originalText"]))))
    profile = F.when(s["detectionProfile"].isNotNull(), parse_pinned(F.to_json(s["detectionProfile"])))
    session = s.withField("mappings", own).withField("detectionProfile", profile).dropFields("broken")
    return told.select(*[F.col(f"row.`{c}`") for c in others], F.when(F.col("problem").isNull(), session).alias("session"), "problem")


def written(session: Column) -> Column:
    """The JSON of a session; null fields are left out."""
    return F.to_json(session)


def of_masked(session_id: Column, created_at: Column, text: Column, masked: Column, mappings: Column, original_format: Column, generation: Column | None = None) -> Column:
    """The session of a row that `detect.mask` gave."""
    own = F.transform(
        mappings,
        lambda m: F.struct(
            m["id"].alias("id"), m["original_text"].alias("originalText"), m["placeholder"].alias("placeholder"), m["category"].alias("category"),
            m["enabled"].alias("enabled"), m["confidence"].alias("confidence"), m["source"].alias("source"), m["variants"].alias("variants"), m["occurrences"].alias("occurrences"),
        ),
    )
    return F.struct(
        session_id.cast("string").alias("sessionId"), created_at.cast("string").alias("createdAt"), F.lit("FILE").alias("inputType"), original_format.alias("originalFormat"),
        F.coalesce(text, F.lit("")).alias("rawMarkdown"), masked.alias("anonymizedMarkdown"), own.alias("mappings"),
        (F.lit(None).cast("string") if generation is None else generation).alias("storageGeneration"),
    )
