"""What leaves: findings that hold it back, text, page and sheet forms, and the sealed key to undo it."""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.scalars import escape_html
from maskwright.operators import markdown

PLACEHOLDER = r"(\[\[[A-Z][A-Z0-9_]*\]\])"
# Limits and shapes of the gate.
MOST_CHARACTERS = 4_000_000
RESIDUE = r"https?://|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|(?<![A-Za-z0-9_])(?:\d[ -]?){13,19}(?![A-Za-z0-9_])"


def findings(output: Column, source: Column, mappings: Column, status: Column, warnings: Column, scan: Column, categories_off: Column) -> Column:
    """blocked: why the output may not leave; review: what somebody must look at first. status: of the import, see files.

    scan is pending, ready or failed.
    """
    nothing = (F.trim(output) == "") | (F.trim(source) == "") | status.isin("empty", "failed")
    blocked = F.array_compact(
        F.array(
            F.when(nothing, "no readable content"),
            F.when(F.coalesce(scan, F.lit("pending")) != "ready", "processing is incomplete"),
            F.when(F.length(output) > MOST_CHARACTERS, "the output is too long"),
        )
    )
    live = F.filter(mappings, lambda m: m["enabled"])
    left = F.exists(live, lambda m: F.exists(m["variants"], lambda v: (v != "") & F.contains(output, v)))
    review = F.array_compact(
        F.concat(
            F.when(status == "review", F.coalesce(warnings, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
            F.array(
                F.when(categories_off > 0, F.concat(categories_off.cast("string"), F.lit(" categories are switched off"))),
                F.when(F.exists(mappings, lambda m: ~m["enabled"]), "some values were left visible"),
                F.when(left, "an original value remains"),
                F.when(output.rlike(RESIDUE), "links, addresses or long numbers remain"),
                F.when(F.contains(source, F.lit("[[V1_")), "the source holds text shaped like tokens"),
            ),
        )
    )
    return F.struct(blocked.alias("blocked"), F.array_distinct(review).alias("review"))


def released(rows: DataFrame, found_col: str = "findings", acknowledged_col: str = "acknowledged", unattended: bool = False) -> DataFrame:
    """The rows that may leave: nothing blocks them, and what needs review was acknowledged by somebody."""
    found = F.col(found_col)
    looked = F.lit(False) if unattended else F.coalesce(F.col(acknowledged_col), F.lit(False))
    return rows.filter((F.size(found["blocked"]) == 0) & ((F.size(found["review"]) == 0) | looked))


def highlighted(text: Column) -> Column:
    """Escaped text with every placeholder marked."""
    return F.regexp_replace(escape_html(text), PLACEHOLDER, "<mark>$1</mark>")


def page(text: Column, title: str, marked: bool = True) -> Column:
    """A page that stands alone: no script, no link, no font."""
    body = highlighted(text) if marked else escape_html(text)
    head = f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{title}</title><style>pre{{white-space:pre-wrap}}</style></head>\n<body><pre>'
    return F.concat(F.lit(head), body, F.lit("</pre></body></html>\n"))


def exported(docs: DataFrame, keys: list[str], side: str = "sanitized", marked: bool = True, text_col: str = "text") -> DataFrame:
    """keys, kind (txt, md, html), file_name, mime and content: every text as it is, as Markdown that loads nothing and
    as a page that stands alone. Names of files tell nothing of their source.
    """
    stem = f"document-{side}"
    none = docs.select(*keys, F.lit("").alias("token"), F.lit("").alias("original")).where("false")
    texts = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    whole = markdown.structured(texts, none, keys, "__text", kept=("__text",)).select(*keys, "__text", F.col("html").alias("__html"), F.col("markdown").alias("__markdown"))
    body = F.regexp_replace("__html", PLACEHOLDER, "<mark>$1</mark>") if marked else F.col("__html")
    head = f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{stem}</title><style>pre{{white-space:pre-wrap}}</style></head>\n<body>\n'
    forms = {"txt": ("text/plain", F.col("__text")), "md": ("text/markdown", F.col("__markdown")), "html": ("text/html", F.concat(F.lit(head), body, F.lit("\n</body></html>\n")))}
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(f"{stem}.{k}").alias("file_name"), F.lit(f"{m};charset=utf-8").alias("mime"), c.alias("content")) for k, (m, c) in forms.items()]
    return whole.select(*keys, F.explode(F.array(*rows)).alias("f")).select(*keys, "f.*")


def write_text(rows: DataFrame, path: str, text_col: str = "masked") -> None:
    """One JSON line per document (id columns and text), as text files of any number."""
    rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value")).write.text(path)


# sheets

_RULE_ROW = re.compile(r"\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*")


def tables(markdown: str) -> list[tuple[str | None, list[list[str]]]]:
    """The tables of a text, each with the heading of the second level before it."""
    lines = markdown.split("\n")
    out, heading, at = [], None, 0
    while at < len(lines):
        if named := re.fullmatch(r"##\s+(.+?)\s*", lines[at]):
            heading = named[1]
        elif lines[at].lstrip().startswith("|") and at + 1 < len(lines) and _RULE_ROW.fullmatch(lines[at + 1].strip()):
            rows = [lines[at]]
            at += 2
            while at < len(lines) and lines[at].lstrip().startswith("|"):
                rows.append(lines[at])
                at += 1
            out.append((heading, [[c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|\Z", "", r.strip().removeprefix("|")))] for r in rows]))
            heading = None
            continue
        at += 1
    return out


def sheet_names(given: list[str | None]) -> list[str]:
    """Names that sheets may have: 31 characters, no brackets or slashes, no two alike but for case."""
    used: set[str] = set()
    out = []
    for i, name in enumerate(given, 1):
        base = re.sub(r"[\[\]:*?/\\]", "_", name or f"Sheet{i}")[:31] or f"Sheet{i}"
        own, n = base, 2
        while own.lower() in used:
            own, n = base[: 31 - len(f" ({n})")] + f" ({n})", n + 1
        used.add(own.lower())
        out.append(own)
    return out


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def workbook(markdown: str) -> bytes | None:
    """A workbook of the tables of a text, every cell as text; None where there is no table."""
    from xml.sax.saxutils import escape, quoteattr

    found = tables(markdown)
    if not found:
        return None
    names = sheet_names([n for n, _ in found])
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(names) + 1)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>'
        + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">'
        + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>",
    }
    for i, (_, rows) in zip(numbers, found):
        body = "".join(
            f'<row r="{r}">' + "".join(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row) if v) + "</row>"
            for r, row in enumerate(rows, 1)
        )
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + xml)
    return out.getvalue()


def workbooks(docs: DataFrame, text_col: str = "text", format_col: str = "format") -> DataFrame:
    """docs with `workbook`: the sheets of documents that came as csv or xlsx, else null."""
    make = F.pandas_udf(lambda texts: pd.Series([workbook(t) if isinstance(t, str) else None for t in texts], dtype=object), "binary")
    return docs.withColumn("workbook", F.when(F.col(format_col).isin("csv", "xlsx"), make(F.col(text_col))))


# sealed keys

LEAST_ROUNDS, MOST_ROUNDS = 600_000, 1_000_000
# The published form of a sealed key.
VERSION, CIPHER, DERIVATION = 1, "AES-256-GCM", "PBKDF2-HMAC-SHA256"
FIELDS = ("version", "algorithm", "kdf", "iterations", "salt", "nonce", "ciphertext")
LONGEST_ENVELOPE, LONGEST_PAYLOAD = 8_010_000, 4_000_000


def _keys(headers: DataFrame, password: str) -> DataFrame:
    """headers (salt in hex, iterations), each once, with the key that the password gives under them.

    A key is a value of a row and the password a part of the function, so neither stands in a plan or an event log.
    """
    if not 1 <= len(password.encode("utf-16-le")) // 2 <= 1024:
        raise ValueError("a password has 1 to 1024 characters")

    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = lambda salt, rounds: hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt), int(rounds), 32)
            yield batch.assign(key=[key(*h) for h in zip(batch["salt"], batch["iterations"])])

    return headers.select("salt", "iterations").distinct().mapInPandas(derive, "salt string, iterations int, key binary")


def _bound(salt: Column, nonce: Column, rounds: Column) -> Column:
    """The data that a ciphertext is bound to: the header as a JSON array."""
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat(F.lit(f'[{VERSION},"{CIPHER}","{DERIVATION}",'), rounds.cast("string"), F.lit(","), text(salt), F.lit(","), text(nonce), F.lit("]"))


def seal(snapshots: DataFrame, password: str, json_col: str = "snapshot", rounds: int = LEAST_ROUNDS, salt: bytes | None = None) -> DataFrame:
    """snapshots with `envelope`: the JSON text encrypted under a key of the password, in the published form.

    Each row has its own nonce; header and ciphertext belong together, so a changed header opens nothing. A payload
    beyond LONGEST_PAYLOAD bytes has no envelope. Nonces are drawn when the rows are computed: write the result once.
    """
    if not LEAST_ROUNDS <= rounds <= MOST_ROUNDS:
        raise ValueError(f"rounds from {LEAST_ROUNDS} to {MOST_ROUNDS}")
    header = snapshots.sparkSession.range(1).select(F.lit((salt or os.urandom(16)).hex()).alias("salt"), F.lit(rounds).alias("iterations"))
    key = _keys(header, password).select("key").scalar()
    drawn = snapshots.withColumn("__nonce", F.substring(F.sha2(F.concat(F.uuid(), F.uuid()).cast("binary"), 256), 1, 24))
    shown = F.lit((salt or b"").hex()) if salt else header.select("salt").scalar()
    whole = F.aes_encrypt(F.col(json_col).cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.unhex("__nonce"), _bound(shown, F.col("__nonce"), F.lit(rounds)))
    # the cipher puts the nonce in front; the envelope has it as a field of its own
    cipher = F.lower(F.hex(F.substring(whole, 13, 2**31 - 1)))
    parts = F.struct(
        F.lit(VERSION).alias("version"), F.lit(CIPHER).alias("algorithm"), F.lit(DERIVATION).alias("kdf"), F.lit(rounds).alias("iterations"),
        shown.alias("salt"), F.col("__nonce").alias("nonce"), cipher.alias("ciphertext"),
    )
    fits = F.octet_length(json_col) <= LONGEST_PAYLOAD
    return drawn.withColumn("envelope", F.when(fits, F.to_json(parts))).drop(json_col, "__nonce")


def unseal(envelopes: DataFrame, password: str, envelope_col: str = "envelope") -> DataFrame:
    """envelopes with `snapshot`; null where the password or the header is wrong, or the envelope has another form.

    Keys are derived once for each salt, on the executors, and meet their envelopes by a join: a table may hold any
    number of sealings.
    """
    shape = "struct<version:int,algorithm:string,kdf:string,iterations:int,salt:string,nonce:string,ciphertext:string>"
    e, text = F.col("__e"), F.col(envelope_col)
    fields = F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(f) for f in sorted(FIELDS)])
    hexes = e["salt"].rlike(r"^[a-f0-9]{32}\z") & e["nonce"].rlike(r"^[a-f0-9]{24}\z") & e["ciphertext"].rlike(r"^[a-f0-9]{32,}+\z") & (F.length(e["ciphertext"]) % 2 == 0)
    known = (e["version"] == VERSION) & (e["algorithm"] == CIPHER) & (e["kdf"] == DERIVATION) & e["iterations"].between(LEAST_ROUNDS, MOST_ROUNDS)
    good = F.coalesce((F.length(text) <= LONGEST_ENVELOPE) & fields & known & hexes, F.lit(False))
    rows = envelopes.withColumn("__e", F.from_json(text, shape)).withColumn("__salt", F.when(good, e["salt"])).withColumn("__rounds", F.when(good, e["iterations"]))
    headers = rows.where("__salt is not null").select(F.col("__salt").alias("salt"), F.col("__rounds").alias("iterations"))
    keys = _keys(headers, password).withColumnsRenamed({"salt": "__key_salt", "iterations": "__key_rounds", "key": "__key"})
    met = rows.join(keys, (F.col("__salt") == F.col("__key_salt")) & (F.col("__rounds") == F.col("__key_rounds")), "left")
    sealed = F.unhex(F.concat(e["nonce"], e["ciphertext"]))
    opened = F.try_aes_decrypt(sealed, F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), _bound(e["salt"], e["nonce"], e["iterations"]))
    out = F.when(F.col("__key").isNotNull(), opened.cast("string"))
    return met.withColumn("snapshot", out).drop("__e", "__salt", "__rounds", "__key", "__key_salt", "__key_rounds")
