"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row: type, record_id, refers_to, target_uri, date, headers (name and value, in order) and block.
Derived records name the response they come from in WARC-Refers-To, keep its target, date and digests, and carry
its HTTP headers in the metadata block. Their own identifiers are name-based on the response's, so a rerun gives
the same ones. Chunked transfer and the encodings gzip and deflate are undone first; a body that does not have the
form its headers name counts as decoded already. A body of another encoding (br) or of a media type that is not
text, and one that breaks off undecodably, gives its metadata record only. Files are read and written by Spark's own readers and writers: plain or gzip-compressed.

Defined results: a page without a URL has the URI urn:page:<id>; null pages have an empty body; repeated rows of an
id and a URL are one capture, whose record is written as often as the row is there and keeps its identifier; records
that break off or lack a length become rows with a `problem`, after which their file is not read on; a record of more
than LARGEST bytes is passed over and has a `problem`, as has a file of more than LARGEST_FILE; a body that inflates
beyond LARGEST gives its metadata only; a charset that is unknown or no charset is read as UTF-8, and what cannot be
decoded becomes replacement characters, while digests are those of the bytes; a response without an identifier gets
one of its content; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: Bytes of records that go on together.
BATCH = 8 << 20
CRLF = "\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = (
    "type string, record_id string, refers_to string, target_uri string, date string, "
    "headers array<struct<name:string,value:string>>, block binary, problem string"
)
#: Bytes that a body may inflate to, and a record may have: one task holds that much at a time.
LARGEST = 256 << 20
#: Files beyond this cannot be read as one value; they become rows with a problem.
LARGEST_FILE = (1 << 31) - (1 << 20)
_BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li ul ol tr table section article nav footer header title head body html blockquote pre".split())
_RAW = frozenset(("script", "style", "noscript", "template"))
_OPENED = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_HREF = re.compile(r"""\bhref\s*=\s*["']?([^"'\s>]+)""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_LONG_NUMBER = re.compile(r"&#(?:\d{8,}|[xX][0-9a-fA-F]{7,});?")
#: Charsets that are looked up; any other name means UTF-8. Codecs that are no charsets (idna, unicode_escape) are out.
_CHARSET = re.compile(r"(?:utf|ucs|iso|latin|windows|cp|koi8|mac|us|ascii|gb|hz|big5|euc|shift|sjis|ms|tis|viscii|x)[\w.-]*", re.I)
_NO_CHARSET = frozenset(("utf-7", "mbcs", "oem"))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, ' '.join(parts))}>"


@dataclass
class Page:
    """What a page holds: visible text, one line a block; title, language and links, null where it has none."""

    text: str
    title: str | None
    lang: str | None
    links: list[str]


def unescaped(text: str) -> str:
    """Character references resolved; a number that is no code point is one replacement character."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text))


def read_page(page: str) -> Page:
    """One forward pass over the tags of a page: every character is looked at a bounded number of times.

    Comments, declarations and the insides of scripts, styles, templates and noscript go; one that is not closed goes
    to the page's end. A `<` that opens no tag is text.
    """
    parts: list[str] = []
    links: list[str] = []
    title = lang = None
    at, low = 0, page.lower()
    low = low if len(low) == len(page) else "".join(c.lower() if c.isascii() else c for c in page)
    ends = {name: 0 for name in _RAW | {"title"}}

    def closing(name: str, start: int) -> int:
        """Where the next end tag of that name begins, or the page's length; a name's ends are never looked for twice."""
        if ends[name] < start:
            found = low.find(f"</{name}", start)
            ends[name] = len(page) if found < 0 else found
        return ends[name]

    while at < len(page):
        tag = _OPENED.search(page, at)
        if not tag:
            parts.append(page[at:])
            break
        opened = tag.start()
        parts.append(page[at:opened])
        if page.startswith("<!--", opened):
            shut = page.find("-->", opened + 4)
            at = len(page) if shut < 0 else shut + 3
            continue
        shut = page.find(">", opened)
        if shut < 0:
            parts.append(page[opened:])
            break
        at = shut + 1
        named = _NAME.match(low, opened + 1, shut)
        if not named:
            continue
        name, begins = named[1], low[opened + 1] != "/"
        if name in _BLOCKS:
            parts.append("\n")
        if begins and name in _RAW:
            end = closing(name, at)
            shut = page.find(">", end)
            at = len(page) if shut < 0 else shut + 1
        elif begins and name == "title" and title is None:
            end = closing("title", at)
            if end < len(page):
                title = " ".join(unescaped(page[at:end]).split())
        elif begins and name == "a" and (link := _HREF.search(page, opened, shut)):
            links.append(unescaped(link[1]))
        elif begins and name == "html" and lang is None and (found := _LANG.search(page, opened, shut)):
            lang = found[1]
    lines = (" ".join(line.split()) for line in unescaped("".join(parts)).split("\n"))
    return Page("\n".join(line for line in lines if line), title, lang, links)


def charset_of(name: str) -> str:
    """The codec of a charset's name, UTF-8 for what is none."""
    try:
        known = codecs.lookup(name).name if _CHARSET.fullmatch(name) else "utf-8"
    except (LookupError, ValueError):
        return "utf-8"
    return "utf-8" if known in _NO_CHARSET or not codecs.lookup(known)._is_text_encoding else known


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record with the two line ends that close it."""
    head = "".join(f"{n}: {v}{CRLF}" for n, v in headers)
    return f"{VERSION}{CRLF}{head}{CRLF}".encode() + block + (CRLF + CRLF).encode()


class _Stream:
    """The bytes of a file, decompressed as they are asked for; gzip files may have many members."""

    def __init__(self, data: bytes):
        packed = data[:2] == b"\x1f\x8b"
        self.source = gzip.GzipFile(fileobj=io.BytesIO(data)) if packed else io.BytesIO(data)
        self.held = b""
        self.broken = ""

    def fill(self, n: int) -> bool:
        """Whether n bytes are held, after reading what is missing."""
        while len(self.held) < n and not self.broken:
            try:
                more = self.source.read(max(n - len(self.held), 1 << 16))
            except (OSError, EOFError, zlib.error) as problem:
                self.broken, more = f"compressed data: {problem}", b""
            if not more:
                self.broken = self.broken or "end"
            self.held += more
        return len(self.held) >= n

    def skip(self, n: int) -> bool:
        """Whether n bytes went by; no more than some of them are held."""
        while n and self.fill(min(n, 1 << 20)):
            n -= len(self.take(min(n, 1 << 20)))
        return n == 0

    def take(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        return out


HEAD = 1 << 20


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """Headers, block and problem (null) of each record; Content-Length says where a block ends.

    Where a file breaks off or is no WARC any more, the last record has what is there and says what is wrong. Only
    the record at hand is held decompressed.
    """
    stream = _Stream(data)
    while True:
        while stream.fill(2) and stream.held[:2] == b"\r\n":
            stream.take(2)
        if not stream.held:
            if stream.broken not in ("", "end"):
                yield [], b"", stream.broken
            return
        size, end = 1 << 12, -1
        while end < 0 and size <= HEAD:
            more = stream.fill(size)
            end = stream.held.find(b"\r\n\r\n")
            size = size * 2 if more else HEAD + 1
        if end < 0 or not stream.held.startswith(b"WARC/"):
            yield [], stream.held, "no WARC record" if not stream.held.startswith(b"WARC/") else f"headers break off ({stream.broken or 'too long'})"
            return
        lines = stream.take(end + 4)[:-4].decode("utf-8", "replace").split(CRLF)
        headers: list[tuple[str, str]] = []
        for line in lines[1:]:
            if line[:1] in " \t" and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                headers.append((name.strip(), value.strip()))
        length = next((v for n, v in headers if n.lower() == "content-length"), "")
        if not (length.isascii() and length.isdigit() and len(length) < 19):
            yield headers, stream.held, "no Content-Length"
            return
        if int(length) > LARGEST:
            yield headers, b"", f"block of more than {LARGEST} bytes"
            if not stream.skip(int(length)):
                return
            continue
        if not stream.fill(int(length)):
            yield headers, stream.held, f"block breaks off ({stream.broken})"
            return
        yield headers, stream.take(int(length)), None


def _row(headers: list[tuple[str, str]], block: bytes, problem: str | None = None) -> tuple:
    known = {n.lower(): v for n, v in reversed(headers)}
    fields = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date")
    return (*(known.get(n) for n in fields), [{"name": n, "value": v} for n, v in headers], block, problem)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[p.split()[0] for p in RECORD.split(", ")])


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records for a table of crawled pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, url, page in zip(batch["id"], batch["url"], batch["html"]):
                body = (page if isinstance(page, str) else "").encode("utf-8")
                uri = url if isinstance(url, str) and url else f"urn:page:{key}"
                http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(body)}{CRLF}{CRLF}".encode()
                block = http + body
                headers = [
                    ("WARC-Type", "response"),
                    ("WARC-Record-ID", named_id("response", str(key), uri)),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", uri),
                    ("WARC-Payload-Digest", digest(body)),
                    ("WARC-Block-Digest", digest(block)),
                    ("Content-Type", "application/http;msgtype=response"),
                    ("Content-Length", str(len(block))),
                ]
                rows.append(_row(headers, block))
            yield _frame(rows)

    rows = pages.selectExpr(f"cast(`{id_col}` as string) as id", f"`{url_col}` as url", f"`{html_col}` as html")
    return rows.mapInPandas(run, RECORD)


_TEXTUAL = re.compile(r"text/|application/([\w.-]+\+)?(xml|json)\b|application/(xhtml|javascript|x-javascript|ecmascript)\b|image/svg\+xml", re.I)
_CHUNK = re.compile(rb"([0-9a-fA-F]+)[ \t]*(?:;[^\r\n]*)?\r?\n")


def unchunked(body: bytes) -> bytes:
    """The data of a chunked body; of one that breaks off, what is there."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            break
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(out) if out or m else body


def inflated(body: bytes, coding: str) -> bytes | None:
    """The body without one content coding, or None where it cannot be undone."""
    if coding in ("", "identity"):
        return body
    if coding in ("gzip", "x-gzip"):
        if not body.startswith(b"\x1f\x8b"):
            return body
        kinds = (31,)
    elif coding == "deflate":
        kinds = (15, -15)
    else:
        return None
    for kind in kinds:
        out, rest, left = [], body, LARGEST
        try:
            while rest and (kind != 31 or rest.startswith(b"\x1f\x8b")):  # gzip may have several members
                undo = zlib.decompressobj(kind)
                out.append(undo.decompress(rest, left + 1))
                left -= len(out[-1])
                if left < 0:
                    return None
                rest = undo.unused_data if kind == 31 else b""
            return b"".join(out)
        except zlib.error:
            continue
    return None


def payload_text(http: list[str], body: bytes) -> bytes | None:
    """The decoded body of an HTTP response, or None where it is no text or cannot be decoded."""
    named: dict[str, str] = {}
    for line in http[1:]:
        name, _, value = line.partition(":")
        name = name.strip().lower()
        named[name] = f"{named[name]},{value.strip()}" if name in named else value.strip()
    media = named.get("content-type", "")
    if media and not _TEXTUAL.match(media):
        return None
    transfers = [c.strip().lower() for c in named.get("transfer-encoding", "").split(",")]
    codings = [c.strip().lower() for c in named.get("content-encoding", "").split(",")]
    for coding in [*reversed(transfers), *reversed(codings)]:
        body = unchunked(body) if coding == "chunked" else inflated(body, coding)
        if body is None:
            return None
    return body


def derive_one(headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
    """The metadata record of one response and, where its body is text, the conversion record."""
    known = {n.lower(): v for n, v in reversed(headers)}
    source, uri, date = known.get("warc-record-id", ""), known.get("warc-target-uri", ""), known.get("warc-date", "")
    head, split, body = block.partition(b"\r\n\r\n")
    http = head.decode("utf-8", "replace").split(CRLF) if split and head.startswith(b"HTTP/") else []
    if not http:
        body = block
    charset = next((m[1] for line in http for m in [re.search(r"charset=[\"']?([\w.-]+)", line, re.I)] if m), "utf-8")
    decoded = payload_text(http, body)
    page = read_page((decoded or b"").decode(charset_of(charset), "replace"))
    if not source:  # named by what it holds, or all nameless responses would share their derived ids
        source = named_id("nameless", uri, date, digest(block))
    payload = known.get("warc-payload-digest") or digest(body)
    linked = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri)]
    fields = [("source-payload-digest", payload)]
    if "warc-block-digest" in known:
        fields.append(("source-block-digest", known["warc-block-digest"]))
    fields += [("source-status", http[0])] if http else []
    fields += [("source-header", line) for line in http[1:]]
    fields += [("title", page.title)] if page.title is not None else []
    fields += [("language", page.lang)] if page.lang else []
    fields += [("outlink", link) for link in page.links]
    about = "".join(f"{n}: {v}{CRLF}" for n, v in fields).encode("utf-8", "replace")
    text = page.text.encode("utf-8", "replace")
    out = []
    for kind, data, content in (("metadata", about, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        if kind == "conversion" and decoded is None:
            continue
        out.append(
            _row(
                [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", named_id(kind, source)),
                    ("WARC-Date", date),
                    *linked,
                    ("WARC-Source-Payload-Digest", payload),
                    ("WARC-Block-Digest", digest(data)),
                    ("Content-Type", content),
                    ("Content-Length", str(len(data))),
                ],
                data,
            )
        )
    return out


def derive(records: DataFrame) -> DataFrame:
    """The derived records of each whole response among the records; others and damaged ones give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for headers, block in zip(batch["headers"], batch["block"]):
                made = derive_one([(h["name"], h["value"] or "") for h in headers], bytes(block))
                rows += made
                size += sum(len(r[6]) + 1000 for r in made)
                if size >= BATCH:
                    yield _frame(rows)
                    rows, size = [], 0
            yield _frame(rows)

    whole = (F.col("type") == "response") & F.col("problem").isNull()
    return records.filter(whole).select("headers", "block").mapInPandas(run, RECORD)


def read_warc(spark, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files; a damaged record has a `problem` and ends its file, never the job.

    A task holds the compressed bytes of one file, one decompressed record and a batch of rows of about BATCH bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for headers, block, problem in parse(bytes(content)):
                    rows.append(_row(headers, block, problem))
                    size += len(block) + 1000
                    if size >= BATCH:
                        yield _frame(rows)
                        rows, size = [], 0
                yield _frame(rows)

    files = spark.read.format("binaryFile").load(path)
    whole = files.where(F.col("length") <= LARGEST_FILE).select("content").mapInPandas(run, RECORD)
    # the content of a larger file is never asked for
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema if f.name not in ("target_uri", "problem")]
    large = files.where(F.col("length") > LARGEST_FILE).select(F.col("path").alias("target_uri"), F.lit(f"file of more than {LARGEST_FILE} bytes").alias("problem"), *none)
    return whole.unionByName(large)


def write_warc(records: DataFrame, path: str, compress: bool = True) -> None:
    """Write text records; each part is a WARC file, whole records one after another."""
    head = F.concat(
        F.lit(VERSION + CRLF),
        F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit(CRLF))), ""),
        F.lit(CRLF),
    )
    writer = records.select(F.concat(head, F.decode("block", "UTF-8")).alias("value")).write.option("lineSep", CRLF + CRLF)
    (writer.option("compression", "gzip") if compress else writer).text(path)


def digests(records: DataFrame) -> DataFrame:
    """What a report shows of each record: links, sizes, headers as one string and the text of the block."""
    return records.select(
        "record_id",
        F.col("type").alias("record_type"),
        "refers_to",
        "target_uri",
        F.col("date").alias("warc_date"),
        F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n").alias("headers"),
        F.octet_length("block").cast("long").alias("n_bytes"),
        F.sha2("block", 256).alias("block_sha256"),
        F.decode("block", "UTF-8").alias("block"),
    )
