"""WARC derivatives of hostile input, and of random pages against another derivation."""

from __future__ import annotations

import gzip
import hashlib
import html
import random
import re
import time

import pytest

from maskwright.llm import warc

GONE = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<!doctype[^>]*>", re.S | re.I)
BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|nav|footer|header|title|head|body|html|blockquote|pre)\b[^>]*>", re.I)


def by_patterns(page: str) -> tuple:
    """What a small whole page holds, by patterns that scan it again and again."""
    text = html.unescape(re.sub(r"<[a-zA-Z/!?][^>]*>", "", BREAK.sub("\n", GONE.sub("", page))))
    lines = [" ".join(line.split()) for line in text.split("\n")]
    title = re.search(r"<title[^>]*>(.*?)</title", page, re.S | re.I)
    lang = re.search(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", page, re.I)
    links = re.findall(r"""<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", page, re.I)
    return ("\n".join(x for x in lines if x), " ".join(html.unescape(title[1]).split()) if title else None, lang[1] if lang else None, [html.unescape(x) for x in links])


def random_page(draw: random.Random) -> str:
    words = ["one", "t&amp;wo", "thrée", "a < b", "&#65;", "  ", "x&nbsp;y", "\n"]
    kinds = ["<p>{}</p>", "<div class='a'>{}</div>", "<b>{}</b>", "<br>{}", "<!-- {} -->", "<script>if (a) {}</script>", "<STYLE>{}</STYLE >", '<a href="/p?a=1&amp;b={}">link</a>', "<li>{}", "<span>{}"]
    body = "".join(draw.choice(kinds).replace("{}", draw.choice(words)) for _ in range(draw.randint(0, 30)))
    head = draw.choice(["", "<title> A &lt;b&gt;\n title</title>", "<TITLE lang=x>two</TITLE><title>three</title>"])
    return f"{draw.choice(['', '<!DOCTYPE html>'])}<html{draw.choice(['', ' lang=en-GB', ' data-x=1 lang=\"de\"'])}><head>{head}</head><body>{body}</body></html>"


def test_random_pages_equal_the_patterns():
    draw = random.Random(8)
    for _ in range(400):
        page = random_page(draw)
        found = warc.read_page(page)
        assert (found.text, found.title, found.lang, found.links) == by_patterns(page), page


@pytest.mark.parametrize("unit", ["<!--", "<script>", "<a ", "<title>", "<template><script>", "</script", "<a href  ", "&#1", "<"])
def test_hostile_pages_take_linear_time(unit):
    began = time.time()
    warc.read_page(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 10


def response(http: str, body: bytes, **headers: str) -> tuple[list[tuple[str, str]], bytes]:
    block = http.replace("\n", "\r\n").encode() + b"\r\n\r\n" + body
    return [("WARC-Type", "response"), *((k.replace("_", "-"), v) for k, v in headers.items())], block


@pytest.mark.parametrize("charset", ["undefined", "idna", "unicode_escape", "punycode", "utf-7", "hex", "utf-16", "no-such", "x" * 99, "koi8-r"])
def test_any_charset_gives_records(charset):
    headers, block = response(f"HTTP/1.1 200 OK\nContent-Type: text/html; charset={charset}", b"<p>\\ud800 \xff\xfe &#xD800; &#" + b"9" * 5000 + b";</p>", WARC_Record_ID="<urn:uuid:1>")
    kinds = [r[0] for r in warc.derive_one(headers, block)]
    assert kinds == ["metadata", "conversion"]


def test_lengths_that_are_none_and_bodies_that_burst(monkeypatch):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\nrest"
    assert [problem for _, _, problem in warc.parse(record)] == ["no Content-Length"]
    monkeypatch.setattr(warc, "LARGEST", 1000)
    small = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    large = b"WARC/1.1\r\nWARC-Type: y\r\nContent-Length: 5000\r\n\r\n" + b"z" * 5000 + b"\r\n\r\n"
    found = list(warc.parse(gzip.compress(small + large + small)))
    assert [(b, p is None) for _, b, p in found] == [(b"abc", True), (b"", False), (b"abc", True)]
    headers, block = response("HTTP/1.1 200 OK\nContent-Type: text/html\nContent-Encoding: gzip", gzip.compress(b"a" * 5000), WARC_Record_ID="<urn:uuid:2>")
    assert [r[0] for r in warc.derive_one(headers, block)] == ["metadata"]


def test_responses_without_identifiers_keep_apart():
    made = [warc.derive_one(*response("HTTP/1.1 200 OK\nContent-Type: text/html", body)) for body in (b"<p>one", b"<p>two")]
    assert len({r[1] for rows in made for r in rows}) == 4


def test_hostile_records_do_not_end_the_job(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{}>\r\nContent-Length: {}\r\n\r\n"
    out = b""
    for i, charset in enumerate(["undefined", "idna", "unicode_escape", "utf-8"]):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n<p>t{i}</p>".encode()
        out += head.format(i, len(block)).encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(out)
    rows = warc.derive(warc.read_warc(spark, str(tmp_path))).where("type = 'conversion'").collect()
    assert sorted(bytes(r["block"]) for r in rows) == [b"t0", b"t1", b"t2", b"t3"]


def test_query_equals_another_derivation(spark, tmp_path):
    draw = random.Random(9)
    pages = [(i, f"http://h/{i}", random_page(draw)) for i in range(40)] + [(99, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    from maskwright.llm import queries

    got = {(r["target_uri"], r["record_type"]): r for r in queries.op4_warc(spark, str(tmp_path)).collect()}
    assert len(got) == 2 * len(pages)
    for i, url, page in pages:
        uri = url or f"urn:page:{i}"
        text, title, lang, links = by_patterns(page or "")
        r = got[uri, "conversion"]
        assert (r["block"], r["n_bytes"], r["block_sha256"]) == (text, len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
        about = [line.partition(": ")[::2] for line in got[uri, "metadata"]["block"].split("\r\n") if line]
        assert [v for n, v in about if n == "outlink"] == links
        assert [v for n, v in about if n == "title"] == ([title] if title is not None else [])
        assert [v for n, v in about if n == "language"] == ([lang] if lang else [])
        assert ("source-payload-digest", warc.digest((page or "").encode())) in about
        assert r["refers_to"] == got[uri, "metadata"]["refers_to"] == warc.named_id("response", str(i), uri)
