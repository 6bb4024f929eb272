"""Office files and mail as text: headings, lists and tables as Markdown, never emphasis; what is dropped is said.

Each reader takes a file's bytes and gives its text and warnings. Archives are opened within limits, see LIMITS.
"""

from __future__ import annotations

import datetime
import email
import email.policy
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as X

from maskwright.sources.csvs import table_of
from maskwright.sources.pages import to_markdown

Read = tuple[str, list[str]]
# Entries, bytes of an entry, bytes in all that an archive may expand to.
LIMITS = (2000, 2_000_000, 20_000_000)
MANY_ROWS, LAST_COLUMN = 5000, 16383
# Numbers of the built-in formats that show dates, and percentages with their decimals.
DATE_FORMATS = {*range(14, 23), 45, 46, 47}
PERCENT_FORMATS = {9: 0, 10: 2}


def opened(content: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(content))
    entries = archive.infolist()
    if len(entries) > LIMITS[0] or any(e.file_size > LIMITS[1] for e in entries) or sum(e.file_size for e in entries) > LIMITS[2]:
        raise ValueError("the archive expands beyond the limits")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> X.Element | None:
    if name not in archive.namelist():
        return None
    with archive.open(name) as f:
        data = f.read(LIMITS[1] + 1)
    if len(data) > LIMITS[1] or b"<!DOCTYPE" in data[:4096]:
        raise ValueError(f"{name} is too large or has a document type")
    return X.fromstring(data)


def _tag(e: X.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(root: X.Element | None, *names: str) -> list[X.Element]:
    return [] if root is None else [e for e in root.iter() if isinstance(e.tag, str) and _tag(e) in names]


def _kids(e: X.Element, *names: str) -> list[X.Element]:
    return [c for c in e if isinstance(c.tag, str) and (not names or _tag(c) in names)]


def _get(e: X.Element, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def _flat(text: str) -> str:
    return " ".join(text.split())


def _text(e: X.Element) -> str:
    return _flat("".join(e.itertext()))


def _people(names: list[str]) -> str:
    return ", ".join(dict.fromkeys(n for n in names if n))


# spreadsheets


def _styles(archive: zipfile.ZipFile) -> tuple[set[int], dict[int, int]]:
    """Which cell styles show dates, and which percentages with how many decimals."""
    root = _xml(archive, "xl/styles.xml")
    dates, percents = set(DATE_FORMATS), dict(PERCENT_FORMATS)
    for f in _all(root, "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", ""))
        if "%" in code.split(";")[0]:
            shown = re.search(r"\.([0#?]+)", code.split(";")[0])
            percents[int(f.get("numFmtId", -1))] = len(shown[1]) if shown else 0
        elif re.search("[dmyhs]", code, re.I):
            dates.add(int(f.get("numFmtId", -1)))
    kinds = [int(x.get("numFmtId", 0)) for t in _all(root, "cellXfs")[:1] for x in _kids(t, "xf")]
    return {i for i, k in enumerate(kinds) if k in dates and k not in percents}, {i: percents[k] for i, k in enumerate(kinds) if k in percents}


def _cell(c: X.Element, strings: list[str], dates: set[int], percents: dict[int, int]) -> str:
    kind = c.get("t", "n")
    raw = next((v.text or "" for v in _kids(c, "v")), "")
    if kind == "s":
        return strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
    if kind == "inlineStr":
        return "".join(t for i in _kids(c, "is") for t in i.itertext())
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    style = int(c.get("s", -1))
    try:
        number = float(raw)
    except ValueError:
        return raw
    if kind == "n" and style in percents:
        return f"{number * 100:.{percents[style]}f}%"
    if kind == "n" and style in dates:  # sheets count a 29 February 1900 that never was
        return (datetime.date(1899, 12, 31) + datetime.timedelta(int(number - 1 if number >= 60 else number))).isoformat()
    return raw


def xlsx(content: bytes) -> Read:
    archive = opened(content)
    book = _xml(archive, "xl/workbook.xml")
    if book is None:
        raise ValueError("no workbook")
    strings = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(_xml(archive, "xl/sharedStrings.xml"), "si")]
    dates, percents = _styles(archive)
    blocks, warnings, formula = [], [], False
    for i, name in enumerate((s.get("name") or f"Sheet{n}" for n, s in enumerate(_all(book, "sheet"), 1)), 1):
        sheet = _xml(archive, f"xl/worksheets/sheet{i}.xml")
        if sheet is None:
            continue
        rows = []
        for row in _all(sheet, "row"):
            cells: list[str] = []
            for c in _kids(row, "c"):
                letters = re.match("[A-Z]+", c.get("r", "A"))
                at = 0
                for letter in letters[0] if letters else "A":
                    at = at * 26 + ord(letter) - 64
                if at - 1 > LAST_COLUMN:
                    raise ValueError("a column beyond the limit")
                cells += [""] * (at - len(cells))
                cells[at - 1] = _cell(c, strings, dates, percents)
                formula |= bool(_kids(c, "f"))
            if any(v.strip() for v in cells):
                rows.append(cells)
        if not rows:
            warnings.append(f"sheet {name} is empty")
            continue
        if len(rows) > MANY_ROWS:
            warnings.append(f"sheet {name}: {len(rows)} rows")
        blocks.append(f"## {name}\n\n{table_of(rows)}")
    return "\n\n".join(blocks), [*warnings, *(["formulas were replaced by their last value"] if formula else [])]


# text documents


def docx(content: bytes) -> Read:
    archive = opened(content)
    document = _xml(archive, "word/document.xml")
    if document is None:
        raise ValueError("no document")
    words = lambda e: _flat("".join("\n" if _tag(t) in ("br", "cr", "tab") else t.text or "" for t in _all(e, "t", "br", "cr", "tab")))
    blocks: list[str] = []
    for e in [k for b in _all(document, "body")[:1] for k in _kids(b)]:
        if _tag(e) == "tbl":
            blocks.append(table_of([[words(c) for c in _kids(r, "tc")] for r in _kids(e, "tr")]))
        elif _tag(e) == "p" and (text := words(e)):
            style = next((_get(s, "val") for s in _all(e, "pStyle")), "")
            level = re.fullmatch(r"(?:Heading|heading)\s?([1-6])", style)
            if _all(e, "numPr"):
                item = f"- {text}"
                blocks = [*blocks[:-1], f"{blocks[-1]}\n{item}"] if blocks and blocks[-1].startswith("- ") else [*blocks, item]
            else:
                blocks.append("#" * int(level[1]) + " " + text if level else text)
    images = len(_all(document, "drawing", "pict"))
    return "\n\n".join(blocks), [f"{images} images were left out"] if images else []


def _odt_list(e: X.Element, depth: int = 0) -> list[str]:
    out = []
    for item in _kids(e, "list-item", "list-header"):
        for child in _kids(item):
            if _tag(child) == "list":
                out += _odt_list(child, depth + 1)
            elif text := _text(child):
                out.append("  " * depth + "- " + text)
    return out


def odt(content: bytes) -> Read:
    archive = opened(content)
    body = next(iter(_all(_xml(archive, "content.xml"), "text")), None)
    if body is None:
        raise ValueError("no text")
    blocks, warnings = [], []
    for e in _kids(body):
        kind = _tag(e)
        if kind == "h" and _text(e):
            blocks.append("#" * min(6, max(1, int(_get(e, "outline-level", "1")))) + " " + _text(e))
        elif kind == "p" and _text(e):
            blocks.append(_text(e))
        elif kind == "list" and (lines := _odt_list(e)):
            blocks.append("\n".join(lines))
        elif kind == "table":
            blocks.append(table_of([[_text(c) for c in _kids(r, "table-cell")] for r in _all(e, "table-row")]))
        elif kind == "tracked-changes":
            who = _people([_text(c) for c in _all(e, "creator")])
            warnings.append("tracked changes were left out" + (f", by {who}" if who else ""))
    notes = _all(body, "annotation")
    if notes:
        said = [t for t in (" ".join(_text(p) for p in _kids(n, "p")).strip() for n in notes) if t]
        blocks += ["Comments:\n" + "\n".join(f"- {t}" for t in said)] if said else []
        who = _people([_text(c) for c in _all(body, "creator")])
        warnings.append(f"{len(notes)} comments" + (f" by {who}" if who else ""))
    warnings += [f"{n} {what} were left out" for what, n in (("images", len(_all(body, "image"))), ("objects", len(_all(body, "object")))) if n]
    who = _people([_text(c) for c in _all(_xml(archive, "meta.xml"), "creator", "initial-creator")])
    return "\n\n".join(blocks), [*warnings, *([f"the file's metadata names {who}"] if who else [])]


# slides


def _lines(e: X.Element) -> list[str]:
    return [t for t in (_flat("".join(r.text or "" for r in _all(p, "t"))) for p in _all(e, "p")) if t]


def pptx(content: bytes) -> Read:
    archive = opened(content)
    numbers = sorted(int(m[1]) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    if not numbers:
        raise ValueError("no slides")
    sections, images, charts = [], 0, 0
    for shown, number in enumerate(numbers, 1):
        blocks = []
        for e in [k for t in _all(_xml(archive, f"ppt/slides/slide{number}.xml"), "spTree")[:1] for k in _kids(t)]:
            if _tag(e) == "sp":
                blocks += ["\n\n".join(lines)] if (lines := _lines(e)) else []
            elif _tag(e) == "graphicFrame":
                rows = [[" ".join(_lines(c)) for c in _all(r, "tc")] for r in _all(e, "tr")]
                rows = [r for r in rows if any(r)]
                blocks += [table_of(rows)] if rows else []
                charts += bool(_all(e, "chart"))
            elif _tag(e) == "pic":
                images += 1
        for link in _all(_xml(archive, f"ppt/slides/_rels/slide{number}.xml.rels"), "Relationship"):
            if link.get("Type", "").endswith("notesSlide"):
                notes = _xml(archive, posixpath.normpath(posixpath.join("ppt/slides", link.get("Target", ""))))
                lines = _lines(notes) if notes is not None else []
                blocks += ["### Speaker notes\n\n" + "\n\n".join(lines)] if lines else []
        if blocks:
            sections.append(f"## Slide {shown}\n\n" + "\n\n".join(blocks))
    return "\n\n".join(sections), [f"{n} {what} were left out" for what, n in (("images", images), ("charts", charts)) if n]


# mail

HEADERS = ("From", "To", "Cc", "Bcc", "Reply-To", "Subject", "Date")


def eml(content: bytes) -> Read:
    message = email.message_from_bytes(content, policy=email.policy.default)
    if not message.keys() or not any(message.get(h) for h in ("From", "To", "Subject")) and not message.get_content_maintype() == "multipart":
        raise ValueError("no message")
    head = "\n".join(f"{h}: {_flat(str(message[h]))}" for h in HEADERS if message[h] and str(message[h]).strip())
    body = message.get_body(("plain", "html"))
    text = "" if body is None else body.get_content().strip()
    if body is not None and body.get_content_subtype() == "html":
        text = to_markdown(text)
    warnings = [] if text else ["no body"]
    attached = [a.get_filename() or f"unnamed {i}" for i, a in enumerate(message.iter_attachments(), 1)]
    if attached:
        warnings.append(f"{len(attached)} attachments were left out: {', '.join(attached)}")
    return "\n\n".join(x for x in (head, text) if x), warnings
