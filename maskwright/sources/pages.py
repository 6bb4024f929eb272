"""HTML as a text source: headings, bullets and tables as Markdown, emphasis unwrapped."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from maskwright.operators.detect import _with

SKIPPED = {"script", "style", "noscript", "template", "head"}
BLOCKS = {"p", "div", "section", "article", "nav", "footer", "header", "ul", "ol", "table", "blockquote", "body", "pre"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.cells: list[str] | None = None
        self.header = False

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag == "table":
            self.header = True
            self.parts.append("\n\n")
        elif tag in BLOCKS:
            self.parts.append("\n\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "tr" and self.cells is not None:
            row = [" ".join(c.split()).replace("|", "\\|") for c in self.cells]
            self.parts.append("| " + " | ".join(row) + " |\n")
            if self.header:
                self.parts.append("|" + " --- |" * len(row) + "\n")
            self.header, self.cells = False, None
        elif tag in BLOCKS or re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n")

    def handle_data(self, data):
        if self.hidden:
            return
        if self.cells:
            self.cells[-1] += data
        elif self.cells is None:
            self.parts.append(re.sub(r"\s+", " ", data))


def to_markdown(page: str | None) -> str:
    """Text of a page; an empty string for none."""
    writer = _Writer()
    writer.feed(page or "")
    writer.close()
    lines = "\n".join(line.strip() for line in "".join(writer.parts).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def from_table(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with `text` in place of the HTML."""

    made = _with(pages, [html_col], {"text": ("string", pa.string())}, lambda: lambda page: (to_markdown(page),))
    return made.drop(html_col)
