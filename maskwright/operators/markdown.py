"""Markdown texts as arrays of blocks and leaves: originals are put back inside leaves only, and pages, plain texts and
Markdown are written from the same arrays.

A text is a sequence of lines and fenced blocks (one pattern, a closing fence by a back-reference); runs of lines that
belong together are blocks (slices between the lines that open one); a block has one leaf, a table one for each cell;
a leaf is a sequence of pieces: tokens of the masking, code, links, markup and text. A text stays in its row from its
lines to its pages, so the only thing that is shuffled is the text itself, once, to meet the mapping of its keys (not
even that where there is no mapping). The mapping of a text comes as one sorted array in which its tokens are looked up
by halving; what is put back is not read as Markdown again.

Every step is linear in the text, a look-up logarithmic in the mapping: neighbours are read by their index, groups are
slices, and what is used twice is a variable of a function (`_let`), or it would be worked out for each element.

Defined results: null and empty texts give empty results; a token without a mapping, or with several originals, stays;
links and images leave their text, raw HTML is written as text (`inert` counts both); a marker of emphasis without its
partner is text, and a pair holds no other pair of its own kind; lists deeper than DEEPEST are drawn at that depth,
items keep the numbers they were written with, and blank lines between blocks become one; repeated rows of
the same keys give a row each, under the same mapping; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nesting of lists that gets its own tags.
DEEPEST = 6
FENCE = r" {0,3}(?:`{3,}(?=[^`\n]*(?:\n|\z))|~{3,})"
#: A fenced block to its closing fence or the end of the text, else a line.
PART = r"(?md)^ {0,3}(`{3,}(?=[^`\n]*(?:\n|\z))|~{3,})[^\n]*(?:\n(?s:.*?)(?:^ {0,3}\1[`~]*[ \t]*(?:\n|\z)|\z)|\z)|[^\n]*\n|[^\n]+"
RULE = r"^ {0,3}(?:(?:-[ \t]*+){3,}+|(?:\*[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)\z"
UNDERLINE = r"^ {0,3}(?:=+|-{2,})[ \t]*\z"
DELIMITER = r"^ {0,3}(?=.*\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*+:?-++:?[ \t]*+)*+\|?[ \t]*\z"
ITEM = r"^([ \t]*)([-*+]|\d{1,9}[.)])(?:[ \t]+|\z)"
TOKEN = r"\[{1,2}[^\]\[\r\n]{1,200}\]{1,2}"
LINK = rf"!?\[(?:[^\]\[\n]++|{TOKEN}){{0,200}}+\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)"
#: Characters that begin no other piece, with the blanks, newlines, exclamation marks and underscores between them that
#: begin none either; repetitions are possessive, as Java would use its stack for others.
RUN = r"(?:[^\s`!\[<*~_\\]++|\s(?=\S)|!(?!\[)|(?<=[\p{L}\p{N}])_+(?=[\p{L}\p{N}]))++"
#: Pieces of a leaf; the last alternative takes any character, so nothing is lost.
PIECE = rf"(?s)(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)|{LINK}|{TOKEN}|<[A-Za-z/!?][^<>\n]*>|\*+|~~|(?<![\p{{L}}\p{{N}}_])_+|_+(?![\p{{L}}\p{{N}}_])|\\[!-/:-@\[-`{{-~]|(?: {{2,}}|\\)\n|{RUN}|."
#: The same where no line ends: blanks begin no break there, so they stay with their words.
PIECE_OF_LINE = PIECE.replace(RUN, r"(?:[^`!\[<*~_\\]++|!(?!\[)|(?<=[\p{L}\p{N}])_+(?=[\p{L}\p{N}]))++")
#: What a leaf without further markup is made of.
PLAIN_PIECE = rf"(?s){TOKEN}|[^\[]+|."
#: The first characters of lines that may be something else than text; the rest of a line of text is not looked at.
MARKED = r"^(?:\s*(?:[-#*_+\d]|\z)| {4}|\t)"
BLANKS = " \t\n\x0b\f\r"
TAG = {"**": "strong", "*": "em", "~~": "del", "__": "strong", "_": "em"}


def _let(value: Column, use) -> Column:
    """use(value), worked out once."""
    return F.transform(F.array(value), use)[0]


def _struct(of: Column | None = None, keep: tuple = (), **fields) -> Column:
    """A struct of the kept fields of another and of new ones."""
    return F.struct(*[of[k].alias(k) for k in keep], *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _runs(rows: Column, opens, use) -> Column:
    """use(run) for each slice of rows between one that opens(row, i) and the next."""

    def cut(starts):
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(rows))
        return F.transform(starts, lambda s, k: _let(F.slice(rows, s + 1, end(k) - s), use))

    return _let(F.filter(F.transform(rows, lambda x, i: F.when(opens(x, i), i)), lambda i: i.isNotNull()), cut)


def escaped(text: Column) -> Column:
    """text for an HTML page."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(text.rlike("[&<>\"']"), out).otherwise(text)


def literal(text: Column) -> Column:
    """text as Markdown that no parser reads as markup: everything but letters, digits, _ and blanks as an entity."""
    one = lambda c: F.when(c.rlike(r"[\p{L}\p{N}_ ]"), c).otherwise(F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";")))
    return F.when(text.rlike(r"[^\p{L}\p{N}_ ]"), F.array_join(F.transform(F.split(text, "(?s)(?<=.)(?=.)"), one), "")).otherwise(text)


def tolerant(token: Column) -> Column:
    """What spellings of a token have in common: case, separators, leading zeros and the number of brackets do not count.

    Null for what has no number at its end.
    """
    inner = F.lower(F.regexp_replace(F.regexp_replace(token, r"^\[+|\]+\z", ""), r"[\s_]+", "_"))
    return F.when(inner.rlike(r"(?s)^(?:.*_)?[0-9]+\z"), F.regexp_replace(inner, r"(^|_)0+(?=[0-9]+\z)", "$1"))


def _lines(text: Column) -> Column:
    """quote (depth), body and kind of every line and fenced block."""

    def without_end(p: Column) -> Column:
        return F.when(p.endswith("\n"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)

    def kind(b: Column) -> Column:
        return (
            F.when(~b.rlike(MARKED), "text").when(~b.rlike(r"\S"), "blank").when(b.rlike(r"^ {0,3}#{1,6}(?:[ \t]|\z)"), "heading")
            .when(b.rlike(RULE), "rule").when(b.rlike(ITEM), "item").when(b.rlike(r"^(?: {4}|\t)"), "indented").otherwise("text")
        )

    def line(x: Column) -> Column:
        arrows = F.when(x["line"].rlike("^ {0,3}>"), F.regexp_extract(x["line"], r"^(?: {0,3}> ?)*+", 0)).otherwise("")
        return _let(arrows, lambda a: _let(
            F.when(a == "", x["line"]).otherwise(F.substring(x["line"], F.length(a) + 1, F.length(x["line"]))),
            lambda b: _struct(quote=F.length(F.regexp_replace(a, "[^>]", "")), body=b, kind=kind(b)),
        ))

    text = F.coalesce(text, F.lit(""))
    text = F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    parts = F.transform(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), lambda p: _struct(fenced=p.rlike("^" + FENCE), line=without_end(p)))
    return F.transform(parts, lambda x: F.when(x["fenced"], _struct(quote=0, body=x["line"], kind="code")).otherwise(line(x)))


def blocks(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """docs with __blocks: kind (heading, text, item, code, rule, table), level, quote, indent, mark, and rows: its lines."""

    def underlined(rows: Column) -> Column:
        """Beneath a line of text, dashes underline it."""

        def one(x, i):
            was = F.get(rows, i - 1)
            return _struct(x, ("quote", "body", "kind"), under=F.coalesce((was["kind"] == "text") & (was["quote"] == x["quote"]) & x["body"].rlike(UNDERLINE), F.lit(False)))

        return F.transform(rows, one)

    def going_on(rows: Column) -> Column:
        """Four blanks go on with a block, unless a blank line, another such line or nothing stands before."""

        def one(x, i):
            follows = (x["kind"] == "indented") & F.get(rows, i - 1)["kind"].isin("text", "item")
            return _struct(x, ("quote", "body", "under"), kind=F.when(x["under"], "under").when(follows, "text").otherwise(x["kind"]))

        return F.transform(rows, one)

    def split(rows: Column) -> Column:
        """The line beneath the head of a table."""

        def one(x, i):
            was = F.get(rows, i - 1)
            found = (x["kind"] == "text") & (was["kind"] == "text") & was["body"].contains("|") & x["body"].rlike(DELIMITER)
            return _struct(x, ("quote", "body", "kind", "under"), split=F.coalesce(found, F.lit(False)))

        return F.transform(rows, one)

    def opening(rows: Column) -> Column:
        def opens(x, i):
            kind, was, head = x["kind"], F.get(rows, i - 1), F.coalesce(F.get(rows, i + 1)["split"], F.lit(False))
            goes_on = (
                ((kind == "text") & was["kind"].isin("text", "item") & ~head)
                | (((kind == "under") | ((kind == "indented") & (was["kind"] == "indented"))) & (was["quote"] <= x["quote"]))
            )
            return (kind != "blank") & ~F.coalesce(goes_on, F.lit(False))

        def gap(i):
            was = F.get(rows, i - 1)
            return F.coalesce((was["kind"] == "blank") & (was["quote"] == 0), F.lit(False))

        return F.transform(rows, lambda x, i: _struct(x, ("quote", "body", "kind", "under", "split"), opens=opens(x, i), gap=gap(i)))

    def block(rows: Column) -> Column:
        first = rows[0]
        under = F.array_max(F.transform(F.filter(rows, lambda r: r["under"]), lambda r: F.when(r["body"].contains("="), 1).otherwise(2)))
        level = F.when(first["kind"] == "heading", F.length(F.regexp_extract(first["body"], r"^ {0,3}(#{1,6})", 1)))
        kind = F.when(F.exists(rows, lambda r: r["split"]), "table").when(under.isNotNull(), "heading").when(first["kind"] == "indented", "code").otherwise(first["kind"])
        item = first["kind"] == "item"
        return _struct(
            first, ("quote", "gap"), kind=kind, level=F.coalesce(under, level), indented=first["kind"] == "indented",
            rows=F.transform(F.filter(rows, lambda r: ~r["under"] & ~r["split"]), lambda r: r["body"]),
            indent=F.when(item, F.length(F.replace(F.regexp_extract(first["body"], ITEM, 1), F.lit("\t"), F.lit("    ")))),
            mark=F.when(item, F.regexp_extract(first["body"], ITEM, 2)),
        )

    # after a blank line every line opens, so blank lines stand at the end of a run only
    cut = lambda rows: _runs(rows, lambda x, i: x["opens"], lambda run: _let(F.filter(run, lambda r: r["kind"] != "blank"), block))
    found = _lines(F.col(text_col))
    for step in (underlined, going_on, split, opening, cut):
        found = _let(found, step)
    return docs.withColumn("__blocks", found)


def _framed(found: DataFrame, keys: list[str]) -> DataFrame:
    """__blocks with what stands before and after each in a page (opening, closing), in Markdown and in a plain text."""
    kept = ("kind", "quote", "gap", "level", "indented", "rows", "mark")

    def tags(a: Column, b: Column, one) -> Column:
        """one(k) for k from a to b, in that order; nothing if the step would go the other way."""
        return F.when(a <= b, F.array_join(F.transform(F.sequence(a, b), one), "")).otherwise("")

    def closed(lists: Column, a: Column, b: Column) -> Column:
        """Lists from depth a down to b, each with its last item."""
        return F.when(a >= b, F.array_join(F.transform(F.sequence(a, b), lambda k: F.concat(F.lit("</li></"), F.get(lists, k), F.lit(">"))), "")).otherwise("")

    def latest(items: Column, k: Column) -> Column:
        """For each item the kind of list that the last item of depth k up to it stands in."""

        def spread(at):
            upto = lambda j: F.coalesce(F.get(at, j), F.size(items))
            after = F.transform(at, lambda s, j: F.array_repeat(F.get(items, s)["list"], upto(j + 1) - s))
            return F.flatten(F.concat(F.array(F.array_repeat(F.lit("ul"), upto(F.lit(0)))), after))

        return _let(F.filter(F.transform(items, lambda x, i: F.when(x["deep"] == k, i)), lambda i: i.isNotNull()), spread)

    def listed(items: Column) -> Column:
        """Items of one run of lists with the tags before and after them."""

        def one(x, i, lists):
            was, comes, deep = F.get(items, i - 1), F.get(items, i + 1), x["deep"]
            number = F.regexp_extract(x["mark"], r"^\d+", 0).cast("long").cast("string")
            start = F.when(x["list"] == "ol", F.concat(F.lit('<ol start="'), number, F.lit('">'))).otherwise("<ul>")
            # lists that are passed over on the way down get an item of their own
            above = tags(F.coalesce(was["deep"], F.lit(-1)) + 1, deep - 1, lambda k: F.concat(F.lit("<"), F.get(lists, k), F.lit("><li>")))
            opened = F.when(was["deep"].isNull() | (was["deep"] < deep), F.concat(above, start)).when((was["deep"] == deep) & (was["list"] != x["list"]), start).otherwise("")
            after = (
                F.when(comes["deep"].isNull(), closed(lists, deep, F.lit(0))).when(comes["deep"] > deep, "")
                .when(comes["deep"] == deep, F.when(comes["list"] != x["list"], F.concat(F.lit("</li></"), x["list"], F.lit(">"))).otherwise("</li>"))
                .otherwise(F.concat(closed(lists, deep, comes["deep"] + 1), F.lit("</li>")))
            )
            bullet = F.when(x["list"] == "ol", F.concat(number, F.lit(". "))).otherwise("• ")
            return _struct(x, (*kept, "deep"), before=F.concat(opened, F.lit("<li>")), after=after, bullet=bullet)

        last = F.transform(F.sequence(F.lit(0), F.lit(DEEPEST - 1)), lambda k: latest(items, k))
        return _let(last, lambda last: F.transform(items, lambda x, i: _let(F.transform(last, lambda of: F.get(of, i)), lambda lists: one(x, i, lists))))

    def run(rows: Column) -> Column:
        """A run of items of one quotation, or a block of another kind by itself."""
        depths = F.slice(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["indent"]))), 1, DEEPEST)

        def placed(depths):
            at = lambda x: F.array_position(depths, x["indent"]).cast("int")
            return F.transform(rows, lambda x: _struct(x, kept, deep=F.when(at(x) > 0, at(x)).otherwise(DEEPEST) - 1, list=F.when(x["mark"].rlike(r"\d"), "ol").otherwise("ul")))

        other = F.transform(rows, lambda x: _struct(x, kept, deep=F.lit(None).cast("int"), before="", after="", bullet=""))
        return F.when(rows[0]["kind"] == "item", _let(_let(depths, placed), listed)).otherwise(other)

    def opens(rows):
        def one(x, i):
            was = F.get(rows, i - 1)
            return ~F.coalesce((x["kind"] == "item") & (was["kind"] == "item") & (was["quote"] == x["quote"]), F.lit(False))

        return one

    def ends(rows: Column) -> Column:
        def one(x, i):
            kind, quote, was, comes = x["kind"], x["quote"], F.get(rows, i - 1), F.get(rows, i + 1)
            tag = F.when(kind == "heading", F.concat(F.lit("h"), x["level"].cast("string"))).when(kind == "text", "p").when(kind == "table", "table")
            opening = F.when(kind == "item", x["before"]).when(kind == "rule", "<hr>").when(kind == "code", "<pre><code>").otherwise(F.concat(F.lit("<"), tag, F.lit(">")))
            closing = F.when(kind == "item", x["after"]).when(kind == "rule", "").when(kind == "code", "</code></pre>").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))
            # a quotation goes on from block to block until a blank line outside of it
            up = quote - F.when(x["gap"], 0).otherwise(F.coalesce(was["quote"], F.lit(0)))
            down = quote - F.when(comes["gap"], 0).otherwise(F.coalesce(comes["quote"], F.lit(0)))
            within = (kind == "item") & (comes["kind"] == "item")
            gap = F.when(comes.isNull(), "").when(within, "").otherwise("\n\n")
            arrows, dents = F.repeat(F.lit("> "), quote), F.repeat(F.lit("   "), F.coalesce(x["deep"], F.lit(0)))
            marked = F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "))).when(kind == "item", F.concat(x["mark"], F.lit(" "))).when(kind == "rule", "---").otherwise("")
            return _struct(
                x, ("kind", "quote", "indented", "rows", "bullet"),
                opening=F.concat(F.repeat(F.lit("<blockquote>"), F.greatest(up, F.lit(0))), opening),
                closing=F.concat(closing, F.repeat(F.lit("</blockquote>"), F.greatest(down, F.lit(0))), gap),
                mark=F.concat(arrows, dents, marked), gap=F.when(within, "\n").otherwise(gap),
                again=F.concat(arrows, F.repeat(F.lit(" "), F.when(kind == "item", F.length(dents) + F.length(x["mark"]) + 1).otherwise(0))),
            )

        return F.transform(rows, one)

    grouped = _let(F.col("__blocks"), lambda rows: F.flatten(_runs(rows, opens(rows), run)))
    return found.withColumn("__blocks", _let(grouped, ends))


def leaves(framed: DataFrame, keys: list[str]) -> DataFrame:
    """__blocks with cells: where originals may stand, by row and cell; all but tables have one."""
    inside = lambda r: F.trim(r, F.lit(BLANKS))

    def cells(x: Column) -> Column:
        kind, rows, head = x["kind"], x["rows"], F.get(x["rows"], F.lit(0))
        fenced = F.regexp_replace(F.regexp_replace(head, r"(?d)\n {0,3}(?:`{3,}|~{3,})[ \t]*\z", ""), r"\A[^\n]*\n?", "")
        first = F.when(kind == "heading", F.regexp_replace(head, r"^ {0,3}#{1,6}(?:[ \t]+|\z)|[ \t]+#+[ \t]*\z", "")).when(kind == "item", F.regexp_replace(head, ITEM, "")).otherwise(head)
        # two blanks at the end of a line break it, so ends are trimmed at the block's end only
        more = F.transform(F.slice(rows, 2, F.size(rows)), lambda r: F.regexp_replace(r, r"^[ \t]+", ""))
        joined = inside(F.when(F.size(rows) < 2, first).otherwise(F.array_join(F.concat(F.array(first), more), "\n")))
        code = F.when(x["indented"], F.array_join(F.transform(rows, lambda r: F.regexp_replace(r, r"^(?: {4}|\t)", "")), "\n")).otherwise(fenced)
        of_row = lambda r: F.transform(F.split(F.regexp_replace(inside(r), r"^\||(?<!\\)\|\z", ""), r"(?<!\\)\|"), lambda c: F.replace(inside(c), F.lit("\\|"), F.lit("|")))
        whole = F.when(kind == "code", code).when(kind == "rule", "").otherwise(joined)
        return F.when(kind == "table", F.transform(rows, of_row)).otherwise(F.array(F.array(F.coalesce(whole, F.lit("")))))

    kept = ("kind", "opening", "closing", "mark", "bullet", "gap", "again")
    # a table of delimiters alone has no rows and is not drawn
    return framed.withColumn("__blocks", F.filter(F.transform("__blocks", lambda x: _struct(x, kept, cells=cells(x))), lambda x: F.size(x["cells"]) > 0))


def _pieces(leaf: Column, text: Column) -> Column:
    """kind (text, code, span, link, url, html, tag, escape, break), opens and piece: the parts of a leaf."""
    p = lambda x: x["piece"]
    cut = F.when(leaf == "code", F.regexp_extract_all(text, F.lit(PLAIN_PIECE), F.lit(0))).when(
        text.contains("\n"), F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    ).otherwise(F.regexp_extract_all(text, F.lit(PIECE_OF_LINE), F.lit(0)))

    def kind(p: Column) -> Column:
        return (
            F.when(leaf == "code", "code").when(~p.rlike(r"^(?:[`!\[<*_~\\]| {2,}\n\z)"), "text").when(p.rlike(r"^`.*`\z"), "span").when(p.rlike(r"(?s)^!?\[.*\]\([^()]*\)\z"), "link")
            .when(p.rlike(rf"^{TOKEN}\z"), "text").when(p.rlike(r"^<(?:https?|mailto):[^\s<>]*>\z"), "url").when(p.rlike(r"^<.+>\z"), "html").when(p.rlike(r"^(?:\*{1,2}|_{1,2}|~~)\z"), "mark")
            .when(p.rlike(r"^\\.\z"), "escape").when(p.rlike(r"^(?: {2,}|\\)\n\z"), "break").otherwise("text")
        )

    def paired(rows: Column) -> Column:
        """Markers with a partner are tags, others are text: an opener whose next marker of its kind closes is a pair with it."""

        def mark(x, i):
            behind, ahead = F.coalesce(p(F.get(rows, i - 1)), F.lit(" ")), F.coalesce(p(F.get(rows, i + 1)), F.lit(" "))
            return F.when(x["kind"] == "mark", _struct(x, ("piece",), at=i, can_open=~ahead.rlike(r"^\s"), can_close=~behind.rlike(r"\s\z")))

        def opening(marks):
            def one(x, i):
                was, comes = F.get(marks, i - 1), F.get(marks, i + 1)
                opens = x["can_open"] & F.coalesce(comes["can_close"], F.lit(False)) & ~F.coalesce(was["can_open"] & x["can_close"], F.lit(False))
                return _struct(x, ("at", "piece"), opens=opens)

            return F.transform(marks, one)

        def closing(marks):
            def one(x, i):
                found = x["opens"] | F.coalesce(F.get(marks, i - 1)["opens"], F.lit(False))
                return _struct(x, ("at",), kind=F.when(found, "tag").otherwise("text"), opens=x["opens"], piece=x["piece"])

            return F.transform(marks, one)

        def met(marks):
            by_kind = F.transform(F.array(*map(F.lit, TAG)), lambda m: _let(_let(F.filter(marks, lambda x: p(x) == m), opening), closing))
            others = F.filter(F.transform(rows, lambda x, i: _struct(at=i, kind=x["kind"], opens=x["opens"], piece=p(x))), lambda x: x["kind"] != "mark")
            return F.transform(F.array_sort(F.concat(others, F.flatten(by_kind))), lambda x: _struct(x, ("kind", "opens", "piece")))

        return _let(F.filter(F.transform(rows, mark), lambda x: x.isNotNull()), met)

    found = F.transform(cut, lambda x: _struct(kind=kind(x), opens=False, piece=x))
    return _let(found, lambda rows: F.when(F.exists(rows, lambda x: x["kind"] == "mark"), paired(rows)).otherwise(rows))


def pieces(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, row, cell, pos, kind, opens, piece: the parts of every leaf as rows, for whoever looks at them one by one."""
    by_block = found.select(*keys, F.posexplode("__blocks").alias("block", "b"))
    by_row = by_block.select(*keys, "block", F.col("b.kind").alias("leaf"), F.posexplode("b.cells").alias("row", "cells"))
    by_cell = by_row.select(*keys, "block", "leaf", "row", F.posexplode("cells").alias("cell", "text"))
    return by_cell.select(*keys, "block", "row", "cell", F.posexplode(_pieces(F.col("leaf"), F.col("text"))).alias("pos", "p")).select(*keys, "block", "row", "cell", "pos", "p.*")


def _known(mappings: DataFrame, keys: list[str], token_key) -> DataFrame:
    """keys, __known (token, original; by token) and __steps, by which it is halved: the tokens that stand for one original."""
    pair = F.struct(token_key(F.col("token")).alias("token"), F.col("original").alias("original"))
    pairs = F.array_sort(F.collect_set(F.when(pair["token"].isNotNull() & pair["original"].isNotNull(), pair)))
    alone = lambda rows: F.filter(rows, lambda x, i: ~F.coalesce(F.get(rows, i - 1)["token"] == x["token"], F.lit(False)) & ~F.coalesce(F.get(rows, i + 1)["token"] == x["token"], F.lit(False)))
    found = mappings.groupBy(*keys).agg(pairs.alias("__pairs")).select(*keys, _let(F.col("__pairs"), alone).alias("__known"))
    powers = F.array(*[F.lit(2**k) for k in reversed(range(31))])
    return found.select(*keys, "__known", F.filter(powers, lambda s: s <= F.size("__known")).alias("__steps"))


def _original(token: Column) -> Column:
    """The original of a token's key in __known, null without one."""

    def nearer(at: Column, step: Column) -> Column:
        return F.when(F.get("__known", at + step)["token"] <= token, at + step).otherwise(at)

    return _let(F.get("__known", F.aggregate("__steps", F.lit(-1), nearer)), lambda found: F.when(found["token"] == token, found["original"]))


def _shown(x: Column, token_key, linked: bool) -> Column:
    """html, markdown and plain of the parts of a piece, with was_token and put: a token and its original."""
    kind, piece = x["kind"], x["piece"]
    shown = (
        F.when(kind == "span", F.regexp_replace(piece, r"^`+ ?| ?`+\z", "")).when(kind == "link", F.regexp_replace(piece, r'(?s)^!?\[|\]\([^()]*\)\z', ""))
        .when(kind == "url", F.substring(piece, F.lit(2), F.length(piece) - 2)).when(kind == "escape", F.substring(piece, F.lit(2), F.length(piece))).otherwise(piece)
    )
    whole = kind.isin("code", "html", "tag", "escape", "break", "url") | ~piece.contains("[") | ((kind == "text") & piece.rlike(rf"^{TOKEN}\z"))
    # a link without a text is drawn by its destination alone
    cut = lambda s: _let(F.when(whole, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(PLAIN_PIECE), F.lit(0))), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(""))))
    tag = F.create_map(*[F.lit(v) for pair in TAG.items() for v in pair])[piece]
    to = F.when((kind == "link") & ~piece.startswith("!"), F.regexp_extract(piece, r"(?s)\]\(([^()\s]*)[^()]*\)\z", 1)).when(kind == "url", F.substring(piece, F.lit(2), F.length(piece) - 2))

    def written(s: Column) -> Column:
        part, put, shown = s["part"], s["put"], F.coalesce(s["put"], s["part"])
        escape = _let(shown, escaped)
        html = (
            F.when(kind == "tag", F.concat(F.when(x["opens"], "<").otherwise("</"), tag, F.lit(">"))).when(kind == "break", "<br>").when(kind == "code", escape)
            .when(kind == "span", F.concat(F.lit("<code>"), escape, F.lit("</code>"))).otherwise(F.replace(escape, F.lit("\n"), F.lit("<br>")))
        )
        marks = F.when(tag == "strong", "**").when(tag == "em", "*").otherwise("~~")
        markdown = (
            F.when(kind == "tag", marks).when(kind == "break", "  \n").when(kind == "code", shown).when(kind.isin("html", "span", "escape") | put.isNotNull(), literal(shown)).otherwise(shown)
        )
        plain = F.when(kind == "tag", "").when(kind == "break", "\n").otherwise(shown)
        if linked:
            link = lambda to: F.concat(F.when(s["first"], F.concat(F.lit('<a href="'), escaped(to), F.lit('">'))).otherwise(""), html, F.when(s["last"], "</a>").otherwise(""))
            html = F.when(kind == "html", shown).when(s["to"].isNull(), html).otherwise(link(s["to"]))
            named = s["to"].isNotNull() & (s["to"] != shown)
            plain = F.when(kind == "html", "").when(named & s["first"] & (shown == ""), s["to"]).when(named & s["last"], F.concat(shown, F.lit(" ("), s["to"], F.lit(")"))).otherwise(plain)
        return _struct(s, ("put", "was_token"), html=html, markdown=markdown, plain=plain, part=part)

    def part(parts: Column, c: Column, sub: Column) -> Column:
        is_token = kind.isin("text", "link", "span", "code") & c.startswith("[") & c.rlike(rf"^{TOKEN}\z")
        ends = {"first": sub == 0, "last": sub == F.size(parts) - 1, "to": to} if linked else {}
        key = F.when(is_token, token_key(c))
        return _let(key, lambda key: _struct(part=c, was_token=key.isNotNull(), put=F.when(key.isNotNull(), _original(key)), **ends))

    return _let(shown, lambda s: _let(cut(s), lambda parts: F.transform(F.transform(parts, lambda c, sub: part(parts, c, sub)), written)))


def structured(docs: DataFrame, mappings: DataFrame, keys: list[str], text_col: str = "text", token_key=lambda token: token, linked: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """keys, kept columns of docs, html, markdown, plain, n_restored, n_unknown, inert: texts written anew with originals inside leaves.

    mappings: keys, token, original. token_key gives what spellings of a token have in common (its brackets included).
    linked keeps destinations in the page (`<a href>`) and the plain text (`text (destination)`) and raw HTML in the
    page only: such a page goes through `sanitise.sanitised` before anyone opens it.
    """
    joined = lambda rows, name: F.array_join(F.transform(rows, lambda x: x[name]), "")
    total = lambda rows, name: F.aggregate(rows, F.lit(0).cast("long"), lambda n, x: n + x[name])
    count = lambda rows, of: F.size(F.filter(rows, of)).cast("long")
    sums = ("n_restored", "n_unknown", "inert")

    def leaf_view(leaf: Column, text: Column) -> Column:
        def view(rows):
            def parts(found):
                return _struct(
                    html=joined(found, "html"), markdown=joined(found, "markdown"), plain=joined(found, "plain"), n_restored=count(found, lambda x: x["put"].isNotNull()),
                    n_unknown=count(found, lambda x: x["was_token"] & x["put"].isNull()), inert=count(rows, lambda x: x["kind"].isin("html", "link")),
                )

            return _let(F.flatten(F.transform(rows, lambda x: _shown(x, token_key, linked))), parts)

        return _let(_pieces(leaf, text), view)

    def table(views: Column) -> Column:
        """Cells with what stands around them in a table."""

        def cell(v, row, at, n):
            last, th = at == n - 1, F.when(row == 0, "th").otherwise("td")
            edge = F.when(row == 0, "</tr></thead><tbody>").otherwise("</tr>")
            opened = F.when(at == 0, F.when(row == 0, "<thead><tr>").otherwise("<tr>")).otherwise("")
            rule = F.when(last & (row == 0), F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), n))).otherwise("")
            barred = F.replace(F.replace(v["markdown"], F.lit("|"), F.lit("&#124;")), F.lit("\n"), F.lit("&#10;"))
            return _struct(
                html=F.concat(opened, F.lit("<"), th, F.lit(">"), v["html"], F.lit("</"), th, F.lit(">"), F.when(last, edge).otherwise("")),
                markdown=F.concat(F.when(at == 0, F.when(row == 0, "| ").otherwise("\n| ")).otherwise(" | "), barred, F.when(last, " |").otherwise(""), rule),
                plain=F.concat(F.when(at > 0, "\t").when(row > 0, "\n").otherwise(""), v["plain"]), **{k: v[k] for k in sums},
            )

        whole = lambda found: _struct(html=F.concat(joined(found, "html"), F.lit("</tbody>")), **{k: joined(found, k) for k in ("markdown", "plain")}, **{k: total(found, k) for k in sums})
        return _let(F.flatten(F.transform(views, lambda r, row: F.transform(r, lambda v, at: cell(v, row, at, F.size(r))))), whole)

    def block_view(x: Column) -> Column:
        def framed(v):
            ticks = F.array_max(F.transform(F.regexp_extract_all(v["markdown"], F.lit("`+"), F.lit(0)), lambda t: F.length(t)))
            fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(ticks, F.lit(0)) + 1))
            fenced = _let(fence, lambda f: F.concat(f, F.lit("\n"), F.regexp_replace(v["markdown"], r"\n\z", ""), F.lit("\n"), f))
            body = F.when(x["kind"] == "code", fenced).otherwise(v["markdown"])
            body = F.when(x["again"] == "", body).otherwise(F.replace(body, F.lit("\n"), F.concat(F.lit("\n"), x["again"])))
            return _struct(
                v, sums, html=F.concat(x["opening"], v["html"], x["closing"]), markdown=F.concat(x["mark"], body, x["gap"]), plain=F.concat(x["bullet"], v["plain"], x["gap"]),
            )

        cells = F.transform(x["cells"], lambda row: F.transform(row, lambda text: leaf_view(x["kind"], text)))
        return _let(cells, lambda views: _let(F.when(x["kind"] == "table", table(views)).otherwise(views[0][0]), framed))

    met = docs.select(*keys, *kept, F.col(text_col).alias("__source")).join(_known(mappings, keys, token_key), keys, "left")
    found = leaves(_framed(blocks(met, keys, "__source"), keys), keys)
    whole = lambda rows: _struct(**{k: joined(rows, k) for k in ("html", "markdown", "plain")}, **{k: total(rows, k) for k in sums})
    return found.select(*keys, *kept, _let(F.transform("__blocks", block_view), whole).alias("__views")).select(*keys, *kept, "__views.*")
