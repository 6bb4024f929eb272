"""Pages without anything that runs or loads: tags as a table, whole subtrees left out by their depth.

A page is a sequence of tags and texts. Elements that run or load open and close a depth, a running sum over the
sequence; what stands at a depth of one or more is inside of one and goes, however deep it is nested. An image leaves
its alternative text, other tags keep the attributes of a list, and links that are no web address lose theirs.

Defined results: null pages are empty; tags that are not closed reach to the page's end; closing tags without an
opening one go; a `<` that opens no tag is written as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Elements that go with all they hold, and elements without an inside that go.
HOLDING = ("script", "style", "iframe", "object", "video", "audio", "svg", "math", "form", "button", "textarea", "select", "picture", "frame", "noscript", "template")
EMPTY = ("img", "source", "track", "embed", "link", "input", "base", "meta")
#: Attributes that stay.
KEPT = ("href", "title", "lang", "dir", "alt", "id", "class", "colspan", "rowspan")
#: The inside of scripts and styles is one piece, or a tag in a string would count.
TOKEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)|<[/!?]?[a-z][^>]*>|[^<]+|<"
NAME = r"^</?([A-Za-z][A-Za-z0-9]*)"
#: One attribute that stays, with its value in double quotes, single ones or none.
ATTRIBUTE = rf"""(?i)\s((?:{'|'.join(KEPT)})\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))"""
UNSAFE = r"""(?i)^href\s*=\s*["']?+\s*+(?!https?:|mailto:|tel:|/|#|\.|[a-z0-9_-]+(?:[/?#."']|\z))"""


def tokens(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """keys, pos, token, tag (in small letters, null for text) and opens: 1 and -1 for an element that goes, else 0."""
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", NAME, 1))
    tag = F.when(name != "", name)
    rows = rows.withColumn("tag", tag)
    held = F.col("tag").isin(*HOLDING) & ~F.col("token").rlike(r"(?is)/>\z|^<(?:script|style)\b.*</(?:script|style)\s*>\z")
    return rows.withColumn("opens", F.when(held, F.when(F.col("token").startswith("</"), -1).otherwise(1)).otherwise(0))


def sanitised(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """keys and `clean`, the page without what runs or loads."""
    rows = tokens(pages, keys, html_col)
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a closing tag without an opening one must not lift what follows: the depth is counted from its lowest point so far
    total = rows.withColumn("sum", F.sum("opens").over(upto))
    lowest = total.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    outside = lowest.where((F.col("depth") == 0) & (F.col("opens") == 0))
    token, tag = F.col("token"), F.col("tag")
    alt = F.regexp_extract(token, r"""(?i)\salt\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    kept = F.filter(F.regexp_extract_all(token, F.lit(ATTRIBUTE), F.lit(1)), lambda a: ~a.rlike(UNSAFE))
    opened = F.concat(F.lit("<"), tag, F.concat_ws("", F.transform(kept, lambda a: F.concat(F.lit(" "), a))), F.lit(">"))
    written = (
        F.when(tag == "img", alt)
        .when(tag.isin(*EMPTY, *HOLDING) | token.rlike(r"^<[!?]"), "")
        .when(token.startswith("</"), F.concat(F.lit("</"), tag, F.lit(">")))
        .when(tag.isNotNull(), opened)
        .otherwise(F.replace(token, F.lit("<"), F.lit("&lt;")))
    )
    parts = outside.select(*keys, F.struct("pos", written.alias("put")).alias("part"))
    whole = parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["put"]), "").alias("clean"))
    return pages.select(*keys).distinct().join(whole, keys, "left").withColumn("clean", F.coalesce("clean", F.lit("")))
