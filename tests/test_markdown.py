"""Markdown as tables of blocks and leaves."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from maskwright import scratch
from maskwright.functions.engine import token_key
from maskwright.operators import export, markdown

MAPPING = [("[[NAME_1]]", "<Ana|*B*>"), ("[[NAME_2]]", "x"), ("[[NAME_2]]", "y")]
CASES = {
    "": ("", ""),
    "# A [[NAME_1]] #": ("<h1>A &lt;Ana|*B*&gt;</h1>", "A <Ana|*B*>"),
    "one\ntwo  \nthree": ("<p>one<br>two<br>three</p>", "one\ntwo\nthree"),
    "*a* **b** ~~c~~ d** e_f_g": ("<p><em>a</em> <strong>b</strong> <del>c</del> d** e_f_g</p>", "a b c d** e_f_g"),
    "`[[NAME_1]]` [t [[NAME_1]]](u/[[NAME_1]]) <b>": ("<p><code>&lt;Ana|*B*&gt;</code> t &lt;Ana|*B*&gt; &lt;b&gt;</p>", "<Ana|*B*> t <Ana|*B*> <b>"),
    "[[NAME_2]] [[NAME_9]]": ("<p>[[NAME_2]] [[NAME_9]]</p>", "[[NAME_2]] [[NAME_9]]"),
    "- a\n  - b\n- c": ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "• a\n• b\n• c"),
    "- a\n\n2. b": ('<ul><li>a</li></ul><ol start="2"><li>b</li></ol>', "• a\n2. b"),
    "> a\n> b\n\n> c": ("<blockquote><p>a<br>b</p></blockquote>\n\n<blockquote><p>c</p></blockquote>", "a\nb\n\nc"),
    "T\n===\nu\n---\n---": ("<h1>T</h1>\n\n<h2>u</h2>\n\n<hr>", "T\n\nu\n\n"),
    "|a|b|\n|-|-|\n|1||": ("<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td></td></tr></tbody></table>", "a\tb\n1\t"),
    "````x\n```\n[[NAME_1]]\n````\nt": ("<pre><code>```\n&lt;Ana|*B*&gt;</code></pre>\n\n<p>t</p>", "```\n<Ana|*B*>\n\nt"),
    "a\n\n    code": ("<p>a</p>\n\n<pre><code>code</code></pre>", "a\n\ncode"),
    "```\nopen": ("<pre><code>open</code></pre>", "open"),
}


def _views(spark, texts, linked=False):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = spark.createDataFrame([(i, *m) for i in range(len(texts)) for m in MAPPING], "id long, token string, original string")
    return sorted(markdown.structured(docs, rows, ["id"], linked=linked).collect(), key=lambda r: r["id"])


def test_pages_and_plain_texts(spark):
    got = _views(spark, list(CASES))
    assert [(r["html"], r["plain"]) for r in got] == list(CASES.values())
    assert [r["n_restored"] for r in got] == [t.count("[[NAME_1]]") - t.count("(u/[[NAME_1]]") for t in CASES]
    assert [r["n_unknown"] for r in got] == [t.count("[[NAME_2]]") + t.count("[[NAME_9]]") for t in CASES]


def test_written_markdown_gives_the_same_page(spark):
    """What was put back is not read as markup when the Markdown is read again."""
    texts = [t for t in CASES if "(u/" not in t and "`[[" not in t]
    first = _views(spark, texts)
    second = _views(spark, [r["markdown"].replace("&#60;", "<").replace("&#62;", ">") for r in first])
    assert [r["markdown"].count("*B*") for r in first] == [1 if t.startswith("````") else 0 for t in texts]
    same = [(a["plain"], b["plain"]) for a, b in zip(first, second) if "&#" not in a["markdown"]]
    assert len(same) > 8 and all(a == b for a, b in same)


def test_links_and_html_with_destinations(spark):
    got = _views(spark, ["[t](u) <http://h/x> ![alt](i) [](v) <b>x</b>"], linked=True)[0]
    assert got["plain"] == "t (u) http://h/x alt v x"
    assert got["html"].startswith('<p><a href="u">t</a> <a href="http://h/x">http://h/x</a> alt ') and got["html"].endswith("<b>x</b></p>")


def test_null_and_empty_tables(spark):
    got = _views(spark, [None, ""])
    assert [(r["html"], r["plain"], r["n_restored"]) for r in got] == [("", "", 0)] * 2
    empty = spark.createDataFrame([], "id long, text string")
    assert markdown.structured(empty, spark.createDataFrame([], "id long, token string, original string"), ["id"]).count() == 0


def test_long_texts_of_one_kind_end(spark):
    units = ["[", "[[NAME_1]]", "`", "* ", "**a", "<", "|-", "> ", "- a\n", "```\n", "a_", "---\n", "# \n", "![a](", "\\\n"]
    began = time.time()
    got = _views(spark, [u * (60_000 // len(u)) for u in units])
    assert time.time() - began < 60
    assert got[1]["n_restored"] == 6_000 and got[1]["plain"] == "<Ana|*B*>" * 6_000


def test_spellings_of_a_token_meet_its_mapping(spark):
    spelled = ["[[NAME_001]]", "[name 1]", "[[Name__1]]", "[[NAME_010]]", "[[V1_AB_X_7]]", "[[NAME]]", "[x_y]", "[[NAME_0]]", "[[A_00]]", "[7]"]
    rows = spark.createDataFrame([(t,) for t in spelled], "t string").select("t", markdown.tolerant(F.col("t")).alias("k")).collect()
    for r in rows:
        want = token_key(r["t"].strip("[]"))
        assert (r["k"] or "") == want.removeprefix("_"), r
    docs = spark.createDataFrame([(1, "a [name 1] [[NAME_01]] [[NAME]] [NAME_2]")], "id long, text string")
    known = spark.createDataFrame([(1, "[[NAME_001]]", "Ana")], "id long, token string, original string")
    got = markdown.structured(docs, known, ["id"], token_key=markdown.tolerant).first()
    assert got["plain"] == "a Ana Ana [[NAME]] [NAME_2]" and got["n_restored"] == 2


def test_exported_forms_stand_alone(spark):
    docs = spark.createDataFrame([(1, "# [[NAME_1]]\n![x](http://h/p.png) <script>a</script>"), (2, None)], "id long, text string")
    got = {(r["id"], r["kind"]): r for r in export.exported(docs, ["id"]).collect()}
    assert len(got) == 6 and got[1, "txt"]["content"].startswith("# [[NAME_1]]\n![x]") and got[2, "txt"]["content"] == ""
    page = got[1, "html"]["content"]
    assert "<h1><mark>[[NAME_1]]</mark></h1>" in page and "http" not in page and "<script" not in page
    assert got[1, "md"]["content"] == "# [[NAME_1]]\n\nx &#60;script&#62;a&#60;&#47;script&#62;"


def test_what_opens_no_markup_is_one_piece(spark):
    """Punctuation is not cut from the words beside it, and the pieces are still all of the text."""
    texts = {'Say "hi" (to) a/b@c.d! - x = 1 > 0\nit\'s 5% & #7; {e} ]': 1, "a_b and *c* d": 5, "see [[NAME_1]], then": 3, "wow![x](u) !y": 3, "tail  \nend \\! a": 5}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    framed = markdown._framed(markdown.blocks(docs, ["id"]), ["id"])
    rows = markdown.pieces(markdown.leaves(framed, ["id"]), ["id"]).collect()
    assert [sum(r["id"] == i for r in rows) for i in range(len(texts))] == list(texts.values())
    got = _views(spark, list(texts))
    assert [r["plain"] for r in got] == [*list(texts)[:1], "a_b and c d", "see <Ana|*B*>, then", "wowx !y", "tail\nend ! a"]


def test_texts_are_shuffled_once_and_written_nowhere(spark):
    """F1 of round 4: every piece of a text went through the network with its page, and its blocks to the shared folder."""
    kept = set(scratch._written)
    docs = spark.range(40).selectExpr("id", "repeat('# [[NAME_1]] *a* `b`\n\n- [[NAME_2]]\n', 50) AS text").repartition(4)
    known = docs.selectExpr("id", "explode(array('[[NAME_1]]', '[[NAME_2]]')) AS token", "concat('o', id) AS original")
    views = markdown.structured(docs, known, ["id"]).collect()
    assert [r["n_restored"] for r in views] == [100] * 40 and all(r["plain"].startswith(f"o{r['id']} a b\n\n• o{r['id']}\n\n") for r in views)
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert moved(markdown.structured(docs.hint("merge"), known, ["id"])) <= 2
    assert moved(markdown.structured(docs, known.where("false"), ["id"])) == 0
    assert moved(export.exported(docs, ["id"])) == 0
    assert set(scratch._written) == kept


def test_first_lines_that_could_underline_stay(spark):
    got = _views(spark, ["===\na", "--", "|-|-|\n[[NAME_1]]", "> =\n> b"])
    assert [r["plain"] for r in got] == ["===\na", "--", "|-|-|\n<Ana|*B*>", "=\nb"]


def test_tokens_are_looked_up_in_mappings_of_any_length(spark):
    """Tokens that stand for several originals, for none or for null are left, whatever stands beside them."""
    sizes = (1, 2, 3, 64, 1000)
    docs = spark.createDataFrame([(n, " ".join(f"[[NAME_{i}]]" for i in range(n + 1))) for n in sizes], "id long, text string")
    of = lambda n: [(n, f"[[NAME_{i}]]", f"o{i}") for i in range(n)] + [(n, f"[[NAME_{i}]]", "two") for i in range(0, n, 7)] + [(n, f"[[NAME_{i}]]", None) for i in range(n + 1)] * 2 + [(n, None, "x")]
    rows = spark.createDataFrame([r for n in sizes for r in of(n)], "id long, token string, original string")
    got = {r["id"]: r for r in markdown.structured(docs, rows, ["id"]).collect()}
    for n in sizes:
        assert got[n]["plain"].split(" ") == [f"o{i}" if i % 7 and i < n else f"[[NAME_{i}]]" for i in range(n + 1)]
        assert got[n]["n_restored"] + got[n]["n_unknown"] == n + 1
