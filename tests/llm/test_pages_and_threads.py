import os
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from tessera.llm import html_layout, quotes

SF = "/root/testdata/sf0.01"


def test_layout_of_blocks_lists_and_tables():
    page = """<html><head><title>no</title><style>.gone, #x {display:none} p {color:red}</style></head><body>
    <h1>Title</h1><p>One <b>bold</b>
    line<p>Two<br>lines<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
    <table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td colspan=2>wide</table>
    <div class="gone">no</div><span id=x>no</span><div hidden>no</div><p style="display: none">no</p><script>no</script><!-- no -->
    <pre>  x\n    y</pre>&lt;tag&gt; &amp; caf&eacute;<details><summary>More</summary>no</details><input type=hidden value=no><input type=submit value=Go></body>"""
    assert html_layout.visible_text(page).split("\n") == [
        "Title", "", "One bold line", "", "Two", "lines", "", "- a", "- b", "  3. x", "  4. y", "", "Cap", "Name  | Qty", "apple | 3", "wide  |", "", "  x", "    y", "", "<tag> & café", "More", "Go",
    ]


def test_spans_and_stray_cells_keep_columns():
    page = "<table><tr><td rowspan=2>r<td>a<td>b<tr><td>c<td>d<tbody><td>e</table>after"
    assert html_layout.visible_text(page) == "r | a | b\n  | c | d\ne |   |\n\nafter"


def test_broken_pages_give_text():
    assert html_layout.visible_text("<p>a<div>b</p>c</div></x><td>d") == "a\n\nb\n\nc\nd"
    assert html_layout.visible_text(None) == html_layout.visible_text("") == html_layout.visible_text("<script>x") == ""
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert html_layout.visible_text(deep) == "deep"
    assert html_layout.visible_text('<a "b <c') == '<a "b <c'


def test_text_that_is_easily_lost_or_shown():
    shown = html_layout.visible_text
    assert shown("<table>one<tr>loose<td>x<tr><b>two</b></table>") == "oneloosetwo\nx"
    assert shown("<xmp>a <b> &lt;</xmp>") == "a <b> &lt;"
    assert shown("<style>@media print {.n {display:none}} @media (max-width: 600px) {p {display:none}} @media screen and (min-width:50em) {i {display:none}}</style><p class=n>a<p>b<i>c</i>") == "a\n\nb"
    assert shown("<style media=print>p {display:none}</style><p>a") == "a"
    assert shown("<style>.n p.x > b[title] {display:none} #i.j {visibility:hidden} .n + p {display:none}</style><div class=n><p class=x>a<b title=t>no</b><b>c</b></div><p id=i class=j>no<p>d") == "ac\n\nd"
    assert shown("<style>p {display:none} .on {display:block}</style><p>no<p class=on>a<p class=on style='display:none'>no<p class='on' hidden>b") == "a\n\nb"
    assert shown("<div style='visibility:hidden'>no<b style='visibility:visible'>a</b><i>no</i></div>b") == "a\nb"
    assert shown("a<br><br>b<br>c<br><br><br>d") == "a\n\nb\nc\n\nd"
    assert shown("<style>/* p{display:none} */ a { b { display:none } } @font-face { display: none }</style><p>x<b>y</b>") == "xy"


def test_deep_and_wide_pages_keep_their_layout():
    n = 3000
    deep = "<div>" * n + "<ul><li>" * n + "x" + "</ul>" * n + "<p>after"
    assert html_layout.visible_text(deep).split("\n") == [" " * (2 * n - 2) + "- x", "", "after"]
    nested = "<table><tr><td>" * n + "core" + "</table>" * n + "end"
    assert html_layout.visible_text(nested) == "core\n\nend"
    wide = "<table>" + "<tr>" + "<td>a" * 900 + "<tr>" + "<td>bb" * 900 + "</table>"
    assert html_layout.visible_text(wide).split("\n") == [" | ".join(["a "] * 900).rstrip(), " | ".join(["bb"] * 900)]
    long = "<p>" + "word <b>bold</b> &amp; " * 200_000
    assert len(html_layout.visible_text(long)) == 200_000 * 12 - 1


class Reader(HTMLParser):
    """The words of a page outside hidden elements, by the standard library's parser and a stack of names."""

    HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

    def __init__(self, hidden_classes):
        super().__init__()
        self.open, self.words, self.hidden_classes = [], [], hidden_classes

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        gone = tag in html_layout.UNSHOWN or "hidden" in a or bool(self.HIDES.search(a.get("style") or "")) or bool(set((a.get("class") or "").split()) & self.hidden_classes)
        if tag == "input" and not gone and a.get("type", "text") in html_layout.INPUTS:
            self.words.append(a.get("value") or "")
        if tag not in html_layout.VOID:
            self.open.append((tag, gone))
        self.words.append(" " if tag in html_layout.BLOCK | html_layout.SPACED | {"br", "td", "th", "caption", "input"} else "")

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        self.words.append(" " if tag in html_layout.BLOCK | html_layout.SPACED | {"td", "th", "caption"} else "")

    def handle_data(self, data):
        if not any(gone for _, gone in self.open):
            self.words.append(data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_words_equal_a_plain_reading_of_the_tables_pages(spark):
    rows = html_layout.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    marks = re.compile(r"^\s*(?:- |\d+\. )+|(?<!\S)\|(?!\S)", re.M)
    for r in rows:
        html = pages[r["page_id"]] or ""
        reader = Reader({c for rule in re.findall(r"([^{}]+)\{[^{}]*display\s*:\s*none[^{}]*\}", "".join(re.findall(r"<style.*?</style>", html, re.S))) for c in re.findall(r"\.([\w-]+)", rule)})
        reader.feed(html)
        reader.close()
        words = "".join(reader.words).split()
        assert Counter(marks.sub(" ", r["text"]).split()) == Counter(marks.sub(" ", " ".join(words)).split()), r["page_id"]
    assert len(rows) == sum(k is not None for k in pages)


BROKEN = {
    "tag": lambda n: "<title" * n, "quote": lambda n: '<a "' * n, "end tag": lambda n: '</a"' * n, "declaration": lambda n: "<!" * n, "quotes": lambda n: "<a '\"<b \"'" * n,
    "nested": lambda n: "<style>div div{display:block} div p .x{display:none}</style>" + "<div>" * n + "x", "far end": lambda n: "<b><table><tr><td>" + "<span>" * n + "</b>" * n,
    "selector": lambda n: "<style>" + "(" * n + "{display:none}[a=" + " " * n + "{display:none}</style><p>x", "attributes": lambda n: "<a " + "x " * n + ">y",
    "numbers": lambda n: "&#" + "1" * n + ";&#" + "0" * n + "65;", "table": lambda n: "<table>" + "<tr><td>a<td>b" * (n // 10) + "<tr><td>" + "x" * n + "<td>y</table>",
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_time_grows_with_length(name):
    begun = time.process_time()
    html_layout.visible_text(BROKEN[name](20_000))
    assert time.process_time() - begun < 3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<span style="display:block">a</span><span style="display:block">b</span>', "a\nb"),
        ("<style>li{display:inline}</style><ul><li>a</li> <li>b</li></ul>", "a b"),
        ("<style>li{display:inline-block}</style><ul><li>a</li><li>b</li></ul>", "a b"),
        ('<div style="white-space:pre">a  b\n  c</div>d', "a  b\n  c\nd"),
        ("<style>p:not(.k), p:first-child, h1 + p {display:none}</style><div><p>1</p><p class=k>2</p><h1>h</h1><p class=k>3</p><p class=k>4</p></div>", "2\n\nh\n\n4"),
        ("<style>.a ~ i {display:none} div > b:last-child{display:none}</style><div><b>1</b><i>2</i><u class=a></u><i>3</i><b>4</b></div>", "12"),
        ("<style>i:not(.a, .b){display:none}</style><i>1</i><i class=a>2</i><i class=b>3</i>", "23"),
        ("<style>a:hover, a:visited{display:none}</style><a>x</a>", "x"),
        ("<table><tr><td>" + "w" * 70 + "<td>b<tr><td>c<td>d</table>", "w" * 70 + " | b\nc" + " " * 69 + " | d"),
        ('<a href="foo>text</a> more', "text more"), ("x <b and c", "x <b and c"), ('<a"b c">z</a>', "z"), ("<p title='>'>q", "q"),
        ("a<!-- c > <b>x</b> --> d <b", "a d <b"), ("<b <!-- hidden", "<b"), ("&#99999999999999999999; &#0000065;", "\ufffd A"),
    ],
)
def test_rendering(html, text):
    assert html_layout.visible_text(html) == text


def test_steps_equal_a_walk_back():
    """Bits of selectors against the plain definition of combinators, on random trees."""
    draw = random.Random(3)
    for _ in range(60):
        root = html_layout.Node("html", {})
        nodes, over = [root], {root: None}
        for _ in range(25):
            parent = draw.choice(nodes)
            node = html_layout.Node(draw.choice("abi"), {"class": draw.choice(["", "k", "m", "k m"])})
            parent.children.append(node)
            nodes.append(node)
            over[node] = parent
        parts = [(draw.choice(["a", "b", "i", ".k", ".m", "a.k", "*"]), draw.choice([" ", " > ", " + ", " ~ "])) for _ in range(3)]
        selector = "".join(x + y for x, y in parts[:-1]) + parts[-1][0]
        styles = html_layout.Styles([("", selector + "{display:none}")])

        def fits(node, k):
            name, _, kind = parts[k][0].partition(".")
            if name not in ("", "*", node.tag) or kind and kind not in node.attrs.get("class", "").split():
                return False
            if k == 0:
                return True
            sign, parent = parts[k - 1][1].strip(), over[node]
            if parent is None:
                return False
            before = parent.children[: parent.children.index(node)]
            above = []
            while parent is not None:
                above.append(parent)
                parent = over[parent]
            return any(fits(x, k - 1) for x in {"": above, ">": above[:1], "+": before[-1:], "~": before}[sign])

        def visit(path):
            assert styles.shown(path, True)[0] == (not fits(path[-1], 2)), selector
            for child in path[-1].children:
                visit([*path, child])

        visit([root])


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", 9), (1, "u", "<p>x</p>", 9), (2, None, None, 9), (None, "u", "x", 9)], "page_id long, url string, html string, text int")
    got = html_layout.extract(pages)
    assert sorted((r["page_id"], r["text"], r["n_chars"], r["n_lines"]) for r in got.collect()) == [(1, "x", 1, 1), (1, "x", 1, 1), (2, "", 0, 0)]
    assert html_layout.extract(pages.where("page_id > 5")).count() == 0


SCHEMA = "conv_id long, turn long, role string, text string, key string"
TALK = [
    (1, 0, "user", "Hello there.\nHow do I sort a list?", "k"),
    (1, 1, "a", "Use sorted().\nIt returns a new list.", "k"),
    (1, 2, "user", "A wrote:\n> Use sorted().\n> It returns a new list.\n\nThanks, but in place?", "k"),
    (1, 3, "b", "> hello there\n> How do I sort\n> a list?\nAlso see sort().", "k"),
    (1, 4, "a", ">> Use sorted().\n> Thanks, but in place?\nYes: list.sort().", "k"),
    (1, 5, "c", "> never said\nHm.", "k"),
    (2, 0, "u", None, None), (2, 0, "u", None, None), (2, None, None, "y", None), (None, 1, "u", "x", None), (3, 7, "u", "x " * 50_000, None),
]


def test_threads(spark):
    got = [(r["conv_id"], r["thread_turn"], r["turn"], r["parent_turn"], r["n_quoted"], r["text"][:25]) for r in quotes.threads(spark.createDataFrame(TALK, SCHEMA)).collect()]
    assert got == [
        (1, 0, 0, None, 0, "Hello there.\nHow do I sort"[:25]), (1, 0, 3, 0, 3, "Also see sort()."), (1, 1, 1, None, 0, "Use sorted().\nIt returns a"[:25]),
        (1, 1, 2, 1, 2, "Thanks, but in place?"), (1, 1, 4, 2, 2, "Yes: list.sort()."), (1, 5, 5, None, 1, "Hm."),
        (2, -1, -1, None, 0, "y"), (2, 0, 0, None, 0, ""), (3, 7, 7, None, 0, ("x " * 50)[:25]),
    ]
    assert quotes.threads(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chains_of_answers(spark):
    rows = [(1, t, "u", (f"> line number {t - 1}\n" if t else "") + f"line number {t}", None) for t in range(40)]
    got = quotes.threads(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["turn"] for r in got] == list(range(40)) and {r["thread_turn"] for r in got} == {0}
    assert [r["parent_turn"] for r in got] == [None, *range(39)]


def test_threads_equal_their_sql(spark):
    import duckdb
    import pyarrow as pa

    from tessera.llm import queries

    talk = pa.table({n: [r[k] for r in TALK] for k, n in enumerate(("conv_id", "turn", "role", "text"))})
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    for row in zip(*(talk[c].to_pylist() for c in talk.column_names)):
        con.execute("INSERT INTO conversations VALUES (?, ?, ?, ?)", list(row))
    columns = ["conv_id", "thread_turn", "turn", "parent_turn", "role", "n_quoted", "n_linked", "text"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.OP1_SQL})").fetchall()
    got = [tuple(r[c] for c in columns) for r in quotes.threads(spark.createDataFrame(TALK, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
