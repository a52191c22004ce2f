import re

import pytest

from patronage.llm.html_text import extract, page_texts, visible_text

CASES = {
    "<p>a <b>b</b>c<p>d": "a bc\n\nd",
    "<ul><li>x<li>y<ol><li>1<li>2</ol></ul>z": "- x\n- y\n  1. 1\n  2. 2\n\nz",
    "<table><tr><td>aa<td>b<tr><td>c<td>dddd</table>": "aa | b\nc  | dddd",
    "<td>loose<td>cells": "loose | cells",
    "<table><tr><th colspan=2>w<td>x<tr><td>a<td>b<td>c</table>": "w |   | x\na | b | c",
    "a<span hidden>no</span><span data-hidden=1>yes</span>": "ayes",
    "<pre>k\n  l</pre>": "k\n  l",
    "x<script>var t='</p>'</script>y<style>p{}</style><template>n</template>": "xy",
    "1 &lt; 2 &amp;&nbsp;3": "1 < 2 & 3",
    "a < b <3 c": "a < b <3 c",
    "<!-- gone --><title>t</title><h1>h</h1>t": "h\n\nt",
    "<details><summary>s</summary>closed</details><details open><summary>s</summary>open</details>": "s\ns\nopen",
    "<dl><dt>a<dd>b<dt>c</dl>": "a\nb\nc",
    "": "",
    "<p>one\n  two</p>\n": "one two",
    "unclosed <b>bold": "unclosed bold",
    "<a href='x>y'>link</a>": "link",
    "</p></div>x": "x",
}


@pytest.mark.parametrize("page", [p for p, want in CASES.items() if want is not None])
def test_layout(page):
    assert visible_text(page) == CASES[page]


HIDDEN = {
    '<nav class="nav hidden md:flex">menu</nav>': "menu",
    '<p class="hidden md:block" title="a hidden gem" aria-label=\'x hidden y\'>t</p>': "t",
    "<p title=\"style='display:none'\">t</p>": "t",
    '<p style="display:block" data-style="display:none">t</p>': "t",
    '<p style="x-display:none; display:none; display:block">t</p>': "t",
    "a<p style=display:none>no</p>": "a",
    "a<p style='color:red; Display : NONE !important; display:block'>no</p>": "a",
    'a<p STYLE="visibility:hidden">no</p>': "a",
    'a<p hidden="">no</p><p class=x/hidden>b</p><p class="x"hidden>no</p><br hidden/>': "a\n\nb",
    '<details class="open"><summary>s</summary>no</details>': "s",
    '<dialog class="open">no</dialog><dialog open>yes</dialog>': "yes",
    '<table><tr><td title="colspan=3">a<td>b</table>': "a | b",
    "<p>a<xmp><b>k</b>\n  &amp;</xmp>c": "a\n\n<b>k</b>\n  &amp;\n\nc",
}


@pytest.mark.parametrize("page", HIDDEN)
def test_hiding_attributes(page):
    assert visible_text(page) == HIDDEN[page]


LAID_OUT = {
    "<table><tr><td rowspan=2>A<td>b<tr><td>c</table>": "A | b\n  | c",
    "<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d<td>e</table>": "A | b\n  | c\n  | d | e",
    "<table><tr><td>a<td rowspan=2 colspan=2>B<td>c<tr><td>d<td>e<tr><td>f<td>g</table>": "a | B |  | c\nd |   |  | e\nf | g",  # the third column has no cell of its own and so no width
    "<table><tr><td rowspan=3>A<td>b</tr><tr></tr><tr><td>c</table>": "A | b\n  | c",
    "<table><tr><td>a<br>b<td>c<tr><td>dd<td>e<br>f</table>": "a  | c\nb  |\ndd | e\n   | f",
    "<ol start=5><li>a<li>b<li value=9>c<li>d</ol>": "5. a\n6. b\n9. c\n10. d",
    "<ol reversed><li>a<li>b</ol><ol reversed start=9><li>c<li>d</ol><ol start=x><li value=-2>e</ol>": "2. a\n1. b\n\n9. c\n8. d\n\n-2. e",
    "a<div style='visibility:hidden'>no<b style='visibility:visible'>yes<i style='visibility:collapse'>no</i></b></div>b": "a\nyes\nb",
    "<div style='display:none'>no<b style='visibility:visible'>no</b></div>b": "b",
    "<table><tr><td style='visibility:hidden'>no<td>b<tr><td>long<td>c</table>": "     | b\nlong | c",
    "<ol><li style='visibility:hidden'>no<li>two</ol>": "2. two",
}


@pytest.mark.parametrize("page", LAID_OUT)
def test_spans_numbers_and_visibility(page):
    # A page's text has no blanks around lines but those that align cells.
    assert visible_text(page) == LAID_OUT[page]


HOSTILE = {
    "a wide cell above many rows": "<table><tr><td>" + "w" * 50_000 + "<td>x" + "<tr><td>a<td>b" * 1000 + "</table>",
    "many wide spans": "<table>" + "<tr><td colspan=1000>a<td>b" * 300 + "</table>",
    "spans down": "<table><tr>" + "<td rowspan=9999>a" * 1500 + "<tr><td>b" * 6000 + "</table>",
    "uneven spans down": "<table><tr>" + "".join(f"<td rowspan={9000 - k}>a" for k in range(900)) + "<tr><td>b" * 3000 + "</table>",
    "a tall cell in a wide row": "<table><tr><td>" + "x<br>" * 3000 + "<td>y" * 3000 + "</table>",
    "lists within lists": "<ul><li>x" * 4000,
    "tables within tables": "<table><tr><td>a<td>b<br>" * 1500,
    "tables in lists": "<ul><li>a<table><tr><td>b<td>c<br>" * 1000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_text_is_bounded_by_the_page(kind):
    page = HOSTILE[kind]
    text = visible_text(page)
    assert len(text) <= 40 * len(page)
    plain = lambda x: sorted(re.sub(r"[\s|-]+", "", x))
    assert plain(text) == plain(re.sub(r"<[^>]*>", " ", page))


def test_deep_and_broken_pages():
    assert visible_text("<div>" * 20_000 + "x") == "x"
    assert visible_text("<p>" * 20_000 + "x") == "x"
    assert visible_text("<table><tr><td>" * 300 + "x") == "x"
    for page in ("<", "<a", "<!--", "<a b='", "&#xZZ;&", "<script>", "<" * 5000, "<a " * 5000):
        visible_text(page)


def test_all_words_of_given_pages(spark, small):
    """The words between tags, without scripts, styles and titles, in order."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    rows = page_texts(pages).collect()
    assert len(rows) == len(raw)
    for row in rows:
        plain = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", "", raw[row.page_id])
        plain = re.sub(r"<[^>]*>", " ", plain).replace("&amp;", "&").replace("&copy;", "©").replace("&middot;", "·").replace("&nbsp;", " ")
        clean = lambda text: re.sub(r"[\s|-]+|\d+\. ", "", text)
        assert clean(row.text) == clean(plain)
        assert row.n_chars == len(row.text)


def test_tables(odd, empty):
    out = extract(odd.withColumnRenamed("text", "html"), out="score")
    assert set(out.columns) == {*odd.columns, "html"} - {"text"}
    assert {r.score for r in out.filter("html IS NULL OR html = ''").collect()} == {""}
    assert extract(empty.withColumnRenamed("text", "html")).count() == 0
