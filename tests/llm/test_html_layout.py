from html.parser import HTMLParser

import pytest

from tracelake.llm import html_layout
from tracelake.llm.common import table
from tracelake.llm.queries import op5_html_layout

from .conftest import SF


class Words(HTMLParser):
    """Words in the order of the source, by the standard library's parser."""

    SKIP = {"script", "style", "head", "template", "noscript", "title"}
    INLINE = {"b", "i", "a", "em", "strong", "span", "u", "code", "small", "sup", "sub"}

    def __init__(self):
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        if tag not in self.INLINE:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag in self.SKIP and self.depth > 0
        if tag not in self.INLINE:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def test_every_visible_word_of_the_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF.replace("0.001", "0.01"), "pages").collect()}
    got = op5_html_layout(spark, SF.replace("0.001", "0.01")).collect()
    assert len(got) == len(pages)
    for r in got:
        words = Words()
        words.feed(pages[r["page_id"]])
        words.close()
        want = "".join(words.parts).split()
        rows = [w for w in r["text"].split() if w != "*"]
        assert sorted(rows) == sorted(w for w in want if w != "*")


CASES = {
    "<p>One<p>Two<br>three</p>four": "One\n\nTwo\nthree\n\nfour",
    "a<div>b</div>c  \n d <b> e</b>f": "a\nb\nc d ef",
    "<title>t</title><style>s</style><h1>A &amp; B</h1>x<script>if (1 < 2) '</p>'</script>y": "A & B\n\nxy",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "* a\n* b\n  * c\n* d\n\ne",
    "<ol start=9><li>x<p>y</p><li>z<li value=3>v<li></ol>": "9. x\n\n   y\n\n10. z\n3. v\n4.",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<table><tr><th>Name<th>N<tr><td>longer name<td>1<tr><td>x<td>22</table>": "Name         N\nlonger name  1\nx            22",
    "<table><td>a<td>b<tr><td colspan=2>wide cell<td>c</table>z": "a  b\nwide cell  c\n\nz",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><tr><td>a<br>bb<td>c<table><tr><td>i<td>j</table></table>": "a   c\nbb\n    i  j",
    "<table><caption>cap</caption><tbody><tr><td>日本<td>x<tr><td>abc<td>y</table>": "cap\n日本  x\nabc   y",
    "<pre>a  b\n  c</pre>d": "a  b\n  c\n\nd",
    "<p hidden>no<p style='color:red; display:none'>no<p>yes": "yes",
    "<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span>no</div>": "yes",
    "<details><summary>s</summary><p>no</details><details open>yes</details><dialog>no</dialog>": "s\nyes",
    "<!-- no --><!doctype html>a<!--> b --><input type=submit value=Go>": "a b -->Go",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "a &lt;b&gt; 1 < 2 </nothing> c": "a <b> 1 < 2 c",
    "a<p class='x>y'>b<a href=\"u": "a\n\nb",
    "<td>plain</td><tr>text": "plaintext",
    "<head><meta x><body>seen": "seen",
    "<SCRIPT>no</SCRIPT >yes<textarea>no</textarea>": "yes",
    "": "",
    "   \n": "",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert html_layout.render(page) == CASES[page]


def test_deep_and_long_pages():
    assert html_layout.render("<div>" * 50_000 + "x") == "x"
    assert html_layout.render("<b>" * 50_000 + "x" + "</b>" * 50_000) == "x"
    text = html_layout.render("<p>word " * 30_000)
    assert text.split() == ["word"] * 30_000
    assert html_layout.render("<a b='" * 20_000) == ""
    assert html_layout.render("< < <3 " * 5_000).count("<3") == 5_000


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, 1, "x"), (2, "", 2, "y"), (None, "<p>a", 3, None), (4, "<p>b", None, "z"), (4, "<p>b", None, "z")],
        "page_id long, html string, text long, id string",
    )
    got = html_layout.extract(rows).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("1", ""), ("2", ""), ("4", "b"), ("4", "b"), ("None", "a")]
    assert html_layout.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>x<select><option>o</select>z", "xz"),
        ("<p>a<select><div>q<optgroup label=u><option>v</select>b", "ab"),
        ("<select><option>o<input type=submit value=go>", "go"),
        ("<p>x<noscript><p>enable</p></noscript>y", "xy"),
        ("<head><noscript><img></noscript></head><p>x", "x"),
        ("<p>x<option>y", "x\ny"),
    ],
)
def test_lists_of_options_and_noscript_are_hidden(page, text):
    assert html_layout.render(page) == text


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<blockquote>w" * n,
        lambda n: "<ol><li>w" * n,
        lambda n: "<table><tr><td>" + "w" * 6 * n + "<td>w" + "<tr><td>w<td>w" * n,
        lambda n: "<table>" + "<tr><td colspan=900>w<td>w" * n,
        lambda n: "<table><tr><td>w<td>w" * n,
        lambda n: "<b><button>" + "<i>w" * n + "</b>" * n,
    ],
)
def test_output_and_time_grow_with_the_page(make):
    """Twice the page gives about twice the text, all of its letters included."""
    sizes = []
    for n in (500, 1_000, 2_000):
        page = make(n)
        text = html_layout.render(page)
        assert text.count("w") == page.count("w")
        sizes.append(len(text) / len(page))
    assert sizes[2] < 1.5 * sizes[0] + 1 and sizes[2] < 40


def test_long_cells_push_what_follows():
    wide = "x" * 200
    rows = html_layout.render(f"<table><tr><td>{wide}<td>a<tr><td>b<td>c").split("\n")
    assert rows == [f"{wide}  a", "b" + " " * (html_layout.MAX_COLUMN + 1) + "c"]
