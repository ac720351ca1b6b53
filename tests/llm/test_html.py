import pytest

from albumetry.llm.html_text import extract, render

CASES = [
    ("<p>one<p>two<br>three<div>four</div>five", "one\n\ntwo\nthree\n\nfour\nfive"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>x<li>y<li value=3>z</ol>", "9. x\n10. y\n3. z"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>12<tr><td>kiwi</table>", "Name   Qty\napple  12\nkiwi"),
    ("<table><tr><td colspan=2>total<td>9<tr><td>a<td>b<td>c</table>", "total  9\na  b   c"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<pre>\n a  b\n\tc</pre>", " a  b\n        c"),
    ("<head><title>t</title></head><body>x<script>if (a<b) '</p>'</script><style>p{}</style>y<noscript>n</noscript>", "xy"),
    ("a<span hidden>no</span><b style='color:red; display : none'>no</b><i style='visibility:hidden'>no</i> b", "a b"),
    ("<details><summary>s</summary>hid</details><details open><summary>t</summary>seen</details>", "s\nt\nseen"),
    ("<dl><dt>T<dd>D1<dd>D2</dl>", "T\n  D1\n  D2"),
    ("a &lt; b &amp;amp; 1<2 &eacute;&nbsp;x", "a < b &amp; 1<2 é x"),
    ("<a href='x>y' title=\"<b>\">link</a>", "link"),
    ("<!-- <p>no --><!DOCTYPE html><?php no ?>yes", "yes"),
    ("<blockquote><p>q<p>r</blockquote>", "  q\n\n  r"),
    ("<b>bold<p>para</b> rest", "bold\n\npara rest"),
    ("<select><option>A<option>B</select><textarea> x </textarea>", "A\nB\nx"),
    ("", ""), ("<", "<"), ("x<a", "x"), ("</p>q", "q"), ("<script>x", ""), ("x<a '", "x"),
]

# what stands in a row beside its cells, in drawings and in formulas
SEEN = [
    ("<table><tr><form><td>A</td><td>B</td></form></tr></table>", "A  B"),
    ("<table><tr><center><td>A</td></center><td>B</table>", "A  B"),
    ("<table><tr><a href=x>go<td>A</td></a></tr></table>", "go\nA"),
    ("<table><tr>text<td>A</td> more</tr><tr><td>B</table>", "text\nmore\nA\nB"),
    ("<table><tr><div>d<table><tr><td>in</table></div><td>A</table>", "d\n\nin\n\nA"),
    ("<table><tr><noscript><td>no</td></noscript><td>A<b hidden>no</b></table>", "A"),
    ("<svg><title>no</title><desc>no</desc><metadata>no</metadata><text>one</text><text>two</text></svg>", "one two"),
    ("<svg><title/><path d='M0'/><text>one</text></svg> two", "one two"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> <desc>yes</desc>", "x=1 yes"),
]
# quotes that open no value
QUOTES = [
    ('<br clear="all"">Hello <a href="x">link</a> end', "Hello link end"),
    ("<p title=don't>text", "text"),
    ("<p title=don't>one <b>two</b><p title='a>b'>three", "one two\n\nthree"),
    ('<a "href="x>y">link</a> <b>it\'s</b>', "link it's"),
    ('<a href="x>y" "class="z>w">link</a>', "link"),
    ("<img alt='5'' x'>a<p '>b</p>c", "a\n\nb\n\nc"),
    ('<p title="a" "hidden">seen', "seen"),
    ('<p title="abc hidden>seen', "seen"),
    ('<p a=b"c>one</p><p d="e>f" \'>two', "one\n\ntwo"),
    ('<p>a<b title="x>y<i>z</i>" w', 'ayz" w'),
]


@pytest.mark.parametrize("page, want", CASES + SEEN + QUOTES)
def test_layout(page, want):
    assert render(page) == want


def test_deep_and_odd_pages_end():
    assert render("<div>" * 20000 + "x") == "x"
    assert render("<table><tr><td>" * 60 + "x").split() == ["x"]
    assert render("<ul><li>" * 300 + "x").split()[-1] == "x"
    assert render("<a " * 20000) == ""
    long = "word " * 100_000
    assert render(f"<p>{long}</p>") == long.strip()


def test_table_of_pages(spark):
    rows = [(1, "<p>a", "u", "t"), (2, None, "u", "t"), (3, "", None, "t"), (1, "<p>a", "u", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    assert sorted(map(tuple, extract(pages).collect()), key=repr) == [(1, "a"), (1, "a"), (2, None), (3, "")]
    assert extract(pages.filter("false")).count() == 0


def test_cells_over_several_rows_and_columns():
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert render("<table><tr><td>1<td rowspan=0>x<td>2<tr><td>33<td>4<tr><td>5<td>6</table>") == "1   x  2\n33     4\n5      6"
    assert render("<table><tr><td colspan=2>wide one<td>z<tr><td>a<td>b<td>c</table>") == "wide one  z\na  b      c"
    assert render("<table><tr><td rowspan=9>a<td>b</table>after") == "a  b\n\nafter"


def test_style_sheets_and_visibility():
    css = "<style>/* .d{display:none} */ .x{display:none} #i{visibility:hidden} p.y, em {display:none} @media print{.m{display:none}} @media screen{.s{display:none}}</style>"
    assert render(css + "<p class='a x'>no<p class=y>no<div class=y>yes</div><em>no</em><p id=i>no <b style='visibility:visible'>seen</b></p>") == "yes\n\nseen"
    assert render(css + "<p class=m>yes<p class=s>no<p class=d>shown") == "yes\n\nshown"
    assert render("<p style='display:none;display:block'>yes</p><p style='display:block;display:none'>no</p>") == "yes"
    assert render("<style>.x{display:none!important}</style><p class=x style='display:block'>no</p>on") == "on"
    assert render("<style>#k{display:block}.x{display:none}</style><p class=x id=k>yes</p>") == "yes"
    assert render("<style>p{display:none</style><p>broken rule") == "broken rule"
    assert render("<p hidden style='display:block'>shown</p>") == "shown"


def test_wide_letters_and_long_cells():
    assert render("<table><tr><td>日本<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>") == "日本  x\nabcd  y\ne\u0301     z"
    long = " ".join(["word"] * 30)
    text = render(f"<table><tr><td>{long}<td>b<tr><td>a<td>{long}</table>")
    lines = text.split("\n")
    assert text.split().count("word") == 60 and lines[0].endswith("  b") and lines[-1] == "a".ljust(61) + long
    deep = "<table><tr><td>" * 30 + "inside<td>beside" + "</table>" * 30
    assert render(deep) == "inside  beside"
    assert render("<div>" * 2000 + "deep") == "deep"
