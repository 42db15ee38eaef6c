import time

import pytest

from foliomill.functions.tree_markdown import MAX_LEVEL, tree_engine, tree_markdown


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("a &amp;lt; b &#8217;&#x2019;&eacute;&nosuch;", "a &lt; b ’’é&nosuch;"),
        ("<h1>T</h1><p>a <b> bold</b> <i>it</i><br>next", "# T\n\na **bold** *it*\nnext"),
        ("<a href='u?a=1&amp;b'>l <i>k</i></a> <a>plain</a>", "[l *k*](u?a=1&b) plain"),
        ("<ul><li>one<ul><li>in<ol><li>x<li>y</ol></ul><li>two<p>para</ul>after", "- one\n  - in\n    1. x\n    2. y\n- two\n\n  para\n\nafter"),
        ("<ol><li>a<li>b</ol><ol><li>c</ol>", "1. a\n2. b\n\n1. c"),
        ("<table><tr><th>K<th>N|</tr><tr><td>1<td>a<br>b<tr><td>2</table>", "| K | N\\| |\n|---|---|\n| 1 | a b |\n| 2 |  |"),
        ("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>", "| x in ner | y |\n|---|---|"),
        ("<p>x<blockquote>q<p>r</blockquote><hr>end", "x\n\n> q\n>\n> r\n\n---\n\nend"),
        ("<script>var a='<p>no';</script><style>p{}</style><!-- <p>no -->yes<b>open", "yes**open**"),
        ("</ul></table></b></a><li>stray", "stray"),
    ],
)
def test_structure(page, text):
    assert tree_markdown(page) == text


def test_deep_and_broken_markup_takes_linear_time():
    for piece in ("<p>", "<li>a", "<ul><li>a", "<b>x", "<table><tr><td>x", "<a href='x ", "<blockquote>a", "<!--", "<script>"):
        took = []
        for n in (2_000, 8_000):
            start = time.perf_counter()
            tree_markdown(piece * n)
            took.append(time.perf_counter() - start)
        assert took[1] < 12 * took[0] + 1.0, piece
    assert max(len(line) for line in tree_markdown("<ul><li>a" * 500).split("\n")) <= 2 * MAX_LEVEL + 1


def test_engine_rows(spark):
    files = spark.createDataFrame([("a", "<p>x"), ("b", ""), ("c", None)], "path string, html string")
    assert {r.path: (r.text, r.error is None) for r in tree_engine().run(files).collect()} == {"a": ("x", True), "b": ("", False), "c": (None, False)}
