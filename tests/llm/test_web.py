"""WARC bundles, wrapper induction and licence scans."""

import base64
import hashlib
import os
import random
import time

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from foliomill.llm import licenses, warc, wrapper

PAGES = "page_id long, url string, html string, owner string, digest string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], PAGES).repartition(3)


def archived(spark, tmp_path, rows, least=0):
    index = warc.write_archives(pages(spark, rows), f"file://{tmp_path}/warc", least)
    return index, warc.read_archives(index).collect()


ROWS = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2\r\nX: y", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""), (5, "u", "x" * 700_000)]
ROWS += [(6, "u", "WARC/1.1\r\n\r\n\r\n"), (6, "u", "WARC/1.1\r\n\r\n\r\n"), (None, "n", "alone"), (None, "n", "<p>é</p>")]


def test_archives_read_back_whole(spark, tmp_path):
    index, found = archived(spark, tmp_path, ROWS)
    assert len(found) == len(ROWS) == index.count()
    by = {}
    for r in found:
        by.setdefault(r["page_id"], []).append(r)
    digest = base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert [(r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in by[1]] == [("revisit", 2, 9, digest)]
    assert by[2][0]["record_type"] == "response" and by[2][0]["payload"].decode() == "<p>é</p>" and "\n" not in by[2][0]["url"]
    assert (by[3][0]["record_type"], by[3][0]["refers_to"], by[3][0]["payload_bytes"]) == ("revisit", 4, 0)
    assert by[4][0]["record_type"] == "response" and len(by[5][0]["payload"]) == 700_000
    assert [r["record_type"] for r in by[6]] == ["response"] * 2 and by[6][0]["payload"] == b"WARC/1.1\r\n\r\n\r\n"
    assert {r["payload_bytes"] for r in by[None]} == {5, 9}


def test_small_payloads_are_all_responses(spark, tmp_path):
    _, found = archived(spark, tmp_path, ROWS, least=10)
    assert {r["record_type"] for r in found} == {"response"}


def test_one_record_by_its_index_row_and_frames_by_the_seek_table(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>page {k}</p>" * 3000) for k in range(60)]
    index, _ = archived(spark, tmp_path, rows)
    for r in index.collect():
        record = warc.read_record(r["bundle"], r["frame_offset"], r["frame_bytes"], r["record_offset"], r["record_bytes"])
        assert [h["X-Page-ID"] for _, h, _, _ in warc.parse_records(record)] == [str(r["page_id"])]
    bundle = index.first()["bundle"]
    storage, path = warc._place(bundle)
    table = warc.seek_table(storage, path)
    with open(path, "rb") as f:
        data = f.read()
    assert len(table) > 1 and table[-1][0] + table[-1][1] < len(data)
    for at, packed, plain in table:
        assert len(zstandard.decompress(data[at : at + packed])) == plain
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # any reader skips the table
    assert len(whole) == sum(t[2] for t in table)


def test_empty_table_of_pages(spark, tmp_path):
    assert archived(spark, tmp_path, [])[1] == []
    assert wrapper.extract_text(pages(spark, [])).count() == 0


PARTS = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="sidebar"><nav><ul><li><a href=x>menu</a></li></ul></nav>
<header><h1>site</h1></header><div class="cookie-notice">we use cookies</div><aside>side</aside><script>var a = "</p><p>no";</script>
<article class="post"><header><h1>The &amp; title&hellip;</h1></header><p>First <b>bold</b>
 and <a href="y">link</a>.<br>Second&nbsp;line<p>Open paragraph <i>here<ul><li>one<li>two</ul>
<div hidden>hidden</div><div class="ad">buy</div><form><p>form</p></form><table><tr><td>a<td>b</tr></table><!-- <p>comment</p> -->
<section id="comments"><p>first!</p></section></article><footer>&copy; foot</footer></body></html>"""
TEXT = "The & title…\nFirst bold and link. Second line\nOpen paragraph here\none\ntwo\na b"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in wrapper.extract_text(pages(spark, rows)).collect()}


def test_article_without_its_surroundings(spark):
    odd = [(2, None, None), (3, "x", ""), (4, "http://h/4", "plain text &lt;b&gt;"), (5, "http://h/5", "<p>unclosed <b>x"), (None, "u", PARTS)]
    found = texts(spark, [(1, "http://h/1", PARTS), *odd])
    assert found == {1: TEXT, 2: "", 3: "", 4: "plain text <b>", 5: "unclosed x", None: TEXT}


def test_no_part_of_an_article_goes():
    text = lambda h: [n.text for n in wrapper.leaves(wrapper.content_tree(h)[0])]
    assert text("<p>x</p><article><p>one</p></article><p>y</p><article><p>part two</p></article>") == ["one", "part two"]
    assert text("<div itemprop=articleBody>a</div><div class=ad>buy</div><div itemprop=articleBody>b</div>") == ["a", "b"]
    assert text("<div class='has-sidebar'><article><p>one</p></article><div class='sidebar'>side</div></div>") == ["one"]
    post = "<article class='post comment-open'><p>story of the day</p><div class='share'>share</div></article>"
    assert text(f"{post}<ol class='commentlist'><li><article class='comment'>first</article></ol>") == ["story of the day"]
    assert text("<form><p>a long story in a form</p><div class='menu'>menu</div></form>") == ["a long story in a form"]
    assert text("<p><a href=x>a linked paragraph</a></p><p>more</p>") == ["a linked paragraph", "more"]


def test_constant_nodes_of_a_host_are_template(spark):
    def page(k):
        return f"<body><div><p>Welcome to our site</p><div><p>Story {k}</p><p>More of {k * 7}</p></div><p>Call us any time</p></div></body>"

    rows = [(k, f"http://one.example/{k}", page(k)) for k in range(8)] + [(50, "http://two.example/", page(50))]
    found = texts(spark, rows)
    assert all(found[k] == f"Story {k}\nMore of {k * 7}" for k in range(8))
    assert found[50].startswith("Welcome")  # alone on its host


def test_a_host_has_a_template_for_each_layout(spark):
    one = lambda k: f"<body><div><p>Welcome</p><p>Story {k}</p></div></body>"
    two = lambda k: f"<body><section><h2>Archive</h2><p>Entry {k}</p></section></body>"
    rows = [(k, f"http://one.example/{k}", (one if k % 2 else two)(k)) for k in range(2, 30)]
    found = texts(spark, [(0, "http://one.example/0", None), (1, "http://one.example/1", "<body></body>"), *rows])
    assert found == {0: "", 1: ""} | {k: f"{'Story' if k % 2 else 'Entry'} {k}" for k in range(2, 30)}


def test_copies_of_one_page_are_no_template(spark):
    rows = [(k, f"http://one.example/{k}", "<body><p>Same story</p><p>everywhere</p></body>") for k in range(30)]
    assert set(texts(spark, rows).values()) == {"Same story\neverywhere"}


def test_a_line_that_marked_articles_of_a_host_share_is_template(spark):
    page = lambda k, line: f"<article><h1>T{k}</h1><p>{line}</p><p>{k}</p></article>"
    rows = [(k, f"http://two.example/{k}", page(k, "Shared line")) for k in range(10)]
    rows += [(10 + k, f"http://three.example/{k}", page(k, "Shared line" if k < 3 else f"Own line {k}")) for k in range(10)]
    found = texts(spark, rows)
    assert all(found[k] == f"T{k}\n{k}" for k in range(10)) and found[10] == "T0\nShared line\n0" and found[15] == "T5\nOwn line 5\n5"


def test_tree_matching_keeps_order_and_labels():
    tree = lambda h: wrapper.read_skeleton(wrapper.skeleton(*wrapper.content_tree(h)))[0]
    a, b = tree("<div><p>a</p><h2>b</h2><p>c</p></div>"), tree("<div><p>x</p><p>a</p><h2>new</h2><p>c</p><p>d</p></div>")
    _, pairs = wrapper.match_trees(a, b)
    same = [x.key == y.key for x, y in pairs]
    assert len(pairs) == 3 and same.count(True) == 2


def test_broken_markup_takes_linear_time():
    for piece in ("<p>", "<a href='x ", '<p class="', "<!--", "<div>", "<script>", "<b", "</p>", "<ul><li>"):
        took = []
        for n in (20_000, 80_000):
            start = time.perf_counter()
            wrapper.content_tree(piece * n)
            took.append(time.perf_counter() - start)
        assert took[1] < 10 * took[0] + 1.0, piece


def heaviest(a, b):
    """The weight of the best matching of two nodes with equal labels, by recursion over all pairs."""
    memo = {}

    def own(x, y):
        p, q = wrapper._plain(x), wrapper._plain(y)
        if x.label != y.label:
            return 0.0
        if p or q:
            return 2.0 + bool(p and q and p.key == q.key)
        return heaviest(x, y)

    def best(i, j):
        if not (i and j):
            return 0.0
        if (i, j) not in memo:
            memo[i, j] = max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + own(a.children[i - 1], b.children[j - 1]))
        return memo[i, j]

    return 1.0 + best(len(a.children), len(b.children))


@pytest.mark.parametrize("cells", [1, 12, 4_000_000])
def test_tree_matching_against_all_matchings(monkeypatch, cells):
    monkeypatch.setattr(wrapper, "DENSE_CELLS", cells)
    rng = random.Random(cells)
    tree = lambda h: wrapper.read_skeleton(wrapper.skeleton(*wrapper.content_tree(h)))[0]

    def page(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{rng.choice('abcd')}</p>"
        return f"<{(tag := rng.choice(['div', 'section', 'ul']))}>" + "".join(page(depth - 1) for _ in range(rng.randrange(5))) + f"</{tag}>"

    for _ in range(40):
        a, b = (tree("".join(page(2) for _ in range(6))) for _ in range(2))
        score, pairs = wrapper.match_trees(a, b)
        assert score == heaviest(a, b)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_constants_in_long_lists_are_found_in_any_table(monkeypatch):
    rows = lambda k: "".join(f"<div><p>{r}</p><p>slot {k} {r}</p></div>" for r in range(30))
    tree = lambda k: wrapper.read_skeleton(wrapper.skeleton(*wrapper.content_tree(rows(k))))[0]
    for cells in (10, 4_000_000):
        monkeypatch.setattr(wrapper, "DENSE_CELLS", cells)
        pairs = wrapper.match_trees(tree(1), tree(2))[1]
        assert len(pairs) == 60 and sum(x.key == y.key for x, y in pairs) == 30


def test_names_within_an_article_count_as_a_whole():
    text = lambda h: [n.text for n in wrapper.leaves(wrapper.content_tree(h)[0])]
    inner = "<h2 id='related-work'>Related work</h2><section id='search-trees'><p>trees</p></section><div id='comments'>first!</div>"
    assert text(f"<article><p>a</p>{inner}<h3 class='share'>On sharing</h3></article>") == ["a", "Related work", "trees", "On sharing"]
    hidden = "<div data-v1='hidden'>a</div><div data-hidden>b</div><div hidden>c</div><div hidden=''>d</div><div class=x hidden>e</div>"
    assert text(f"<article>{hidden}</article>") == ["a", "b"]


def test_licences_under_other_spellings(spark, empty):
    mit = licenses.LICENSE_TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper()),
        (2, "MIT License\n© 2021 X\nAll rights reserved.\n" + mit.replace('"', "'").replace("\n", "   \n")),
        (3, mit + " And more."),
        (4, "prose\n  Licenced under the apache license, v2.0\nReleased under the MIT License.\nReleased under the MIT License."),
        (5, None),
        (6, ""),
        (7, "This work is licensed under Creative Commons BY 4.0."),
        (None, mit),
        (1, "!!!"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("license_id", F.lit("clash"))
    known = licenses.known_digests(spark)
    found = [((r["doc_id"] or 0), r["license_id"], r["notices"]) for r in licenses.license_scan(docs, known).collect() if r["text_digest"]]
    by = {}
    for k, one, notices in found:
        by.setdefault(k, []).append((one, notices))
    assert by[2][0][0] == "MIT" and by[3] == [(None, [])] and by[4] == [(None, ["Apache-2.0", "MIT"])]
    assert by[5] == by[6] == [(None, [])] and by[7] == [("CC-BY-4.0", ["CC-BY-4.0"])] and by[0][0][0] == "MIT"
    assert {x[0] for x in by[1]} == {"MIT", None}
    assert licenses.license_scan(empty, known).count() == 0
    assert licenses.license_scan(docs, known.limit(0)).where("license_id is not null").count() == 0


def test_every_spelling_rule_runs_on_every_text(spark):
    from foliomill.llm.oracles import _canonical

    lines = {
        "Released under the GNU GPL v3.": ["GPL-3.0"],
        "Released under CC BY v4.0": ["CC-BY-4.0"],
        "Distributed under the CC0 version 1.0": ["CC0-1.0"],
        "\ufeffReleased under the MIT License.": ["MIT"],
        "Released under the MIT\u2122 License\uff0e": ["MIT"],
        "\u25a0 Released under the MIT License.": ["MIT"],
        "v4 favour \u00e9t\u00e9 over ver 2": [],
        "\u00e9 copyright 2020": [],
    }
    rows = list(enumerate(lines))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.license_scan(docs, licenses.known_digests(spark)).collect()}
    assert [found[k]["notices"] for k, _ in rows] == list(lines.values())
    sql = duckdb.connect().execute(f"SELECT k, sha256({_canonical('t')}) FROM (SELECT unnest(?) AS k, unnest(?) AS t)", [[k for k, _ in rows], list(lines)])
    assert dict(sql.fetchall()) == {k: r["text_digest"] for k, r in found.items()}


def test_long_licences_are_known_by_digest(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "BSD-3-Clause": "BSD"}
    there = {k: f"{folder}/{f}" for k, f in names.items() if os.path.exists(f"{folder}/{f}")}
    if not there:
        pytest.skip("no licence texts on this machine")
    rows = []
    for key, path in there.items():
        with open(path, encoding="utf-8") as file:
            text = file.read()
        rows += [(key, text), (key, "Copyright 2020 Someone\n" + text.upper().replace("\n", " \n "))]
    docs = spark.createDataFrame([(k, f"{key}|{t}") for k, (key, t) in enumerate(rows)], "doc_id long, text string")
    docs = docs.withColumn("text", F.regexp_replace("text", r"^[^|]*\|", ""))
    found = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs, licenses.known_digests(spark)).collect()}
    assert [found[k] for k in range(len(rows))] == [key for key, _ in rows]
    assert len(dict.fromkeys(d for _, d in licenses.LICENSE_DIGESTS)) == len(licenses.LICENSE_DIGESTS)


def test_licence_scan_is_native(spark, sf_dir):
    from foliomill.llm.queries import op10_license_scan

    plan = op10_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
