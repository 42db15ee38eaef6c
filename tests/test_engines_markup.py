import time

import pytest

from foliomill import ColumnEngine, isolated_engine, register_engine, registered_engines
from foliomill.functions import markup
from foliomill.plans.catalog import ARTICLE
from foliomill.operators.engines import FrameEngine, guarded_engine, missing_ocr
from foliomill.plans.corpus import convert_corpus


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "html string").selectExpr(f"{expression} AS r").first().r


@pytest.mark.parametrize(
    "html, markdown",
    [
        ("<h1>Title</h1><p>One</p><p>Two</p>", "# Title\n\nOne\n\nTwo"),
        ("<H3 class='x'>T</H3>text", "### T\n\ntext"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"),
        ('<a href="/x?a=1&amp;b=2">go</a>', "[go](/x?a=1&b=2)"),
        ("<a class=c href='/y' id=z><span>in</span></a>", "[in](/y)"),
        ("<a name=top>plain</a>", "plain"),
        ("<b>bold</b> <strong>too</strong> <i>it</i> <em>al</em>", "**bold** **too** *it* *al*"),
        ("<p><b>left open<p>next", "left open\n\nnext"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<script>var t='</p><b>x</b>';</script>kept<style>p{}</style>", "kept"),
        ("<script>if (s.indexOf('<!--')) {}</script>kept", "kept"),
        ("<!-- <script> -->kept<!-- open", "kept"),
        ("<head><title>no</title></head><header>yes</header>", "yes"),
        ("&lt;b&gt; &amp;lt; &copy; &quot;q&quot; &#39;s&#39;&nbsp;x", "<b> &lt; © \"q\" 's' x"),
        ("  <p>  a   b \n c </p>\n\n\n\n<p>d</p> ", "a b\nc\n\nd"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("", ""),
    ],
)
def test_html_to_markdown(spark, html, markdown):
    assert one(spark, markup.html_to_markdown("html"), html) == markdown


def test_html_to_text(spark):
    html = "<head><title>no</title></head><h1>T</h1><p>a<b>b</b>\n\n<!-- c -->&copy;&nbsp;d</p>"
    assert one(spark, markup.html_to_text("html"), html) == "T a b © d"


def test_broken_markup_takes_linear_time(spark):
    broken = ["<a href=" + "x" * 200_000, "<" * 200_000, "<script>" * 20_000, "<!--" * 20_000, "<b>" * 50_000, "\n " * 100_000]
    df = spark.createDataFrame([(b,) for b in broken], "html string")
    start = time.time()
    df.selectExpr(f"length({markup.html_to_markdown('html')})", f"length({markup.html_to_text('html')})").collect()
    assert time.time() - start < 30


def test_repeated_unclosed_tags_take_linear_time(spark):
    def seconds(n):
        broken = ["<head>" * n, "<a " + "href=x " * n, "<a href=x>" * n, "<article>" * n, "<a href=" * n, "<h1>" * n]
        df = spark.createDataFrame([(b,) for b in broken], "html string").repartition(1)
        article = f"array_join(regexp_extract_all(html, r'{ARTICLE}', 1), '')"
        start = time.time()
        df.selectExpr(f"length({markup.html_to_markdown('html')})", f"length({markup.html_to_text('html')})", f"length({article})").collect()
        return time.time() - start

    seconds(1000)
    assert seconds(80_000) < 4 * seconds(20_000) + 10


def test_an_unclosed_head_ends_at_the_body(spark):
    page = "<head><title>no</title><body><p>yes <a href=u>link</a></p><a href='v'>w</a>"
    df = spark.createDataFrame([(page,)], "html string")
    assert df.selectExpr(markup.html_to_markdown("html")).first()[0] == "yes [link](u)\n\n[w](v)"


def test_csv_keeps_all_cells(spark):
    from foliomill.operators.formats import csv_to_table

    texts = ['a,b,c\n1,2,3\n', 'x\n"q ""r"", s",t\n', 'a,\r\n"two\nlines|",', "", "only", "a,b\n1,2,3,4\n,", '"open, end']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = [r[0] for r in df.orderBy("k").selectExpr(csv_to_table("t")).collect()]
    assert found == [
        "| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |",
        '| x |\n|---|\n| q "r", s | t |',
        "| a |  |\n|---|---|\n| two lines\\| |  |",
        "",
        "| only |\n|---|",
        "| a | b |\n|---|---|\n| 1 | 2 | 3 | 4 |\n|  |  |",
        "| open, end |\n|---|",
    ]


def test_broken_bytes_become_replacement_characters(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xff\xfe end \xe4\xb8\xad"),)], "content binary")
    text = df.selectExpr(f"{markup.decode_text('content')} AS t").first().t
    assert text.startswith("ok " + chr(0xFFFD)) and text.endswith(" end 中")


def files(spark, texts):
    rows = [(f"/in/{i}.txt", f"/o/{i}.md", ".txt", 100, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, target_path string, ext string, length bigint, raw string")


def picky(resource, raw):
    if raw == "bad":
        raise ValueError("cannot read")
    return resource + raw if raw else ""


def test_python_engine_keeps_faults_to_their_row(spark):
    engine = isolated_engine("picky", 0, picky, ["raw"], setup=lambda: "> ")
    found = {r.path: (r.text, r.error, r.seconds >= 0) for r in engine.run(files(spark, ["x", "bad", "", "y"])).collect()}
    assert found == {
        "/in/0.txt": ("> x", None, True),
        "/in/1.txt": (None, "ValueError: cannot read", True),
        "/in/2.txt": (None, "转换结果为空", True),
        "/in/3.txt": ("> y", None, True),
    }


def test_python_and_expression_engines_in_one_run(spark):
    engines = [isolated_engine("markitdown", 0, picky, ["raw"], setup=str), ColumnEngine("third", 1, text="concat(raw, '. End.')")]
    results, stats = convert_corpus(spark, files(spark, ["x", "bad"]), engines)
    found = {r.source_path: r for r in results.collect()}
    assert found["/in/0.txt"].tool_used == "markitdown" and found["/in/0.txt"].contested
    assert found["/in/0.txt"].processing_time >= 0
    assert found["/in/1.txt"].tool_used == "third" and not found["/in/1.txt"].contested
    assert stats.first().tool_wins["single_option"] == 1


def test_setup_runs_once_per_partition(spark):
    def setup():
        import uuid

        return uuid.uuid4().hex

    engine = isolated_engine("e", 0, lambda resource, raw: resource, ["raw"], setup=setup)
    texts = engine.run(files(spark, ["x"] * 40).coalesce(2)).select("text").distinct()
    assert texts.count() == 2


def test_registry_and_missing_ocr(spark):
    register_engine(ColumnEngine("one", 2, text="raw"))
    register_engine(ColumnEngine("two", 1, text="raw"))
    assert [e.name for e in registered_engines("one", "two")] == ["two", "one"]
    with pytest.raises(ValueError):
        FrameEngine("x", 0, "video")
    image = files(spark, ["x"]).selectExpr("'/in/p.png' AS path", "target_path", "'.png' AS ext", "length")
    for prefer, message in (("auto", ""), ("markitdown", "PaddleOCR: PaddleOCR 未初始化")):
        results, _ = convert_corpus(spark, image, [missing_ocr()], prefer=prefer)
        row = results.first()
        assert (row.success, row.error_message) == (False, message)


def _sometimes(_, raw):
    import os
    import time

    if raw == "hang":
        time.sleep(600)
    if raw == "die":
        os._exit(3)
    if raw == "spin":
        end = time.perf_counter() + 1
        while time.perf_counter() < end:
            pass
        return f"{end - 1}"
    return raw + "!"


def test_stalled_rows_of_a_task_wait_together(spark):
    engine = guarded_engine("sometimes", 0, _sometimes, ["raw"], seconds=4.0)
    texts = ["hang", "a", "die", "hang", "b", "hang", "", "die", "c"]
    start = time.time()
    found = {r.path: (r.text, r.error) for r in engine.run(files(spark, texts).coalesce(1)).collect()}
    assert time.time() - start < 11
    limit, died = (None, "TimeLimit: no text within 4 s"), (None, "WorkerDied: exit code 3")
    expected = [limit, ("a!", None), died, limit, ("b!", None), limit, ("!", None), died, ("c!", None)]
    assert found == {f"/in/{i}.txt": e for i, e in enumerate(expected)}


def test_rows_that_compute_go_one_after_the_other(spark):
    engine = guarded_engine("sometimes", 0, _sometimes, ["raw"], seconds=30.0)
    begun = sorted(float(r.text) for r in engine.run(files(spark, ["spin"] * 3).coalesce(1)).collect())
    assert all(later - earlier > 0.9 for earlier, later in zip(begun, begun[1:], strict=False))


def test_texts_go_to_python_in_small_batches(spark):
    from pyspark.sql import functions as F

    def held(_, raw):
        import sys

        frame = sys._getframe(1)  # the loop over a batch
        while "batch" not in frame.f_locals:
            frame = frame.f_back
        return str(len(frame.f_locals["batch"]))

    many = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("/in/"), "id").alias("path"), F.lit("x").alias("raw"))
    sizes = isolated_engine("held", 0, held, ["raw"]).run(many).agg(F.max(F.col("text").cast("int"))).first()[0]
    assert sizes <= 1000
