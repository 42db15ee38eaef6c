import json
import os

import pytest
from pyspark.sql import functions as F

from foliomill import (
    ColumnEngine,
    convert_corpus,
    convert_to_tables,
    isolated_engine,
    manifest,
    read_contents,
    scan_files,
    walk_files,
)
from foliomill.functions import markup
from foliomill.operators.engines import table_engine
from foliomill.plans.corpus import read_results, running_stats, surviving_texts
from foliomill.sources.files import stream_files
from foliomill.sources.sinks import export_texts
from foliomill.streaming.incremental import convert_stream

PASS_THROUGH = ColumnEngine("markitdown", 0, text=markup.decode_text("content"))


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "in"
    texts = {
        "sample.txt": "This is a sample document for testing.",
        "sample.md": "# Sample Document\n\nThis is a test.",
        "sub/deep/page.html": "<h1>T</h1>",
        "sub/empty.json": "",
        "build/out.txt": "skipped",
        ".git/x.txt": "hidden",
        "temp_file.txt": "temp content",
        "sub/sample.csv": "a,b",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return root


def names(df):
    return sorted(r.name for r in df.select("name").collect())


def test_scan(spark, corpus):
    found = scan_files(spark, str(corpus))
    assert names(found) == ["page.html", "sample.csv", "sample.txt", "temp_file.txt"]
    row = found.where("name = 'page.html'").first()
    assert (row.rel_dir, row.stem, row.ext, row.length) == ("sub/deep", "page", ".html", 10)
    assert row.path == f"{corpus}/sub/deep/page.html"
    assert row.target_path == f"{corpus}/markdown_output/sub/deep/page.md"
    assert names(scan_files(spark, str(corpus), extensions=[".txt"], exclude_patterns=["TEMP_"])) == ["sample.txt"]


def test_walk_sees_hidden_and_empty_files_and_prunes_directories(spark, corpus):
    for name in (".hidden.txt", "_u.txt", "sub/deep/a/b/c/d.TXT", "markdown_output/conversion_report.json", "venv/x.txt"):
        (corpus / name).parent.mkdir(parents=True, exist_ok=True)
        (corpus / name).write_text("x", encoding="utf-8")
    os.symlink(corpus / "sub", corpus / "link")
    expected = [".hidden.txt", "_u.txt", "d.TXT", "empty.json", "page.html", "sample.csv", "sample.txt", "temp_file.txt"]
    for entries in (1, 3, 1000):
        found = walk_files(spark, str(corpus), wave_entries=entries)
        assert names(found) == expected
    row = found.where("name = 'page.html'").first()
    assert (row.rel_dir, row.stem, row.ext, row.length) == ("sub/deep", "page", ".html", 10)
    contents = {r.name: bytes(r.content) for r in read_contents(found).collect()}
    assert contents["page.html"] == b"<h1>T</h1>" and contents["empty.json"] == b""
    by_uri = walk_files(spark, f"file://{corpus}", exclude_patterns=[".hidden"])
    assert names(by_uri) == expected[1:]


def test_a_file_that_is_gone_has_no_content(spark):
    df = spark.createDataFrame([("/no/such/file.txt", 1)], "path string, k int")
    assert read_contents(df).first().content is None


def test_scan_reads_no_contents(spark, corpus):
    plan = scan_files(spark, str(corpus)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def run(spark, corpus, batch_id=None, **options):
    files = walk_files(spark, str(corpus))
    out = str(corpus / "markdown_output")
    return convert_to_tables(files, [PASS_THROUGH], out, batch_id, input_dir=str(corpus), load=read_contents, **options)


def tools(results):
    return {os.path.basename(r.source_path): r.tool_used for r in results.collect()}


def test_batch_runs_skip_what_is_there(spark, corpus):
    results, stats = run(spark, corpus)
    assert tools(results) == {
        "sample.txt": "markitdown", "page.html": "markitdown", "temp_file.txt": "markitdown", "sample.csv": "markitdown", "empty.json": "",
    }
    first = stats.first()
    assert (first.total_files, first.converted_files, first.failed_files) == (5, 4, 1)
    assert [e.error for e in first.errors] == ["MarkItDown: 转换结果为空"]

    (corpus / "new.xml").write_text("<a/>", encoding="utf-8")
    results, stats = run(spark, corpus)
    again = tools(results)
    assert again.pop("new.xml") == "markitdown" and again.pop("empty.json") == ""
    assert set(again.values()) == {"cached"} and len(again) == 4
    total = stats.first()
    assert (total.total_files, total.converted_files, total.skipped_files, total.failed_files) == (11, 5, 4, 2)

    report = corpus / "markdown_output" / "conversion_report.json"
    text = report.read_text(encoding="utf-8")
    assert json.loads(text)["stats"]["converted_files"] == 5 and "转换结果为空" in text


def test_running_a_batch_again_replaces_it(spark, corpus):
    run(spark, corpus, 0)
    _, stats = run(spark, corpus, 0)
    assert stats.first().total_files == 5 and stats.first().converted_files == 4


def test_a_batch_of_other_files_is_not_replaced(spark, corpus, tmp_path):
    rows = [("/in/one.txt", "/o/one.md", ".txt", 3, b"one"), ("/in/two.txt", "/o/two.md", ".txt", 3, b"two")]
    files = spark.createDataFrame(rows, "path string, target_path string, ext string, length bigint, content binary")
    out = str(tmp_path / "out")
    for path in ("/in/one.txt", "/in/two.txt"):
        convert_to_tables(files.where(F.col("path") == path), [PASS_THROUGH], out)
    kept = {(r.batch_id, r.source_path, r.text) for r in read_results(spark, out, texts=True).collect()}
    assert kept == {(0, "/in/one.txt", "one"), (1, "/in/two.txt", "two")}
    with pytest.raises(ValueError):
        convert_to_tables(files.where("path = '/in/two.txt'"), [PASS_THROUGH], out, 0)


def test_files_that_cannot_be_listed_or_read_keep_their_fault(spark, corpus):
    os.symlink(corpus / "loop.txt", corpus / "loop.txt")
    os.symlink(corpus / "nowhere", corpus / "gone.txt")
    files = read_contents(walk_files(spark, str(corpus), wave_entries=2))
    faults = {r.name: r.read_error for r in files.collect()}
    assert faults["gone.txt"].startswith("FileNotFoundError: ") and faults["loop.txt"].startswith("OSError: ")
    assert faults["sample.txt"] is None
    results, _ = run(spark, corpus)
    found = {os.path.basename(r.source_path): r.error_message for r in results.collect()}
    assert found["loop.txt"].startswith("MarkItDown: OSError: ") and found["sample.txt"] == ""


def test_roots_are_taken_as_the_file_system_names_them(spark, corpus, monkeypatch):
    expected = {r.path for r in walk_files(spark, str(corpus)).collect()}
    other = f"{corpus}/sub/../../{corpus.name}"
    assert {r.path for r in walk_files(spark, other).collect()} == expected
    assert {r.path for r in scan_files(spark, other).collect()} == {r.path for r in scan_files(spark, str(corpus)).collect()}
    with pytest.raises(FileNotFoundError):
        walk_files(spark, f"{corpus}/none")


def test_overwrite_converts_again_and_the_last_writer_wins(spark, corpus):
    out = str(corpus / "markdown_output")
    files = walk_files(spark, str(corpus), preserve_structure=False)
    _, first = convert_to_tables(files, [PASS_THROUGH], out, 0, load=read_contents)
    assert first.first().skipped_files == 1  # sample.txt and sub/sample.csv share sample.md
    results, stats = convert_to_tables(files, [PASS_THROUGH], out, 1, overwrite=True, load=read_contents)
    assert results.where("success").count() == 4 and results.where("tool_used = 'cached'").count() == 0
    texts = {os.path.basename(r.target_path): r.text for r in surviving_texts(spark, out).collect()}
    assert texts["sample.md"] == "a,b" and len(texts) == 3


def test_outside_engine_runs_give_the_same_as_the_lazy_plan(spark, tmp_path):
    rows = [(f"/in/{i}.pdf", f"/o/{i // 2}.md", ".pdf", 50) for i in range(20)]
    files = spark.createDataFrame(rows, "path string, target_path string, ext string, length bigint")
    first = files.select("path", F.when(F.col("path") != "/in/4.pdf", F.concat(F.lit("One. Two. "), "path")).alias("text"), F.lit(None).cast("string").alias("error"))
    second = isolated_engine("paddleocr", 1, lambda _, path: path * 3 if "1" in path else 1 / 0, ["path"], kind="ocr")
    engines = [table_engine("markitdown", 0, first), second]
    lazy, _ = convert_corpus(spark, files, engines)
    written, _ = convert_to_tables(files, engines, str(tmp_path / "out"))
    columns = [c for c in lazy.columns if c != "processing_time"]
    assert written.select(columns).exceptAll(lazy.select(columns)).count() == 0
    assert written.count() == lazy.count() == 20
    message = "MarkItDown: 转换结果为空; PaddleOCR: ZeroDivisionError: division by zero"
    assert lazy.where("source_path = '/in/4.pdf'").first().error_message == message
    texts = read_results(spark, str(tmp_path / "out"), texts=True)
    assert texts.where("success AND tool_used <> 'cached' AND text IS NULL").count() == 0


def test_a_second_candidate_of_an_engine_is_an_error(spark):
    files = spark.createDataFrame([("/a.pdf", "/o/a.md", ".pdf", 5)], "path string, target_path string, ext string, length bigint")
    texts = spark.createDataFrame([("/a.pdf", "One.", None), ("/a.pdf", "Two.", None)], "path string, text string, error string")
    with pytest.raises(Exception, match="several candidates of markitdown"):
        convert_corpus(spark, files, [table_engine("markitdown", 0, texts)])[0].collect()


def test_export_writes_whole_files_and_can_be_repeated(spark, tmp_path):
    texts = spark.createDataFrame([(f"{tmp_path}/out/{i}/f.md", f"é中\n{i}") for i in range(10)], "target_path string, text string")
    for _ in range(2):
        sizes = {r.target_path: r.bytes for r in export_texts(texts).collect()}
    assert set(sizes.values()) == {len("é中\n0".encode())}
    for r in texts.collect():
        assert open(r.target_path, encoding="utf-8", newline="").read() == r.text
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".part")]


class Stage:
    """As much of a frame as an export looks at; it gives the function that would run in the tasks."""

    def __init__(self, spark):
        self.sparkSession = spark

    def where(self, _):
        return self

    def select(self, *_):
        return self

    def mapInPandas(self, function, _):
        return function


def test_names_of_a_crowded_folder_are_made_in_a_folder_of_the_task(spark, tmp_path):
    import pandas as pd

    seen = []

    class Text(str):
        def encode(self, *options):
            seen.append({e.name for e in os.scandir(tmp_path) if e.name.startswith(".") and e.is_dir()})
            return super().encode(*options)

    def batch(name, n):
        return pd.DataFrame({"target_path": [f"{tmp_path}/{name}{i}.txt" for i in range(n)], "text": [Text(f"text {i}") for i in range(n)]})

    (tmp_path / "a7.txt").mkdir()  # a file that cannot be moved in place
    (tmp_path / "a7.txt" / "x").write_text("x")
    found = list(export_texts(Stage(spark))(iter([batch("a", 40), batch("b", 3)])))
    assert not seen[0] and len(seen[1]) == 1 and all(s == seen[1] for s in seen[1:])
    assert [i for i, fault in enumerate(found[0]["error"]) if fault] == [7] and found[1]["error"].isna().all()
    assert sorted(os.listdir(tmp_path)) == sorted([*(f"a{i}.txt" for i in range(40)), *(f"b{i}.txt" for i in range(3))])
    assert (tmp_path / "a9.txt").read_text() == "text 9"


def test_a_file_of_the_same_bytes_is_not_replaced_but_touched(spark, tmp_path):
    places = {n: tmp_path / f"{n}.txt" for n in ("same", "other", "longer", "link")}
    for n in ("same", "other", "longer"):
        places[n].write_text("abc")
        os.utime(places[n], (1, 1))
    places["link"].symlink_to(places["same"])
    before = {n: os.lstat(p).st_ino for n, p in places.items()}
    texts = {"same": "abc", "other": "abd", "longer": "abcd", "link": "abc"}
    rows = [(str(places[n]), t) for n, t in texts.items()]
    found = export_texts(spark.createDataFrame(rows, "target_path string, text string")).collect()
    assert sorted((r.bytes, r.error) for r in found) == [(3, None), (3, None), (3, None), (4, None)]
    assert {n: p.read_text() for n, p in places.items()} == texts
    assert {n for n, p in places.items() if os.lstat(p).st_ino == before[n]} == {"same"} and not places["link"].is_symlink()
    assert all(p.stat().st_mtime > 1 for p in places.values())


def test_stream_reads_each_path_once_and_equals_the_batch(spark, corpus, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        arrivals = stream_files(spark, str(corpus), max_files=2)
        query = convert_stream(arrivals, lambda b: manifest(b, str(corpus), out), [PASS_THROUGH], out, state)
        query.awaitTermination()
        return running_stats(spark, out).first()

    first = go()
    batch, _ = convert_corpus(spark, scan_files(spark, str(corpus), output_dir=out, content=True), [PASS_THROUGH])
    columns = [c for c in batch.columns if c != "processing_time"]
    streamed = read_results(spark, out).select(columns)
    assert streamed.exceptAll(batch.select(columns)).count() == 0 and streamed.count() == batch.count() == first.total_files

    (corpus / "sample.txt").write_text("changed", encoding="utf-8")
    (corpus / "later.txt").write_text("new one", encoding="utf-8")
    second = go()
    assert second.total_files == first.total_files + 1 and second.converted_files == first.converted_files + 1
    changed = read_results(spark, out, texts=True).where("source_path LIKE '%/sample.txt'").collect()
    assert [r.text for r in changed] == ["This is a sample document for testing."]


def test_a_small_batch_of_a_stream_takes_few_jobs(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for k in range(6):
        (root / f"{k}.txt").write_text(f"text {k}", encoding="utf-8")
    arrivals = stream_files(spark, str(root), max_files=2)
    query = convert_stream(arrivals, lambda b: manifest(b, str(root), out), [PASS_THROUGH], out, str(tmp_path / "state"), short=True)
    query.awaitTermination()
    assert {(r.source_path[-5:], r.text) for r in read_results(spark, out, texts=True).collect()} == {(f"{k}.txt", f"text {k}") for k in range(6)}
    assert running_stats(spark, out).first().converted_files == 6
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(query.runId)
    assert 3 <= len(jobs) <= 3 * 18


class Cluster:
    """As much of a session as the work folder looks at."""

    def __init__(self, master, **settings):
        self.conf = self.sparkContext = self
        self.master, self.settings = master, settings

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)

    def getConf(self):
        return self


def test_work_folder_follows_the_setting():
    from foliomill.session import work_folder

    assert work_folder(Cluster("spark://x", spark_checkpoint_dir="/shared/"), "x").startswith("/shared/x-")
    with pytest.raises(ValueError):
        work_folder(Cluster("spark://x"), "x")
    assert os.path.isdir(os.path.dirname(work_folder(Cluster("local[4]"), "x")))
