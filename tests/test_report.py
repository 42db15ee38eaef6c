import json

from pyspark.sql import functions as F

from foliomill.operators import report
from foliomill.schemas import RESULTS, STATS


def results(spark, rows):
    full = [(p, f"/o{p}", ok, tool, err, src, dst, 0.0, None, None, None, c) for p, ok, tool, err, src, dst, c in rows]
    return spark.createDataFrame(full, RESULTS)


ROWS = [
    ("/a", True, "markitdown", "", 10, 4, True),
    ("/b", True, "paddleocr", "", 20, 5, False),
    ("/c", True, "cached", "已存在，跳过", 40, 0, False),
    ("/e", False, "", "second", 80, 0, False),
    ("/d", False, "", "", 160, 0, False),
]


def test_counters(spark):
    row = report.summarize(results(spark, ROWS), total_time=1.239).first()
    assert (row.total_files, row.converted_files, row.failed_files, row.skipped_files) == (5, 2, 2, 1)
    assert (row.total_size_source, row.total_size_target) == (70, 9)
    assert row.tool_wins == {"markitdown": 1, "paddleocr": 1, "single_option": 0} and row.contested == 1
    assert (row.success_rate, row.total_time, row.ok) == (40.0, 1.24, False)
    assert [tuple(e) for e in row.errors] == [("/d", ""), ("/e", "second")]


def test_stats_have_the_stated_schema(spark):
    found = report.summarize(results(spark, ROWS)).schema
    assert [(f.name, f.dataType.simpleString()) for f in found] == [(f.name, f.dataType.simpleString()) for f in STATS]


def test_no_files_give_a_report_of_zeros(spark):
    row = report.summarize(results(spark, [])).first()
    assert (row.total_files, row.total_size_source, row.success_rate, row.errors, row.ok) == (0, 0, 0.0, [], True)


def test_only_the_first_ten_errors_by_path_are_listed(spark):
    many = results(spark, [(f"/{i:03d}", False, "", "x", 1, 0, False) for i in range(200, 0, -1)])
    row = report.summarize(many).first()
    assert row.failed_files == 200 and [e.path for e in row.errors] == [f"/{i:03d}" for i in range(1, 11)]
    assert report.errors(many).count() == 200
    plan = report.first_errors(report.errors(many))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_counters_add_up_over_batches(spark):
    one, two = results(spark, ROWS[:2]), results(spark, ROWS[2:])
    added = report.add_counters(report.counters(one).unionByName(report.counters(two)))
    assert added.first() == report.counters(results(spark, ROWS)).first()


def test_rate_text(spark):
    cases = [(80.0, "80.0%"), (12.25, "12.2%"), (12.75, "12.8%"), (100 / 3, "33.3%"), (0.0, "0.0%"), (100.0, "100.0%")]
    df = spark.createDataFrame([(r,) for r, _ in cases], "r double")
    assert [r[0] for r in df.select(report.rate_text(F.col("r"))).collect()] == [t for _, t in cases]


def test_json_report(spark):
    stats = report.summarize(results(spark, ROWS), total_time=2.0)
    for pretty in (False, True):
        text = report.report_json(stats, "/in", "/out", pretty=pretty).first().value
        body = json.loads(text)
        assert list(body) == ["timestamp", "input_dir", "output_dir", "mode", "tools", "quality_weights", "stats"]
        assert body["quality_weights"] == {"accuracy": 0.6, "completeness": 0.4}
        assert body["stats"]["success_rate"] == "40.0%" and body["stats"]["errors"] == [["/d", ""], ["/e", "second"]]
        assert list(body["stats"])[:4] == ["total_files", "converted_files", "failed_files", "skipped_files"]
        assert ("\n" in text) == pretty


def test_quality_report_percentiles_and_totals(spark):
    rows = [("a", "x", i / 10, i % 2 == 0) for i in range(1001)] + [("b", "x", 50.0, True)]
    scored = spark.createDataFrame(rows, "ext string, engine string, weighted_score double, won boolean")
    found = {(r.ext, r.engine): r for r in report.quality_report(scored, ("ext", "engine")).collect()}
    assert found.keys() == {("a", "x"), ("a", None), ("b", "x"), ("b", None), (None, None)}
    a = found["a", "x"]
    assert (a.n, a.p25, a.p50, a.p75, a.min_score, a.max_score, a.wins) == (1001, 25.0, 50.0, 75.0, 0.0, 100.0, 501)
    assert found[None, None].n == 1002 and found["b", None].win_rate == 1.0
