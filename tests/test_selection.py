import pytest

from foliomill import ColumnEngine
from foliomill.operators.engines import table_engine
from foliomill.operators.routing import route
from foliomill.operators.selection import select_from_candidates, select_in_row, with_winning_text
from foliomill.plans.corpus import convert_corpus, run_engines
from tests.sql_scores import sql_scores

GOOD, FLAT = "One. Two. Three.\n\nFour.", "no marks at all"
# name, ext, text engine's text, second engine's text
CASES = [
    ("tie", ".pdf", GOOD, GOOD),
    ("first better", ".pdf", GOOD, "\x01" * 20),
    ("second better", ".pdf", "\x01" * 20, GOOD),
    ("only first", ".pdf", GOOD, None),
    ("only second", ".pdf", None, GOOD),
    ("empty against text", ".pdf", "", GOOD),
    ("blank against nothing", ".pdf", " \n", None),
    ("blank against text", ".pdf", " \n", FLAT),
    ("both blank", ".pdf", " ", "\t"),
    ("nothing", ".pdf", None, None),
    ("both empty", ".pdf", "", ""),
    ("image", ".png", GOOD, FLAT),
    ("word", ".docx", FLAT, GOOD),
]


def files(spark):
    rows = [(n, f"/out/{n}.md", e, 120, a, b) for n, e, a, b in CASES]
    return spark.createDataFrame(rows, "path string, target_path string, ext string, length bigint, a string, b string")


def engines():
    return [ColumnEngine("markitdown", 0, text="a"), ColumnEngine("paddleocr", 1, "ocr", text="b")]


@pytest.fixture(scope="module")
def chosen(spark):
    return {r.source_path: r for r in select_in_row(route(files(spark)), engines()).collect()}


@pytest.mark.parametrize(
    "name, tool, text, contested",
    [
        ("tie", "markitdown", GOOD, True),
        ("first better", "markitdown", GOOD, True),
        ("second better", "paddleocr", GOOD, True),
        ("only first", "markitdown", GOOD, False),
        ("only second", "paddleocr", GOOD, False),
        ("empty against text", "paddleocr", GOOD, False),
        ("blank against nothing", "markitdown", " \n", False),
        ("blank against text", "paddleocr", FLAT, True),
        ("both blank", "markitdown", " ", True),
        ("image", "paddleocr", FLAT, False),
        ("word", "markitdown", FLAT, False),
    ],
)
def test_winner(chosen, name, tool, text, contested):
    r = chosen[name]
    assert (r.success, r.tool_used, r.text, r.contested, r.error_message) == (True, tool, text, contested, "")
    ext = dict((n, e) for n, e, _, _ in CASES)[name]
    assert r.quality_score.weighted_score == pytest.approx(sql_scores([(text, ext, 120)])[0][2])
    assert r.file_size_target == len(text.encode()) and r.file_size_source == 120


def test_scores_of_both_engines_are_kept(chosen):
    assert chosen["second better"].markitdown_score == pytest.approx(sql_scores([("\x01" * 20, ".pdf", 120)])[0][2])
    assert chosen["second better"].ocr_score == pytest.approx(sql_scores([(GOOD, ".pdf", 120)])[0][2])
    assert chosen["only first"].ocr_score is None and chosen["image"].markitdown_score is None


def test_failures_join_the_errors_of_the_engines_that_ran(chosen):
    nothing, empty = chosen["nothing"], chosen["both empty"]
    for r in (nothing, empty):
        assert (r.success, r.tool_used, r.quality_score, r.text, r.file_size_target) == (False, "", None, None, 0)
        assert r.error_message == "MarkItDown: 转换结果为空"


def test_row_and_long_form_agree(spark, chosen):
    routed = route(files(spark))
    candidates = run_engines(routed, engines())
    results = select_from_candidates(routed, candidates, engines())
    found = {r.source_path: r for r in with_winning_text(results, candidates).collect()}
    assert found.keys() == chosen.keys()
    for name, r in found.items():
        keep = [c for c in chosen[name].asDict() if c not in ("processing_time", "error_message")]
        assert [r[c] for c in keep] == [chosen[name][c] for c in keep], name


def outside(spark):
    first = [("f", None, "IOError: bad"), ("g", None, None), ("i", GOOD, None)]
    second = [("f", None, "Fault: no"), ("g", "", None), ("i", None, None), ("w", GOOD, None)]
    schema = "path string, text string, error string"
    a, b = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    return [table_engine("markitdown", 0, a), table_engine("paddleocr", 1, b, "ocr")]


def test_outside_candidates(spark):
    rows = [("f", ".pdf"), ("g", ".pdf"), ("i", ".png"), ("w", ".docx")]
    fs = spark.createDataFrame([(p, f"/o/{p}.md", e, 10) for p, e in rows], "path string, target_path string, ext string, length bigint")
    results, stats = convert_corpus(spark, fs, outside(spark), unique_targets=True)
    found = {r.source_path: (r.success, r.error_message) for r in results.collect()}
    assert found == {
        "f": (False, "MarkItDown: IOError: bad; PaddleOCR: Fault: no"),
        "g": (False, "MarkItDown: 转换结果为空"),
        "i": (False, ""),  # the text engine's candidate does not count for an image
        "w": (False, "PaddleOCR: PaddleOCR 仅支持图片和PDF"),  # nor OCR's for a Word file
    }
    assert stats.first().failed_files == 4 and not stats.first().ok


def test_three_engines_and_priorities(spark):
    three = [ColumnEngine("late", 5, text="a"), ColumnEngine("early", 1, text="b"), ColumnEngine("mid", 3, text="concat(b, '')")]
    fs = files(spark).where("path IN ('tie', 'first better')")
    found = {r.source_path: r.tool_used for r in select_in_row(route(fs), three).collect()}
    assert found == {"tie": "early", "first better": "late"}


def test_row_selection_does_not_shuffle_and_long_selection_moves_no_text(spark):
    routed = route(files(spark))
    row = select_in_row(routed, engines())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in row
    long = select_from_candidates(routed.drop("a", "b"), run_engines(routed, engines()), engines())
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "text" not in " ".join(long.columns)
