import random

import pytest
from pyspark.sql import functions as F

from foliomill.functions import ocr
from foliomill.operators import pages as P
from foliomill.operators import tables as TB
from foliomill.operators.scoring import with_counts
from foliomill.schemas import OCR_LINES_BY_FIELD, OCR_LINES_BY_ROW

PAGES = [("d", 3, "third"), ("d", 1, "first"), ("d", 2, None), ("e", 1, ""), ("f", 1, None)]
SCHEMA = "path string, page_no int, text string"


def test_pages_are_joined_in_order_and_missing_ones_left_out(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    found = {r.path: (r.part_no, r.page_count, r.text) for r in P.assemble_pages(df).collect()}
    assert found == {
        "d": (0, 2, "--- 第 1 页 ---\nfirst\n\n--- 第 3 页 ---\nthird"),
        "e": (0, 1, "--- 第 1 页 ---\n"),
    }
    assert {r.path: r.page_count for r in P.page_counts(df).collect()} == {"d": 3, "e": 1, "f": 1}


def test_parts_of_a_long_document_join_to_the_whole(spark):
    df = spark.createDataFrame([("d", i, f"text {i}") for i in range(1, 1001)], SCHEMA)
    whole = P.assemble_pages(df, pages_per_part=1000).first().text
    parts = P.assemble_pages(df, pages_per_part=64).orderBy("part_no").collect()
    assert len(parts) == 16 and max(p.page_count for p in parts) == 64
    assert "\n\n".join(p.text for p in parts) == whole


def test_counts_of_pages_add_up_to_those_of_the_whole_text(spark):
    rng = random.Random(3)
    atoms = ["a", "aaaaa", "------", ".", " ", "\n", "\n\n", "\n\n\n", "\x01", chr(0xFFFD), chr(0x4E2D) * 30, chr(0x3000), "-", "é"]
    rows = [(f"d{d}", n, "".join(rng.choices(atoms, k=rng.randint(0, 12)))) for d in range(150) for n in range(1, rng.randint(2, 7))]
    df = spark.createDataFrame(rows, SCHEMA)
    summed = P.assembled_counts(df)
    whole = with_counts(P.assemble_pages(df).select("path", "text")).select(*summed.columns)
    assert summed.exceptAll(whole).count() == 0 and summed.count() == whole.count() == 150


@pytest.mark.parametrize(
    "result, text, found",
    [
        (None, "", False),
        ([], "", False),
        ([None], "", False),
        ([(["one", "two"], [0.9, 0.1])], "one\ntwo", True),
        ([(["one"], [0.9]), (["second result"], [0.9])], "one", True),
        ([([], [])], "", True),
        ([(["one", None, "three"], None)], "one\nthree", True),
    ],
)
def test_ocr_results_with_fields(spark, result, text, found):
    df = spark.createDataFrame([(result,)], f"result {OCR_LINES_BY_FIELD.simpleString()}")
    row = df.select(ocr.text_of_fields(F.col("result")), ocr.found_fields(F.col("result"))).first()
    assert tuple(row) == (text, found)


@pytest.mark.parametrize(
    "result, text, found",
    [
        (None, "", False),
        ([], "", False),
        ([[]], "", False),
        ([[([[0.0, 1.0]], "one", 0.01), ([[0.0, 1.0]], "two", 0.9)]], "one\ntwo", True),
        ([[(None, "one", None), (None, None, 0.9)], [(None, "second", 1.0)]], "one", True),
    ],
)
def test_ocr_results_with_rows(spark, result, text, found):
    df = spark.createDataFrame([(result,)], f"result {OCR_LINES_BY_ROW.simpleString()}")
    row = df.select(ocr.text_of_rows(F.col("result")), ocr.found_rows(F.col("result"))).first()
    assert tuple(row) == (text, found)


def test_table_with_column_names(spark):
    rows = [("k", 2, "x|y", 1.5), ("k", 1, "a\r\nb\nc", None), ("j", 9, None, 2.0)]
    df = spark.createDataFrame(rows, "key string, pos int, name string, value double")
    found = {r.key: (r.row_count, r.text) for r in TB.rows_to_markdown(df, "key", "pos", ["name", "value"]).collect()}
    assert found == {
        "k": (2, "| name | value |\n|---|---|\n| a b c |  |\n| x\\|y | 1.5 |"),
        "j": (1, "| name | value |\n|---|---|\n|  | 2.0 |"),
    }


@pytest.mark.parametrize("header", [True, False])
def test_table_parts_join_to_the_whole(spark, header):
    df = spark.range(1, 501).select(F.lit("hot").alias("key"), "id", F.concat(F.lit("v"), "id").alias("v"))
    whole = TB.rows_to_markdown(df, "key", "id", ["v"], header, rows_per_part=1000).first().text
    parts = TB.rows_to_markdown(df, "key", "id", ["v"], header, rows_per_part=50).orderBy("part_no").collect()
    assert len(parts) == 11 and max(p.row_count for p in parts) == 50
    assert "\n".join(p.text for p in parts) == whole
    assert whole.startswith("| v |\n|---|\n| v1 |" if header else "| v1 |\n|---|\n| v2 |")


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n1,"line\nbreak"\n2,"q ""x"" | y"\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("k,v\nonly,row\n", encoding="utf-8")
    found = {r.path.rsplit("/", 1)[1]: r.text for r in TB.csv_to_markdown(spark, str(tmp_path)).collect()}
    assert found == {
        "a.csv": '| h1 | h2 |\n|---|---|\n| 1 | line break |\n| 2 | q "x" \\| y |',
        "b.csv": "| k | v |\n|---|---|\n| only | row |",
    }
