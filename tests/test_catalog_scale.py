"""Queries over tables of other shapes than those of the small folders."""

import pytest

from foliomill.operators.engines import table_engine
from foliomill.operators.routing import route
from foliomill.plans import catalog
from foliomill.plans.corpus import run_engines


@pytest.mark.parametrize("parts", (1, 3))
def test_a_stream_reads_a_table_of_several_files(spark, sf_dir, tmp_path, parts):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(7)
    pages.repartition(parts).write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.incremental_convert(spark, str(tmp_path)).count() == 7


def test_texts_of_files_that_are_not_converted_are_not_scored(spark):
    rows = [(f"/in/{k}.pdf", f"/out/{k}.md", ".pdf", 10) for k in range(3)]
    files = route(spark.createDataFrame(rows, "path string, target_path string, ext string, length bigint"))
    texts = spark.range(100).selectExpr("concat('/in/', id, '.pdf') AS path", "'A text.' AS text", "cast(NULL AS string) AS error")
    engine = table_engine("markitdown", 0, texts)
    assert sorted(r.path for r in run_engines(files, [engine]).collect()) == [r[0] for r in rows]
    timed = table_engine("markitdown", 0, texts.selectExpr("*", "1D AS seconds"))
    assert run_engines(files, [timed]).count() == 100
