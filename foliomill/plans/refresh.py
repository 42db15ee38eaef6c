"""Runs over a folder that changes: new and changed files are converted, texts of removed files are given up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators.engines import Engine
from foliomill.plans.corpus import convert_to_tables, read_results, surviving_texts
from foliomill.session import work_folder
from foliomill.sources.changes import ADDED, CHANGED, REMOVED, commit_changes, known_state, stage_changes


def refresh(
    files: DataFrame, engines: list[Engine], output_dir: str, load: Callable[[DataFrame], DataFrame] | None = None, every: bool = False, **options
) -> DataFrame:
    """Bring the tables below `output_dir` up to the files of a manifest (path, length, modificationTime, target_path, ...).

    Files are compared with the last version (`record_changes`). Converted again are changed files whose text is the one at their
    target, and, for targets whose source is gone, the first file that is left with that target; then new files, by the usual rule
    that an existing target is kept. Returns the changes of this version, which is committed last: a run that fails is made up for by
    the next. `current_texts` leaves out what removed files had written.
    """
    spark, out = files.sparkSession, output_dir.rstrip("/")
    number, changes = stage_changes(files, f"{out}/manifest", every)
    new = changes.where(F.col("change").isin(ADDED, CHANGED)).select("path")
    results = read_results(spark, out)
    if results is not None:
        writers = _writers(results)
        gone = changes.where(F.col("change") == REMOVED).select("path")
        freed = writers.join(gone, "path", "left_semi").select("target_path")
        heirs = files.join(freed, "target_path", "left_semi").groupBy("target_path").agg(F.min("path").alias("path"))
        changed = changes.where(F.col("change") == CHANGED).select("path")
        again = writers.join(changed, "path", "left_semi").select("path").union(heirs.select("path")).distinct()
        folder = work_folder(spark, "again")
        again.write.parquet(folder)
        again = spark.read.schema(again.schema).parquet(folder)
        new = new.join(again, "path", "left_anti")
        if not again.isEmpty():
            convert_to_tables(files.join(again, "path", "left_semi"), engines, out, overwrite=True, load=load, **options)
    convert_to_tables(files.join(new, "path", "left_semi"), engines, out, load=load, **options)
    return commit_changes(spark, f"{out}/manifest", number)


def current_texts(spark: SparkSession, output_dir: str) -> DataFrame:
    """`target_path, text` of the files that are there: what `surviving_texts` has, without texts of removed files."""
    out = output_dir.rstrip("/")
    here = known_state(spark, f"{out}/manifest").select(F.col("path").alias("source_path"))
    owned = _writers(read_results(spark, out)).withColumnRenamed("path", "source_path").join(here, "source_path", "left_semi")
    return surviving_texts(spark, out).join(owned.select("target_path"), "target_path", "left_semi")


def _writers(results: DataFrame) -> DataFrame:
    """The file whose text is at each target: the last that was converted, by batch and path."""
    wrote = results.where("success AND tool_used <> 'cached'")
    last = wrote.groupBy("target_path").agg(F.max(F.struct("batch_id", "source_path")).alias("last"))
    return last.select("target_path", F.col("last.source_path").alias("path"))
