"""The whole batch: files in, best texts, results and report out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliomill.functions import paths as P
from foliomill.operators import report, targets
from foliomill.operators.engines import ColumnEngine, Engine, is_available, named_engines
from foliomill.operators.routing import route
from foliomill.operators.selection import select_from_candidates, select_in_row, with_winning_text
from foliomill.plans.state import add_batch, at_once, score_report, score_rows, score_state, totals
from foliomill.plans.target_index import TargetIndex, written_batches, written_targets
from foliomill.session import held, work_folder
from foliomill.sources.sinks import write_report

METADATA = ("path", "target_path", "length")
ROUTING = ("ext", "page_count")
STREAM_BATCHES = 1 << 31  # batch numbers of streams start here
FILES_PER_TASK, BYTES_PER_TASK = 4096, 16 << 20
FEW = FILES_PER_TASK  # paths and numbers of so many files are kept by the driver
CANDIDATE_COLUMNS = "path string, engine string, text string, error string, seconds double"


def convert_corpus(
    spark: SparkSession,
    files_df: DataFrame,
    engines: list[Engine | str],
    existing: DataFrame | None = None,
    overwrite: bool = False,
    preserve_structure: bool = True,
    prefer: str = "auto",
    output_dir: str | None = None,
    ocr_available: bool | None = None,
    unique_targets: bool = False,
    load: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Lazy `(results, stats)` of a file table with `path, ext, length`, and `target_path` or `rel_dir, stem`.

    `engines` are engines or names of registered ones. `existing` is an earlier results table. `unique_targets` states that no two files share a target; a first run of
    expression engines is then one narrow stage without any shuffle. `load` (such as `read_contents`) adds what engines
    read to the files that are left to convert. Use `convert_to_tables` to also keep the texts.
    """
    engines = named_engines(engines)
    files = _targeted(files_df, output_dir, preserve_structure)
    ocr = _ocr_available(engines, ocr_available)
    if overwrite or (unique_targets and existing is None):
        todo, cached = files, None
    else:
        seen = None if existing is None else targets.existing_targets(existing)
        decided = targets.decide(files.select(*METADATA), seen)
        todo = files.join(targets.pending(decided).select("path"), "path", "left_semi")
        cached = targets.as_cached_results(targets.already_done(decided))
    paths = route(todo, ocr, prefer)
    routed = route(load(todo), ocr, prefer) if load else paths
    if _all_columns(engines):
        results = select_in_row(routed, engines, ocr, with_text=False)
    else:
        results = select_from_candidates(_without_content(routed), run_engines(routed, engines, ocr, paths), engines, ocr)
    if cached is not None:
        results = results.unionByName(cached, allowMissingColumns=True)
    return results, report.summarize(results)


def run_engines(routed: DataFrame, engines: list[Engine], ocr_available: bool = True, paths: DataFrame | None = None) -> DataFrame:
    """Long candidate table of all engines, each over the files routed to it. Filtering comes before any Python stage.

    `paths` are the same files before their contents are read, for engines that need no more.

    It has a `part_no` if an engine gives its texts in parts (`page_engine`).
    """
    outputs = []
    for e in engines:
        if not is_available(e) or (e.kind == "ocr" and not ocr_available):
            continue
        files = paths if paths is not None and getattr(e, "by_path", False) else routed
        chosen = files.where(f"{e.runs()} AND ocr_supported" if e.kind == "ocr" else e.runs())
        if isinstance(e, ColumnEngine):
            known = [x for x in ("read_error" if "read_error" in chosen.columns else None, e.error, "cast(NULL AS string)") if x]
            from_engine = chosen.selectExpr("path", f"{e.text} AS text", f"coalesce({', '.join(known)}) AS error")
        else:
            from_engine = e.run(chosen)
        seconds = F.col("seconds") if "seconds" in from_engine.columns else F.lit(None).cast("double")
        part = ["part_no"] if "part_no" in from_engine.columns else []
        outputs.append(from_engine.select("path", F.lit(e.name).alias("engine"), "text", "error", seconds.alias("seconds"), *part))
    if not outputs:
        return routed.sparkSession.createDataFrame([], CANDIDATE_COLUMNS)
    stacked = outputs[0]
    for more in outputs[1:]:
        stacked = stacked.unionByName(more, allowMissingColumns=True)
    return stacked


def convert_to_tables(
    files_df: DataFrame,
    engines: list[Engine | str],
    output_dir: str,
    batch_id: int | None = None,
    overwrite: bool = False,
    preserve_structure: bool = True,
    prefer: str = "auto",
    ocr_available: bool | None = None,
    input_dir: str = "",
    load: Callable[[DataFrame], DataFrame] | None = None,
    short: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Run a batch and write it below `output_dir`; returns `(results, stats)` read back from there.

    `load` (such as `read_contents`) adds what engines read to the files that are left to convert. `short` states that
    `files_df` lists few files, and lists them fast; if there are more than `FEW` nonetheless, it is asked again.

    * `converted/batch_id=N`: results with the winning text. By default every run is a new batch. Running a stated batch again
      replaces it, so retries are safe; if files of its earlier output are not in the list, that is refused.
    * `state`: what the running report is added up from; `targets`: an index of the targets that are there (`target_index`).
    * `conversion_report.json`: the report over all batches.

    Targets of other batches count as existing. The file list and what to convert of it are written out first, so that
    listing and decision are made once and on paths alone; those of at most `FEW` files are held by the driver, where a plan over them is
    one task without a shuffle. With `load`, the files to convert are dealt evenly to tasks, and their contents are read and
    joined to nothing; contents that are in `files_df` already are joined to the files to convert, so a file that arrives
    later is left to the next run. Outside engines' texts are written once before they are scored. What is written on
    the way is removed in the end.
    """
    spark, started, out, folders = files_df.sparkSession, time.time(), output_dir.rstrip("/"), []

    def _written(df: DataFrame, purpose: str) -> DataFrame:
        folders.append(work_folder(spark, purpose))
        df.write.parquet(folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    done = written_batches(spark, out)
    if batch_id is None:
        batch_id = _claimed(spark, out, max((b for b in done if b < STREAM_BATCHES), default=-1) + 1)
    engines = named_engines(engines)
    files = _targeted(files_df, output_dir, preserve_structure)
    ocr = _ocr_available(engines, ocr_available)
    known = [c for c in files.columns if c in (*ROUTING, "read_error")]
    listing = files.select(*METADATA, *known)
    paths = held(listing, FEW) if short else None
    listed = _written(listing, "files") if paths is None else paths
    paths = held(listed.coalesce(1), FEW) if paths is None else paths
    few, listed = paths is not None, listed if paths is None else paths
    index = TargetIndex(spark, out)
    existing = index.lookup(listed, batch_id, few) if done and not overwrite else None
    if batch_id in done:
        replaced = read_batch(spark, out, batch_id).select(F.col("source_path").alias("path"))
        if not replaced.join(listed.select("path"), "path", "left_anti").isEmpty():
            raise ValueError(f"batch {batch_id} holds other files; give another batch_id, or none for a new batch")
    decision = held(targets.decide(listed.coalesce(1), existing, overwrite)) if few else _written(targets.decide(listed, existing, overwrite), "decision")
    convert, cached = targets.pending(decision), targets.already_done(decision)
    todo = convert.drop("action") if load else files.join(convert.select("path"), "path", "left_semi")
    routed = route(todo, ocr, prefer)
    loaded = load(dealt(routed)) if load else routed
    if _all_columns(engines):
        converted = select_in_row(loaded, engines, ocr)
    else:
        candidates = _written(run_engines(loaded, engines, ocr, routed), "candidates")
        chosen = select_from_candidates(_without_content(routed), candidates, engines, ocr)
        converted = with_winning_text(chosen, candidates)
    rows = converted.unionByName(targets.as_cached_results(cached), allowMissingColumns=True)
    if batch_id in done:
        index.forget()
    rows.write.mode("overwrite").parquet(f"{out}/converted/batch_id={batch_id}")
    batch = read_batch(spark, out, batch_id, rows.schema)
    names, near = tuple(e.name for e in engines), held(batch).coalesce(1) if few else batch
    counted = report.counters(near, names).withColumn("seconds", F.lit(time.time() - started))
    first = report.first_errors(report.errors(near))
    left = {"counters": counted, "errors": first, "scores": score_state(score_rows(near))}
    if few:
        found = at_once(left | {"targets": written_targets(near).select("target_path").distinct()})
        index.note(batch_id, found.pop("targets"))
        left = found
    add_batch(spark, out, batch_id, left)
    stats = running_stats(spark, out)
    write_report(report.report_json(stats, input_dir, out, names, pretty=True), out)
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return batch, stats


def dealt(files: DataFrame) -> DataFrame:
    """File rows whose contents are to be read next, dealt to tasks by hash of path, as many as their number and bytes ask for.

    A table of paths is so small that its own splits say nothing of the work behind them: all web pages of a run may lie in one.
    """
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(min(n, files.sparkSession.sparkContext.defaultParallelism), n // FILES_PER_TASK, size // BYTES_PER_TASK, 1)
    return files.repartition(tasks, "path")


def read_results(spark: SparkSession, output_dir: str, texts: bool = False) -> DataFrame | None:
    """Results of all batches, or None before the first; `text` is read only on request."""
    table = _table(spark, output_dir, "converted")
    return table if table is None or texts else table.drop("text")


def read_batch(spark: SparkSession, output_dir: str, batch_id: int, schema: StructType | None = None) -> DataFrame:
    """Results of one batch, without texts; no other batch is listed or read. With its schema no file is opened for it."""
    folder = f"{output_dir.rstrip('/')}/converted"
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("basePath", folder).parquet(f"{folder}/batch_id={batch_id}").drop("text")


def running_stats(spark: SparkSession, output_dir: str) -> DataFrame:
    """Report over all batches, from the last snapshot and the few batches since."""
    total = totals(spark, output_dir, ("counters", "errors"))
    return report.stats(total["counters"], total["errors"], F.col("seconds"))


def running_scores(spark: SparkSession, output_dir: str) -> DataFrame:
    """Score distribution per extension and engine over all batches, without reading results."""
    return score_report(totals(spark, output_dir, ("scores",))["scores"])


def surviving_texts(spark: SparkSession, output_dir: str) -> DataFrame:
    """`target_path, text` for the file export: where overwriting let several files write one target, the last one."""
    texts = read_results(spark, output_dir, texts=True).where(F.col("text").isNotNull())
    keys = texts.select("target_path", F.col("source_path").alias("path"), "batch_id")
    latest = keys.groupBy("target_path", "path").agg(F.max("batch_id").alias("batch_id"))
    order = F.struct("batch_id", "path")
    owners = latest.groupBy("target_path").agg(F.max(order).alias("_last")).select(
        F.col("_last.path").alias("source_path"), F.col("_last.batch_id").alias("batch_id"), "target_path"
    )
    return texts.join(owners, ["source_path", "batch_id", "target_path"], "left_semi").select("target_path", "text")


def _table(spark: SparkSession, output_dir: str, name: str) -> DataFrame | None:
    folder = f"{output_dir.rstrip('/')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("basePath", folder).parquet(folder)


def _claimed(spark: SparkSession, out: str, number: int) -> int:
    """The first number from `number` on that no other run has; a run that fails keeps its number, so that runs at one time never share one."""
    while True:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/claims/{number}")
        storage = path.getFileSystem(spark._jsc.hadoopConfiguration())
        storage.mkdirs(path.getParent())
        if storage.createNewFile(path):
            return number
        number += 1


def _targeted(files: DataFrame, output_dir: str | None, preserve_structure: bool) -> DataFrame:
    if "target_path" in files.columns:
        return files
    if output_dir is None:
        raise ValueError("files have no target_path, so output_dir is needed")
    return files.withColumn(
        "target_path", P.target_path(output_dir.rstrip("/"), F.col("rel_dir"), F.col("stem"), preserve_structure)
    )


def _ocr_available(engines: list[Engine], stated: bool | None) -> bool:
    return any(e.kind == "ocr" and is_available(e) for e in engines) if stated is None else stated


def _all_columns(engines: list[Engine]) -> bool:
    return all(isinstance(e, ColumnEngine) for e in engines)


def _without_content(routed: DataFrame) -> DataFrame:
    return routed.select("path", "target_path", "ext", "length", "use_text", "use_ocr", "ocr_supported")
