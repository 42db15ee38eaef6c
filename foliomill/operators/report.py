"""Batch counters, quality report and the JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.schemas import (
    ACCURACY_WEIGHT,
    CACHED,
    COMPLETENESS_WEIGHT,
    MAX_REPORTED_ERRORS,
    OCR_ENGINE,
    REPORT_MODE,
    SINGLE_OPTION,
    TEXT_ENGINE,
)

WIN_KEYS = (TEXT_ENGINE, OCR_ENGINE, SINGLE_OPTION)
SCORE_BINS_PER_POINT = 10


# The report of each batch of a stream is made anew; as SQL an expression is one call to the JVM.


def _total(value: str) -> str:
    return f"cast(coalesce(sum({value}), 0) AS bigint)"


def _count_if(condition: str) -> str:
    return _total(f"cast(coalesce({condition}, false) AS int)")


def _quoted(text: str, mark: str) -> str:
    return mark + text.replace(mark, mark * 2) + mark


def counters(results: DataFrame, engines: tuple[str, ...] = ()) -> DataFrame:
    """All counters of a batch as one flat row that adds up over batches.

    Sizes cover successful files, skipped ones included: those add their source and no target bytes. Wins of the two
    fixed engines and of any further `engines` come as `wins_<name>`; `wins_single_option` counts winners outside
    them, which the fixed rules never produce.
    """
    cached = f"tool_used = '{CACHED}'"
    converted = f"(success AND NOT {cached})"
    named = {k: _quoted(k, "'") for k in dict.fromkeys((*WIN_KEYS, *engines)) if k != SINGLE_OPTION}
    counts = {
        "total_files": "count(1)",
        "converted_files": _count_if(converted),
        "failed_files": _count_if("NOT success"),
        "skipped_files": _count_if(f"success AND {cached}"),
        "total_size_source": _total("CASE WHEN success THEN file_size_source END"),
        "total_size_target": _total("CASE WHEN success THEN file_size_target END"),
        **{f"wins_{k}": _count_if(f"{converted} AND tool_used = {name}") for k, name in named.items()},
        f"wins_{SINGLE_OPTION}": _count_if(f"{converted} AND NOT tool_used IN ({', '.join(named.values())})"),
        "contested": _count_if("contested"),
    }
    return results.selectExpr(*[f"{count} AS {_quoted(name, '`')}" for name, count in counts.items()])


def add_counters(batches: DataFrame, *others: str) -> DataFrame:
    """Sum of the counter rows of several batches, and further aggregates of them as SQL."""
    names = [_quoted(c, "`") for c in batches.columns if c != "seconds"]
    return batches.selectExpr(*[f"{_total(c)} AS {c}" for c in names], *others)


def success_rate(converted: Column, total: Column) -> Column:
    """Percent converted; skipped files count in the total only."""
    return converted / F.greatest(total, F.lit(1)) * 100


def errors(results: DataFrame) -> DataFrame:
    """Every failed file with its error, `path, error`."""
    failed = results.where(~F.col("success"))
    return failed.select(F.col("source_path").alias("path"), F.col("error_message").alias("error"))


def first_errors(error_rows: DataFrame, n: int = MAX_REPORTED_ERRORS) -> DataFrame:
    """The first `n` errors by path: a bounded heap per task, no full sort."""
    return error_rows.orderBy("path", "error").limit(n)


def stats(counter_row: DataFrame, error_rows: DataFrame, total_time: float | Column | None = None) -> DataFrame:
    """The one-row report record from counters and errors."""
    listed = first_errors(error_rows).selectExpr("array_sort(collect_list(struct(path, error))) AS errors")
    wins = [c for c in counter_row.columns if c.startswith("wins_")]
    by_tool = [x for w in wins for x in (_quoted(w.removeprefix("wins_"), "'"), _quoted(w, "`"))]
    return counter_row.select(
        "total_files",
        "converted_files",
        "failed_files",
        "skipped_files",
        "total_size_source",
        "total_size_target",
        F.round(F.lit(total_time).cast("double"), 2).alias("total_time"),
        success_rate(F.col("converted_files"), F.col("total_files")).alias("success_rate"),
        F.expr(f"map({', '.join(by_tool)})").alias("tool_wins"),
        "contested",
        listed.scalar().alias("errors"),
        (F.col("failed_files") == 0).alias("ok"),
    )


def summarize(results: DataFrame, total_time: float | None = None) -> DataFrame:
    """Report record of a results table. With no files at all it is one row of zeros."""
    return stats(counters(results), errors(results), total_time)


def rate_text(rate: Column) -> Column:
    """`80.0%`; halves that are exact in binary round to even, as the report always wrote them."""
    return F.format_string("%.1f%%", F.bround(rate, 1))


def report_json(
    stats_row: DataFrame, input_dir: str = "", output_dir: str = "", engines: tuple[str, ...] = (TEXT_ENGINE, OCR_ENGINE),
    timestamp: Column | None = None, pretty: bool = False,
) -> DataFrame:
    """The batch report as one JSON text in column `value`."""
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if timestamp is None else timestamp
    given = {"_when": when, "_in": F.lit(input_dir), "_out": F.lit(output_dir), "_tools": F.array(*[F.lit(e) for e in engines])}
    body = (
        "struct(total_files, converted_files, failed_files, skipped_files, total_size_source, total_size_target, total_time,"
        " _rate AS success_rate, tool_wins, transform(errors, e -> array(e.path, e.error)) AS errors)"
    )
    weights = f"struct({ACCURACY_WEIGHT}D AS accuracy, {COMPLETENESS_WEIGHT}D AS completeness)"
    report = (
        f"struct(_when AS timestamp, _in AS input_dir, _out AS output_dir, '{REPORT_MODE}' AS mode, _tools AS tools,"
        f" {weights} AS quality_weights, {body} AS stats)"
    )
    rows = stats_row.withColumns(given | {"_rate": rate_text(F.col("success_rate"))})
    return rows.selectExpr(f"to_json({report}, map('pretty', '{str(pretty).lower()}', 'ignoreNullFields', 'false')) AS value")


def quality_report(scored: DataFrame, by: tuple[str, ...], score: str = "weighted_score", won: str = "won") -> DataFrame:
    """Score distribution per group of `by`, with a total row for every prefix of it (rollup; null = all).

    Rows are first reduced to (group, score in tenths), at most 1,001 rows per group however large it is; percentiles are
    then exact on tenths and need no unbounded state. Smallest and largest scores are exact. The rollup expands only that small table.
    """
    tenth = F.floor(F.col(score) * SCORE_BINS_PER_POINT) / SCORE_BINS_PER_POINT
    binned = scored.groupBy(*by, tenth.alias("tenth")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(score).alias("score_sum"),
        F.sum(F.col(won).cast("int")).alias("wins"),
        F.min(score).alias("low"),
        F.max(score).alias("high"),
    )
    n = F.sum("n")
    return binned.rollup(*by).agg(
        n.alias("n"),
        (F.sum("score_sum") / n).alias("avg_score"),
        *[
            F.percentile("tenth", F.lit(p / 100), F.col("n")).alias(f"p{p}")
            for p in (25, 50, 75)
        ],
        F.min("low").alias("min_score"),
        F.max("high").alias("max_score"),
        F.sum("wins").alias("wins"),
        (F.sum("wins") / n).alias("win_rate"),
    )
