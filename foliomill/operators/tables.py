"""Tables to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.sources.split_csv import SPLIT_BYTES, csv_files, read_csv_rows

ROWS_PER_PART = 10_000


def cell(df: DataFrame, column: str) -> Column:
    """A value as it stands in a pipe table. Strings, and what holds strings, can have a pipe or a line break in them."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return text if isinstance(df.schema[column].dataType, plain) else one_line(text)


def one_line(text: Column) -> Column:
    for old, new in (("\r\n", " "), ("\n", " "), ("\r", " "), ("|", "\\|")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def pipe_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def rule_row(n: int) -> str:
    return "|" + "---|" * n


def rows_to_markdown(
    df: DataFrame, key: str, position: str, columns: list[str], header: bool = True, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """One pipe table per key, rows by the integer `position`, as `key, part_no, row_count, text`.

    Column names form the heading, or each key's first row does if `header` is false. `part_no` is the position divided
    by `rows_per_part`: a key with all its positions in one such span is one row holding its table, a longer table comes
    in parts that join with a line break to the whole. So a hot key is spread over its parts and no group is larger than
    a part. Positions are unique within a key.
    """
    pos = F.col(position).cast("bigint")
    line = pipe_row([cell(df, c) for c in columns])
    rows = df.select(key, pos.alias("_pos"), F.lit(1).alias("_rank"), line.alias("_line"))
    # Heading and rule enter as one more row next to each key's first; its position is a map-side combined minimum.
    rule = rule_row(len(columns))
    extra, rank = (_literal_row(columns) + "\n" + rule, 0) if header else (rule, 2)
    firsts = df.groupBy(key).agg(F.min(pos).alias("_pos"))
    marks = firsts.select(key, "_pos", F.lit(rank).alias("_rank"), F.lit(extra).alias("_line"))
    return (
        rows.unionByName(marks)
        .groupBy(key, F.floor(F.col("_pos") / rows_per_part).alias("part_no"))
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_rank", "_line"))).alias("_rows"), _row_count())
        .select(key, "part_no", "row_count", F.array_join(F.col("_rows._line"), "\n").alias("text"))
    )


def _row_count() -> Column:
    return F.sum((F.col("_rank") == 1).cast("bigint")).alias("row_count")


def _literal_row(names: list[str]) -> str:
    return "| " + " | ".join(n.replace("|", "\\|") for n in names) + " |"


def cells_to_markdown(rows: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One pipe table per path of `path, row_no, cells`, as `rows_to_markdown`; row 0 is the heading, rows keep all their cells."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", one_line), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit("---|"), F.size("cells")))
    lines = rows.select("path", "row_no", F.concat(line, F.when(F.col("row_no") == 0, rule).otherwise(F.lit(""))).alias("line"))
    return (
        lines.groupBy("path", F.floor(F.col("row_no") / rows_per_part).alias("part_no"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("rows"))
        .select("path", "part_no", "row_count", F.array_join(F.col("rows.line"), "\n").alias("text"))
    )


def csv_to_markdown(spark: SparkSession, root: str, split_bytes: int = SPLIT_BYTES, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One Markdown table per csv file below `root`, with all its columns; each file's first row is its heading.

    A file larger than `split_bytes` is read by several tasks, whatever its quoted cells hold.
    """
    return cells_to_markdown(read_csv_rows(csv_files(spark, root), split_bytes), rows_per_part)
