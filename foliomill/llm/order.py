"""A global order of rows without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.tables import written

PART_SHIFT = 33


def in_order(df: DataFrame, *keys: str, purpose: str) -> DataFrame:
    """`df`, written, with a long `at` that rises along `keys` (nulls first); rows with equal keys get distinct values.

    `at` holds the number of the range partition above `PART_SHIFT` bits and the place within it below them. Ties are broken by
    a number that is written before the partitions are chosen: a key with a third of all rows is spread over many tasks,
    and a task that runs again deals its rows out in the same way.
    """
    numbered = written(df.withColumn("_tie", F.monotonically_increasing_id()), f"{purpose}-rows")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k).asc_nulls_first() for k in (*keys, "_tie")]
    dealt = numbered.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return written(dealt.drop("_tie").withColumn("at", F.monotonically_increasing_id()), f"{purpose}-ordered")


def part(at: str = "at"):
    """The range partition of a row."""
    return F.shiftright(F.col(at), PART_SHIFT)
