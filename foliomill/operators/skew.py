"""Attaching per-key extremes to rows when a few keys may hold a large share of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def attach_group_extreme(
    df: DataFrame,
    key: str,
    value: Column,
    name: str,
    salt_on: Column,
    extreme: Callable[[Column], Column] = F.min,
    salts: int = SALTS,
) -> DataFrame:
    """Add to each row the minimum (or maximum) of `value` over the rows with its `key`, split over `salts` tasks a key.

    A window over `key` would bring all rows of a hot key to one task, and so would a plain join back. Here rows meet
    on (key, salt): extremes are taken per pair with map-side combining, spread over the at most `salts` rows of a
    key, and joined back on the pair, so no task sees more than about a 1/`salts` share of a key. Rows with a null key get
    a null.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    per_salt = salted.where(F.col(key).isNotNull()).groupBy(key, "_salt").agg(extreme(value).alias("_part"))
    per_key = extreme(F.col("_part")).over(Window.partitionBy(key))
    return salted.join(per_salt.select(key, "_salt", per_key.alias(name)), [key, "_salt"], "left").drop("_salt")
