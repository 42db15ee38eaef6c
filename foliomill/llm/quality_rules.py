"""Quality rules whose cut-offs adapt to each language and source.

Every document is measured (`measures`); each measure's distribution per (lang, source) is held in a mergeable quantile
sketch: counts of log-linear buckets, exact below 64 and within 1/32 above. Sketches are plain sums, so they merge by
adding: a group with few documents takes the thresholds of its language's merged sketch, a small language those
of all documents. Thresholds are outlier fences (upper or lower quartile plus or minus a multiple of the spread, plus a
slack), so that a clean group loses nothing, and are joined back to the documents.

Nulls: a null text has no words; a null lang or source counts as the empty name. Repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm import words as W
from foliomill.llm.tables import written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 200
SPREAD_FACTOR = 3
#: measure: (expression over the columns of `measures`, slack of the fence, whether there is a lower fence too)
RULES = {
    "word_length": ("100 * word_chars div n_words", 150, True),
    "symbols": ("1000 * n_symbols div n_words", 100, False),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 300, False),
    "repeats": ("1000 * n_repeat_words div n_words", 300, False),
}
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _line_duplicates(data: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and lines with a word."""
    breaks = np.flatnonzero(data == 10)
    low = np.unique(np.concatenate([starts[:-1], breaks + 1]))
    low = low[low < len(data)]
    high = np.append(low[1:], len(data))
    high = np.where(data[high - 1] == 10, high - 1, high) if len(low) else high
    wordy = np.searchsorted(begin, high) > np.searchsorted(begin, low)
    low, high = low[wordy], high[wordy]
    text = np.searchsorted(starts, low, side="right") - 1
    lines = W.word_hashes(data, low, high)
    order = np.lexsort((lines, text))
    same = (lines[order][1:] == lines[order][:-1]) & (text[order][1:] == text[order][:-1])
    n = len(starts) - 1
    return np.bincount(text[order][1:][same], minlength=n), np.bincount(text, minlength=n)


def _repeated_words(words: np.ndarray, before: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text: words inside windows of `width` words that occur at least twice in the text."""
    at, owner = W.starts_within(before, width)
    n = len(before) - 1
    if not len(at):
        return np.zeros(n, dtype=np.int64)
    windows = W.window_hashes(words, width)[at]
    order = np.lexsort((windows, owner))
    same = (windows[order][1:] == windows[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    hit = np.zeros(len(at), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[at[hit] + k] = True
    total = np.append(0, np.cumsum(covered))
    return total[before[1:]] - total[before[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, data, starts in W.text_slices(batch.column(0)):
            begin, end, before = W.word_bounds(data, starts)
            characters = np.append(0, np.cumsum(((data & 0xC0) != 0x80) & ~W._SPACE[data]))
            symbols = np.append(0, np.cumsum(_IS_SYMBOL[data]))
            hashes = W.word_hashes(data, begin, end)
            dup, lines = _line_duplicates(data, starts, begin)
            found.append(
                [
                    np.diff(before),
                    characters[starts[1:]] - characters[starts[:-1]],
                    symbols[starts[1:]] - symbols[starts[:-1]],
                    dup,
                    _repeated_words(hashes, before),
                    lines,
                ]
            )
        if found:
            columns = [pa.array(np.concatenate(x), type=pa.int64()) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *_FIELDS])


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of `docs` with the counts of each whole text: one narrow stage, no shuffle."""
    others = [c for c in docs.columns if c != text and c not in _FIELDS]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), *(f"{c} long" for c in _FIELDS)])
    return docs.select(text, *others).mapInArrow(_measure, schema)


def bucket(value: Column) -> Column:
    """Lower end of the value's bucket: exact below 64, above that 32 buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    width = F.expr("1L") * F.pow(F.lit(2), shift).cast("long")
    return (F.floor(value / width) * width).cast("long")


def sketches(measured: DataFrame, group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Rows (group..., measure, bucket, n). Adding `n` over groups merges their sketches."""
    values = F.array(*(F.struct(F.lit(k).alias("measure"), F.expr(v).cast("long").alias("v")) for k, (v, _, _) in RULES.items()))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in group]
    return (
        measured.where("n_words > 0")
        .select(*keys, F.explode(values).alias("m"))
        .groupBy(*group, F.col("m.measure").alias("measure"), bucket(F.col("m.v")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda part: F.min(F.when(F.col("upto") * 4 >= F.col("total") * part, F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("total"))


def thresholds(sketch: DataFrame, group: tuple[str, ...] = ("lang", "source"), min_group: int = MIN_GROUP) -> DataFrame:
    """Rows (group..., <measure>_low, <measure>_high): fences of the finest level that has `min_group` documents."""
    found = _quartiles(sketch, list(group))
    for depth in range(len(group) - 1, -1, -1):
        keys = list(group[:depth])
        coarse = _quartiles(sketch, keys).toDF(*keys, "measure", "_q1", "_q3", "_total")
        enough = F.col("total") >= min_group
        found = found.join(coarse, [*keys, "measure"]).select(
            *group,
            "measure",
            F.when(enough, F.col("q1")).otherwise(F.col("_q1")).alias("q1"),
            F.when(enough, F.col("q3")).otherwise(F.col("_q3")).alias("q3"),
            F.when(enough, F.col("total")).otherwise(F.col("_total")).alias("total"),
        )
    columns = []
    for name, (_, slack, two_sided) in RULES.items():
        own = lambda value, n=name: F.max(F.when(F.col("measure") == n, value))
        reach = (F.col("q3") - F.col("q1")) * SPREAD_FACTOR + slack
        columns.append(own(F.col("q3") + reach).alias(f"{name}_high"))
        columns.append((own(F.col("q1") - reach) if two_sided else F.lit(None).cast("long")).alias(f"{name}_low"))
    return found.groupBy(*group).agg(*columns)


def judge(measured: DataFrame, limits: DataFrame, group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """`measured` with `base_failed` and `kept`. Every group of the documents with words is in `limits`."""
    inside = F.lit(True)
    for name, (value, _, two_sided) in RULES.items():
        inside &= F.expr(value) <= F.col(f"_t.{name}_high")
        if two_sided:
            inside &= F.expr(value) >= F.col(f"_t.{name}_low")
    keys = [F.coalesce(F.col(f"_d.{c}").cast("string"), F.lit("")) == F.col(f"_t.{c}") for c in group]
    on = keys[0]
    for k in keys[1:]:
        on &= k
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    joined = measured.alias("_d").join(limits.alias("_t"), on, "left")
    kept = ~failed & F.coalesce(F.when(F.col("n_words") > 0, inside), F.lit(False))
    return joined.select("_d.*", failed.alias("base_failed"), kept.alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Measured and judged documents; the texts are read once, the counts are written to the shared folder.

    An empty table gives an empty result; an empty text has `base_failed`. Columns named like those of the result are replaced.
    """
    others = [c for c in docs.columns if c not in (text, "base_failed", "kept", *group)]
    measured = written(measures(docs.select(text, *group, *others), text), "quality-measures")
    # written, their size is known: a few rows a group are broadcast, and no document is dealt by its group
    limits = written(thresholds(sketches(measured, group), group), "quality-limits")
    return judge(measured, limits, group)
