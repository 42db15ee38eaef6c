"""Reading csv files in parallel, quoted line breaks included.

Whether a line break ends a row depends on all quotes before it, so a byte range of a file cannot be cut into rows on its own.
Ranges are therefore scanned twice. The first scan runs for both states a range can start in, outside and inside a quoted cell:
what a run of quotes does to the state depends only on its length and on the byte before it, so a range comes down to four
numbers, the state it ends in and the rows that start in it from either state. Composing those in file order, in blocks of
`BLOCK` ranges so that one file of millions of ranges is no sequential task, gives every range its state and its first row's
number. The second scan cuts each range into rows at once. No text is shuffled, and no task holds more than a range
and the rest of its last row.

A cell is quoted if its first byte is a quote; in it a doubled quote is a quote, and what follows the closing quote up to the
next separator belongs to the cell as it stands, as does any quote in an unquoted cell. Rows end with \\n, \\r or \\r\\n.
Lines without any character are no rows. A byte order mark is left out; bad bytes become U+FFFD.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.session import work_folder
from foliomill.sources.files import name_glob
from foliomill.sources.ranges import read_range

SPLIT_BYTES = 16 << 20
BLOCK = 1024
ROWS_PER_BATCH = 10_000
_QUOTE, _COMMA, _LF, _CR = b'",\n\r'
_BOM = b"\xef\xbb\xbf"
_LOOK_AHEAD = 1 << 12
OUTSIDE, INSIDE = 0, 1


class Range:
    """The bytes [low, high) of a file with what is needed around them."""

    def __init__(self, path: str, size: int, low: int, high: int) -> None:
        self.path, self.size, self.low, self.high = path, size, low, min(high, size)
        self.base = low - 1 if low > len(_BOM) + 1 else 0
        data = read_range(path, self.base, self.high + _LOOK_AHEAD - self.base)
        self.first = len(_BOM) if self.base == 0 and data.startswith(_BOM) else 0
        self.data = np.frombuffer(data, dtype=np.uint8)
        while self.end < size and self.data[max(self.high - self.base - 1, 0) :].tobytes().strip(b'"') == b"":
            self.extend()  # quotes up to the end of what was read

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def extend(self) -> None:
        more = read_range(self.path, self.end, max(len(self.data) // 2, _LOOK_AHEAD))
        self.data = np.concatenate([self.data, np.frombuffer(more, dtype=np.uint8)])
        if not more:
            self.size = self.end

    def _separated(self, at: np.ndarray) -> np.ndarray:
        """Whether a cell starts at these places (within `data`)."""
        before = self.data[np.maximum(at - 1, 0)]
        start = at + self.base == self.first if self.base == 0 else np.zeros(len(at), dtype=bool)
        return start | (before == _COMMA) | (before == _LF) | (before == _CR)

    def runs(self, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of quotes that start in [low, high): their places in `data`, which of them swap the state, which end a cell."""
        quotes = np.flatnonzero(self.data == _QUOTE)
        starts = quotes[(quotes == 0) | (self.data[quotes - 1] != _QUOTE)]
        lengths = np.diff(np.append(np.searchsorted(quotes, starts), len(quotes)))
        here = (starts >= self.low - self.base) & (starts < high - self.base)
        starts, odd = starts[here], lengths[here] % 2 == 1
        opens = self._separated(starts)
        return starts, odd & opens, odd & ~opens

    @staticmethod
    def states(swap: np.ndarray, reset: np.ndarray, state: int) -> np.ndarray:
        """The state before the first run and after each."""
        swaps = np.append(0, np.cumsum(swap))
        last = np.maximum.accumulate(np.append(0, np.where(reset, np.arange(1, len(reset) + 1), 0)))
        return np.where(last > 0, (swaps - swaps[last]) % 2, (state + swaps) % 2)

    def row_starts(self, starts: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Places in `data` where rows start, within the range."""
        inner = self.data[: self.high - self.base]
        breaks = (inner == _LF) | (inner == _CR)
        at = np.flatnonzero(breaks[:-1] & ~breaks[1:]) + 1 if len(inner) else np.zeros(0, dtype=np.int64)
        if self.base == 0 and self.first < len(inner) and not breaks[self.first]:
            at = np.unique(np.append(self.first, at))
        at = at[at >= self.low - self.base]
        return at[states[np.searchsorted(starts, at)] == OUTSIDE]

    def rows(self, state: int) -> Iterator[list[str]]:
        """The rows that start in the range, the last one read to its end."""
        starts, swap, reset = self.runs(self.high)
        at = self.row_starts(starts, self.states(swap, reset, state))
        if not len(at):
            return
        while True:
            quotes, swap, reset = self.runs(self.end)
            states = self.states(swap, reset, state)
            rest = np.flatnonzero((self.data[at[-1] :] == _LF) | (self.data[at[-1] :] == _CR)) + at[-1]
            ends = rest[states[np.searchsorted(quotes, rest)] == OUTSIDE]
            # a quote at the end of what was read can be the first of two
            if len(ends) or self.end >= self.size:
                break
            self.extend()
        stop = ends[0] if len(ends) else len(self.data)
        csv.field_size_limit(sys.maxsize)
        text = self.data[at[0] : stop].tobytes().decode("utf-8", "replace")
        found = 0
        for row in csv.reader(io.StringIO(text, newline="")):
            if row:
                found += 1
                yield row
        if found != len(at):
            raise ValueError(f"{self.path}: {found} rows where {len(at)} start, from byte {self.low}")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range (path, size, part, split) does to either state, and the rows that start in it."""
    for batch in batches:
        out = []
        for path, size, part, split in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            piece = Range(path, size, part * split, (part + 1) * split)
            starts, swap, reset = piece.runs(piece.high)
            both = [piece.states(swap, reset, state) for state in (OUTSIDE, INSIDE)]
            out.append((path, part, *(int(s[-1]) for s in both), *(len(piece.row_starts(starts, s)) for s in both)))
        names = ["path", "part", "to_from_0", "to_from_1", "rows_from_0", "rows_from_1"]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(path: str, first: int, rows: list[list[str]]) -> pa.RecordBatch:
        numbers = pa.array(range(first, first + len(rows)), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), numbers, pa.array(rows, pa.list_(pa.string()))], ["path", "row_no", "cells"])

    for batch in batches:
        for path, size, part, split, state, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held: list[list[str]] = []
            for row in Range(path, size, part * split, (part + 1) * split).rows(state):
                held.append(row)
                if len(held) == ROWS_PER_BATCH:
                    yield batch_of(path, first, held)
                    first, held = first + len(held), []
            if held:
                yield batch_of(path, first, held)


def _after(state: Column, first: Column, item: Column) -> Column:
    """The state and row number after an item, from those before it."""
    to = F.when(state == OUTSIDE, item["to_from_0"]).otherwise(item["to_from_1"])
    rows = F.when(state == OUTSIDE, item["rows_from_0"]).otherwise(item["rows_from_1"])
    return F.struct(to.alias("state"), (first + rows).alias("first"))


def _start(state: Column, first: Column) -> Column:
    return F.struct(state.cast("int").alias("state"), first.cast("long").alias("first"))


def _through(items: Column, state: int) -> Column:
    return F.aggregate(items, _start(F.lit(state), F.lit(0)), lambda at, x: _after(at["state"], at["first"], x))


def _before_each(items: Column, name: str, state: Column, first: Column) -> Column:
    """For each item of an array in order: its number, and the state and row number before it."""
    kind = f"array<struct<{name}:bigint,state:int,first:bigint>>"
    begin = F.struct(_start(state, first).alias("at"), F.array().cast(kind).alias("found"))

    def step(so_far: Column, item: Column) -> Column:
        at = so_far["at"]
        found = F.struct(item[name].alias(name), at["state"].alias("state"), at["first"].alias("first"))
        return F.struct(_after(at["state"], at["first"], item).alias("at"), F.concat(so_far["found"], F.array(found)).alias("found"))

    return F.aggregate(items, begin, step, lambda so_far: so_far["found"])


def placed_ranges(scanned: DataFrame, block: int = BLOCK) -> DataFrame:
    """State and first row number (path, part, state, first) of every scanned range."""
    item = F.struct("part", "to_from_0", "to_from_1", "rows_from_0", "rows_from_1")
    blocks = scanned.groupBy("path", F.floor(F.col("part") / block).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    whole = [_through(F.col("items"), s).alias(f"from_{s}") for s in (OUTSIDE, INSIDE)]
    folded = blocks.select("path", "block", *whole).select(
        "path",
        F.struct(
            "block",
            *[F.col(f"from_{s}.state").alias(f"to_from_{s}") for s in (OUTSIDE, INSIDE)],
            *[F.col(f"from_{s}.first").alias(f"rows_from_{s}") for s in (OUTSIDE, INSIDE)],
        ).alias("item"),
    )
    order = folded.groupBy("path").agg(F.sort_array(F.collect_list("item")).alias("items"))
    starts = order.select("path", F.inline(_before_each(F.col("items"), "block", F.lit(OUTSIDE), F.lit(0))))
    inside = blocks.join(starts, ["path", "block"])
    return inside.select("path", F.inline(_before_each(F.col("items"), "part", F.col("state"), F.col("first"))))


def csv_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of the csv files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob([".csv"]))
    return reader.load(root).select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), "length")


def read_csv_rows(files: DataFrame, split_bytes: int = SPLIT_BYTES, block: int = BLOCK) -> DataFrame:
    """Every row of csv files (path, length) as path, row_no (from 0) and cells, whatever their number; large files by many tasks.

    Empty files have no rows. The ranges and their states, a row for each `split_bytes`, are written to the shared folder.
    """
    spark = files.sparkSession
    if split_bytes < 1:
        raise ValueError("split_bytes must be positive")
    last = F.floor((F.col("length") - 1) / split_bytes)
    parts = files.where("length > 0").select("path", F.col("length").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    ranges = _written(parts.withColumn("split", F.lit(split_bytes).cast("long")), "csv-ranges")
    n = ranges.count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism * 4, n // 16)))
    kinds = "path string, part long, to_from_0 int, to_from_1 int, rows_from_0 long, rows_from_1 long"
    scanned = _written(ranges.repartition(tasks).mapInArrow(_scanned, kinds), "csv-scan")
    placed = ranges.join(placed_ranges(scanned, block), ["path", "part"]).select("path", "size", "part", "split", "state", "first")
    return placed.repartition(tasks).mapInArrow(_cut, "path string, row_no long, cells array<string>")


def _written(df: DataFrame, purpose: str) -> DataFrame:
    spark: SparkSession = df.sparkSession
    folder = work_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
