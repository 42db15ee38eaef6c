"""Removal of repeated passages by a compacted de Bruijn graph of token windows.

A window is `WIDTH` consecutive words of one document; windows are the edges of a graph whose nodes are the overlaps.
Building it edge by edge would shuffle every word of the corpus many times, so edges travel in runs:

1. Each window has an anchor, its smallest inner `ANCHOR`-gram (by hash, leftmost). Consecutive windows with one anchor
   form a run of at most WIDTH - ANCHOR + 1 windows; equal windows have equal anchors. Anchors found once in the
   corpus drop out with their runs: none of their windows repeats.
2. Runs that are left get a key, (anchor, hash of all their words). Equal runs repeat as a whole. A join gives every run the
   source coordinates of its first occurrence (smallest document, then smallest start). As long as a document's runs stay on
   the path of one earlier occurrence, at one distance from it, they compact into one edge: one span, however long,
   and however many other documents branch off between. All occurrences other than the first repeat.
3. Runs that share an anchor but not all words (ends of repeats, small edits) are compared window by window, by
   the coordinates of each distinct run's first occurrence. All other occurrences were dealt with in 2.

Both steps give spans of source coordinates; words inside them go. Hot runs, anchors and windows are reduced before each
shuffle. Joins back are on unique keys that are written first: both sides then come straight from an exchange, so that Spark
can split a hot key's partition. Per document the work is bounded by the document itself.

Hashes have 64 bits and are compared only under an equal 64-bit anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm import words as W
from foliomill.llm.tables import discard, written

WIDTH = 20
ANCHOR = 8


def _runs(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of all texts of a slice: text, first window, number of windows, anchor and content hash of each run."""
    at, owner = W.starts_within(before, width)
    none = np.zeros(0, dtype=np.int64)
    if not len(at):
        return none, none, none, none, none
    anchor = min(ANCHOR, width)
    grams = W.window_hashes(words, anchor)
    spread = width - anchor + 1
    least = np.empty(len(grams) - spread + 1, dtype=np.int64)
    for low in range(0, len(least), 1 << 17):
        high = min(low + (1 << 17), len(least))
        view = np.lib.stride_tricks.sliding_window_view(grams[low : high + spread - 1], spread)
        least[low:high] = view.argmin(axis=1) + np.arange(low, high)
    place = least[at]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    n = np.diff(np.append(first, len(at)))
    content = W.span_hashes(words, at[first], at[first] + n - 1 + width)
    return owner[first], at[first], n, grams[place[first]].view(np.int64), content.view(np.int64)


def _runs_of(width: int, count_only: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, data, starts in W.text_slices(batch.column(1)):
                begin, end, before = W.word_bounds(data, starts)
                owner, at, n, anchor, content = _runs(W.word_hashes(data, begin, end), before, width)
                if count_only:
                    values, counts = np.unique(anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts, type=pa.int64())], ["anchor", "n"])
                else:
                    columns = [anchor, content, at - before[owner], n]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(owner + first)), *(pa.array(x, type=pa.int64()) for x in columns)],
                        ["id", "anchor", "content", "start", "n"],
                    )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as Zstandard frames, as they cross two shuffles."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        packed = pa.array([None if t is None else squeeze.compress(t) for t in (x.as_py() for x in texts)], type=pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["id", "packed"])


def _words(packed: bytes | None) -> list[bytes]:
    return zstandard.decompress(packed).split() if packed else []


def _windows_of(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = zstandard.decompress(batch.column(1)[i].as_py())
                data = np.frombuffer(text, dtype=np.uint8)
                begin, end, before = W.word_bounds(data, np.array([0, len(data)]))
                hashes = W.window_hashes(W.word_hashes(data, begin, end), width)
                runs = batch.column(2)[i].values
                start, n = (runs.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n"))
                anchor = np.repeat(runs.field("anchor").to_numpy(zero_copy_only=False), n)
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                ids = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), batch.column(0).slice(i, 1))
                yield pa.RecordBatch.from_arrays(
                    [ids.dictionary_decode(), pa.array(anchor), pa.array(hashes[at].view(np.int64)), pa.array(at, type=pa.int64())],
                    ["id", "anchor", "window", "start"],
                )

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            words = _words(batch.column(1)[i].as_py())
            spans = batch.column(2)[i]
            if not spans.is_valid:
                out.append((b" ".join(words).decode(), len(words), 0))
                continue
            low, high = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high"))
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(depth, low, 1)
            np.add.at(depth, high, -1)
            keep = np.cumsum(depth[:-1]) == 0
            out.append((b" ".join([words[k] for k in np.flatnonzero(keep)]).decode(), len(words), int((~keep).sum())))
        kept, n_words, n_removed = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
            ["id", "kept_text", "n_words", "n_removed"],
        )


def repeated_runs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Runs (id, anchor, content, start, n) of `docs` (id, text) whose anchor is found at least twice, written."""
    kind = docs.schema["id"].dataType.simpleString()
    counts = docs.mapInArrow(_runs_of(width, True), "anchor long, n long")
    repeated = written(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "substring-anchors")
    runs = docs.mapInArrow(_runs_of(width, False), f"id {kind}, anchor long, content long, start long, n long")
    found = written(runs.join(repeated, "anchor", "left_semi"), "substring-runs")
    discard(repeated)
    return found


def compacted_paths(runs: DataFrame, distinct: DataFrame, width: int = WIDTH) -> DataFrame:
    """Spans of words (id, low, high) that repeat: the longest walks of a document along the path of one earlier occurrence.

    `distinct` has one row a run, with the coordinates of its first occurrence. While a document's next run comes first where
    the one before it does, as many words on, it stays on one path; where it leaves it the span ends. The document's own first
    occurrences are no repeats.
    """
    here = Window.partitionBy("id").orderBy("start")
    found = runs.join(distinct.select("anchor", "content", "first"), ["anchor", "content"])
    walks = found.select("id", "start", "n", F.col("first.id").alias("on"), (F.col("start") - F.col("first.start")).alias("shift"))
    same = (F.lag("on").over(here) == F.col("on")) & (F.lag("shift").over(here) == F.col("shift"))
    joined = F.coalesce(same & (F.lag(F.col("start") + F.col("n")).over(here) == F.col("start")), F.lit(False))
    paths = walks.withColumn("head", (~joined).cast("long")).withColumn("path", F.sum("head").over(here))
    repeats = paths.where((F.col("on") != F.col("id")) | (F.col("shift") != 0))
    spans = repeats.groupBy("id", "path").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("n")).alias("end"))
    return spans.select("id", "low", (F.col("end") + (width - 1)).alias("high"))


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Of `docs` (id, text): spans of words to remove (id, low, high), and the packed texts."""
    kind = docs.schema["id"].dataType.simpleString()
    docs = docs.where("id is not null")
    runs = repeated_runs(docs, width)
    first = F.min(F.struct("id", "start")).alias("first")
    distinct = written(runs.groupBy("anchor", "content").agg(first, F.first("n").alias("n")), "substring-distinct")
    whole = compacted_paths(runs, distinct, width)
    packed = docs.mapInArrow(_packed, f"id {kind}, packed binary")
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    mixed = written(mixed, "substring-mixed")
    asked = (
        distinct.join(mixed, "anchor", "left_semi")
        .groupBy(F.col("first.id").alias("id"))
        .agg(F.collect_list(F.struct(F.col("first.start").alias("start"), "n", "anchor")).alias("runs"))
    )
    windows = written(
        packed.join(asked, "id").mapInArrow(_windows_of(width), f"id {kind}, anchor long, window long, start long"),
        "substring-windows",
    )
    earliest = written(
        windows.groupBy("anchor", "window")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "start")).alias("first"))
        .where("n > 1")
        .drop("n"),
        "substring-earliest",
    )
    single = (
        windows.join(earliest, ["anchor", "window"])
        .where((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start")))
        .select("id", F.col("start").alias("low"), (F.col("start") + width).alias("high"))
    )
    spans = written(whole.union(single), "substring-spans")
    discard(runs, distinct, mixed, windows, earliest)
    return spans, packed


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: id, kept_text (kept words joined by one space), n_words, n_removed.

    Null and empty texts have no words. Rows with a null id are neither sources nor changed, so come back with all their words.
    Equal coordinates are not earlier than each other: rows that repeat an id with the same text keep what one of them
    keeps; an id must not stand for different texts. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    spans, packed = repeated_spans(rows, width)
    by_id = spans.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    out = f"id {kind}, kept_text string, n_words long, n_removed long"
    kept = packed.join(by_id, "id", "left").mapInArrow(_kept, out)
    nameless = rows.where("id is null").mapInArrow(_packed, f"id {kind}, packed binary")
    empty = F.lit(None).cast("array<struct<low: long, high: long>>").alias("spans")
    kept = kept.unionByName(nameless.select("id", "packed", empty).mapInArrow(_kept, out))
    return kept.withColumnRenamed("id", id_column)
