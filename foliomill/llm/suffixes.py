"""Removal of repeated byte strings by suffix sorting with hashed comparisons.

A string of `WIDTH` bytes of one document is a window; windows that occur more than once in the corpus go, all of them. Sorting
every suffix of the corpus would move each byte hundreds of times, so suffixes are sorted where windows can meet:

1. Each window has an anchor, its least inner `ANCHOR` bytes (by hash, leftmost). Consecutive windows with one anchor form a run; equal
   windows have equal anchors at equal offsets. Runs whose anchor occurs once in the corpus are left out by a join.
2. Runs that are left are read as bytes, again on the executors, and reduced to distinct ones by anchor and a 128-bit
   BLAKE2b digest of their bytes. A run that occurs twice as a whole needs no comparison: each of its windows repeats.
3. Distinct runs with one anchor meet in a bucket. Their suffixes from the anchor on, and their reversed prefixes before it,
   are sorted by mergesort; two suffixes are compared by their longest common extension, found by binary search over prefix
   polynomial hashes, so that a comparison takes a logarithmic number of steps. A sorted order and its common extensions are verified
   byte by byte between neighbours; a bucket in which hashes collided is sorted again by its bytes.
   A window with i bytes before the anchor repeats if another run shares i bytes to the left and WIDTH - i to the right: both are
   intervals of the two orders, so windows are pairs of interval numbers, and no window is compared on its own.
4. Buckets hold at most about `BUCKET` runs. An anchor with more is dealt out by digest; each of its buckets then gives
   one row for each distinct window with a digest, and windows of several buckets meet in a join on it.

Spans of repeated windows are carried back to the documents of all equal runs. Rows are told apart by their id and text, so rows
that repeat both are documents of their own that repeat each other. Memory is bounded by a bucket and by one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm import words as W
from foliomill.llm.tables import written

WIDTH = 200
ANCHOR = 48
BUCKET = 1 << 14
#: Windows hashed at once, and runs sorted at once.
BLOCK, SORTED = 1 << 17, 1 << 13
_PLACE = np.uint64((1 << 20) - 1)


# --- runs of windows with one anchor


def anchored_runs(data: np.ndarray, starts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts that lie at `starts` in `data`: text, first window, windows, bytes before the anchor and anchor of each run."""
    anchor = min(ANCHOR, width)
    spread = width - anchor + 1
    last = len(data) - width + 1
    for low in range(0, max(last, 0), BLOCK):
        high = min(low + BLOCK, last)
        grams = W.window_hashes(W.BYTE_VALUE[data[low : high + width - 1]], anchor)
        # the value above, the place below: the minimum is leftmost among equal values
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= spread:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < spread:
            least = np.minimum(least[: span - spread], least[spread - span :])
        at = np.arange(low, high)
        owner = np.searchsorted(starts, at, side="right") - 1
        inside = at + width <= starts[owner + 1]
        at, owner, place = at[inside], owner[inside], (least & _PLACE).astype(np.int64)[inside]
        if len(at):
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            n = np.diff(np.append(first, len(at)))
            yield owner[first], at[first] - starts[owner[first]], n, place[first] + low - at[first], grams[place[first]].view(np.int64)


def _anchor_counts(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, starts in W.text_slices(batch.column(0)):
                for *_, anchor in anchored_runs(data, starts, width):
                    values, counts = np.unique(anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts, type=pa.int64())], ["anchor", "n"])

    return run


def _anchor_runs(width: int) -> Callable:
    """Rows (a, b, anchor, code): the code holds first window, number of windows and bytes before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, starts in W.text_slices(batch.column(2)):
                for owner, at, n, lead, anchor in anchored_runs(data, starts, width):
                    rows = pa.array(owner + first)
                    code = (at << 16) | (n << 8) | lead
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor), pa.array(code, type=pa.int64())],
                        ["a", "b", "anchor", "code"],
                    )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, text, as Zstandard frames."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        *others, texts = batch.columns
        packed = [None if t is None else squeeze.compress(t) for t in (x.as_py() for x in texts.cast(pa.binary()))]
        yield pa.RecordBatch.from_arrays([*others, pa.array(packed, type=pa.binary())], [*batch.schema.names[:-1], "packed"])


def _text(packed: pa.Scalar) -> bytes:
    return zstandard.decompress(packed.as_py()) if packed.is_valid else b""


def _segments(width: int) -> Callable:
    """Runs with the digest of their bytes; the bytes themselves once a batch for each distinct run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for i in range(batch.num_rows):
                text = _text(batch.column(2)[i])
                runs = batch.column(3)[i].values
                anchors, codes = runs.field("anchor"), runs.field("code")
                contents, bodies = [], []
                for anchor, code in zip(anchors.to_pylist(), codes.to_pylist(), strict=True):
                    start, shape = code >> 16, code & 0xFFFF
                    body = text[start : start + (shape >> 8) + width - 1]
                    content = hashlib.blake2b(body, digest_size=16, salt=shape.to_bytes(2, "little")).digest()
                    contents.append(content)
                    bodies.append(None if (anchor, content) in seen else body)
                    seen.add((anchor, content))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([i] * len(codes), pa.int32())), batch.column(1).take(pa.array([i] * len(codes), pa.int32())),
                        anchors, codes, pa.array(contents, pa.binary()), pa.array(bodies, pa.binary()),
                    ],
                    ["a", "b", "anchor", "code", "content", "body"],
                )

    return run


# --- suffix sort


class Suffixes:
    """Suffixes `[start, start + length)` of a text, compared within groups only."""

    def __init__(self, text: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> None:
        self.text, self.start, self.length, self.group = text, start, length, group
        self.prefix, self.inverse = W.prefix_hashes(text)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes x and y, by binary search over prefix hashes."""
        most = np.minimum(self.length[x], self.length[y])
        found = np.zeros(len(x), dtype=np.int64)
        a, b = self.start[x], self.start[y]
        step = 1 << (int(most.max(initial=0)).bit_length() - 1) if most.max(initial=0) else 0
        while step:
            can = np.flatnonzero(found + step <= most)
            p, q = a[can] + found[can], b[can] + found[can]
            left = (self.prefix[p + step] - self.prefix[p]) * self.inverse[p]
            right = (self.prefix[q + step] - self.prefix[q]) * self.inverse[q]
            found[can[left == right]] += step
            step >>= 1
        return found

    def _ahead(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letters of x and y after their common extension; -1 behind the end."""
        common = self.extension(x, y)
        out = []
        for s in (x, y):
            at = np.minimum(self.start[s] + common, len(self.text) - 1)
            out.append(np.where(common < self.length[s], self.text[at].astype(np.int64), -1))
        return out[0], out[1]

    def order(self) -> np.ndarray:
        """The suffixes by group, then by bytes: a mergesort whose merges are binary searches in the other half."""
        order = np.argsort(self.group, kind="stable")
        if not len(order):
            return order
        grouped = self.group[order]
        heads = np.flatnonzero(np.append(True, grouped[1:] != grouped[:-1]))
        sizes = np.diff(np.append(heads, len(order)))
        head, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        half = 1
        while half < sizes.max():
            slot = np.flatnonzero(size > half)
            offset = slot - head[slot]
            run = offset // half
            other = np.minimum(head[slot] + (run ^ 1) * half, head[slot] + size[slot])
            low, high = other.copy(), np.minimum(other + half, head[slot] + size[slot])
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) // 2
                own, theirs = self._ahead(order[slot[open_]], order[middle])
                # equal suffixes of the first half stay before those of the second
                after = np.where(run[open_] % 2 == 0, theirs < own, theirs <= own)
                low[open_[after]] = middle[after] + 1
                high[open_[~after]] = middle[~after]
            target = head[slot] + (run // 2) * 2 * half + (offset - run * half) + (low - other)
            merged = order.copy()
            merged[target] = order[slot]
            order = merged
            half *= 2
        return order

    def neighbours(self, order: np.ndarray) -> tuple[np.ndarray, bool]:
        """Bytes that each suffix of `order` shares with the one before it (-1: another group), and whether these are in order.

        Compared byte by byte, so that hashes that collide are found.
        """
        shared = np.full(len(order), -1, dtype=np.int64)
        right = True
        pairs = np.flatnonzero(self.group[order][1:] == self.group[order][:-1]) + 1
        for low in range(0, len(pairs), 4096):
            at = pairs[low : low + 4096]
            x, y = order[at - 1], order[at]
            most = np.minimum(self.length[x], self.length[y])
            column = np.arange(int(most.max(initial=0)) + 1)
            last = len(self.text) - 1
            p, q = (np.minimum(self.start[s][:, None] + np.minimum(column, most[:, None]), last) for s in (x, y))
            differ = self.text[p] != self.text[q]
            differ |= column >= most[:, None]
            shared[at] = common = differ.argmax(axis=1)
            ends = common == most
            less = self.text[np.minimum(self.start[x] + common, last)] < self.text[np.minimum(self.start[y] + common, last)]
            right &= bool(np.where(ends, self.length[x] <= self.length[y], less).all())
        return shared, right

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """The verified order and the bytes each suffix shares with the one before it."""
        order = self.order()
        shared, right = self.neighbours(order)
        if not right:
            raw = self.text.tobytes()
            key = lambda k: (self.group[k], raw[self.start[k] : self.start[k] + self.length[k]])
            order = np.array(sorted(range(len(order)), key=key), dtype=np.int64)
            shared, _ = self.neighbours(order)
        return order, shared


def _classes(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the intervals of suffixes that share `length` bytes, by suffix."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(shared < length)
    return out


def repeated_windows(
    bodies: list[bytes], shapes: np.ndarray, group: np.ndarray, width: int, split: np.ndarray | None = None
) -> tuple[np.ndarray, list[tuple[int, int, bool]]]:
    """Which windows of each run (rows) repeat in another run of its group (columns: windows from its first).

    For the runs marked in `split`, also (run, window, alone) once for each distinct window of their groups.
    """
    n, lead = shapes >> 8, shapes & 0xFF
    ends = np.cumsum([len(b) for b in bodies])
    begins = ends - np.array([len(b) for b in bodies])
    text = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    after = Suffixes(text, begins + lead, np.minimum(ends - begins - lead, width), group).sorted()
    before = Suffixes(text[::-1].copy(), len(text) - begins - lead, lead, group).sorted()
    found = np.zeros((len(bodies), int(n.max())), dtype=bool)
    distinct = []
    for i in range(int(lead.max()) + 1):
        member = np.flatnonzero((lead >= i) & (lead - i < n))
        if not len(member):
            continue
        pair = _classes(*after, width - i)[member] * (len(bodies) + 1) + _classes(*before, i)[member]
        _, one, which, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        found[member, lead[member] - i] = count[which] > 1
        if split is not None:
            for k, alone in zip(member[one].tolist(), (count == 1).tolist(), strict=True):
                if split[k]:
                    distinct.append((k, int(lead[k]) - i, alone))
    return found, distinct


def _buckets(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[list[tuple]]:
    """Whole buckets of rows (anchor, salt, split, content, shape, body), which come sorted, several at a time; each run once."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:2] != row[:2] and len(held) >= at_least:
                yield held
                held = []
            if not held or (held[-1][0], held[-1][3]) != (row[0], row[3]):
                held.append(row)
    if held:
        yield held


def _sorted_buckets(width: int) -> Callable:
    """Repeated windows of runs as (anchor, content, low, high); windows of anchors in several buckets with their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches, SORTED):
            anchors, salts, splits, contents, shapes, bodies = (list(x) for x in zip(*rows, strict=True))
            keys = list(zip(anchors, salts, strict=True))
            group = np.cumsum([k and keys[k] != keys[k - 1] for k in range(len(keys))])
            several = np.array(splits, dtype=bool)
            windows = np.array(shapes, dtype=np.int64)
            found, distinct = repeated_windows(bodies, windows, group, width, several if several.any() else None)
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            owner, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)
            out = [(anchors[k], contents[k], a, b, None) for k, a, b in zip(owner.tolist(), low.tolist(), high.tolist(), strict=True)]
            for k, j, alone in distinct:
                digest = hashlib.blake2b(bodies[k][j : j + width], digest_size=16).digest()
                out.append((anchors[k], contents[k] if alone else None, j, j + 1, digest))
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "low", "high", "digest"])

    return run


# --- jobs


def row_key(id_column: Column, text: Column) -> list[Column]:
    return [F.xxhash64(id_column).alias("a"), F.xxhash64(text).alias("b")]


def repeated_parts(segments: DataFrame, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """Of `segments` (anchor, content, code, body): the runs (anchor, content) with the spans of windows that repeat."""
    distinct = written(segments.groupBy("anchor", "content").agg(F.count("*").alias("n")), "suffix-distinct")
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = written(mixed.select("anchor", F.ceil(F.col("kinds") / bucket).alias("parts")), "suffix-mixed")
    bodies = segments.where("body is not null").select("anchor", "content", (F.col("code") % (1 << 16)).alias("shape"), "body")
    salted = bodies.join(mixed, "anchor").withColumn("salt", F.pmod(F.xxhash64("content"), F.col("parts")))
    buckets = salted.select("anchor", "salt", (F.col("parts") > 1).alias("split"), "content", "shape", "body")
    buckets = buckets.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "content")
    found = written(buckets.mapInArrow(_sorted_buckets(width), "anchor long, content binary, low long, high long, digest binary"), "suffix-sorted")
    apart = found.where("digest is not null")
    twice = written(apart.groupBy("anchor", "digest").count().where("count > 1").select("anchor", "digest"), "suffix-apart")
    across = apart.where("content is not null").join(twice, ["anchor", "digest"], "left_semi")
    whole = distinct.where("n > 1").select("anchor", "content", F.lit(0).cast("long").alias("low"), F.lit(1 << 16).cast("long").alias("high"))
    parts = found.where("digest is null").drop("digest").unionByName(across.drop("digest")).unionByName(whole)
    return parts.groupBy("anchor", "content").agg(F.collect_list(F.struct("low", "high")).alias("windows"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts = [], []
        for i in range(batch.num_rows):
            text = np.frombuffer(_text(batch.column(1)[i]), dtype=np.uint8)
            spans = batch.column(2)[i]
            depth = np.zeros(len(text) + 1, dtype=np.int32)
            if spans.is_valid:
                low, high = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high"))
                np.add.at(depth, low, 1)
                np.add.at(depth, high, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept.append(text[~gone].tobytes())
            counts.append((len(text), int(gone.sum()), int((gone[1:] > gone[:-1]).sum() + gone[:1].sum())))
        numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *numbers], ["id", "kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """Per row of `docs`: id, kept (binary: the bytes that are left, joined), n_bytes, n_removed, n_spans (maximal removed runs).

    Every byte of a `width`-byte string that occurs more than once goes, its first occurrence too. Null texts are empty; rows with null
    ids, or with an id of other rows, are documents like all others. What is kept need not be UTF-8: a string can begin or end within a
    character. Other columns are left out; an empty table gives an empty result. `width` is at most 255 + `ANCHOR`.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    keyed = docs.select(*row_key(F.col(id_column), F.col(text)), F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    counts = keyed.select("text").mapInArrow(_anchor_counts(width), "anchor long, n long")
    repeated = written(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "suffix-anchors")
    runs = keyed.select("a", "b", "text").mapInArrow(_anchor_runs(width), "a long, b long, anchor long, code long")
    asked = runs.join(repeated, "anchor", "left_semi").groupBy("a", "b").agg(F.collect_set(F.struct("anchor", "code")).alias("runs"))
    packed = keyed.select("a", "b", "id", "text").mapInArrow(_packed, f"a long, b long, id {kind}, packed binary")
    read = packed.drop("id").join(written(asked, "suffix-runs"), ["a", "b"])
    segments = read.mapInArrow(_segments(width), "a long, b long, anchor long, code long, content binary, body binary")
    segments = written(segments, "suffix-segments")
    parts = written(repeated_parts(segments, width, bucket), "suffix-parts")
    start, n = F.shiftright("code", 16), F.shiftright("code", 8) % 256
    span = lambda w: F.struct((start + w["low"]).alias("low"), (start + F.least(w["high"], n) + (width - 1)).alias("high"))
    spans = segments.drop("body").join(parts, ["anchor", "content"]).select("a", "b", F.transform("windows", span).alias("spans"))
    by_row = written(spans.groupBy("a", "b").agg(F.flatten(F.collect_set("spans")).alias("spans")), "suffix-spans")
    whole = packed.join(by_row, ["a", "b"], "left").select("id", "packed", "spans")
    kept = whole.mapInArrow(_kept, f"id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
    return kept.withColumnRenamed("id", id_column)
