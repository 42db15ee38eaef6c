"""Packing of tokenised documents into sequences of fixed length, with certified partitions.

Documents become pieces of at most `CAPACITY` tokens (only longer documents are cut, into full pieces and a rest). Full
pieces are sequences of their own. The others are dealt at random into partitions of bounded size, and each partition is
packed by best-fit decreasing. Dual-feasible functions of the sizes give a lower bound of the bins that any packing of the
partition needs; a partition that reaches it is certified, and hands on only its least filled bin, which holds what rounding
up lost. A partition with a gap hands on its least filled bins, up to 1/`FAN_IN` of a partition's pieces. In each round `FAN_IN`
partitions exchange what they hand on in a pool, which runs best-fit decreasing again, keeps the better packing and
is certified in turn, until one pool is left. Only a row count reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.tables import written

CAPACITY = 2048
PARTITION_PIECES = 20_000
FAN_IN = 8
EOS = 0
GROUP_BYTES = 2 << 20
_FIELDS = "piece int, start long, length long, ids_crc32 long"


def _encoded(encoder, column: pa.Array) -> Iterator[bytes]:
    """Ids of each text, encoded some megabytes at a time."""
    group, size = [], 0
    for text in column.cast(pa.binary()):
        group.append(text.as_py() or b"")
        size += len(group[-1])
        if size > GROUP_BYTES:
            yield from encoder.encode(group)
            group, size = [], 0
    yield from encoder.encode(group)


def _pieces_of(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from foliomill.llm.subwords import word_ids

        encoder = word_ids(path)
        end = EOS.to_bytes(4, "little")
        for batch in batches:
            owner, out = [], []
            for i, ids in enumerate(_encoded(encoder, batch.column(1))):
                ids += end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    owner.append(i)
                    out.append((piece, start, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 3), strict=True)] if out else [
                pa.array([], k) for k in (pa.int32(), *[pa.int64()] * 3)
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names)
        encoder.forget()  # the worker may serve other stages next

    return run


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of the sizes needs: the best of three families of dual-feasible functions.

    The sizes themselves; sizes below e dropped and those above capacity - e counted as whole bins; and for k = 1..: sizes
    rounded to multiples of 1/k, floor((k+1)x)/k, exact multiples of 1/(k+1) staying as they are.
    """
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    mass = counts * size
    best = -(-int(mass.sum()) // capacity)
    number, total = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(mass))
    e = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - e + 1]
    middle = total[capacity - e + 1] - total[e]
    best = max(best, int((large - (-middle // capacity)).max(initial=0)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each size: largest first, each into the fullest bin that has room. Ties go by position."""
    bins = np.empty(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r is there
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, opened
            opened += 1
        bins[i] = chosen
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(chosen)
    return bins


def _offsets(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.append(True, bins[order][1:] != bins[order][:-1]) if len(bins) else np.zeros(0, bool)
    out = np.empty(len(bins), dtype=np.int64)
    out[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return out


def _packer(capacity: int, most_released: int, last: bool):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["length"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        earlier = pd.factorize(pd.MultiIndex.from_frame(rows[["origin", "bin"]]))[0] if (rows["bin"] >= 0).all() else None
        if earlier is not None and earlier.max() <= bins.max():
            bins = earlier.astype(np.int64)
        used = int(bins.max()) + 1
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        bound = lower_bound(sizes, capacity)
        out = np.zeros(used, dtype=bool)
        if not last:
            least = np.argsort(fill, kind="stable")
            least = least[fill[least] < capacity]
            if used <= bound:
                least = least[:1]
            out[least[np.cumsum(np.bincount(bins, minlength=used)[least]) <= most_released]] = True
        return rows.assign(origin=rows["part"], bin=bins, released=out[bins], offset=_offsets(bins, sizes), certified=used <= bound)

    return pack


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32) of `docs` (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_pieces_of(vocabulary, capacity), f"id {kind}, {_FIELDS}")


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """`pieces` (id, piece, start, length, ids_crc32) with sequence_id, offset and certified.

    Works on any table with a `length` of 1 to `capacity`; rows are packed one by one, so repeated rows and null ids
    are kept. `certified` tells whether the last partition that packed the row met its lower bound. An empty table
    gives an empty result.
    """
    kind = pieces.schema["id"].dataType.simpleString()
    fields = "id piece start length ids_crc32 sequence_id offset certified".split()
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == capacity).select(
        "id", "piece", "start", "length", "ids_crc32", "row", F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")
    )
    loose = numbered.where(F.col("length") < capacity)
    parts = max(1, -(-loose.count() // partition_pieces))
    state = loose.select(
        "id", "piece", "start", "length", "ids_crc32",
        F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), F.lit(-1).cast("long").alias("origin"), F.lit(-1).cast("long").alias("bin"),
    )
    schema = f"id {kind}, {_FIELDS}, part long, origin long, bin long, released boolean, offset long, certified boolean"
    done = full.select("id", "piece", "start", "length", "ids_crc32", (-F.col("row") - 1).alias("sequence_id"), "offset", "certified")
    level = 0
    while True:
        packed = written(state.groupBy("part").applyInPandas(_packer(capacity, partition_pieces // FAN_IN, parts == 1), schema), "packing")
        number = F.lit(level).cast("long") * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin")
        done = done.unionByName(packed.where("not released").withColumn("sequence_id", number).select(*fields))
        if parts == 1:
            return done
        parts = -(-parts // FAN_IN)
        level += 1
        state = packed.where("released").select(
            "id", "piece", "start", "length", "ids_crc32", F.floor(F.col("part") / FAN_IN).cast("long").alias("part"), F.col("part").alias("origin"), "bin"
        )


def pack_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their sequence and place: id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    A null or empty text is the end token alone.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    pieces = written(tokenised_pieces(rows, vocabulary, capacity), "packing-pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_column)
