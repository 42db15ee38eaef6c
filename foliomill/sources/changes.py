"""What has changed in a growing folder since the last look: a versioned manifest and its difference to a new listing.

`versions/version=N` holds the rows that version N changed, `snapshots/version=N` the whole state after version N; a snapshot is
written after every `SNAPSHOT_EVERY` versions, so a look reads one snapshot and a bounded number of differences, never the whole
history. A version is staged first and counts from one rename on, so that a run that fails between the two sees its changes again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.session import work_folder
from foliomill.sources.ranges import read_range

ADDED, CHANGED, TOUCHED, REMOVED = "added", "changed", "touched", "removed"
STATE = "path string, length bigint, modificationTime timestamp, digest string"
SNAPSHOT_EVERY = 16
PIECE = 8 << 20


def with_digests(files: DataFrame) -> DataFrame:
    """Add `digest`, the SHA-256 of each file's bytes, read in pieces on the executors; null where it cannot be read."""

    def read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(digest=[_digest(p) for p in batch["path"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(read_batches, schema + ", digest string")


def _digest(path: str) -> str | None:
    whole, at = hashlib.sha256(), 0
    try:
        while piece := read_range(path, at, PIECE):
            whole.update(piece)
            at += len(piece)
    except OSError:
        return None
    return whole.hexdigest()


def compare(listing: DataFrame, known: DataFrame, every: bool = False) -> DataFrame:
    """What differs between a listing (path, length, modificationTime) and a known state: path, change, length, modificationTime, digest.

    `added` and `removed` go by path. A file whose size or time differs is read: `changed` if its digest differs, else `touched`.
    One with the same size and time is taken as unchanged; with `every`, all files are read. Of a path that is listed several
    times the latest row counts. A file that cannot be read has no digest and is `changed`.
    """
    latest = F.max(F.struct("modificationTime", "length")).alias("now")
    now = listing.groupBy("path").agg(latest).select("path", F.col("now.length").alias("length"), F.col("now.modificationTime").alias("modificationTime"))
    old = known.select(
        F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("modificationTime").alias("_time"), F.col("digest").alias("_digest")
    )
    both = now.join(old, F.col("path") == F.col("_path"), "full")
    same = F.col("length").eqNullSafe(F.col("_length")) & F.col("modificationTime").eqNullSafe(F.col("_time"))
    gone, new = F.col("path").isNull(), F.col("_path").isNull()
    removed = both.where(gone).select(
        F.col("_path").alias("path"), F.lit(REMOVED).alias("change"), F.col("_length").alias("length"), F.col("_time").alias("modificationTime"), F.col("_digest").alias("digest")
    )
    suspects = both.where(~gone & (new | F.lit(every) | ~same)).select("path", "length", "modificationTime", new.alias("new"), "_digest", same.alias("same"))
    read = with_digests(suspects.repartition(suspects.sparkSession.sparkContext.defaultParallelism * 4))
    equal = F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False))
    change = F.when(F.col("new"), ADDED).when(~equal, CHANGED).when(~F.col("same"), TOUCHED)
    found = read.select("path", change.alias("change"), "length", "modificationTime", "digest").where("change IS NOT NULL")
    return found.unionByName(removed)


def known_state(spark: SparkSession, history: str, upto: int | None = None) -> DataFrame:
    """The files after the last version, or after version `upto`: path, length, modificationTime, digest."""
    versions = [v for v in _numbers(spark, history, "versions") if upto is None or v <= upto]
    snapshots = [v for v in _numbers(spark, history, "snapshots") if upto is None or v <= upto]
    base = max(snapshots, default=-1)
    later = [v for v in versions if v > base]
    parts = []
    if base >= 0:
        parts.append(_read(spark, history, "snapshots", base).withColumns({"change": F.lit(ADDED), "version": F.lit(base)}))
    parts += [_read(spark, history, "versions", v).withColumn("version", F.lit(v)) for v in later]
    if not parts:
        return spark.createDataFrame([], STATE)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    last = rows.groupBy("path").agg(F.max(F.struct("version", "change", "length", "modificationTime", "digest")).alias("last"))
    state = last.where(F.col("last.change") != REMOVED)
    return state.select("path", *[F.col(f"last.{c}").alias(c) for c in ("length", "modificationTime", "digest")])


def stage_changes(listing: DataFrame, history: str, every: bool = False) -> tuple[int, DataFrame]:
    """Compare a listing with the last version; number and rows of the next one, which counts once it is committed.

    The listing is written once before it is compared, so that what is compared is what is recorded.
    """
    spark = listing.sparkSession
    number = max(_numbers(spark, history, "versions"), default=-1) + 1
    folder = work_folder(spark, "listing")
    listing.select("path", "length", "modificationTime").write.parquet(folder)
    changes = compare(spark.read.parquet(folder), known_state(spark, history), every)
    changes.write.mode("overwrite").parquet(f"{history}/staged/version={number}")
    _delete(spark, folder)
    return number, _read(spark, history, "staged", number)


def commit_changes(spark: SparkSession, history: str, number: int) -> DataFrame:
    """Make a staged version count, by one rename; its rows. Of two writers of one version the second fails."""
    source, storage = _path(spark, f"{history}/staged/version={number}")
    target, _ = _path(spark, f"{history}/versions/version={number}")
    storage.mkdirs(target.getParent())
    if storage.exists(target) or not storage.rename(source, target):
        raise FileExistsError(f"{history}: version {number} is there already")
    if number % SNAPSHOT_EVERY == SNAPSHOT_EVERY - 1:
        known_state(spark, history, number).write.mode("overwrite").parquet(f"{history}/snapshots/version={number}")
    return _read(spark, history, "versions", number)


def record_changes(listing: DataFrame, history: str, every: bool = False) -> DataFrame:
    """Stage and commit the next version; its rows."""
    number, _ = stage_changes(listing, history, every)
    return commit_changes(listing.sparkSession, history, number)


def _read(spark: SparkSession, history: str, kind: str, number: int) -> DataFrame:
    schema = STATE if kind == "snapshots" else STATE + ", change string"
    return spark.read.schema(schema).parquet(f"{history}/{kind}/version={number}")


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, place: str) -> None:
    path, storage = _path(spark, place)
    storage.delete(path, True)


def _numbers(spark: SparkSession, history: str, kind: str) -> list[int]:
    path, storage = _path(spark, f"{history}/{kind}/version=*/_SUCCESS")
    found = storage.globStatus(path) or []
    return [int(s.getPath().getParent().getName().removeprefix("version=")) for s in found]
