"""Directory walk and file reading on the executors.

Where Spark's own file listing leaves out names starting with `_` or `.` and empty files, and reads a file's content
before any path filter, this walk sees every file, prunes directories before it lists them, and contents are read only for
the files that are left. Local (mounted) paths and URIs of any storage Arrow knows are accepted.
"""

from __future__ import annotations

import hashlib
import os
import random
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain, islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import paths as P
from foliomill.schemas import SKIP_DIRS
from foliomill.session import work_folder
from foliomill.sources.files import default_output_dir, manifest, plain_root, qualified_root
from foliomill.sources.ranges import storage_of

LISTING = "path string, is_dir boolean, length bigint, modified_us bigint, low string, high string, read_error string"
ROWS_PER_BATCH = 10_000
WAVE_ENTRIES = 20_000
SAMPLED_NAMES = 10_000
MOST_RANGES = 64
BYTES_PER_BATCH = 64 << 20
BLOCK = 4 << 20


def walk_files(
    spark: SparkSession,
    root: str,
    extensions: Iterable[str] | None = None,
    exclude_patterns: Iterable[str] = (),
    output_dir: str | None = None,
    preserve_structure: bool = True,
    wave_entries: int = WAVE_ENTRIES,
) -> DataFrame:
    """Manifest of the files below `root`, as `scan_files` but walked by tasks.

    The walk goes in waves: a task lists directories until it has seen `wave_entries` entries and hands back those it has not
    come to, which the next wave spreads over the cluster. A directory of more entries than that is handed back as ranges of
    names, at most 64, from a sample of its names, so that one flat directory is taken up by many tasks. Each wave is written to
    the shared folder. Symbolic links to directories are not followed.

    A directory that cannot be listed is a row of its own, without extension, with its fault in `read_error`; as a file to convert
    it fails with that error. One that has vanished since its parent was listed is passed over. The waves stay in the shared
    folder, as the manifest reads them.
    """
    base = qualified_root(spark, root)
    pruned = plain_root(output_dir or default_output_dir(base))
    start = spark.createDataFrame([(base, None, None)], FOLDERS)
    found = walk_folders(start, pruned, wave_entries)
    listing = found.select("path", "length", F.timestamp_micros("modified_us").alias("modificationTime"), "read_error")
    files = manifest(listing.where("read_error IS NULL"), base, output_dir, extensions, exclude_patterns, preserve_structure)
    return files.unionByName(_unlisted(listing.where("read_error IS NOT NULL"), base, pruned).select(*files.columns))


FOLDERS = "path string, low string, high string"


def walk_folders(folders: DataFrame, pruned: str = "", wave_entries: int = WAVE_ENTRIES) -> DataFrame:
    """All files below folders (path, and low and high, between which names are listed, or nulls), as rows of `LISTING`."""
    spark, waves = folders.sparkSession, []
    tasks = spark.sparkContext.defaultParallelism * 4
    while True:
        waves.append(work_folder(spark, "walk"))
        folders.mapInPandas(_lister(pruned, wave_entries), LISTING).write.parquet(waves[-1])
        left = spark.read.schema(LISTING).parquet(waves[-1]).where("is_dir")
        if left.isEmpty():
            break
        folders = left.select("path", "low", "high").repartition(tasks)
    return spark.read.schema(LISTING).parquet(*waves).where("NOT is_dir")


def _unlisted(folders: DataFrame, base: str, out: str) -> DataFrame:
    """Directories that could not be listed, as file rows; a target below their own name is no file's target."""
    name, rel_dir = P.file_name(F.col("path")), P.relative_dir(F.col("path"), base)
    named = folders.withColumns({"name": name, "rel_dir": rel_dir, "stem": name, "ext": F.lit("")})
    inner = F.concat_ws("/", F.nullif("rel_dir", F.lit("")), "name")
    return named.withColumn("target_path", P.target_path(out, inner, F.lit(""), True))


def read_contents(files: DataFrame, digest: str | None = None) -> DataFrame:
    """Add `content` to file rows, read by path on the executors, and `read_error`, why there is none.

    A file that is gone or cannot be read has a null content and its fault as `TypeName: message`; the others go on. Rows that
    have a `read_error` already are not read. Batches are cut by bytes, so memory follows the largest file and not the
    number of files. With `digest`, a name known to hashlib such as `md5`, there is instead of `content` the hex digest of the whole
    file as `digest`, taken block by block, so that a file of any length is read in a bounded memory.
    """
    name, kind, read = ("digest", "string", partial(_digest, digest)) if digest else ("content", "binary", _read)
    columns = [c for c in files.columns if c != "read_error"]
    fault = F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string")

    def read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start, held, contents, faults = 0, 0, [], []
            for i, (path, known) in enumerate(zip(batch["path"], batch["read_error"], strict=True)):
                content, fault = (None, known) if known else read(path)
                contents.append(content)
                faults.append(fault)
                held += len(content or b"")
                if held >= BYTES_PER_BATCH or i == len(batch) - 1:
                    yield batch.iloc[start : i + 1].drop(columns="read_error").assign(**{name: contents}, read_error=faults)
                    start, held, contents, faults = i + 1, 0, [], []

    kept = files.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return files.select(*columns, fault.alias("read_error")).mapInPandas(read_batches, f"{schema}, {name} {kind}, read_error string")


def _read(path: str) -> tuple[bytes | None, str | None]:
    return _from_file(path, lambda file: file.read())


def _digest(name: str, path: str) -> tuple[str | None, str | None]:
    def whole(file) -> str:
        found = hashlib.new(name)
        while block := file.read(BLOCK):
            found.update(block)
        return found.hexdigest()

    return _from_file(path, whole)


def _from_file(path: str, take: Callable[[Any], Any]) -> tuple[Any, str | None]:
    try:
        if "://" not in path:
            with open(path, "rb") as file:
                return take(file), None
        storage, place = storage_of(path)
        with storage.open_input_stream(place) as file:
            return take(file), None
    except Exception as fault:  # whatever the storage raises belongs to this file
        return None, f"{type(fault).__name__}: {fault}"


def _lister(pruned: str, wave_entries: int):
    def list_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, seen = [], 0
        for batch in batches:
            todo = [(p, low or None, high or None) for p, low, high in batch[["path", "low", "high"]].itertuples(index=False, name=None)]
            while todo and seen < wave_entries:
                for path, is_dir, length, seconds, low, high, fault in _entries(*todo.pop(), wave_entries):
                    seen += 1
                    name = path.rsplit("/", 1)[-1].lower()
                    if low or high:
                        rows.append((path, True, 0, 0, low, high, None))
                    elif is_dir and (name in SKIP_DIRS or name.startswith(".") or path == pruned):
                        continue
                    elif is_dir:
                        todo.append((path, None, None))
                    else:
                        rows.append((path, False, length, int(seconds * 1_000_000), None, None, fault))
                    if len(rows) >= ROWS_PER_BATCH:
                        yield _frame(rows)
                        rows = []
            rows += [(path, True, 0, 0, low, high, None) for path, low, high in todo]
        if rows:
            yield _frame(rows)

    return list_batches


Entry = tuple[str, bool, int, float, str | None, str | None, str | None]


def _entries(folder: str, low: str | None, high: str | None, most: int) -> Iterator[Entry]:
    """The entries of a folder whose names are in [low, high), or, of more than `most`, ranges of their names."""
    try:
        if "://" in folder:
            yield from _stored_entries(folder)
        else:
            yield from _local_entries(folder, low, high, most)
    except FileNotFoundError:  # vanished
        return
    except OSError as fault:
        yield folder, False, 0, 0.0, None, None, f"{type(fault).__name__}: {fault}"


def _stored_entries(folder: str) -> Iterator[Entry]:
    from pyarrow import fs

    storage, place = storage_of(folder)
    head = folder[: len(folder) - len(place)] if folder.endswith(place) else folder.split("://")[0] + "://"
    for info in storage.get_file_info(fs.FileSelector(place)):
        yield head + info.path, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) / 1e9, None, None, None


def _local_entries(folder: str, low: str | None, high: str | None, most: int) -> Iterator[Entry]:
    with os.scandir(folder) as entries:
        if low is None and high is None:
            first = list(islice(entries, most + 1))
            if len(first) > most:
                yield from _name_ranges(folder, (e.name for e in chain(first, entries)), most)
                return
            entries = first
        for entry in entries:
            if (low is not None and entry.name < low) or (high is not None and entry.name >= high):
                continue
            try:
                if entry.is_symlink() and entry.is_dir():
                    continue
                stat = entry.stat()
                yield f"{folder}/{entry.name}", entry.is_dir(), stat.st_size, stat.st_mtime, None, None, None
            except OSError:  # gone since it was listed, a dangling link or one that loops: reading will tell
                yield f"{folder}/{entry.name}", False, 0, 0.0, None, None, None


def _name_ranges(folder: str, names: Iterator[str], most: int) -> Iterator[Entry]:
    """Ranges of about half of `most` names each, cut at places of a bounded sample of the names.

    They are at most `MOST_RANGES`: each range is a pass over all names, so the work would else grow with the square of the folder.
    """
    rng, sample, n = random.Random(0), [], 0
    for name in names:
        n += 1
        if len(sample) < SAMPLED_NAMES:
            sample.append(name)
        elif (k := rng.randrange(n)) < SAMPLED_NAMES:
            sample[k] = name
    parts = min(2 * n // most + 1, len(sample), MOST_RANGES)
    sample.sort()
    cuts = [None, *dict.fromkeys(sample[k * len(sample) // parts] for k in range(1, parts)), None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield folder, True, 0, 0.0, low or "", high or "\U0010ffff\U0010ffff", None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "is_dir", "length", "modified_us", "low", "high", "read_error"])
