"""Walks over flat folders and folders that cannot be listed."""

import os

import pandas as pd
from pyspark.sql import functions as F

from foliomill import convert_to_tables, read_contents, walk_files
from foliomill.operators.formats import format_engine
from foliomill.plans.corpus import running_stats
from foliomill.sources import walk


def test_a_flat_folder_is_listed_by_many_tasks(spark, tmp_path):
    for k in range(3000):
        (tmp_path / f"{k * 7919 % 3000:05d}.txt").write_text("x" * (k % 5))
    for k in range(3):
        (tmp_path / f"sub{k}").mkdir()
        (tmp_path / f"sub{k}" / "é.html").write_text("<p>x")
    expected = {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names}
    found = walk_files(spark, str(tmp_path), wave_entries=100)
    assert {r.path: r.length for r in found.collect()} == expected and found.count() == len(expected)
    lister = walk._lister("", 100)
    first = pd.concat(lister(iter([pd.DataFrame({"path": [str(tmp_path)], "low": [None], "high": [None]})])))
    ranges = first[first.is_dir & first.high.notna()]
    assert len(ranges) > 20
    one = pd.concat(lister(iter([ranges.iloc[5:6]])))
    assert 0 < len(one) < 400 and set(one.path) < set(expected)


def test_a_folder_that_cannot_be_listed_is_a_failed_row(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.txt").write_text("One. Two. Three.")
    (tmp_path / "in" / "sub.txt").write_text("not a folder")
    base = str(tmp_path / "in")
    start = [(base, None, None), (f"{base}/sub.txt", None, None), (f"{base}/vanished", None, None)]
    listing = walk.walk_folders(spark.createDataFrame(start, walk.FOLDERS))
    faults = walk._unlisted(listing.where("read_error IS NOT NULL"), base, "/out")
    row = faults.first()
    assert faults.count() == 1 and row.read_error.startswith("NotADirectoryError") and row.target_path == "/out/sub.txt/.md"
    whole = walk_files(spark, base, output_dir=str(tmp_path / "out"))
    assert whole.where("read_error IS NOT NULL").count() == 0
    files = whole.unionByName(faults.withColumn("modificationTime", F.lit(None).cast("timestamp")).select(*whole.columns))
    results, _ = convert_to_tables(files, [format_engine()], str(tmp_path / "out"), load=read_contents)
    failed = results.where("NOT success").collect()
    assert [(r.source_path, r.error_message.split(":")[1].strip()) for r in failed] == [(f"{base}/sub.txt", "NotADirectoryError")]
    assert running_stats(spark, str(tmp_path / "out")).first().failed_files == 1


def test_a_digest_is_of_the_whole_file_and_holds_one_block_of_it(spark, tmp_path):
    import hashlib

    from foliomill.sources.walk import BLOCK

    contents = {"long": b"0123456789" * (BLOCK // 4), "empty": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    rows = [(f"{tmp_path}/{name}", None) for name in (*contents, "gone")] + [(f"{tmp_path}/long", "known fault")]
    files = spark.createDataFrame(rows, "path string, read_error string")
    found = {(r.path.rsplit("/", 1)[1], r.digest, (r.read_error or "").split(":")[0]) for r in read_contents(files, digest="md5").collect()}
    wanted = {(name, hashlib.md5(content).hexdigest(), "") for name, content in contents.items()}
    assert found == wanted | {("gone", None, "FileNotFoundError"), ("long", None, "known fault")}
    assert read_contents(files, digest="md5").columns == ["path", "digest", "read_error"]


def test_the_ranges_of_a_folder_do_not_grow_with_it():
    names = [f"{k * 7919 % 100_000:06d}" for k in range(100_000)]
    ranges = list(walk._name_ranges("/in", iter(names), 100))
    assert 20 < len(ranges) <= walk.MOST_RANGES
    assert ranges[0][4] == "" and all(one[5] == two[4] for one, two in zip(ranges, ranges[1:], strict=False))
    assert sum(r[4] <= n < r[5] for r in ranges for n in names[:1000]) == 1000


def test_contents_are_read_by_all_tasks_although_one_task_listed_them(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(200):
        (tmp_path / "in" / f"{k}.html").write_text(f"<p>One. Two. {k}.")
    tasks = []

    def load(files):
        tasks.extend(files.groupBy(F.spark_partition_id()).count().collect())
        return read_contents(files)

    results, _ = convert_to_tables(walk_files(spark, str(tmp_path / "in")), [format_engine()], str(tmp_path / "out"), load=load)
    assert results.where("success").count() == 200
    assert len(tasks) == spark.sparkContext.defaultParallelism and max(r["count"] for r in tasks) < 100
