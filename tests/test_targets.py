from pyspark.sql import functions as F

from foliomill.operators import targets
from foliomill.operators.skew import attach_group_extreme


def files(spark, pairs):
    return spark.createDataFrame([(p, t, 5) for p, t in pairs], "path string, target_path string, length bigint")


def actions(df):
    return {r.path: r.action for r in df.collect()}


def test_first_source_path_owns_a_target(spark):
    df = files(spark, [("/in/a.pdf", "/o/a.md"), ("/in/a.docx", "/o/a.md"), ("/in/b.txt", "/o/b.md")])
    owners = {r.path: (r.target_owner, r.owns_target) for r in targets.claim_targets(df).collect()}
    assert owners == {
        "/in/a.pdf": ("/in/a.docx", False),
        "/in/a.docx": ("/in/a.docx", True),
        "/in/b.txt": ("/in/b.txt", True),
    }
    last = {r.path for r in targets.claim_targets(df, last=True).where("owns_target").collect()}
    assert last == {"/in/a.pdf", "/in/b.txt"}


def test_decide_with_and_without_existing_targets(spark):
    df = files(spark, [("/a1", "/o/a"), ("/a2", "/o/a"), ("/b1", "/o/b"), ("/c1", "/o/c"), ("/c2", "/o/c")])
    assert actions(targets.decide(df)) == {"/a1": "convert", "/a2": "cached", "/b1": "convert", "/c1": "convert", "/c2": "cached"}
    earlier = spark.createDataFrame([("/o/a", True), ("/o/a", True), ("/o/b", False)], "target_path string, success boolean")
    found = actions(targets.decide(df, targets.existing_targets(earlier)))
    assert found == {"/a1": "cached", "/a2": "cached", "/b1": "convert", "/c1": "convert", "/c2": "cached"}
    assert set(actions(targets.decide(df, overwrite=True)).values()) == {"convert"}


def test_cached_rows_count_source_bytes_only(spark):
    row = targets.as_cached_results(files(spark, [("/a", "/o/a")])).first()
    assert (row.success, row.tool_used, row.error_message) == (True, "cached", "已存在，跳过")
    assert (row.file_size_source, row.file_size_target, row.processing_time) == (5, 0, 0.0)


def test_hot_key_is_spread_and_whole(spark):
    rows = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key")
    )
    rows = rows.unionByName(spark.createDataFrame([(-1, None)], "id long, key string"))
    found = attach_group_extreme(rows, "key", F.col("id"), "low", salt_on=F.col("id"))
    brute = rows.groupBy("key").agg(F.min("id").alias("want"))
    joined = found.join(brute.where("key IS NOT NULL"), "key", "left")
    assert joined.count() == 30_001
    assert joined.where("NOT (low <=> want)").count() == 0

    # No task of the last join holds the whole hot key: rows are partitioned by key and salt.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = attach_group_extreme(rows, "key", F.col("id"), "low", salt_on=F.col("id"))
        per_task = again.where("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(per_task) == 4 and max(r["count"] for r in per_task) < 10_000 * 0.5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_targets_named_several_times_count_once(spark):
    df = files(spark, [("/a1", "/o/a"), ("/b1", "/o/b"), ("/b2", "/o/b")])
    earlier = spark.range(1000).selectExpr("concat('/o/', id) AS target_path").unionByName(
        spark.createDataFrame([("/o/b",), ("/o/b",)], "target_path string")
    )
    assert actions(targets.decide(df, earlier)) == {"/a1": "convert", "/b1": "cached", "/b2": "cached"}
