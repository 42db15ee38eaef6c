"""Session helpers: local test session, shared work folder, and spreading of small inputs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_NO_ESTIMATE = 1 << 62
BATCH_ROWS = 1000
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_LISTING_SETTING, _LISTING_DEFAULT = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings a configured session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliomill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.sources.parallelPartitionDiscovery.threshold", "32")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder: on a cluster a folder
    of one machine would be lost with it, so there the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="foliomill-")
    return os.path.join(shared.rstrip("/"), f"{purpose}-{uuid.uuid4().hex}")


def small_batches(spark: SparkSession) -> None:
    """Let whole texts go to Python in batches of `BATCH_ROWS` rows, unless the session has its own setting."""
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def short_listings(spark: SparkSession) -> None:
    """Let paths be listed by two tasks a core and not by one a path, unless the session has its own setting."""
    if spark.conf.get(_LISTING_SETTING, _LISTING_DEFAULT) == _LISTING_DEFAULT:
        spark.conf.set(_LISTING_SETTING, str(2 * spark.sparkContext.defaultParallelism))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread an input that is too small to fill the cores by file splits alone.

    A parquet file with one row group is one task whatever its split count. Above one split's worth of
    bytes per core the scan already parallelises, and the frame is returned as it is: no shuffle at scale.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728b"))
    size = estimated_bytes(df)
    if cores * split <= size < _NO_ESTIMATE:  # a stream's micro-batch has no estimate
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def held(df: DataFrame, most: int | None = None) -> DataFrame | None:
    """The rows of `df` as a local table of the driver, or None if there are more than `most`. What is asked of it by row alone needs no job.

    Texts pass through Java strings. One that is not UTF-8 would come back with U+FFFD, so with `most` a row that has one gives None as well.
    """
    rows = (df if most is None else df.limit(most + 1))._jdf.collectAsList()
    if most is not None and (rows.size() > most or chr(0xFFFD) in rows.toString()):
        return None
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(rows, df._jdf.schema()), df.sparkSession)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, from file sizes and schemas; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _bytes(setting: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    digits = setting.lower().removesuffix("b")
    return int(digits[:-1]) * units[digits[-1]] if digits and digits[-1] in units else int(digits)
