"""Reading the given tables and writing intermediate tables where every executor sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliomill.session import work_folder

BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_DEFAULT = "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts go to Python in batches of `BATCH_ROWS` rows unless the session has its own setting."""
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives lost executors, can be read many times."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` of which nothing that is still to be computed reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
