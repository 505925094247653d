"""Session helpers: the shared work folder, written tables that cut lineage, and global ranks without a single task."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the cluster names; a folder of our own only where that is unset and all runs in one process, as in tests.

    On a cluster executors would each write to a disk of their own, and later reads miss their rows, so there an unset folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="skein-", dir="/tmp/checkpoints")
    return _OWN[app]


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and its gateway with it
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task may order, where their number is known.
ONE_TASK = 50_000


def ranked(df: DataFrame, order: list[Column], name: str = "rank", rows: int | None = None) -> DataFrame:
    """df with its place from 1 in the order given. Rows are dealt by ranges and numbered within; only one count for each range reaches the driver.

    rows: the number of rows, if known; up to ONE_TASK of them are ordered at once."""
    if rows is not None and rows <= ONE_TASK:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_slice", F.spark_partition_id()), "ranked")
    counts = sorted((r["_slice"], r["count"]) for r in dealt.groupBy("_slice").count().collect())
    offsets, total = [], 0
    for s, n in counts:
        offsets.append((s, total))
        total += n
    before = F.broadcast(spark.createDataFrame(offsets, "_slice int, _before long"))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return dealt.withColumn(name, within).join(before, "_slice").withColumn(name, F.col(name) + F.col("_before")).drop("_slice", "_before")
