"""Results written down where all executors find them, so that steps which read them often don't make them anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it /tmp/checkpoints in local mode, an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """rows, written below the shared folder and read back; the files go when the session's JVM ends."""
    spark = rows.sparkSession
    where = f"{shared_folder(spark)}/officium/{name}-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    rows.write.parquet(where)
    return spark.read.schema(rows.schema).parquet(where)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows over all cores by key: by size alone, small rows would be few tasks, however long the work on each."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
