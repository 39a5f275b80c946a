"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. It is set here only where it is unset and driver
    and executors are one process (tests); a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='relcheck-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """df dealt by these columns to as many partitions as shuffles have (four a core at least). Adaptive execution joins small
    partitions to few tasks, by bytes, which is too few where much is worked out for each row; these it leaves alone."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


def saved(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads it: cuts the lineage, outlives lost executors."""
    path = f"{workspace(df.sparkSession)}/relcheck-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
