"""Tables between the steps of a plan that branches: written once, read by every branch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that driver and executors share (``spark.checkpoint.dir``), reread.

    What reads it has a short plan, and survives lost executors. Only where the
    session names no such folder and runs on one machine, one below the
    warehouse is used.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rateline-checkpoints"
    path = f"{at.rstrip('/')}/rateline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of much work each, one a series, dealt out in turn to ``spread`` tasks. By key, the exchange would be dropped wherever the rows lie by that key already, and what is left of it merged into one task."""
    return rows.repartition(spread(rows.sparkSession))


def spread(spark: SparkSession) -> int:
    """Tasks for a stage of few rows and much work, which must not be merged by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
