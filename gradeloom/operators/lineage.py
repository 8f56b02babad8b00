"""Cutting a plan's lineage where a table is used again and again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(rows: DataFrame) -> DataFrame:
    """The rows, computed once, written as Parquet to the folder of spark.checkpoint.dir and read again: a lost executor costs a reread.

    Only where neither that setting nor a checkpoint folder is there (on one machine), a folder is made.
    """
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = str(spark.sparkContext.getCheckpointDir())
    path = f"{base.rstrip('/')}/gradeloom-settled-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
