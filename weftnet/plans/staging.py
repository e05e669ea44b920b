"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder named by spark.checkpoint.dir and read it again.

    A temporary folder is set only where the session names none (tests, local runs).
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="weftnet-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/net-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
