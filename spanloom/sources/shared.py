"""Tables written to the folder that all executors share, to end a lineage or to hold what a loop goes on with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written below spark.checkpoint.dir and read back. Without that setting a folder of this machine serves, if there is
    no other machine."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    path = f"{path}/tables/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
