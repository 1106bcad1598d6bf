"""Tables written between the rounds of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df, written below the folder that spark.checkpoint.dir names and read again; survives lost executors.

    Where the setting is unset a temporary folder takes its place on a local master; on a cluster
    that is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidra-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/evidra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that written() wrote, once nothing reads it."""
    context = df.sparkSession.sparkContext
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/evidra-" in root:
            path = context._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
