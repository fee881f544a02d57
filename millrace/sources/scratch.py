"""Written tables that cut a plan's lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a session that runs in one process gets a folder of this machine; a cluster
    has to name one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written and read again."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
