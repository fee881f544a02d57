"""Shared folder, lineage cuts and small column helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import forget_encoders

#: White space of all word operators: space and \t \n \v \f \r, as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where none is set, a session that runs in one process gets a folder of this machine; a cluster has to name one.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Written tables of one operator call: each cuts the lineage, so a lost executor costs one stage, not the job.

    The session's spark.sql.execution.arrow.maxBytesPerBatch is 16 MB from then on: results are lazy, so it can't be put
    back when the call returns.
    """

    def __init__(self, spark: SparkSession, name: str):
        # Arrow batches are cut by size too, so that long texts don't add up in a Python worker.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def cut(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def deal(self, df: DataFrame, name: str, turns: int, *key: str) -> list[DataFrame]:
        """The rows of df in so many tables by a hash of the key, each of which can be dropped by itself."""
        if turns == 1:
            return [self.cut(df, name)]
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.withColumn("__turn", F.pmod(F.xxhash64(*key), F.lit(turns))).write.partitionBy("__turn").parquet(path)
        there = self.spark.read.schema(df.schema)
        folders = [self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/__turn={k}") for k in range(turns)]
        fs = folders[0].getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [there.parquet(str(p)) for p in folders if fs.exists(p)] or [there.parquet(path)]

    def sweep(self) -> None:
        """Lets Spark remove the shuffle files of plans that have ended: it does so when the driver's JVM finds them unused."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing will read again."""
        jvm = self.spark._jvm
        for df in frames:
            for file in df.inputFiles()[:1]:
                path = jvm.org.apache.hadoop.fs.Path(file).getParent()
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy() -> None:
    """Gives what a Python worker has freed back to the system; Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library only
        trim(0)


def alone(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow without what earlier tasks left in its Python worker, which Spark uses again, and leaving nothing."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        tidy()
        yield from work(tables)
        tidy()

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words in a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder5(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: the fold of held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5
