"""Operators on keys: latest row, duplicates and conflicts, inserts, upserts, deterministic caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in `order`: a partial aggregate, no sort, no window."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return top.select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def classify_versions(df: DataFrame, key: str, payload: str, order: list[Column]) -> DataFrame:
    """Adds status: KEEP, DUPLICATE (same payload, not the first in order) or CONFLICT (the key has several payloads)."""
    w = Window.partitionBy(key)
    rank = F.row_number().over(w.orderBy(*order))
    return df.withColumn("status", F.when(F.min(payload).over(w) != F.max(payload).over(w), "CONFLICT").when(rank == 1, "KEEP").otherwise("DUPLICATE"))


def classify_against(new: DataFrame, target: DataFrame, key: str, payload: str) -> DataFrame:
    """Adds status of rows against a table that has been loaded: NEW, DUPLICATE or CONFLICT."""
    old = target.groupBy(F.col(key).alias("__k")).agg(F.min(payload).alias("__p"))
    joined = new.join(old, F.col(key) == F.col("__k"), "left")
    return joined.withColumn("status", F.when(F.col("__k").isNull(), "NEW").when(F.col("__p") == F.col(payload), "DUPLICATE").otherwise("CONFLICT")).drop("__k", "__p")


def _lacking(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys others lack; null keys are equal to null keys."""
    known = others.select([F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return rows.join(known, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Target and the rows of new whose keys it lacks, one a key; null keys are equal. Running it again changes nothing."""
    return target.unionByName(_lacking(new.dropDuplicates(keys), target, keys))


def upsert(target: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of new replace those of target with equal keys (null keys are equal), all others stay.

    A key that `new` repeats has its greatest row in `order`; without an order it is an error that the query raises when it
    runs, since no row of several can be told to win.
    """
    if order is not None:
        fresh = latest_by(new, keys, order).select(*new.columns)
    else:
        once = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
        checked = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("upsert: a key is repeated in the new rows")).cast("boolean"))
        fresh = new.withColumn("__n", once).where(checked).drop("__n")
    return _lacking(target, new, keys).unionByName(fresh)


def overwrite_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Replaces the partitions that df has rows for and no others."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*partitions).parquet(path)


def deterministic_cap(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """n rows that a hash of the columns chooses, the same ones each time. The limit is the operator."""
    return df.orderBy(F.sha2(F.concat_ws("|", *cols), 256)).limit(n)
