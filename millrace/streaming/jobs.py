"""Structured Streaming jobs; each has a batch operator with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, keys: list[str], width: str, late: str, aggs: list[Column]) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(*keys, F.window(at, width).alias("w")).agg(*aggs)
    return out.withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end")).drop("w")


def deduplicated(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def cooldown_alerts(events: DataFrame, key: str, at_us: str, event_id: str, cooldown_us: int) -> DataFrame:
    """Alerts with a state for each key: the time that last fired."""

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fired = state.get[0] if state.exists else None
        out = []
        for t, e in sorted((t, e) for p in parts for t, e in zip(p[at_us], p[event_id])):
            if fired is None or t - fired >= cooldown_us:
                fired = t
                out.append((keys[0], t, e))
        if fired is not None:
            state.update((int(fired),))
        yield pd.DataFrame(out, columns=[key, at_us, event_id])

    kind = dict(events.dtypes)[key]
    return events.select(key, at_us, event_id).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at_us} long, {event_id} long", "fired long", "append", "NoTimeout")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what there is, exactly once for each batch id, and stops."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def hot(events: DataFrame, at: str, keys: list[str], late: str, aggs: list[Column], width: str = "15 minutes", slide: str = "1 minute") -> DataFrame:
    """Trailing windows that end every `slide`."""
    out = events.withWatermark(at, late).groupBy(*keys, F.window(at, width, slide).alias("w")).agg(*aggs)
    return out.withColumn("window_end", F.col("w.end")).drop("w")


def flagged_late(events: DataFrame, at: str, ingested: str, limit: str = "15 minutes") -> DataFrame:
    """Events with is_late: ingested more than the limit after they happened. No watermark, so none is dropped."""
    return events.withColumn("is_late", F.col(at) < F.col(ingested) - F.expr(f"interval {limit}"))


def lag_health(events: DataFrame, at: str, ingested: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Count, mean and 95th percentile of the delay in ms for each window of ingestion time."""
    lag = (F.unix_micros(ingested) - F.unix_micros(at)) / 1000
    return tumbling(events.withColumn("__lag", lag), ingested, keys, width, late, [F.count("*").alias("events"), F.avg("__lag").alias("avg_lag_ms"), F.percentile_approx("__lag", 0.95, 1000).alias("p95_lag_ms")])


def accumulated(events: DataFrame, key: str, at_us: str, quantity: str, every_us: int = 30_000_000) -> DataFrame:
    """Quantities of a key, added up until `every_us` have passed since the last row that was sent; then one row with the
    time, the time that passed and the sum."""

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begun, total = state.get if state.exists else (None, 0.0)
        out = []
        for t, q in sorted((t, q) for p in parts for t, q in zip(p[at_us], p[quantity])):
            begun = t if begun is None else begun
            total += q
            if t - begun >= every_us:
                out.append((keys[0], t, t - begun, total))
                begun, total = t, 0.0
        if begun is not None:
            state.update((int(begun), float(total)))
        yield pd.DataFrame(out, columns=[key, at_us, "elapsed_us", "total"])

    kind = dict(events.dtypes)[key]
    rows = events.select(key, at_us, F.col(quantity).cast("double").alias(quantity))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at_us} long, elapsed_us long, total double", "begun long, total double", "append", "NoTimeout")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One foreachBatch function for several sinks; the batch is read once and kept while they run."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return write


def incidents(existing: DataFrame, alerts: DataFrame, resolutions: DataFrame, now_us: int, escalate_us: int = 600_000_000) -> DataFrame:
    """The incident table after a batch. alerts (event_id, machine_id, kind, event_us, severity): each new event_id opens an
    incident, one that is known changes nothing. resolutions (machine_id, kind, event_us): the first after an incident closes
    it; closed incidents stay. What is still open after `escalate_us` is escalated."""
    new = alerts.dropDuplicates(["event_id"]).select("event_id", "machine_id", "kind", "event_us", F.coalesce("severity", F.lit("CRITICAL")).alias("priority"), F.lit("OPEN").alias("status"), F.lit(None).cast("long").alias("resolved_us"))
    every = existing.unionByName(new.join(existing.select("event_id"), "event_id", "left_anti"))
    closing = resolutions.select(F.col("machine_id").alias("__m"), F.col("kind").alias("__k"), F.col("event_us").alias("__at"))
    first = every.where("resolved_us is null").join(closing, (F.col("machine_id") == F.col("__m")) & (F.col("kind") == F.col("__k")) & (F.col("__at") >= F.col("event_us"))).groupBy(F.col("event_id").alias("__id")).agg(F.min("__at").alias("__first"))
    out = every.join(first, F.col("event_id") == F.col("__id"), "left").withColumn("resolved_us", F.coalesce("resolved_us", "__first")).drop("__id", "__first")
    late = F.col("event_us") + escalate_us <= now_us
    return out.withColumn("status", F.when(F.col("resolved_us").isNotNull(), "RESOLVED").when(late, "ESCALATED").otherwise("OPEN"))


def expired(folder_dates: DataFrame, date: str, today: str, days: int = 1) -> DataFrame:
    """Dates of a table that retention lets go: those more than `days` before today."""
    return folder_dates.select(date).distinct().where(F.col(date) < F.date_sub(F.lit(today).cast("date"), days))


def drop_partitions(spark, path: str, column: str, values: list[str]) -> None:
    """Removes whole partitions of a table, in whatever store it is."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in values:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={v}"), True)
