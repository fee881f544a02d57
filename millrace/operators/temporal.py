"""Joins and windows over time. Times are microseconds (long); intervals are half-open unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def scd2_join(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, on_date: str, how: str = "left", start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Facts with the version of their key that is valid on a date; both ends belong to it, an open end is forever."""
    return facts.join(dim, (facts[key] == dim[dim_key]) & (facts[on_date] >= dim[start]) & (dim[end].isNull() | (facts[on_date] <= dim[end])), how)


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points in [start, end): intervals are spread over bins of a width, so the join is an equi-join on bins."""
    spread = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    binned = points.withColumn("__bin", F.floor(F.col(at) / width))
    return binned.join(spread, (binned["__bin"] == spread["__bin"]) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)), how).drop("__bin")


def overlap_join(a: DataFrame, b: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of intervals (a_start, a_end), (b_start, b_end) that overlap. A pair is made in the first bin both are in."""
    x = a.withColumn("__ba", F.explode(F.sequence(F.floor(F.col("a_start") / width), F.floor((F.col("a_end") - 1) / width))))
    y = b.withColumn("__bb", F.explode(F.sequence(F.floor(F.col("b_start") / width), F.floor((F.col("b_end") - 1) / width))))
    first = F.greatest(F.floor(F.col("a_start") / width), F.floor(F.col("b_start") / width))
    cond = (F.col("__ba") == F.col("__bb")) & (F.col("__ba") == first) & (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    for k in keys:
        cond = cond & (x[k] == y[k])
    return x.join(y, cond).drop("__ba", "__bb")


def state_intervals(events: DataFrame, key: str, at: str, order: list[str], state: str, close_at: Column | None = None) -> DataFrame:
    """Each event with the end of the state that it begins: the next event of its key, or close_at; open ends are dropped."""
    w = Window.partitionBy(key).orderBy(*order)
    out = events.withColumn("next_state", F.lead(state).over(w)).withColumn("state_end", F.coalesce(F.lead(at).over(w), close_at) if close_at is not None else F.lead(at).over(w))
    return out.where(F.col("state_end") > F.col(at))


def carry_in(events: DataFrame, key: str, at: str, order: list[str], start: int) -> DataFrame:
    """Events from start on, and each key's last one before it."""
    before = events.where(F.col(at) < start)
    last = before.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("__r = 1").drop("__r")
    return events.where(F.col(at) >= start).unionByName(last)


def split_by_shift(intervals: DataFrame, start: str, end: str, length: int, offset: int) -> DataFrame:
    """Each interval cut at shift limits: shift_no, piece_start, piece_end. Shifts are arithmetic, so nothing is joined."""
    first = F.floor((F.col(start) + offset) / length)
    last = F.floor((F.col(end) - 1 + offset) / length)
    out = intervals.withColumn("shift_no", F.explode(F.sequence(first, last)))
    return out.withColumn("piece_start", F.greatest(F.col(start), F.col("shift_no") * length - offset)).withColumn("piece_end", F.least(F.col(end), (F.col("shift_no") + 1) * length - offset))


def late_flag(df: DataFrame, batch: str, at: str, limit: int) -> DataFrame:
    """Flags rows more than limit before the latest of their batch. The maximum is an aggregate, not a window over a batch."""
    top = df.groupBy(F.col(batch).alias("__b")).agg(F.max(at).alias("__top"))
    return df.join(top, F.col(batch).eqNullSafe(F.col("__b")), "left").withColumn("is_late", F.col(at) < F.col("__top") - limit).drop("__b", "__top")


def next_within(df: DataFrame, key: str, at: str, marked: Column, horizon: int) -> Column:
    """The time of the next marked row of the key in (t, t + horizon], by one sort."""
    return F.min(F.when(marked, F.col(at))).over(Window.partitionBy(key).orderBy(at).rangeBetween(1, horizon))


def trailing(key: str, at: str, span: int) -> Window:
    """The window [t - span, t] of a key, closed on both sides."""
    return Window.partitionBy(key).orderBy(at).rangeBetween(-span, 0)


def greedy_cooldown(df: DataFrame, key: str, at: str, tie: str, cooldown: int) -> DataFrame:
    """Rows that fire: a key's first, then each that is at least cooldown after the last that fired.

    A fixed point of the next firing would need a step for each firing; a scan of a key's times in order needs one pass. Rows
    are narrow and arrive sorted by key, so a key of any size streams through its task.
    """

    def scan(batches):
        key_now, fired = None, None
        for pdf in batches:
            keep = []
            for k, t in zip(pdf[key], pdf[at]):
                if k != key_now:
                    key_now, fired = k, None
                keep.append(fired is None or t - fired >= cooldown)
                if keep[-1]:
                    fired = t
            yield pdf[keep]

    rows = df.select(key, at, tie)
    return rows.repartition(key).sortWithinPartitions(key, at, tie).mapInPandas(scan, rows.schema)
