"""Dimensions, facts and views of the warehouse layer: star-schema rows from accepted events, OEE and its summaries.

Surrogate key 0 is the unknown row of each dimension. Shifts are arithmetic on the local clock, so facts find their business
date and shift without a range join; the calendar is there as a table for those who ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import safe_div
from millrace.operators import keys, temporal
from millrace.operators.temporal import HOUR, MINUTE

#: Local time is ahead of UTC by this, and the first shift begins at this local hour; three shifts of eight hours.
OFFSET, FIRST_HOUR, SHIFT = 330 * MINUTE, 6, 8 * HOUR
#: Seconds of a shift.
SCHEDULED = 28_800
#: States that count as downtime.
STOPPED = ("FAULT", "MAINTENANCE", "OFFLINE", "BLOCKED", "STARVED", "SETUP", "IDLE")
_ALIGN = OFFSET - FIRST_HOUR * HOUR


def shift_number(us: Column) -> Column:
    """Shifts since 1970 that have begun by a time in microseconds; three to a business day."""
    return F.floor((us + _ALIGN) / SHIFT)


def shift_keys(number: Column) -> tuple[Column, Column]:
    """(business date as yyyymmdd, shift_sk 1 to 3) of a shift number."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(number / 3).cast("int"))
    return F.date_format(day, "yyyyMMdd").cast("int"), (F.pmod(number, F.lit(3)) + 1).cast("int")


def with_shift(events: DataFrame, us: str) -> DataFrame:
    """Events with date_sk and shift_sk."""
    date, shift = shift_keys(shift_number(F.col(us)))
    return events.withColumn("date_sk", date).withColumn("shift_sk", shift)


def date_dimension(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Fourteen attributes of each day; the fiscal year begins in April and has the number of the year that it ends in."""
    d, m = F.col("calendar_date"), F.month("calendar_date")
    fiscal_month = F.when(m >= 4, m - 3).otherwise(m + 9)
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("calendar_date"))
    weekday = F.weekday(d) + 1
    columns = {
        "date_sk": F.date_format(d, "yyyyMMdd").cast("int"), "calendar_date": d, "calendar_year": F.year(d), "calendar_quarter": F.quarter(d), "month_number": m, "month_name": F.date_format(d, "MMMM"),
        "week_of_year": F.weekofyear(d), "day_of_month": F.dayofmonth(d), "day_of_week_number": weekday, "day_name": F.date_format(d, "EEEE"), "is_weekday": weekday <= 5,
        "fiscal_year": F.year(d) + F.when(m >= 4, 1).otherwise(0), "fiscal_quarter": F.floor((fiscal_month - 1) / 3).cast("int") + 1, "fiscal_month_number": fiscal_month,
    }
    return days.select(*[c.alias(n) for n, c in columns.items()])


def with_unknown(dim: DataFrame, key: str, **values: object) -> DataFrame:
    """A dimension with its unknown row: key 0, the given values, null in other columns. One that has it already keeps it."""
    row = dim.sparkSession.range(1).select(*[F.lit(0 if f.name == key else values.get(f.name)).cast(f.dataType).alias(f.name) for f in dim.schema.fields])
    return dim.unionByName(row.join(dim.where(F.col(key) == 0).select(key), key, "left_anti"))


def shift_calendar(dates: DataFrame, shifts: DataFrame) -> DataFrame:
    """dates (date_sk, calendar_date) x shifts (shift_sk, start_minute, end_minute, crosses_midnight): start and end in UTC
    microseconds. Both are dimensions: shifts are a handful of rows, so the product is theirs by definition."""
    day = F.unix_micros(F.col("calendar_date").cast("timestamp"))
    end = F.col("end_minute") + F.when(F.col("crosses_midnight"), 1440).otherwise(0)
    rows = dates.where("date_sk <> 0").crossJoin(F.broadcast(shifts.where("shift_sk <> 0")))
    return rows.select("date_sk", "shift_sk", (day + F.col("start_minute").cast("long") * MINUTE - OFFSET).alias("shift_start_us"), (day + end.cast("long") * MINUTE - OFFSET).alias("shift_end_us"))


def _current(dim: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return dim.select(*[F.col(c).alias(f"{prefix}{c}") for c in (*columns, "effective_from", "effective_to")])


def _versioned(rows: DataFrame, dim: DataFrame, on: str, key: str, keep: dict[str, str], how: str) -> DataFrame:
    """Rows with columns (new name: column) of the dimension row that is valid on __day."""
    side = _current(dim, "__d_", [key, *keep.values()])
    joined = temporal.scd2_join(rows, side, on, f"__d_{key}", "__day", how, "__d_effective_from", "__d_effective_to")
    return joined.select(*rows.columns, *[F.col(f"__d_{c}").alias(n) for n, c in keep.items()])


def _lookup(rows: DataFrame, dim: DataFrame, column: str, code: str, sk: str) -> DataFrame:
    """Rows with the surrogate key of a code; a null code or one that isn't there has the unknown key."""
    side = dim.select(F.col(code).alias("__code"), F.col(sk).alias("__sk"))
    return rows.join(side, F.col(column) == F.col("__code"), "left").withColumn(sk, F.coalesce("__sk", F.lit(0))).drop("__code", "__sk")


def _in_window(rows: DataFrame, start: int | None, end: int | None) -> DataFrame:
    rows = rows.withColumn("event_us", F.unix_micros("event_time")).withColumn("__day", F.to_date("event_time"))
    if start is not None:
        rows = rows.where(F.col("event_us") >= start)
    return with_shift(rows if end is None else rows.where(F.col("event_us") < end), "event_us")


def fact_telemetry(silver: DataFrame, machines: DataFrame, lines: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Telemetry with keys: machines and lines valid on the day; rows without either are left out."""
    rows = _versioned(_in_window(silver, start, end), machines, "machine_id", "machine_id", {"machine_sk": "machine_sk", "line_sk": "line_sk"}, "inner")
    return _versioned(rows, lines, "line_sk", "line_sk", {"plant_sk": "plant_sk"}, "inner").drop("__day")


def fact_operational(silver: DataFrame, machines: DataFrame, lines: DataFrame, alarms: DataFrame, failures: DataFrame, operators: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """As telemetry, with alarm_sk, failure_mode_sk and operator_sk; unknown codes have key 0."""
    rows = fact_telemetry(silver, machines, lines, start, end)
    rows = _lookup(_lookup(rows, alarms, "alarm_code", "alarm_code", "alarm_sk"), failures, "failure_mode_code", "failure_mode_code", "failure_mode_sk")
    rows = _versioned(rows.withColumn("__day", F.to_date("event_time")), operators, "operator_id", "operator_id", {"operator_sk": "operator_sk"}, "left")
    return rows.withColumn("operator_sk", F.coalesce("operator_sk", F.lit(0))).drop("__day")


def fact_production(silver: DataFrame, plants: DataFrame, lines: DataFrame, machines: DataFrame, products: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Production events with keys: the plant has to be known; line, machine and product have key 0 where the id is null or
    unknown in a table with an unknown row, and null where nothing is valid that day."""
    rows = _versioned(_in_window(silver, start, end), plants, "plant_id", "plant_id", {"plant_sk": "plant_sk"}, "inner")
    for dim, name in ((lines, "line"), (machines, "machine"), (products, "product")):
        rows = rows.withColumn("__id", F.coalesce(F.col(f"{name}_id"), F.lit("UNKNOWN")))
        rows = _versioned(rows, dim, "__id", f"{name}_id", {f"{name}_sk": f"{name}_sk"}, "left").drop("__id")
    return rows.drop("__day")


def fact_loss(production: DataFrame) -> DataFrame:
    """Recorded losses of the production facts; a null quantity is 0."""
    lost = production.where("event_type = 'ProductionLossRecorded'")
    return lost.select("event_id", "date_sk", "shift_sk", "plant_sk", "line_sk", "machine_sk", "product_sk", "loss_category", "loss_reason_code", F.coalesce("loss_quantity", F.lit(0.0)).alias("loss_quantity"), "loss_duration_seconds", "event_us")


def fact_by_codes(silver: DataFrame, plants: DataFrame, lines: DataFrame, machines: DataFrame, lookups: list[tuple[DataFrame, str, str, str]], start: int | None = None, end: int | None = None) -> DataFrame:
    """Maintenance and quality facts: keys of plant (known), line and machine as of the day, and of each code given as
    (dimension, column of the events, code of the dimension, its key)."""
    rows = _versioned(_in_window(silver, start, end), plants, "plant_id", "plant_id", {"plant_sk": "plant_sk"}, "inner")
    rows = _versioned(rows, lines, "line_id", "line_id", {"line_sk": "line_sk"}, "left")
    rows = _versioned(rows, machines, "machine_id", "machine_id", {"machine_sk": "machine_sk"}, "left")
    rows = rows.withColumn("line_sk", F.coalesce("line_sk", F.lit(0))).withColumn("machine_sk", F.coalesce("machine_sk", F.lit(0)))
    for dim, column, code, sk in lookups:
        rows = _lookup(rows, dim, column, code, sk)
    return rows.drop("__day")


def downtime_category(state: Column, planned: Column) -> Column:
    """Ten categories: planned ones come first, what isn't planned has its state's, and the rest is idle."""
    p = F.coalesce(planned, F.lit(False))
    out = F.lit("IDLE_NO_DEMAND")
    for s in ("SETUP", "MAINTENANCE", "STARVED", "BLOCKED", "OFFLINE", "FAULT"):
        out = F.when(state == s, f"UNPLANNED_{s}").otherwise(out)
    for s in ("IDLE", "SETUP", "MAINTENANCE"):
        out = F.when(p & (state == s), f"PLANNED_{s}").otherwise(out)
    return out


def fact_downtime(changes: DataFrame, start: int, end: int) -> DataFrame:
    """Downtime from state changes (event_id, machine_sk, line_sk, plant_sk, event_us, generation_sequence, new_state,
    is_planned): a state lasts to the machine's next change. Each machine's last change before the window is carried in.
    Intervals are cut at shift limits and at the window; an open last state is no interval. One row a piece."""
    order = ["event_us", "generation_sequence", "event_id"]
    rows = temporal.carry_in(changes.where(F.col("event_us") < end), "machine_sk", "event_us", order, start)
    spans = temporal.state_intervals(rows, "machine_sk", "event_us", order, "event_id").withColumnRenamed("next_state", "end_event_id")
    spans = spans.where((F.col("state_end") > start) & F.col("new_state").isin(*STOPPED))
    spans = spans.withColumn("from_us", F.greatest("event_us", F.lit(start))).withColumn("to_us", F.least("state_end", F.lit(end))).where("from_us < to_us")
    cut = temporal.split_by_shift(spans, "from_us", "to_us", SHIFT, _ALIGN)
    date, shift = shift_keys(F.col("shift_no"))
    seconds = F.round((F.col("piece_end") - F.col("piece_start")) / 1_000_000, 3)
    return cut.select(F.col("event_id").alias("start_event_id"), "end_event_id", date.alias("date_sk"), shift.alias("shift_sk"), "plant_sk", "line_sk", "machine_sk", F.col("new_state").alias("state_code"), downtime_category(F.col("new_state"), F.col("is_planned")).alias("downtime_category"), F.coalesce("is_planned", F.lit(False)).alias("is_planned"), F.col("piece_start").alias("interval_start_us"), F.col("piece_end").alias("interval_end_us"), seconds.alias("duration_seconds"))


def merge_downtime(target: DataFrame, new: DataFrame) -> DataFrame:
    """Pieces of a later window replace those they extend: the key is the first event, the business date and the shift."""
    key = ["start_event_id", "date_sk", "shift_sk"]
    both = new.unionByName(target)
    ends = both.groupBy(*key).agg(F.min("interval_start_us").alias("__s"), F.max("interval_end_us").alias("__e"))
    row = keys.latest_by(both, key, ["interval_end_us"])
    out = row.join(ends, key).withColumn("interval_start_us", F.col("__s")).withColumn("interval_end_us", F.col("__e")).drop("__s", "__e")
    return out.withColumn("duration_seconds", F.round((F.col("interval_end_us") - F.col("interval_start_us")) / 1_000_000, 3)).select(*target.columns)


def oee(production: DataFrame, downtime: DataFrame, products: DataFrame) -> DataFrame:
    """OEE of each (date, shift, plant, line, machine) that produced or stopped. Production without a machine (null) is a
    group of its own; downtime always has one. Percentages are null where their denominator isn't positive."""
    key = ["date_sk", "shift_sk", "plant_sk", "line_sk", "machine_sk"]
    cycle = products.select(F.col("product_sk").alias("__p"), F.col("standard_cycle_time_seconds").alias("__cycle"))
    q = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    made = production.where("event_type = 'UnitProduced'").withColumn("__k", F.coalesce("product_sk", F.lit(0))).join(cycle, F.col("__k") == F.col("__p"), "left")
    zero = F.lit(0.0)
    made = made.select(*key, q("actual_quantity").alias("total_quantity"), q("good_quantity").alias("good_quantity"), q("rejected_quantity").alias("rejected_quantity"), (q("actual_quantity") * q("__cycle")).alias("ideal_production_seconds"), zero.alias("planned_stop_seconds"), zero.alias("downtime_seconds"))
    lost = downtime.select(*key, zero.alias("total_quantity"), zero.alias("good_quantity"), zero.alias("rejected_quantity"), zero.alias("ideal_production_seconds"), F.when(F.col("is_planned"), F.col("duration_seconds")).otherwise(0.0).alias("planned_stop_seconds"), F.when(F.col("is_planned"), 0.0).otherwise(F.col("duration_seconds")).alias("downtime_seconds"))
    # One aggregate over both sides: groups treat nulls as equal, so nothing has to be joined.
    both = made.unionByName(lost).groupBy(*key).agg(*[F.round(F.sum(c), 3).alias(c) for c in made.columns[5:]])
    loading, run = SCHEDULED - F.col("planned_stop_seconds"), SCHEDULED - F.col("planned_stop_seconds") - F.col("downtime_seconds")
    both = both.withColumn("__loading", loading).withColumn("planned_production_seconds", F.greatest(loading, F.lit(0.0))).withColumn("run_time_seconds", F.greatest(run, F.lit(0.0)))
    both = both.withColumn("availability_pct", 100 * safe_div(F.col("run_time_seconds"), F.col("__loading"))).withColumn("performance_pct", 100 * safe_div(F.col("ideal_production_seconds"), F.col("run_time_seconds"))).withColumn("quality_pct", 100 * safe_div(F.col("good_quantity"), F.col("total_quantity")))
    return both.withColumn("oee_pct", F.col("availability_pct") * F.col("performance_pct") * F.col("quality_pct") / 10_000).drop("__loading")


def oee_summary(facts: DataFrame, by: list[str]) -> DataFrame:
    """OEE of larger groups: ratios of sums, and their product."""
    sums = {c: F.sum(c) for c in ("planned_production_seconds", "planned_stop_seconds", "run_time_seconds", "downtime_seconds", "total_quantity", "good_quantity", "rejected_quantity", "ideal_production_seconds")}
    out = facts.groupBy(*by).agg(*[e.alias(n) for n, e in sums.items()])
    out = out.withColumn("availability_pct", 100 * safe_div(F.col("run_time_seconds"), F.col("planned_production_seconds"))).withColumn("performance_pct", 100 * safe_div(F.col("ideal_production_seconds"), F.col("run_time_seconds"))).withColumn("quality_pct", 100 * safe_div(F.col("good_quantity"), F.col("total_quantity")))
    return out.withColumn("oee_pct", F.col("availability_pct") * F.col("performance_pct") * F.col("quality_pct") / 10_000)


def star(fact: DataFrame, dims: list[tuple[DataFrame, str, list[str]]], how: str = "left") -> DataFrame:
    """A fact with columns of its dimensions, each given as (table, key, columns); a null key is the unknown one."""
    for dim, sk, columns in dims:
        side = dim.select(F.col(sk).alias("__sk"), *columns)
        fact = fact.join(side, F.coalesce(F.col(sk), F.lit(0)) == F.col("__sk"), how).drop("__sk")
    return fact


def business_dates(start: int, end: int) -> tuple[str, str]:
    """First and last local date that a window of UTC microseconds touches; the end is open."""
    import datetime as dt

    local = lambda us: (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us + OFFSET)).date().isoformat()
    return local(start), local(end - MINUTE)


def refresh(silver: dict[str, DataFrame], dims: dict[str, DataFrame], start: int, end: int) -> dict[str, DataFrame]:
    """All facts of a window and their audit row, from silver tables (telemetry, operational, production) and dimensions
    (plant, line, machine, product, alarm, failure, operator). Facts of a window are the same however often it is run."""
    out = {
        "fact_telemetry": fact_telemetry(silver["telemetry"], dims["machine"], dims["line"], start, end),
        "fact_operational": fact_operational(silver["operational"], dims["machine"], dims["line"], dims["alarm"], dims["failure"], dims["operator"], None, end),
        "fact_production": fact_production(silver["production"], dims["plant"], dims["line"], dims["machine"], dims["product"], start, end),
    }
    out["fact_downtime"] = fact_downtime(out["fact_operational"].where("event_type = 'StateChanged'"), start, end)
    out["fact_operational"] = out["fact_operational"].where(F.col("event_us") >= start)
    out["fact_loss"] = fact_loss(out["fact_production"])
    out["fact_oee"] = oee(out["fact_production"], out["fact_downtime"], dims["product"])
    counts = None
    for name, df in list(out.items()):
        one = df.agg(F.count("*").alias(f"{name}_rows"))
        counts = one if counts is None else counts.crossJoin(F.broadcast(one))
    first, last = business_dates(start, end)
    out["audit"] = counts.withColumn("business_date_start", F.lit(first)).withColumn("business_date_end", F.lit(last))
    return out
