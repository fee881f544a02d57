"""The semantic model: facts, dimensions, many-to-one relationships and 29 measures, each in whatever grouping is asked for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import safe_div
from millrace.operators import semantic


def _div(a: str, b: str) -> Column:
    return safe_div(F.sum(a), F.sum(b))


def _oee() -> Column:
    return _div("run_time_seconds", "planned_production_seconds") * _div("ideal_production_seconds", "run_time_seconds") * _div("good_quantity", "total_quantity")


def _minutes(where: Column | None = None) -> Column:
    s = F.col("duration_seconds")
    return F.sum(s if where is None else F.when(where, s)) / 60


def _kind(name: str) -> Column:
    return F.count_if(F.col("event_type") == name)


#: Measures by fact: aggregates that any grouping can use. Two more, over days, are functions below.
MEASURES: dict[str, dict[str, Callable[[], Column]]] = {
    "oee": {
        "Good Units": lambda: F.sum("good_quantity"),
        "Rejected Units": lambda: F.sum("rejected_quantity"),
        "Total Units": lambda: F.sum("total_quantity"),
        "Availability %": lambda: _div("run_time_seconds", "planned_production_seconds"),
        "Performance %": lambda: _div("ideal_production_seconds", "run_time_seconds"),
        "Quality %": lambda: _div("good_quantity", "total_quantity"),
        "OEE %": _oee,
    },
    "downtime": {
        "Downtime Minutes": _minutes,
        "Unplanned Downtime Minutes": lambda: _minutes(~F.col("is_planned")),
        "Planned Downtime Minutes": lambda: _minutes(F.col("is_planned")),
        "Fault Downtime Minutes": lambda: _minutes(F.col("state_code") == "FAULT"),
    },
    "production": {
        "Actual Units": lambda: F.sum("actual_quantity"),
        "Good Units": lambda: F.sum("good_quantity"),
        "Rejected Units": lambda: F.sum("rejected_quantity"),
        "Production Yield %": lambda: _div("good_quantity", "actual_quantity"),
    },
    "telemetry": {
        "Telemetry Event Count": lambda: F.count("*"),
        "Average Vibration mm/s": lambda: F.avg("vibration_mm_s"),
        "Average Temperature C": lambda: F.avg("temperature_c"),
        "Average Power kW": lambda: F.avg("power_kw"),
    },
    "operational": {
        "Alarm Count": lambda: _kind("AlarmRaised"),
        "Fault Count": lambda: _kind("MachineFaulted"),
        "Communication Loss Count": lambda: _kind("CommunicationLost"),
    },
    "risk": {
        "Critical ML Risk Machines": lambda: F.count_distinct(F.when(F.col("risk_band") == "CRITICAL", F.col("machine_sk"))),
        "High ML Risk Machines": lambda: F.count_distinct(F.when(F.col("risk_band").isin("HIGH", "CRITICAL"), F.col("machine_sk"))),
        "Average Failure Risk %": lambda: F.avg("failure_risk_score"),
        # The greatest score among the rows that are last by feature time, then by scoring time.
        "Latest Failure Risk %": lambda: F.max(F.struct("feature_us", "scored_us", "failure_risk_score"))["failure_risk_score"],
    },
    "model_health": {"Model Health Breaches": lambda: F.count_if(F.col("status") == "BREACH")},
}


@dataclass
class Model:
    """tables by name; relationships: (fact, column, dimension, key), many to one, filters flow from dimension to fact."""

    tables: dict[str, DataFrame]
    relationships: list[tuple[str, str, str, str]] = field(default_factory=list)

    def joined(self, fact: str, dimensions: list[str]) -> DataFrame:
        """A fact with the columns of dimensions, named dimension.column; a dimension that isn't related raises."""
        out = self.tables[fact]
        for name in dict.fromkeys(dimensions):
            edge = next(((c, k) for f, c, d, k in self.relationships if (f, d) == (fact, name)), None)
            if edge is None:
                raise ValueError(f"{fact} has no relationship to {name}")
            dim = self.tables[name]
            side = dim.select(F.col(edge[1]).alias("__key"), *[F.col(c).alias(f"{name}.{c}") for c in dim.columns])
            out = out.join(side, F.col(edge[0]) == F.col("__key"), "left").drop("__key")
        return out

    def query(self, fact: str, measures: list[str], by: list[str] = (), where: dict[str, list] | None = None) -> DataFrame:
        """Measures of a fact by columns `dimension.column`, for rows whose columns are in the given lists."""
        where = where or {}
        rows = self.joined(fact, [c.split(".")[0] for c in (*by, *where)])
        for c, values in where.items():
            rows = rows.where(F.col(f"`{c}`").isin(list(values)))
        named = {c: F.col(f"`{c}`").alias(c.split(".")[1]) for c in by}
        return rows.groupBy(*named.values()).agg(*[MEASURES[fact][m]().alias(m) for m in measures])


def oee_by_day(model: Model) -> DataFrame:
    """calendar_date, OEE %, OEE YTD % (of the sums since the first of January) and its change against the day before."""
    sums = ("run_time_seconds", "planned_production_seconds", "ideal_production_seconds", "good_quantity", "total_quantity")
    daily = model.joined("oee", ["date"]).groupBy(F.col("`date.calendar_date`").alias("calendar_date")).agg(*[F.sum(c).alias(c) for c in sums])
    for c in sums:
        daily = semantic.year_to_date(daily, "calendar_date", c).withColumnRenamed("ytd", f"ytd_{c}")

    def rate(p: str) -> Column:
        r = lambda a, b: safe_div(F.col(p + a), F.col(p + b))
        return r("run_time_seconds", "planned_production_seconds") * r("ideal_production_seconds", "run_time_seconds") * r("good_quantity", "total_quantity")

    return semantic.prior_day(daily.select("calendar_date", rate("").alias("oee"), rate("ytd_").alias("oee_ytd")), "calendar_date", "oee").withColumnRenamed("change", "oee_change")
