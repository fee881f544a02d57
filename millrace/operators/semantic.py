"""Measures over facts joined to dimensions, in whatever grouping is asked for, under row-level security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import safe_div


def ratio(num: str, den: str) -> Column:
    """A ratio of sums, never an average of ratios."""
    return safe_div(F.sum(num), F.sum(den))


def measure_query(fact: DataFrame, measures: dict[str, Column], by: list[str], where: Column | None = None) -> DataFrame:
    rows = fact if where is None else fact.where(where)
    return rows.groupBy(*by).agg(*[m.alias(name) for name, m in measures.items()])


def secured(fact: DataFrame, grants: DataFrame, user: str, plant: str) -> DataFrame:
    """Rows of the plants that a user has an active grant for."""
    mine = grants.where((F.lower("user_name") == user.lower()) & F.col("is_active")).select(F.col("plant_id").alias("__p"))
    return fact.join(mine, fact[plant] == F.col("__p"), "left_semi")


def year_to_date(daily: DataFrame, day: str, value: str) -> DataFrame:
    return daily.withColumn("ytd", F.sum(value).over(Window.partitionBy(F.year(day)).orderBy(day)))


def prior_day(daily: DataFrame, day: str, value: str) -> DataFrame:
    """Adds the change against the calendar day before; null where that day has no row."""
    old = daily.select(F.date_add(day, 1).alias("__d"), F.col(value).alias("__v"))
    return daily.join(old, F.col(day) == F.col("__d"), "left").withColumn("change", F.col(value) - F.col("__v")).drop("__d", "__v")
