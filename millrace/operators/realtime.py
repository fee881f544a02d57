"""The hot path: critical incidents of a trailing window and the risk of each machine. `now` is given, never the clock's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import band, points

#: Points by temperature and vibration, points and caps by kind of incident, bands.
TEMPERATURE = [(90, 40), (80, 20), (70, 10)]
VIBRATION = [(8, 40), (6, 20), (4, 10)]
INCIDENTS = {"critical_incident_count": (5, 20), "fault_count": (15, 30), "communication_loss_count": (5, 10)}
BANDS = [(80, "CRITICAL"), (60, "HIGH"), (30, "MEDIUM")]


def critical_incidents(events: DataFrame, now: int, span: int) -> DataFrame:
    """Alarms of high or critical severity and all faults and losses of communication since now - span, newest first. The
    bound is a number, so it reaches the scan."""
    serious = F.coalesce(F.col("severity").isin("HIGH", "CRITICAL"), F.lit(False)) | F.col("event_type").isin("MachineFaulted", "CommunicationLost")
    return events.where((F.col("event_us") >= now - span) & F.col("event_type").isin("AlarmRaised", "MachineFaulted", "CommunicationLost") & serious).orderBy(F.desc("event_us"))


def risk_score(temperature: Column, vibration: Column, counts: dict[str, Column]) -> Column:
    """0 to 100: points for heat, vibration and each kind of incident, each capped."""
    total = points(temperature, TEMPERATURE) + points(vibration, VIBRATION)
    for name, count in counts.items():
        each, cap = INCIDENTS[name]
        total = total + F.least(F.lit(cap), each * count)
    return F.least(F.lit(100), total).cast("double")


def machine_risk(latest: DataFrame, incidents: DataFrame) -> DataFrame:
    """latest (machine_id, temperature_c, vibration_mm_s, ...) with the counts of its critical incidents, of which faults and
    losses count once more by kind, machine_risk_score and risk_band. Every critical incident counts, whatever its kind."""
    counts = incidents.groupBy("machine_id").agg(F.count("*").alias("critical_incident_count"), F.count_if(F.col("event_type") == "MachineFaulted").alias("fault_count"), F.count_if(F.col("event_type") == "CommunicationLost").alias("communication_loss_count"))
    rows = latest.join(counts, "machine_id", "left").fillna(0, list(INCIDENTS))
    rows = rows.withColumn("machine_risk_score", risk_score(F.col("temperature_c"), F.col("vibration_mm_s"), {n: F.col(n) for n in INCIDENTS}))
    return rows.withColumn("risk_band", band(F.col("machine_risk_score"), BANDS, "LOW"))
