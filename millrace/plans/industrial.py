"""Registered queries over the plant of `plant.py`: the whole way from raw lines to facts, OEE, features and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import micros
from millrace.operators import features, gold, keys, learning, measures, silver, temporal
from millrace.operators.temporal import DAY, HOUR, MINUTE
from millrace.plans import plant
from millrace.plans.catalogue import query
from millrace.plans.plant import ACCEPTED, DIMS, E0, ENRICHED, FACTS, GATE, RAW

#: The window of the facts, and its business dates in local time.
START, END = 1_704_240_000_000_000, 1_705_622_400_000_000  # 2024-01-03 to 2024-01-19, UTC midnights
STOPPED = ", ".join(f"'{s}'" for s in gold.STOPPED)


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# ---- silver ----------------------------------------------------------------------------------------------------------
@query(f"WITH {RAW} SELECT n, event_id, event_type, schema_version, event_us, ingestion_us, source_system, plant_id, line_id, machine_id, simulator_run_id, generation_sequence, CAST(d AS VARCHAR) AS event_date FROM timed")
def silver_envelope(spark, sf):
    e = plant.enveloped(spark, sf)
    return e.select("n", "event_id", "event_type", "schema_version", F.unix_micros("event_time").alias("event_us"), F.unix_micros("ingestion_time").alias("ingestion_us"), "source_system", "plant_id", "line_id", "machine_id", "simulator_run_id", "generation_sequence", F.col("event_date").cast("string").alias("event_date"))


@query(f"WITH {ENRICHED} SELECT n, machine_sk, machine_line_sk, machine_type_code, line_sk, line_plant_sk, plant_sk, product_sk FROM enr")
def silver_enrich_keys(spark, sf):
    return plant.gated(spark, sf).select("n", "machine_sk", "machine_line_sk", "machine_type_code", "line_sk", "line_plant_sk", "plant_sk", "product_sk")


@query(f"WITH {GATE} SELECT n, coalesce(rejection_code, 'ACCEPTED') AS code FROM gate")
def silver_gate_rules(spark, sf):
    return plant.gated(spark, sf).select("n", F.coalesce("rejection_code", F.lit("ACCEPTED")).alias("code"))


def _columns(name: str) -> list[str]:
    """Typed fields of a domain."""
    return [*silver.LINEAGE, *silver.DOMAINS[name]]


def _domain_sql(name: str, types: str) -> str:
    given = lambda c, kind: c if c in plant.FIELDS else f"CAST(NULL AS {'DOUBLE' if kind == 'double' else 'VARCHAR' if kind == 'string' else kind})"
    fields = silver.LINEAGE | silver.DOMAINS[name]
    return f"WITH {ACCEPTED} SELECT event_id, event_us, " + ", ".join(f"{given(c, k)} AS {c}" for c, k in fields.items()) + f" FROM acc WHERE event_type IN ({types})"


def _domain(spark, sf, name: str):
    return plant.domain(spark, sf, name).select("event_id", F.unix_micros("event_time").alias("event_us"), *_columns(name))


@query(_domain_sql("telemetry", "'MachineTelemetry'"))
def silver_telemetry(spark, sf):
    return _domain(spark, sf, "telemetry")


@query(_domain_sql("operational", plant.OPERATIONAL))
def silver_operational(spark, sf):
    return _domain(spark, sf, "operational")


@query(_domain_sql("production", plant.PRODUCTION_TYPES))
def silver_production(spark, sf):
    return _domain(spark, sf, "production")


COPIES = "c AS (SELECT *, 0 AS seq, CAST(n AS VARCHAR) AS h FROM raw UNION ALL SELECT *, 1, CAST(n AS VARCHAR) FROM raw WHERE n % 10 = 0 UNION ALL SELECT *, 2, n || 'x' FROM raw WHERE n % 25 = 0), v AS (SELECT *, CASE WHEN min(h) OVER w <> max(h) OVER w THEN 'CONFLICT' WHEN row_number() OVER (PARTITION BY n ORDER BY h, seq) = 1 THEN 'KEEP' ELSE 'DUPLICATE' END AS status FROM c WINDOW w AS (PARTITION BY n))"


@query(f"WITH {GATE}, {COPIES}, k AS (SELECT gate.rejection_code, gate.event_us < max(gate.event_us) OVER () - {10 * DAY} AS late FROM gate JOIN v ON v.n = gate.n AND status = 'KEEP') SELECT (SELECT count(*) FROM v) AS source_rows, (SELECT count(*) FROM v WHERE status = 'DUPLICATE') AS duplicate_rows, (SELECT count(*) FROM v WHERE status = 'CONFLICT') AS conflict_rows, count(*) FILTER (rejection_code IS NULL) AS accepted_rows, count(*) FILTER (rejection_code IS NOT NULL) AS rejected_rows, count(*) FILTER (late) AS late_rows, count(*) FILTER (rejection_code LIKE '%MASTER_NOT_FOUND') AS master_failures FROM k")
def silver_audit(spark, sf):
    raw = plant.lines(spark, sf)
    copies = raw.withColumn("seq", F.lit(0)).unionByName(raw.where("n % 10 = 0").withColumn("seq", F.lit(1))).unionByName(raw.where("n % 25 = 0").select("n", F.concat("value", F.lit(" ")).alias("value"), F.lit(2).alias("seq")))
    seen = keys.classify_versions(copies.withColumn("h", F.sha2("value", 256)), "n", "h", [F.col("h"), F.col("seq")])
    kept = silver.envelope(seen.where("status = 'KEEP'").select("n", "value"))
    rows = silver.quality_gate(silver.enrich_master_keys(kept, *[plant.master(spark, m) for m in ("machine", "line", "plant", "product")]))
    late = temporal.late_flag(rows.withColumn("batch", F.lit(0)).withColumn("event_us", F.unix_micros("event_time")), "batch", "event_us", 10 * DAY)
    return silver.audit(late, seen)


# ---- checks of a run -------------------------------------------------------------------------------------------------
SEQ = "CASE WHEN n % 101 = 3 THEN NULL WHEN n % 103 = 4 THEN 0 ELSE n // 4 + 1 + CASE WHEN n % 107 < 4 THEN 1 ELSE 0 END END"


@query(f"WITH {E0}, s AS (SELECT n, n % 4 AS stream, CASE WHEN n % 109 = 5 THEN NULL WHEN n % 113 = 6 THEN 'RUN-2' ELSE 'RUN-1' END AS run, {SEQ} AS seq, CASE WHEN n % 127 = 7 THEN NULL ELSE n // 12 END AS id FROM e0), w AS (SELECT *, first_value(run IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS UNBOUNDED PRECEDING) AS r0, last_value(CASE WHEN seq >= 1 THEN seq END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, row_number() OVER (PARTITION BY stream, id ORDER BY n) AS copy FROM s) SELECT n, concat_ws(',', CASE WHEN run IS NULL THEN 'MISSING_RUN_LINEAGE' END, CASE WHEN run <> r0 THEN 'MULTIPLE_RUN_IDS' END, CASE WHEN seq IS NULL OR seq < 1 THEN 'INVALID_GENERATION_SEQUENCE' END, CASE WHEN seq <> last + 1 THEN 'GENERATION_SEQUENCE_GAP' END, CASE WHEN id IS NULL THEN 'MISSING_EVENT_ID' END, CASE WHEN id IS NOT NULL AND copy > 1 THEN 'DUPLICATE_EVENT_ID' END) AS codes FROM w")
def check_lineage(spark, sf):
    e = plant.numbered(spark, sf).selectExpr("n", "n AS position", "n % 4 AS stream", "CASE WHEN n % 109 = 5 THEN NULL WHEN n % 113 = 6 THEN 'RUN-2' ELSE 'RUN-1' END AS simulator_run_id", SEQ.replace("//", "div") + " AS generation_sequence", "CASE WHEN n % 127 = 7 THEN NULL ELSE n div 12 END AS event_id")
    return silver.lineage_codes(e).select("n", F.array_join("codes", ",").alias("codes"))


TIMES = "n, n % 4 AS stream, n AS position, us - CASE WHEN n % 97 = 0 THEN 86400000000 ELSE 0 END AS event_us"


@query(f"WITH {E0}, s AS (SELECT {TIMES}, us - CASE WHEN n % 97 = 0 THEN 86400000000 ELSE 0 END + CASE WHEN n % 89 = 1 THEN -5000 ELSE (n * 37) % 1600 * 1000 END AS ingestion_us FROM e0), w AS (SELECT *, max(event_us) OVER (PARTITION BY stream ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s) SELECT n, concat_ws(',', CASE WHEN ingestion_us < event_us THEN 'INGESTION_BEFORE_EVENT' END, CASE WHEN ingestion_us >= event_us AND ingestion_us - event_us NOT BETWEEN 20000 AND 1500000 THEN 'INGESTION_DELAY_OUT_OF_RANGE' END, CASE WHEN event_us < top THEN 'EVENT_TIME_REGRESSION' END) AS codes FROM w")
def check_times(spark, sf):
    e = plant.numbered(spark, sf).selectExpr("n", "n % 4 AS stream", "n AS position", TIMES.split("position, ")[1], "us - CASE WHEN n % 97 = 0 THEN 86400000000 ELSE 0 END + CASE WHEN n % 89 = 1 THEN -5000 ELSE (n * 37) % 1600 * 1000 END AS ingestion_us")
    return silver.temporal_codes(e).select("n", F.array_join("codes", ",").alias("codes"))


@query(f"WITH {RAW} SELECT n, concat_ws(',', CASE WHEN coalesce(actual_quantity < 0, false) OR coalesce(good_quantity < 0, false) OR coalesce(rejected_quantity < 0, false) THEN 'NEGATIVE_QUANTITY' END, CASE WHEN good_quantity + rejected_quantity > actual_quantity + 1e-9 THEN 'QUANTITY_INCONSISTENT' END, CASE WHEN event_type = 'StateChanged' AND previous_state IS NOT DISTINCT FROM new_state THEN 'STATE_NOT_CHANGED' END, CASE WHEN event_type = 'ProductionLossRecorded' AND loss_quantity < 0 THEN 'NEGATIVE_LOSS' END) AS codes FROM raw")
def check_business_rules(spark, sf):
    rows = silver.payload_fields(plant.enveloped(spark, sf), {k: v for d in silver.DOMAINS.values() for k, v in d.items()})
    return silver.business_codes(rows).select("n", F.array_join("codes", ",").alias("codes"))


CAUSES = "n, n AS position, n AS event_id, CASE WHEN n % 5 = 0 THEN n - 50 WHEN n % 7 = 0 THEN n + 3 END AS causation_id, CASE WHEN n % 45 = 0 THEN n % 10 ELSE n % 50 END AS correlation_id, n % 83 <> 0 AS valid"


@query(f"""WITH RECURSIVE {E0}, s AS (SELECT {CAUSES} FROM e0), own AS (SELECT c.*, p.event_id AS parent, c.causation_id IS NOT NULL AND (p.event_id IS NULL OR p.position >= c.position OR NOT p.valid) AS lost, p.event_id IS NOT NULL AND c.correlation_id IS DISTINCT FROM p.correlation_id AS other FROM s c LEFT JOIN s p ON c.causation_id = p.event_id),
bad AS (SELECT event_id FROM own WHERE NOT valid OR lost OR other UNION SELECT o.event_id FROM own o JOIN bad b ON o.causation_id = b.event_id WHERE o.position > b.event_id)
SELECT own.n, concat_ws(',', CASE WHEN lost OR b.event_id IS NOT NULL THEN 'CAUSATION_PARENT_NOT_FOUND' END, CASE WHEN other THEN 'CORRELATION_MISMATCH' END) AS codes FROM own LEFT JOIN bad b ON own.causation_id = b.event_id""")
def check_causation(spark, sf):
    e = plant.numbered(spark, sf).selectExpr(*CAUSES.split(", "), "0 AS stream")
    return silver.causation_codes(e).select("n", F.array_join(F.array_sort("codes"), ",").alias("codes"))


SCHEMA = {
    "required": ["event_id", "plant_id"],
    "fields": {"machine_id": {"pattern": "^MCH-[0-9]{1,2}$"}, "machine_type": {"enum": ["CNC", "ROB", "HPR"]}, "vibration_mm_s": {"minimum": 0.5, "maximum": 9.0}, "simulator_run_id": {"const": "RUN-1"}},
    "when": [{"if": {"event_type": "UnitProduced"}, "then": ["product_id", "actual_quantity"]}, {"if": {"event_type": "MachineTelemetry", "machine_type": ["CNC", "HPR"]}, "then": ["vibration_mm_s"]}],
}


@query(f"WITH {RAW} SELECT n, concat_ws(',', CASE WHEN event_id IS NULL THEN 'REQUIRED:event_id' END, CASE WHEN plant_id IS NULL THEN 'REQUIRED:plant_id' END, CASE WHEN NOT regexp_matches(machine_id, '^MCH-[0-9]{{1,2}}$') THEN 'PATTERN:machine_id' END, CASE WHEN machine_type NOT IN ('CNC', 'ROB', 'HPR') THEN 'ENUM:machine_type' END, CASE WHEN vibration_mm_s < 0.5 THEN 'MINIMUM:vibration_mm_s' END, CASE WHEN vibration_mm_s > 9.0 THEN 'MAXIMUM:vibration_mm_s' END, CASE WHEN event_type = 'UnitProduced' AND product_id IS NULL THEN 'REQUIRED:product_id' END, CASE WHEN event_type = 'UnitProduced' AND actual_quantity IS NULL THEN 'REQUIRED:actual_quantity' END, CASE WHEN event_type = 'MachineTelemetry' AND machine_type IN ('CNC', 'HPR') AND vibration_mm_s IS NULL THEN 'REQUIRED:vibration_mm_s' END) AS codes FROM raw")
def check_schema(spark, sf):
    return schema_checked(spark, sf).select("n", F.array_join("codes", ",").alias("codes"))


def schema_checked(spark, sf):
    rows = silver.payload_fields(plant.enveloped(spark, sf), {"machine_type": "string", "vibration_mm_s": "double", "product_id": "string", "actual_quantity": "double"})
    return silver.schema_codes(rows, SCHEMA)


@query(f"WITH {RAW} SELECT event_type, CAST(CAST(make_timestamp(event_us) AS DATE) AS VARCHAR) AS event_date, count(*) AS records, count(*) AS ids, count(*) FILTER (plant_id IS NULL) AS without_plant FROM raw WHERE event_id IS NULL OR plant_id IS NULL GROUP BY 1, 2")
def quarantine_records(spark, sf):
    rows = silver.schema_codes(plant.enveloped(spark, sf), {"required": ["event_id", "plant_id"]})
    return silver.quarantine(rows).groupBy("event_type", F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("records"), F.count_distinct("quarantine_id").alias("ids"), F.count_if(F.array_contains("reason_codes", "REQUIRED:plant_id")).alias("without_plant"))


# ---- gold ------------------------------------------------------------------------------------------------------------
@query("WITH d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2025-01-10', INTERVAL 1 DAY)) AS DATE) AS d), f AS (SELECT d, CASE WHEN month(d) >= 4 THEN month(d) - 3 ELSE month(d) + 9 END AS fm FROM d) SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, CAST(d AS VARCHAR) AS calendar_date, year(d) AS calendar_year, quarter(d) AS calendar_quarter, month(d) AS month_number, monthname(d) AS month_name, week(d) AS week_of_year, day(d) AS day_of_month, isodow(d) AS day_of_week_number, dayname(d) AS day_name, isodow(d) <= 5 AS is_weekday, year(d) + CASE WHEN month(d) >= 4 THEN 1 ELSE 0 END AS fiscal_year, CAST((fm - 1) // 3 + 1 AS INTEGER) AS fiscal_quarter, fm AS fiscal_month_number FROM f UNION ALL SELECT 0, NULL, NULL, NULL, NULL, 'UNKNOWN', NULL, NULL, NULL, 'UNKNOWN', NULL, NULL, NULL, NULL")
def gold_date_dimension(spark, sf):
    d = gold.with_unknown(gold.date_dimension(spark, "2023-12-25", "2025-01-10"), "date_sk", month_name="UNKNOWN", day_name="UNKNOWN")
    return d.withColumn("calendar_date", F.col("calendar_date").cast("string"))


def _shifts(spark):
    return spark.createDataFrame([(0, None, None, None), (1, 360, 840, False), (2, 840, 1320, False), (3, 1320, 360, True)], "shift_sk int, start_minute int, end_minute int, crosses_midnight boolean")


@query(f"WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS d), s(shift_sk, a, b) AS (VALUES (1, 360, 840), (2, 840, 1320), (3, 1320, 1800)) SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, shift_sk, epoch_us(CAST(d AS TIMESTAMP)) + (a - 330)::BIGINT * {MINUTE} AS shift_start_us, epoch_us(CAST(d AS TIMESTAMP)) + (b - 330)::BIGINT * {MINUTE} AS shift_end_us FROM d, s")
def gold_shift_calendar(spark, sf):
    return gold.shift_calendar(gold.date_dimension(spark, "2024-01-01", "2024-02-10"), _shifts(spark))


@query(f"WITH {DIMS} " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, count(*) AS rows, count(*) FILTER ({k} = 0) AS unknown_rows, count(DISTINCT {k}) AS keys FROM d_{n}" for n, k in plant.KEYS.items()))
def gold_dimensions(spark, sf):
    out = None
    for n, k in plant.KEYS.items():
        one = gold.with_unknown(plant.dimension(spark, n), k).agg(F.lit(n).alias("dimension"), F.count("*").alias("rows"), F.count_if(F.col(k) == 0).alias("unknown_rows"), F.count_distinct(k).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


def _dims(spark):
    return {n: plant.dimension(spark, n) for n in plant.KEYS}


def fact(spark, sf, name, start=None, end=None):
    d = _dims(spark)
    rows = plant.domain(spark, sf, name)
    if name == "telemetry":
        return gold.fact_telemetry(rows, d["machine"], d["line"], start, end)
    if name == "operational":
        return gold.fact_operational(rows, d["machine"], d["line"], d["alarm"], d["failure"], d["operator"], start, end)
    return gold.fact_production(rows, d["plant"], d["line"], d["machine"], d["product"], start, end)


@query(f"WITH {FACTS} SELECT event_id, date_sk, shift_sk, plant_sk, line_sk, machine_sk, event_us, temperature_c, vibration_mm_s FROM f_tel WHERE event_us >= {START} AND event_us < {END}")
def fact_telemetry(spark, sf):
    return fact(spark, sf, "telemetry", START, END).select("event_id", "date_sk", "shift_sk", "plant_sk", "line_sk", "machine_sk", "event_us", "temperature_c", "vibration_mm_s")


@query(f"WITH {FACTS} SELECT event_id, date_sk, shift_sk, plant_sk, line_sk, machine_sk, alarm_sk, failure_mode_sk, operator_sk, event_type FROM f_op")
def fact_operational(spark, sf):
    return fact(spark, sf, "operational").select("event_id", "date_sk", "shift_sk", "plant_sk", "line_sk", "machine_sk", "alarm_sk", "failure_mode_sk", "operator_sk", "event_type")


@query(f"WITH {FACTS} SELECT event_id, date_sk, shift_sk, plant_sk, line_sk, machine_sk, product_sk, event_type, actual_quantity, good_quantity FROM f_prod")
def fact_production(spark, sf):
    return fact(spark, sf, "production").select("event_id", "date_sk", "shift_sk", "plant_sk", "line_sk", "machine_sk", "product_sk", "event_type", "actual_quantity", "good_quantity")


@query(f"WITH {FACTS} SELECT event_id, date_sk, shift_sk, plant_sk, line_sk, machine_sk, product_sk, loss_category, loss_reason_code, coalesce(loss_quantity, 0) AS loss_quantity, loss_duration_seconds, event_us FROM f_prod WHERE event_type = 'ProductionLossRecorded'")
def fact_production_loss(spark, sf):
    return gold.fact_loss(fact(spark, sf, "production"))


def _category(state: str, planned: str) -> str:
    return f"CASE WHEN {planned} AND {state} = 'MAINTENANCE' THEN 'PLANNED_MAINTENANCE' WHEN {planned} AND {state} = 'SETUP' THEN 'PLANNED_SETUP' WHEN {planned} AND {state} = 'IDLE' THEN 'PLANNED_IDLE' WHEN {state} <> 'IDLE' THEN 'UNPLANNED_' || {state} ELSE 'IDLE_NO_DEMAND' END"


#: Every state change that the window sees, with the last one before it; intervals; their pieces by shift.
DOWNTIME = f"""{FACTS}, sc AS (SELECT * FROM f_op WHERE event_type = 'StateChanged'), cand AS (SELECT * FROM sc WHERE event_us >= {START} AND event_us < {END} UNION ALL SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY machine_sk ORDER BY event_us DESC, generation_sequence DESC, event_id DESC) AS r FROM sc WHERE event_us < {START}) WHERE r = 1),
span AS (SELECT *, lead(event_id) OVER w AS end_event_id, lead(event_us) OVER w AS end_us FROM cand WINDOW w AS (PARTITION BY machine_sk ORDER BY event_us, generation_sequence, event_id)), iv AS (SELECT *, greatest(event_us, {START}) AS a, least(end_us, {END}) AS b FROM span WHERE end_us > event_us AND end_us > {START} AND new_state IN ({STOPPED})),
sh AS (SELECT range AS s FROM range({START} // 28800000000 - 2, {END} // 28800000000 + 3)),
f_down AS (SELECT event_id AS start_event_id, end_event_id, CAST(strftime(DATE '1970-01-01' + CAST(s // 3 AS INT), '%Y%m%d') AS INTEGER) AS date_sk, CAST(s % 3 + 1 AS INTEGER) AS shift_sk, plant_sk, line_sk, machine_sk, new_state AS state_code, {_category('new_state', 'coalesce(is_planned, false)')} AS downtime_category, coalesce(is_planned, false) AS is_planned, greatest(a, s * 28800000000 + 1800000000) AS interval_start_us, least(b, (s + 1) * 28800000000 + 1800000000) AS interval_end_us FROM iv JOIN sh ON a < (s + 1) * 28800000000 + 1800000000 AND b > s * 28800000000 + 1800000000),
f_dt AS (SELECT *, round((interval_end_us - interval_start_us) / 1000000.0, 3) AS duration_seconds FROM f_down)"""


def downtime_facts(spark, sf):
    changes = fact(spark, sf, "operational", None, END).where("event_type = 'StateChanged'")
    return gold.fact_downtime(changes, START, END)


@query(f"WITH {DOWNTIME} SELECT * FROM f_dt")
def fact_downtime(spark, sf):
    return downtime_facts(spark, sf)


MAINTAIN = "SELECT 'MNT-' || n AS event_id, plant_id, line_id, machine_id, event_us, 'WO-' || n AS work_order_id, CASE WHEN n % 6 > 0 THEN 'TEC-' || (n % 10) END AS technician_id, failure_mode_code, 'SPR-' || (n % 12) AS spare_part_id, 'DEF-' || (n % 9) AS defect_code, CAST(n % 8 AS DOUBLE) AS quantity_consumed, CAST(n % 50 AS DOUBLE) AS measurement_value, CASE WHEN n % 3 = 0 THEN 'SCRAP' ELSE 'ACCEPT' END AS disposition, CAST(make_timestamp(event_us) AS DATE) AS d FROM acc WHERE event_type = 'MachineFaulted'"


def maintenance_events(spark, sf):
    """Events of work on machines: one for each fault, with a technician and a part; findings of quality likewise."""
    rows = plant.domain(spark, sf, "operational").where("event_type = 'MachineFaulted'").withColumn("n", F.substring("event_id", 5, 20).cast("long"))
    return rows.selectExpr("'MNT-' || n AS event_id", "plant_id", "line_id", "machine_id", "event_time", "'WO-' || n AS work_order_id", "CASE WHEN n % 6 > 0 THEN 'TEC-' || (n % 10) END AS technician_id", "failure_mode_code", "'SPR-' || (n % 12) AS spare_part_id", "'DEF-' || (n % 9) AS defect_code", "CAST(n % 8 AS DOUBLE) AS quantity_consumed", "CAST(n % 50 AS DOUBLE) AS measurement_value", "CASE WHEN n % 3 = 0 THEN 'SCRAP' ELSE 'ACCEPT' END AS disposition")


_BY_CODES = f"""FROM s JOIN d_plant p ON p.plant_id = s.plant_id AND {plant._VALID.format('p')} LEFT JOIN d_line l ON l.line_id = s.line_id AND {plant._VALID.format('l')} LEFT JOIN d_machine m ON m.machine_id = s.machine_id AND {plant._VALID.format('m')}"""


@query(f"WITH {ACCEPTED}, {DIMS}, s AS ({MAINTAIN}) SELECT event_id, {plant._KEYED}, p.plant_sk, coalesce(l.line_sk, 0) AS line_sk, coalesce(m.machine_sk, 0) AS machine_sk, work_order_id, coalesce(t.technician_sk, 0) AS technician_sk, coalesce(f.failure_mode_sk, 0) AS failure_mode_sk, coalesce(x.spare_part_sk, 0) AS spare_part_sk, quantity_consumed {_BY_CODES} LEFT JOIN d_technician t USING (technician_id) LEFT JOIN d_failure f USING (failure_mode_code) LEFT JOIN d_spare_part x ON x.part_id = s.spare_part_id")
def fact_maintenance(spark, sf):
    d = _dims(spark)
    rows = gold.fact_by_codes(maintenance_events(spark, sf), d["plant"], d["line"], d["machine"], [(d["technician"], "technician_id", "technician_id", "technician_sk"), (d["failure"], "failure_mode_code", "failure_mode_code", "failure_mode_sk"), (d["spare_part"], "spare_part_id", "part_id", "spare_part_sk")])
    return rows.select("event_id", "date_sk", "shift_sk", "plant_sk", "line_sk", "machine_sk", "work_order_id", "technician_sk", "failure_mode_sk", "spare_part_sk", "quantity_consumed")


@query(f"WITH {ACCEPTED}, {DIMS}, s AS ({MAINTAIN}) SELECT event_id, {plant._KEYED}, p.plant_sk, coalesce(l.line_sk, 0) AS line_sk, coalesce(m.machine_sk, 0) AS machine_sk, coalesce(q.quality_defect_sk, 0) AS quality_defect_sk, measurement_value, disposition {_BY_CODES} LEFT JOIN d_defect q USING (defect_code)")
def fact_quality(spark, sf):
    d = _dims(spark)
    rows = gold.fact_by_codes(maintenance_events(spark, sf), d["plant"], d["line"], d["machine"], [(d["defect"], "defect_code", "defect_code", "quality_defect_sk")])
    return rows.select("event_id", "date_sk", "shift_sk", "plant_sk", "line_sk", "machine_sk", "quality_defect_sk", "measurement_value", "disposition")


OEE = f"""{DOWNTIME}, scope AS (SELECT DISTINCT date_sk, shift_sk, plant_sk, line_sk, machine_sk FROM f_prod WHERE event_type = 'UnitProduced' AND event_us >= {START} AND event_us < {END} UNION SELECT DISTINCT date_sk, shift_sk, plant_sk, line_sk, machine_sk FROM f_dt),
pr AS (SELECT f.date_sk, f.shift_sk, f.plant_sk, f.line_sk, f.machine_sk, sum(coalesce(actual_quantity, 0)) AS total_quantity, sum(coalesce(good_quantity, 0)) AS good_quantity, sum(coalesce(rejected_quantity, 0)) AS rejected_quantity, sum(coalesce(actual_quantity, 0) * coalesce(standard_cycle_time_seconds, 0)) AS ideal FROM f_prod f LEFT JOIN d_product p ON p.product_sk = coalesce(f.product_sk, 0) WHERE event_type = 'UnitProduced' AND event_us >= {START} AND event_us < {END} GROUP BY 1, 2, 3, 4, 5),
dn AS (SELECT date_sk, shift_sk, plant_sk, line_sk, machine_sk, round(sum(CASE WHEN is_planned THEN duration_seconds ELSE 0 END), 3) AS planned, round(sum(CASE WHEN is_planned THEN 0 ELSE duration_seconds END), 3) AS unplanned FROM f_dt GROUP BY 1, 2, 3, 4, 5),
mt AS (SELECT s.*, coalesce(planned, 0) AS planned_stop_seconds, coalesce(unplanned, 0) AS downtime_seconds, coalesce(total_quantity, 0) AS total_quantity, coalesce(good_quantity, 0) AS good_quantity, coalesce(rejected_quantity, 0) AS rejected_quantity, coalesce(ideal, 0) AS ideal_production_seconds FROM scope s LEFT JOIN pr p ON s.date_sk = p.date_sk AND s.shift_sk = p.shift_sk AND s.plant_sk = p.plant_sk AND s.line_sk IS NOT DISTINCT FROM p.line_sk AND s.machine_sk IS NOT DISTINCT FROM p.machine_sk LEFT JOIN dn d ON s.date_sk = d.date_sk AND s.shift_sk = d.shift_sk AND s.plant_sk = d.plant_sk AND s.line_sk = d.line_sk AND s.machine_sk = d.machine_sk),
f_oee AS (SELECT *, greatest(28800 - planned_stop_seconds, 0) AS planned_production_seconds, greatest(28800 - planned_stop_seconds - downtime_seconds, 0) AS run_time_seconds, CASE WHEN 28800 - planned_stop_seconds > 0 THEN 100.0 * greatest(28800 - planned_stop_seconds - downtime_seconds, 0) / (28800 - planned_stop_seconds) END AS availability_pct, CASE WHEN 28800 - planned_stop_seconds - downtime_seconds > 0 THEN 100.0 * ideal_production_seconds / (28800 - planned_stop_seconds - downtime_seconds) END AS performance_pct, CASE WHEN total_quantity > 0 THEN 100.0 * good_quantity / total_quantity END AS quality_pct FROM mt),
o AS (SELECT *, availability_pct * performance_pct * quality_pct / 10000 AS oee_pct FROM f_oee)"""
PCT = ("availability_pct", "performance_pct", "quality_pct", "oee_pct")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in PCT)


def oee_facts(spark, sf):
    return gold.oee(fact(spark, sf, "production", START, END), downtime_facts(spark, sf), plant.dimension(spark, "product"))


@query(f"WITH {OEE} SELECT date_sk, shift_sk, plant_sk, line_sk, machine_sk, round(planned_production_seconds, 3) AS planned_production_seconds, round(run_time_seconds, 3) AS run_time_seconds, total_quantity, good_quantity, {ROUNDED} FROM o")
def fact_oee(spark, sf):
    return oee_facts(spark, sf).select("date_sk", "shift_sk", "plant_sk", "line_sk", "machine_sk", F.round("planned_production_seconds", 3).alias("planned_production_seconds"), F.round("run_time_seconds", 3).alias("run_time_seconds"), "total_quantity", "good_quantity", *_six(*PCT))


def _star(spark, rows, *names: str):
    """Rows with columns of the named dimensions."""
    columns = {"plant": ["plant_id"], "line": ["line_id"], "machine": ["machine_id", "machine_type_code"], "product": ["product_id"]}
    return gold.star(rows, [(plant.dimension(spark, n), plant.KEYS[n], columns[n]) for n in names])


SUMS = "sum(planned_production_seconds) AS pp, sum(run_time_seconds) AS rt, sum(total_quantity) AS tq, sum(good_quantity) AS gq, sum(ideal_production_seconds) AS ip"


@query(f"WITH {OEE}, g AS (SELECT date_sk, shift_sk, plant_id, line_id, {SUMS} FROM o JOIN d_plant USING (plant_sk) LEFT JOIN d_line l ON l.line_sk = coalesce(o.line_sk, 0) GROUP BY 1, 2, 3, 4), r AS (SELECT *, CASE WHEN pp > 0 THEN 100.0 * rt / pp END AS availability_pct, CASE WHEN rt > 0 THEN 100.0 * ip / rt END AS performance_pct, CASE WHEN tq > 0 THEN 100.0 * gq / tq END AS quality_pct FROM g) SELECT date_sk, shift_sk, plant_id, line_id, tq AS total_quantity, round(availability_pct, 6) AS availability_pct, round(performance_pct, 6) AS performance_pct, round(quality_pct, 6) AS quality_pct, round(availability_pct * performance_pct * quality_pct / 10000, 6) AS oee_pct FROM r")
def view_oee_daily(spark, sf):
    by = ["date_sk", "shift_sk", "plant_id", "line_id"]
    return gold.oee_summary(_star(spark, oee_facts(spark, sf), "plant", "line"), by).select(*by, "total_quantity", *_six(*PCT))


@query(f"WITH {OEE} SELECT date_sk, shift_sk, plant_id, line_id, machine_id, machine_type_code, {ROUNDED} FROM o JOIN d_plant p USING (plant_sk) LEFT JOIN d_line l ON l.line_sk = coalesce(o.line_sk, 0) LEFT JOIN d_machine m ON m.machine_sk = coalesce(o.machine_sk, 0)")
def view_oee_by_machine(spark, sf):
    return _star(spark, oee_facts(spark, sf), "plant", "line", "machine").select("date_sk", "shift_sk", "plant_id", "line_id", "machine_id", "machine_type_code", *_six(*PCT))


@query(f"WITH {FACTS} SELECT date_sk, shift_sk, p.plant_id, l.line_id, r.product_id, event_type, sum(coalesce(actual_quantity, 0)) AS actual_quantity, sum(coalesce(rejected_quantity, 0)) AS rejected_quantity, sum(coalesce(loss_quantity, 0)) AS loss_quantity, count(*) AS event_count FROM f_prod f JOIN d_plant p USING (plant_sk) LEFT JOIN d_line l ON l.line_sk = coalesce(f.line_sk, 0) LEFT JOIN d_product r ON r.product_sk = coalesce(f.product_sk, 0) GROUP BY 1, 2, 3, 4, 5, 6")
def view_production_daily(spark, sf):
    rows = fact(spark, sf, "production").drop("plant_id", "line_id", "product_id")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    by = ["date_sk", "shift_sk", "plant_sk", "line_sk", "product_sk", "event_type"]
    facts = rows.groupBy(*by).agg(total("actual_quantity"), total("rejected_quantity"), total("loss_quantity"), F.count("*").alias("event_count"))
    return _star(spark, facts, "plant", "line", "product").select("date_sk", "shift_sk", "plant_id", "line_id", "product_id", "event_type", "actual_quantity", "rejected_quantity", "loss_quantity", "event_count")


@query(f"WITH {DOWNTIME} SELECT date_sk, shift_sk, plant_id, line_id, machine_id, state_code, downtime_category, is_planned, round(sum(duration_seconds), 3) AS downtime_seconds, count(*) AS interval_count FROM f_dt JOIN d_plant p USING (plant_sk) JOIN d_line l USING (line_sk) JOIN d_machine m USING (machine_sk) GROUP BY ALL")
def view_downtime_daily(spark, sf):
    by = ["date_sk", "shift_sk", "plant_sk", "line_sk", "machine_sk", "state_code", "downtime_category", "is_planned"]
    sums = downtime_facts(spark, sf).groupBy(*by).agg(F.round(F.sum("duration_seconds"), 3).alias("downtime_seconds"), F.count("*").alias("interval_count"))
    rows = _star(spark, sums, "plant", "line", "machine")
    # Versions of a machine have keys of their own but one id, so their groups are added up.
    return rows.groupBy("date_sk", "shift_sk", "plant_id", "line_id", "machine_id", "state_code", "downtime_category", "is_planned").agg(F.round(F.sum("downtime_seconds"), 3).alias("downtime_seconds"), F.sum("interval_count").alias("interval_count"))


@query(f"WITH {FACTS} SELECT event_id, event_us, p.plant_id, l.line_id, m.machine_id, m.machine_type_code, operating_state, temperature_c, vibration_mm_s, power_kw FROM (SELECT * EXCLUDE (plant_id, line_id, machine_id), row_number() OVER (PARTITION BY machine_sk ORDER BY event_us DESC, generation_sequence DESC, event_id DESC) AS r FROM f_tel) JOIN d_plant p USING (plant_sk) JOIN d_line l USING (line_sk) JOIN d_machine m USING (machine_sk) WHERE r = 1")
def view_machine_health_latest(spark, sf):
    rows = keys.latest_by(fact(spark, sf, "telemetry").drop("plant_id", "line_id", "machine_id"), ["machine_sk"], ["event_us", "generation_sequence", "event_id"])
    return _star(spark, rows, "plant", "line", "machine").select("event_id", "event_us", "plant_id", "line_id", "machine_id", "machine_type_code", "operating_state", "temperature_c", "vibration_mm_s", "power_kw")


@query(f"WITH {FACTS} SELECT event_id, date_sk, shift_sk, p.plant_id, l.line_id, m.machine_id, event_type, severity, fault_code, fm.failure_mode_code, failure_name, ac.alarm_code, alarm_name, is_planned, work_order_id FROM (SELECT * EXCLUDE (plant_id, line_id, machine_id, alarm_code, failure_mode_code) FROM f_op) f JOIN d_plant p USING (plant_sk) JOIN d_line l USING (line_sk) JOIN d_machine m USING (machine_sk) LEFT JOIN d_failure fm USING (failure_mode_sk) LEFT JOIN d_alarm ac USING (alarm_sk) WHERE event_type IN ('AlarmRaised', 'MachineFaulted', 'CommunicationLost')")
def view_operational_incidents(spark, sf):
    rows = fact(spark, sf, "operational").where(F.col("event_type").isin("AlarmRaised", "MachineFaulted", "CommunicationLost")).drop("plant_id", "line_id", "machine_id", "alarm_code", "failure_mode_code")
    rows = gold.star(_star(spark, rows, "plant", "line", "machine"), [(plant.dimension(spark, "failure"), "failure_mode_sk", ["failure_mode_code", "failure_name"]), (plant.dimension(spark, "alarm"), "alarm_sk", ["alarm_code", "alarm_name"])])
    return rows.select("event_id", "date_sk", "shift_sk", "plant_id", "line_id", "machine_id", "event_type", "severity", "fault_code", "failure_mode_code", "failure_name", "alarm_code", "alarm_name", "is_planned", "work_order_id")


RISK = f"risk AS (SELECT machine_sk, event_us AS feature_us, event_us + 1000 AS scored_us, round(least(1, (coalesce(vibration_mm_s, 0) * 10 + generation_sequence % 17) / 110), 6) AS failure_risk_score FROM f_tel), banded AS (SELECT *, CASE WHEN failure_risk_score >= 0.8 THEN 'CRITICAL' WHEN failure_risk_score >= 0.6 THEN 'HIGH' WHEN failure_risk_score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM risk)"


def risk(spark, sf):
    from millrace.functions.columns import band, clamp

    rows = fact(spark, sf, "telemetry")
    score = F.round(clamp((F.coalesce("vibration_mm_s", F.lit(0.0)) * 10 + F.col("generation_sequence") % 17) / 110, 0.0, 1.0), 6)
    rows = rows.select("machine_sk", F.col("event_us").alias("feature_us"), (F.col("event_us") + 1000).alias("scored_us"), score.alias("failure_risk_score"))
    return rows.withColumn("risk_band", band(F.col("failure_risk_score"), [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.35, "MEDIUM")], "LOW"))


@query(f"WITH {FACTS}, {RISK} SELECT machine_id, feature_us, failure_risk_score, risk_band FROM banded JOIN d_machine USING (machine_sk)")
def view_failure_risk_history(spark, sf):
    return _star(spark, risk(spark, sf), "machine").select("machine_id", "feature_us", "failure_risk_score", "risk_band")


@query(f"WITH {FACTS}, {RISK}, t AS (SELECT * EXCLUDE (plant_id, line_id, machine_id) FROM f_tel QUALIFY row_number() OVER (PARTITION BY machine_sk ORDER BY event_us DESC, event_id DESC) = 1), r AS (SELECT * FROM banded WHERE machine_sk % 4 > 0 QUALIFY row_number() OVER (PARTITION BY machine_sk ORDER BY feature_us DESC, scored_us DESC, failure_risk_score DESC) = 1) SELECT m.machine_id, l.line_id, p.plant_id, event_us, operating_state, temperature_c, failure_risk_score, risk_band FROM t JOIN d_machine m USING (machine_sk) JOIN d_line l ON l.line_sk = t.line_sk JOIN d_plant p ON p.plant_sk = t.plant_sk LEFT JOIN r ON r.machine_sk = t.machine_sk")
def context_machine_latest(spark, sf):
    last = keys.latest_by(fact(spark, sf, "telemetry").drop("plant_id", "line_id", "machine_id"), ["machine_sk"], ["event_us", "event_id"])
    scores = keys.latest_by(risk(spark, sf).where("machine_sk % 4 > 0"), ["machine_sk"], ["feature_us", "scored_us", "failure_risk_score"]).select("machine_sk", "failure_risk_score", "risk_band")
    return _star(spark, last, "plant", "line", "machine").join(scores, "machine_sk", "left").select("machine_id", "line_id", "plant_id", "event_us", "operating_state", "temperature_c", "failure_risk_score", "risk_band")


@query(f"WITH {FACTS} SELECT m.machine_id, p.plant_id, l.line_id, event_id, event_type, event_us, severity, alarm_sk, failure_mode_sk, fault_code FROM (SELECT * EXCLUDE (plant_id, line_id, machine_id) FROM f_op) t JOIN d_machine m ON m.machine_sk = t.machine_sk JOIN d_line l ON l.line_sk = t.line_sk JOIN d_plant p ON p.plant_sk = t.plant_sk")
def context_incidents(spark, sf):
    rows = fact(spark, sf, "operational").drop("plant_id", "line_id", "machine_id")
    return _star(spark, rows, "plant", "line", "machine").select("machine_id", "plant_id", "line_id", "event_id", "event_type", "event_us", "severity", "alarm_sk", "failure_mode_sk", "fault_code")


@query(f"WITH {DOWNTIME}, {RISK} SELECT (SELECT count(*) FROM f_tel WHERE event_us >= {START} AND event_us < {END}) AS fact_telemetry_rows, (SELECT count(*) FROM f_op WHERE event_us >= {START} AND event_us < {END}) AS fact_operational_rows, (SELECT count(*) FROM f_prod WHERE event_us >= {START} AND event_us < {END}) AS fact_production_rows, (SELECT count(*) FROM f_dt) AS fact_downtime_rows, (SELECT count(*) FROM f_prod WHERE event_type = 'ProductionLossRecorded' AND event_us >= {START} AND event_us < {END}) AS fact_loss_rows, '2024-01-03' AS business_date_start, '2024-01-19' AS business_date_end")
def gold_refresh_audit(spark, sf):
    rows = {n: plant.domain(spark, sf, n) for n in ("telemetry", "operational", "production")}
    return gold.refresh(rows, _dims(spark), START, END)["audit"].drop("fact_oee_rows")


# ---- features and labels ---------------------------------------------------------------------------------------------
CODES = {"CNC": 1, "ROB": 2, "HPR": 3}
_END5 = f"(event_us // {5 * MINUTE} + 1) * {5 * MINUTE}"
FEATURES = f"""{ACCEPTED}, mm2 AS ({plant._table('machine', False)}), tel AS (SELECT machine_id, line_id, event_us, event_id, operating_state, machine_type, coalesce(temperature_c, motor_temperature_c, equipment_temperature_c) AS temperature_c, vibration_mm_s, coalesce(pressure_bar, hydraulic_pressure_bar) AS pressure_bar, power_kw, quality_score_pct, {_END5} AS feature_us FROM acc WHERE event_type = 'MachineTelemetry'),
bt AS (SELECT * FROM tel QUALIFY row_number() OVER (PARTITION BY machine_id, feature_us ORDER BY event_us DESC, event_id DESC) = 1),
bo AS (SELECT machine_id, {_END5} AS feature_us, count(*) FILTER (event_type = 'AlarmRaised') AS alarm_count, count(*) FILTER (event_type = 'MachineFaulted') AS fault_count, count(*) FILTER (event_type = 'CommunicationLost') AS communication_loss_count FROM acc WHERE event_type IN ({plant.OPERATIONAL}) GROUP BY 1, 2),
bl AS (SELECT line_id, {_END5} AS feature_us, sum(coalesce(actual_quantity, 0)) AS qa, sum(coalesce(loss_quantity, 0)) AS ql FROM acc WHERE event_type IN ({plant.PRODUCTION_TYPES}) AND line_id IS NOT NULL GROUP BY 1, 2),
fe AS (SELECT bt.*, coalesce(alarm_count, 0) AS alarm_count, coalesce(fault_count, 0) AS fault_count, coalesce(communication_loss_count, 0) AS communication_loss_count FROM bt LEFT JOIN bo USING (machine_id, feature_us))"""


def built(spark, sf):
    us = F.unix_micros("event_time")
    t, o, p = (plant.domain(spark, sf, n).withColumn("event_us", us) for n in ("telemetry", "operational", "production"))
    return features.build(t, o, p, plant.master(spark, "machine"), CODES, "v1")


_W = {"15m": 15 * MINUTE, "60m": HOUR}
_STATS = ", ".join(f"round(avg({s}) OVER w{n}, 4) AS {s}_mean_{n}, round(stddev_pop({s}) OVER w{n}, 4) AS {s}_std_{n}, round({s} - first_value({s} IGNORE NULLS) OVER w{n}, 4) AS {s}_delta_{n}" for n in _W for s in features.ROLLING)
_LINES = ", ".join(f"coalesce((SELECT sum(q{k[0]}) FROM bl WHERE bl.line_id = f.line_id AND bl.feature_us BETWEEN f.feature_us - {w} AND f.feature_us), 0) AS line_{k}_quantity_{n}" for n, w in _W.items() for k in ("actual", "loss"))
ROLLED = [f"{s}_{x}_{n}" for n in _W for s in features.ROLLING for x in ("mean", "std", "delta")]
LINED = [f"line_{k}_quantity_{n}" for n in _W for k in ("actual", "loss")]
COUNTED = ["alarm_count_15m", "alarm_count_60m", "communication_loss_count_60m", "fault_count_24h"]


@query(f"""WITH {FEATURES}, ro AS (SELECT *, {_STATS}, CAST(sum(alarm_count) OVER w15m AS BIGINT) AS alarm_count_15m, CAST(sum(alarm_count) OVER w60m AS BIGINT) AS alarm_count_60m, CAST(sum(communication_loss_count) OVER w60m AS BIGINT) AS communication_loss_count_60m, CAST(sum(fault_count) OVER w24 AS BIGINT) AS fault_count_24h, round(avg(CASE WHEN operating_state = 'RUNNING' THEN 1.0 ELSE 0.0 END) OVER w15m, 6) AS utilization_proxy_15m FROM fe
WINDOW w15m AS (PARTITION BY machine_id ORDER BY feature_us RANGE BETWEEN {15 * MINUTE} PRECEDING AND CURRENT ROW), w60m AS (PARTITION BY machine_id ORDER BY feature_us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW), w24 AS (PARTITION BY machine_id ORDER BY feature_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW))
SELECT f.machine_id, f.feature_us, f.temperature_c, f.pressure_bar, {', '.join(ROLLED + COUNTED)}, utilization_proxy_15m, {_LINES} FROM ro f""")
def ml_features_full(spark, sf):
    return built(spark, sf).select("machine_id", "feature_us", "temperature_c", "pressure_bar", *[F.round(c, 4).alias(c) for c in ROLLED], *COUNTED, F.round("utilization_proxy_15m", 6).alias("utilization_proxy_15m"), *LINED)


_HOUR5 = f"CAST((feature_us + {330 * MINUTE}) // {HOUR} % 24 AS INTEGER)"


@query(f"WITH {FEATURES} SELECT machine_id, feature_us, CASE WHEN {_HOUR5} BETWEEN 6 AND 13 THEN 1 WHEN {_HOUR5} BETWEEN 14 AND 21 THEN 2 ELSE 3 END AS shift_code, round(sin(2 * pi() * {_HOUR5} / 24), 6) AS hour_sin, round(cos(2 * pi() * {_HOUR5} / 24), 6) AS hour_cos, CASE machine_type WHEN 'CNC' THEN 1 WHEN 'ROB' THEN 2 WHEN 'HPR' THEN 3 END AS machine_type_code, CAST(datediff('day', installation_date, CAST(make_timestamp(feature_us) AS DATE)) AS DOUBLE) AS machine_age_days, sha256(machine_id || '|' || CAST(make_timestamp(feature_us) AS VARCHAR) || '|v1') AS feature_id FROM fe LEFT JOIN mm2 m USING (machine_id) WHERE m.machine_id IS NULL OR m.is_current")
def ml_feature_context(spark, sf):
    return built(spark, sf).select("machine_id", "feature_us", "shift_code", F.round("hour_sin", 6).alias("hour_sin"), F.round("hour_cos", 6).alias("hour_cos"), "machine_type_code", "machine_age_days", "feature_id")


LABELS = f"""{FEATURES}, fl AS (SELECT machine_id, event_us, event_id, failure_mode_code FROM acc WHERE event_type = 'MachineFaulted'),
lb AS (SELECT fe.machine_id, feature_us, min(fl.event_us) AS next_fault_us, arg_min(fl.event_id, fl.event_us) AS next_fault_event_id, arg_min(fl.failure_mode_code, fl.event_us) AS label_failure_mode_code FROM fe LEFT JOIN fl ON fl.machine_id = fe.machine_id AND fl.event_us > feature_us AND fl.event_us <= feature_us + {HOUR} GROUP BY 1, 2),
la AS (SELECT *, CASE WHEN next_fault_us IS NULL THEN 0 ELSE 1 END AS label_failure, NOT (next_fault_us IS NULL AND feature_us > max(feature_us) OVER (PARTITION BY machine_id) - {HOUR}) AS label_valid FROM lb)"""


def labelled(spark, sf):
    us = F.unix_micros("event_time")
    t, o = (plant.domain(spark, sf, n).withColumn("event_us", us) for n in ("telemetry", "operational"))
    base = features.bucket_telemetry(features.unified(t), tuple(features.SIGNALS)).withColumn("feature_id", F.concat_ws("|", "machine_id", F.col("feature_us").cast("string")))
    return base, features.causal_labels(base, o.where("event_type = 'MachineFaulted'").select("machine_id", "event_us", "event_id", "failure_mode_code"), "v1")


@query(f"WITH {LABELS} SELECT machine_id || '|' || feature_us AS feature_id, label_failure, label_valid, next_fault_event_id, next_fault_us, label_failure_mode_code, NOT label_valid AS right_censored FROM la")
def ml_labels_full(spark, sf):
    return labelled(spark, sf)[1].select("feature_id", "label_failure", "label_valid", "next_fault_event_id", "next_fault_us", "label_failure_mode_code", "right_censored")


@query(f"WITH {LABELS} SELECT machine_id || '|' || feature_us AS feature_id, label_failure FROM la JOIN fe USING (machine_id, feature_us) WHERE label_valid AND operating_state NOT IN ('FAULT', 'MAINTENANCE')")
def ml_training_rows(spark, sf):
    return features.training_rows(*labelled(spark, sf)).select("feature_id", "label_failure")


@query(f"WITH {LABELS}, s AS (SELECT label_failure, (feature_us // {5 * MINUTE} % 97) / 97.0 AS score FROM la WHERE label_valid), t AS (SELECT avg(CASE WHEN score >= 0.8 THEN 1.0 ELSE 0.0 END) AS critical_rate, avg((score - label_failure) * (score - label_failure)) AS brier, CAST(NULL AS DOUBLE) AS roc_auc FROM s) SELECT metric, round(value, 6) AS value, threshold, status FROM (SELECT 'critical_rate' AS metric, critical_rate AS value, 0.25::DOUBLE AS threshold, CASE WHEN critical_rate <= 0.25 THEN 'PASS' ELSE 'BREACH' END AS status FROM t UNION ALL SELECT 'brier', brier, 0.25, CASE WHEN brier <= 0.25 THEN 'PASS' ELSE 'BREACH' END FROM t UNION ALL SELECT 'roc_auc', NULL, 0.7, 'UNKNOWN' FROM t)")
def ml_monitoring_gates(spark, sf):
    return monitored(spark, sf).select("metric", F.round("value", 6).alias("value"), "threshold", "status")


def monitored(spark, sf):
    base, labels = labelled(spark, sf)
    scores = base.select("feature_id", (F.floor(F.col("feature_us") / (5 * MINUTE)) % 97 / 97.0).alias("score"))
    joined = learning.prediction_outcomes(scores, labels)
    m = joined.agg(F.avg((F.col("score") >= 0.8).cast("double")).alias("critical_rate"), F.avg(F.pow(F.col("score") - F.col("label_failure"), 2)).alias("brier"), F.lit(None).cast("double").alias("roc_auc"))
    return learning.gates(m, {"critical_rate": ("max", 0.25), "brier": ("max", 0.25), "roc_auc": ("min", 0.7)})


# ---- semantic model --------------------------------------------------------------------------------------------------
EDGES = [(f, f"{d}_sk", d, f"{d}_sk") for f in ("oee", "downtime", "telemetry", "operational", "production", "risk") for d in ("plant", "line", "machine", "date", "product") if not (f == "risk" and d != "machine") and (d != "product" or f == "production")]


def model(spark, sf, *facts: str) -> measures.Model:
    make = {"oee": lambda: oee_facts(spark, sf), "downtime": lambda: downtime_facts(spark, sf), "telemetry": lambda: fact(spark, sf, "telemetry"), "operational": lambda: fact(spark, sf, "operational"), "production": lambda: fact(spark, sf, "production"), "risk": lambda: risk(spark, sf), "model_health": lambda: monitored(spark, sf)}
    tables = {n: plant.dimension(spark, n) for n in ("plant", "line", "machine", "product")} | {"date": gold.date_dimension(spark, "2023-12-01", "2024-12-31")}
    return measures.Model(tables | {f: make[f]() for f in facts}, EDGES)


def _named(df, **names: str):
    return df.select(*[c for c in df.columns if c not in names.values()], *[F.round(f"`{old}`", 6).alias(new) for new, old in names.items()])


@query(f"WITH {OEE}, g AS (SELECT plant_id, {SUMS}, sum(rejected_quantity) AS rj FROM o JOIN d_plant USING (plant_sk) GROUP BY 1) SELECT plant_id, gq AS good_units, rj AS rejected_units, tq AS total_units, round(rt / pp, 6) AS availability, round(ip / rt, 6) AS performance, round(gq / tq, 6) AS quality, round(rt / pp * (ip / rt) * (gq / tq), 6) AS oee FROM g")
def measures_oee(spark, sf):
    names = {"good_units": "Good Units", "rejected_units": "Rejected Units", "total_units": "Total Units", "availability": "Availability %", "performance": "Performance %", "quality": "Quality %", "oee": "OEE %"}
    return _named(model(spark, sf, "oee").query("oee", list(names.values()), ["plant.plant_id"]), **names)


@query(f"WITH {OEE}, g AS (SELECT date_sk, {SUMS} FROM o GROUP BY 1), c AS (SELECT strptime(CAST(date_sk AS VARCHAR), '%Y%m%d')::DATE AS day, rt / pp * (ip / rt) * (gq / tq) AS oee, sum(rt) OVER w / sum(pp) OVER w * (sum(ip) OVER w / sum(rt) OVER w) * (sum(gq) OVER w / sum(tq) OVER w) AS ytd FROM g WINDOW w AS (PARTITION BY date_sk // 10000 ORDER BY date_sk)) SELECT CAST(c.day AS VARCHAR) AS calendar_date, round(c.oee, 6) AS oee, round(c.ytd, 6) AS oee_ytd, round(c.oee - p.oee, 6) AS oee_change FROM c LEFT JOIN c p ON c.day = p.day + 1")
def measures_oee_by_day(spark, sf):
    d = measures.oee_by_day(model(spark, sf, "oee"))
    return d.select(F.col("calendar_date").cast("string").alias("calendar_date"), *_six("oee", "oee_ytd", "oee_change"))


@query(f"WITH {DOWNTIME} SELECT machine_type_code, round(sum(duration_seconds) / 60, 6) AS downtime, round(sum(CASE WHEN NOT is_planned THEN duration_seconds END) / 60, 6) AS unplanned, round(sum(CASE WHEN is_planned THEN duration_seconds END) / 60, 6) AS planned, round(sum(CASE WHEN state_code = 'FAULT' THEN duration_seconds END) / 60, 6) AS fault FROM f_dt JOIN d_machine USING (machine_sk) GROUP BY 1")
def measures_downtime(spark, sf):
    names = {"downtime": "Downtime Minutes", "unplanned": "Unplanned Downtime Minutes", "planned": "Planned Downtime Minutes", "fault": "Fault Downtime Minutes"}
    return _named(model(spark, sf, "downtime").query("downtime", list(names.values()), ["machine.machine_type_code"]), **names)


@query(f"WITH {FACTS} SELECT r.product_id, sum(actual_quantity) AS actual, sum(good_quantity) AS good, sum(rejected_quantity) AS rejected, round(sum(good_quantity) / sum(actual_quantity), 6) AS yield FROM f_prod f JOIN d_product r ON r.product_sk = f.product_sk JOIN d_plant p USING (plant_sk) WHERE p.plant_id IN ('PLT-1', 'PLT-2') GROUP BY 1 UNION ALL SELECT NULL, sum(actual_quantity), sum(good_quantity), sum(rejected_quantity), round(sum(good_quantity) / sum(actual_quantity), 6) FROM f_prod f JOIN d_plant p USING (plant_sk) WHERE p.plant_id IN ('PLT-1', 'PLT-2') AND product_sk IS NULL HAVING count(*) > 0")
def measures_production(spark, sf):
    names = {"actual": "Actual Units", "good": "Good Units", "rejected": "Rejected Units", "yield": "Production Yield %"}
    return _named(model(spark, sf, "production").query("production", list(names.values()), ["product.product_id"], {"plant.plant_id": ["PLT-1", "PLT-2"]}), **names)


@query(f"WITH {FACTS} SELECT l.line_id, count(*) AS events, round(avg(vibration_mm_s), 6) AS vibration, round(avg(temperature_c), 6) AS temperature, round(avg(power_kw), 6) AS power FROM (SELECT * EXCLUDE (line_id) FROM f_tel) JOIN d_line l USING (line_sk) GROUP BY 1")
def measures_telemetry(spark, sf):
    names = {"events": "Telemetry Event Count", "vibration": "Average Vibration mm/s", "temperature": "Average Temperature C", "power": "Average Power kW"}
    return _named(model(spark, sf, "telemetry").query("telemetry", list(names.values()), ["line.line_id"]), **names)


@query(f"WITH {FACTS} SELECT p.plant_id, count(*) FILTER (event_type = 'AlarmRaised') AS alarms, count(*) FILTER (event_type = 'MachineFaulted') AS faults, count(*) FILTER (event_type = 'CommunicationLost') AS losses FROM (SELECT * EXCLUDE (plant_id) FROM f_op) JOIN d_plant p USING (plant_sk) GROUP BY 1")
def measures_operational(spark, sf):
    names = {"alarms": "Alarm Count", "faults": "Fault Count", "losses": "Communication Loss Count"}
    return _named(model(spark, sf, "operational").query("operational", list(names.values()), ["plant.plant_id"]), **names)


@query(f"WITH {FACTS}, {RISK} SELECT m.machine_type_code, count(DISTINCT machine_sk) FILTER (risk_band = 'CRITICAL') AS critical, count(DISTINCT machine_sk) FILTER (risk_band IN ('HIGH', 'CRITICAL')) AS high, round(avg(failure_risk_score), 6) AS average, round(arg_max(failure_risk_score, (feature_us, scored_us, failure_risk_score)), 6) AS latest FROM banded JOIN d_machine m USING (machine_sk) GROUP BY 1")
def measures_risk(spark, sf):
    names = {"critical": "Critical ML Risk Machines", "high": "High ML Risk Machines", "average": "Average Failure Risk %", "latest": "Latest Failure Risk %"}
    return _named(model(spark, sf, "risk").query("risk", list(names.values()), ["machine.machine_type_code"]), **names)


@query(f"WITH {LABELS}, s AS (SELECT label_failure, (feature_us // {5 * MINUTE} % 97) / 97.0 AS score FROM la WHERE label_valid) SELECT CAST(avg(CASE WHEN score >= 0.8 THEN 1.0 ELSE 0.0 END) > 0.25 AS BIGINT) + CAST(avg((score - label_failure) * (score - label_failure)) > 0.25 AS BIGINT) AS breaches FROM s")
def measures_model_health(spark, sf):
    return _named(model(spark, sf, "model_health").query("model_health", ["Model Health Breaches"]), breaches="Model Health Breaches")


# ---- real time -------------------------------------------------------------------------------------------------------
HOT = 3 * DAY
HOT_SQL = f"WITH {RAW}, now AS (SELECT max(us) AS t FROM e0), lt AS (SELECT * FROM raw WHERE event_type = 'MachineTelemetry' AND event_us IS NOT NULL AND machine_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY event_us DESC, n DESC) = 1), ci AS (SELECT raw.* FROM raw, now WHERE event_us >= t - {HOT} AND event_type IN ('AlarmRaised', 'MachineFaulted', 'CommunicationLost') AND (severity IN ('HIGH', 'CRITICAL') OR event_type IN ('MachineFaulted', 'CommunicationLost')))"


def hot_rows(spark, sf):
    """Raw events as the hot table has them, and the time of the newest."""
    rows = silver.payload_fields(plant.enveloped(spark, sf), {"severity": "string", "temperature_c": "double", "vibration_mm_s": "double", "loss_quantity": "double"}).withColumn("event_us", F.unix_micros("event_time"))
    newest = spark.read.parquet(f"{sf}/events.parquet").agg(F.max(micros(F.col("ts")))).first()[0]
    return rows.where("event_us is not null"), newest or 0


@query(f"{HOT_SQL} SELECT event_id, event_type, event_us, machine_id, severity FROM ci")
def hot_critical_incidents(spark, sf):
    from millrace.operators.realtime import critical_incidents

    rows, now = hot_rows(spark, sf)
    return critical_incidents(rows, now, HOT).select("event_id", "event_type", "event_us", "machine_id", "severity")


@query(f"""{HOT_SQL}, i AS (SELECT machine_id, count(*) AS critical_incident_count, count(*) FILTER (event_type = 'MachineFaulted') AS fault_count, count(*) FILTER (event_type = 'CommunicationLost') AS communication_loss_count FROM ci GROUP BY 1),
s AS (SELECT lt.machine_id, lt.event_us, coalesce(critical_incident_count, 0) AS critical_incident_count, coalesce(fault_count, 0) AS fault_count, coalesce(communication_loss_count, 0) AS communication_loss_count, CASE WHEN temperature_c >= 90 THEN 40 WHEN temperature_c >= 80 THEN 20 WHEN temperature_c >= 70 THEN 10 ELSE 0 END + CASE WHEN vibration_mm_s >= 8 THEN 40 WHEN vibration_mm_s >= 6 THEN 20 WHEN vibration_mm_s >= 4 THEN 10 ELSE 0 END AS heat FROM lt LEFT JOIN i USING (machine_id)),
r AS (SELECT *, CAST(least(100, heat + least(20, 5 * critical_incident_count) + least(30, 15 * fault_count) + least(10, 5 * communication_loss_count)) AS DOUBLE) AS machine_risk_score FROM s)
SELECT machine_id, event_us, critical_incident_count, fault_count, communication_loss_count, machine_risk_score, CASE WHEN machine_risk_score >= 80 THEN 'CRITICAL' WHEN machine_risk_score >= 60 THEN 'HIGH' WHEN machine_risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM r""")
def hot_machine_risk(spark, sf):
    from millrace.operators.realtime import critical_incidents, machine_risk

    rows, now = hot_rows(spark, sf)
    latest = keys.latest_by(rows.where("event_type = 'MachineTelemetry' and machine_id is not null"), ["machine_id"], ["event_us", "n"])
    return machine_risk(latest, critical_incidents(rows, now, HOT)).select("machine_id", "event_us", "critical_incident_count", "fault_count", "communication_loss_count", "machine_risk_score", "risk_band")
