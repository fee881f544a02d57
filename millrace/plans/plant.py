"""An industrial plant made from the driver's events: raw JSON lines, master tables and their SQL twins.

Each event becomes one line of the event contract. Users are machines, and remainders of the event number decide which
lines break which rule, so all rules have cases. The expressions are valid in Spark SQL and in DuckDB alike; Spark writes
them into JSON lines and the operators read them back, while SQL uses them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import gold, silver
from millrace.sources.scratch import cut

T = "et = 'view'"
O = "et in ('click', 'error', 'signup')"  # noqa: E741
P = "et = 'purchase'"
UNIT = f"{P} AND k % 10 > 1"
TYPE = "CASE m % 3 WHEN 0 THEN 'CNC' WHEN 1 THEN 'ROB' ELSE 'HPR' END"
STATES = "CASE {} % 9 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAULT' WHEN 2 THEN 'IDLE' WHEN 3 THEN 'MAINTENANCE' WHEN 4 THEN 'SETUP' WHEN 5 THEN 'OFFLINE' WHEN 6 THEN 'BLOCKED' WHEN 7 THEN 'STARVED' ELSE 'RECOVERY' END"


def _id(prefix: str, number: str) -> str:
    return f"'{prefix}' || CAST({number} AS STRING)"


#: Fields of the lines as expressions of n (number), us, u, et, v, k and m, l, p (machine, line, plant from 0).
FIELDS = {
    "event_type": "CASE et WHEN 'view' THEN 'MachineTelemetry' WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'AlarmRaised' ELSE 'AlarmCleared' END WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 'MachineFaulted' ELSE 'StateChanged' END WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'CommunicationLost' WHEN 1 THEN 'CommunicationRestored' ELSE 'StateChanged' END ELSE CASE k % 10 WHEN 0 THEN 'ProductionLossRecorded' WHEN 1 THEN 'ProductionOrderCreated' ELSE 'UnitProduced' END END",
    "event_id": f"CASE WHEN n % 997 = 5 THEN NULL ELSE {_id('EVT-', 'n')} END",
    "schema_version": "'1.0.0'",
    "source_system": "'PLANT'",
    "plant_id": f"CASE WHEN n % 503 = 3 THEN NULL WHEN n % 211 = 2 THEN 'PLT-99' WHEN n % 241 = 4 THEN {_id('PLT-', '(p + 1) % 3 + 1')} ELSE {_id('PLT-', 'p + 1')} END",
    "line_id": f"CASE WHEN n % 401 = 9 THEN NULL WHEN n % 227 = 1 THEN 'LIN-99' WHEN n % 229 = 6 THEN {_id('LIN-', '(l + 3) % 15 + 1')} ELSE {_id('LIN-', 'l + 1')} END",
    "machine_id": f"CASE WHEN n % 223 = 8 THEN 'MCH-999' WHEN {P} AND n % 7 = 0 THEN NULL ELSE {_id('MCH-', 'm + 1')} END",
    "simulator_run_id": "'RUN-1'",
    "generation_sequence": "n + 1",
    "correlation_id": _id("COR-", "n % 50"),
    "causation_id": f"CASE WHEN n % 5 = 0 THEN {_id('EVT-', 'n - 50')} WHEN n % 7 = 0 THEN {_id('EVT-', 'n + 3')} END",
    "scenario_id": "CASE WHEN n % 2 = 0 THEN 'SCN-1' END",
    "machine_type": f"CASE WHEN n % 239 = 11 THEN 'XXX' ELSE {TYPE} END",
    "operating_state": "CASE k % 4 WHEN 0 THEN 'FAULT' WHEN 1 THEN 'IDLE' ELSE 'RUNNING' END",
    "temperature_c": f"CASE WHEN {T} AND m % 3 = 0 THEN CAST(k AS DOUBLE) END",
    "motor_temperature_c": f"CASE WHEN {T} AND m % 3 = 1 THEN CAST(k AS DOUBLE) END",
    "equipment_temperature_c": f"CASE WHEN {T} AND m % 3 = 2 THEN CAST(k AS DOUBLE) END",
    "vibration_mm_s": f"CASE WHEN {T} AND k % 20 <> 0 THEN CAST(k AS DOUBLE) / 10 END",
    "pressure_bar": f"CASE WHEN {T} AND m % 3 = 0 THEN CAST(n % 16 AS DOUBLE) END",
    "hydraulic_pressure_bar": f"CASE WHEN {T} AND m % 3 = 2 THEN CAST(n % 32 AS DOUBLE) END",
    "power_kw": f"CASE WHEN {T} THEN CAST(n % 64 AS DOUBLE) * 0.25 END",
    "quality_score_pct": f"CASE WHEN {T} THEN CAST(k AS DOUBLE) END",
    "previous_state": f"CASE WHEN {O} THEN {STATES.format('n')} END",
    "new_state": f"CASE WHEN {O} THEN {STATES.format('(n + k % 3)')} END",
    "is_planned": f"CASE WHEN {O} THEN n % 4 = 0 END",
    "alarm_code": f"CASE WHEN et = 'click' THEN {_id('ALM-', 'k % 8')} END",
    "severity": f"CASE WHEN {O} THEN CASE n % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END END",
    "fault_code": f"CASE WHEN et = 'error' THEN {_id('FLT-', 'k % 4')} END",
    "failure_mode_code": f"CASE WHEN et = 'error' THEN {_id('FM-', 'k % 7')} END",
    "operator_id": f"CASE WHEN {O} AND n % 3 > 0 THEN {_id('OPR-', 'n % 12')} END",
    "work_order_id": f"CASE WHEN {O} AND n % 10 = 0 THEN {_id('WO-', 'n')} END",
    "production_order_id": f"CASE WHEN {P} THEN {_id('PO-', 'n % 40')} END",
    "product_id": f"CASE WHEN NOT ({P}) OR n % 9 = 0 THEN NULL WHEN n % 233 = 12 THEN 'PRD-99' ELSE {_id('PRD-', 'k % 12 + 1')} END",
    "actual_quantity": f"CASE WHEN {UNIT} THEN CASE WHEN n % 251 = 13 THEN -1.0 ELSE 10.0 + k % 5 END END",
    "good_quantity": f"CASE WHEN {UNIT} THEN CASE WHEN n % 257 = 14 THEN 100.0 ELSE 10.0 + k % 5 - k % 3 END END",
    "rejected_quantity": f"CASE WHEN {UNIT} THEN 0.0 + k % 3 END",
    "loss_quantity": f"CASE WHEN {P} AND k % 10 = 0 AND n % 3 > 0 THEN 0.0 + n % 20 END",
    "loss_category": f"CASE WHEN {P} AND k % 10 = 0 THEN CASE WHEN n % 2 = 0 THEN 'SCRAP' ELSE 'MATERIAL' END END",
    "loss_reason_code": f"CASE WHEN {P} AND k % 10 = 0 THEN {_id('RSN-', 'n % 5')} END",
    "loss_duration_seconds": f"CASE WHEN {P} AND k % 10 = 0 THEN 30.0 + n % 60 END",
}
DOUBLES = {n for n, kind in (silver.DOMAINS["telemetry"] | silver.DOMAINS["production"]).items() if kind == "double"}
FIELDS = {n: f"CAST({e} AS DOUBLE)" if n in DOUBLES else e for n, e in FIELDS.items()}
BAD_TIME = "n % 499 = 7"
LAG_US = "(100 + (n * 37) % 1401) * 1000"
#: Master tables: (rows from, to, expressions of i); machines have a second version for every tenth.
MACHINE = {"machine_sk": "i", "machine_id": _id("MCH-", "i"), "line_sk": "(i - 1) % 15 + 1", "machine_type_code": TYPE.replace("m", "(i - 1)", 1), "installation_date": "CAST('2022-01-01' AS DATE) + CAST(i AS INT)", "effective_from": "CAST('2020-01-01' AS DATE)", "effective_to": "CASE WHEN i % 10 = 0 THEN CAST('2024-01-14' AS DATE) END", "is_current": "i % 10 <> 0"}
LATER = MACHINE | {"machine_sk": "i + 100", "line_sk": "(i + 2) % 15 + 1", "effective_from": "CAST('2024-01-15' AS DATE)", "effective_to": "CAST(NULL AS DATE)", "is_current": "true"}
OPEN = {"effective_from": "CAST('2020-01-01' AS DATE)", "effective_to": "CAST(NULL AS DATE)"}
MASTERS = {
    "plant": (1, 4, {"plant_sk": "i", "plant_id": _id("PLT-", "i"), "plant_name": _id("Plant ", "i")} | OPEN),
    "line": (1, 16, {"line_sk": "i", "line_id": _id("LIN-", "i"), "line_name": _id("Line ", "i"), "plant_sk": "(i - 1) % 3 + 1"} | OPEN),
    "product": (1, 13, {"product_sk": "i", "product_id": _id("PRD-", "i"), "product_name": _id("Product ", "i"), "standard_cycle_time_seconds": "CAST(20 + i AS DOUBLE)"} | OPEN),
    "alarm": (1, 7, {"alarm_sk": "i", "alarm_code": _id("ALM-", "i"), "alarm_name": _id("Alarm ", "i")}),
    "failure": (1, 6, {"failure_mode_sk": "i", "failure_mode_code": _id("FM-", "i"), "failure_name": _id("Failure ", "i")}),
    "operator": (1, 11, {"operator_sk": "i", "operator_id": _id("OPR-", "i")} | OPEN),
    "technician": (1, 9, {"technician_sk": "i", "technician_id": _id("TEC-", "i")} | OPEN),
    "spare_part": (1, 11, {"spare_part_sk": "i", "part_id": _id("SPR-", "i")} | OPEN),
    "defect": (1, 8, {"quality_defect_sk": "i", "defect_code": _id("DEF-", "i")}),
}
KEYS = {"plant": "plant_sk", "line": "line_sk", "machine": "machine_sk", "product": "product_sk", "alarm": "alarm_sk", "failure": "failure_mode_sk", "operator": "operator_sk", "technician": "technician_sk", "spare_part": "spare_part_sk", "defect": "quality_defect_sk"}


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e.select(F.col("event_id").alias("n"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts", F.col("user_id").alias("u"), F.col("event_type").alias("et"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.selectExpr("*", "u % 60 AS m", "u % 60 % 15 AS l", "u % 60 % 15 % 3 AS p")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(n, value): the raw lines, and the number that a line came from, for tests of what becomes of it."""
    text = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    times = [f"CASE WHEN {BAD_TIME} THEN 'no time' ELSE {text.format('ts')} END AS event_time", f"{text.format(f'timestamp_micros(us + {LAG_US})')} AS ingestion_time"]
    rows = numbered(spark, sf).selectExpr("n", *times, *[f"{e} AS {n}" for n, e in FIELDS.items()])
    return rows.select("n", F.to_json(F.struct(*rows.columns[1:])).alias("value"))


def master(spark: SparkSession, name: str) -> DataFrame:
    """A master table without the unknown row."""
    if name == "machine":
        rows = spark.range(1, 61).toDF("i")
        return rows.selectExpr(*[f"{e} AS {n}" for n, e in MACHINE.items()]).unionByName(rows.where("i % 10 = 0").selectExpr(*[f"{e} AS {n}" for n, e in LATER.items()]))
    a, b, columns = MASTERS[name]
    return spark.range(a, b).toDF("i").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


UNKNOWN_TEXT = {"plant_id", "line_id", "machine_id", "product_id", "alarm_code", "failure_mode_code", "operator_id", "technician_id", "part_id", "defect_code"}


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """A master table with its unknown row."""
    dim = master(spark, name)
    values: dict[str, object] = {c: "UNKNOWN" for c in dim.columns if c in UNKNOWN_TEXT}
    if "effective_from" in dim.columns:
        values["effective_from"] = "1900-01-01"
    return gold.with_unknown(dim, KEYS[name], **values)


def enveloped(spark: SparkSession, sf: str) -> DataFrame:
    return silver.envelope(lines(spark, sf))


def gated(spark: SparkSession, sf: str) -> DataFrame:
    rows = silver.enrich_master_keys(enveloped(spark, sf), *[master(spark, n) for n in ("machine", "line", "plant", "product")])
    return silver.quality_gate(rows)


_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rows with the columns of the envelope: the silver table, which a session writes once for each folder, as
    facts, features and measures all read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        _WRITTEN[key] = cut(gated(spark, sf).where("rejection_code is null").select("n", "payload", "payload_sha256", *silver.ENVELOPE, "event_date"))
    return _WRITTEN[key]


def domain(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return silver.domain(accepted(spark, sf), name)


# ---- the same in SQL -------------------------------------------------------------------------------------------------
def _table(name: str, unknown: bool) -> str:
    a, b, columns = (1, 61, MACHINE) if name == "machine" else MASTERS[name]
    select = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM range({a}, {b}) t(i)"
    if name == "machine":
        select += " UNION ALL SELECT " + ", ".join(f"{e} AS {n}" for n, e in LATER.items()) + " FROM range(1, 61) t(i) WHERE i % 10 = 0"
    if unknown:
        select += " UNION ALL SELECT " + ", ".join("0" if n == KEYS[name] else "'UNKNOWN'" if n in UNKNOWN_TEXT else "DATE '1900-01-01'" if n == "effective_from" else "NULL" for n in columns)
    return select


E0 = "e0 AS (SELECT event_id AS n, epoch_us(ts) AS us, user_id AS u, event_type AS et, value AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 60 AS m, user_id % 60 % 15 AS l, user_id % 60 % 15 % 3 AS p FROM events)"
RAW = f"{E0}, raw AS (SELECT n, CASE WHEN {BAD_TIME} THEN NULL ELSE us END AS event_us, us + {LAG_US} AS ingestion_us, " + ", ".join(f"{e} AS {n}" for n, e in FIELDS.items()) + " FROM e0), timed AS (SELECT *, CAST(make_timestamp(event_us) AS DATE) AS d FROM raw)"
_VALID = "{0}.effective_from <= d AND ({0}.effective_to IS NULL OR d <= {0}.effective_to)"
ENRICHED = f"""{RAW}, mm AS ({_table('machine', False)}), ml AS ({_table('line', False)}), mp AS ({_table('plant', False)}), mr AS ({_table('product', False)}),
enr AS (SELECT timed.*, mm.machine_sk, mm.line_sk AS machine_line_sk, mm.machine_type_code, ml.line_sk, ml.plant_sk AS line_plant_sk, mp.plant_sk, mr.product_sk FROM timed LEFT JOIN mm ON timed.machine_id = mm.machine_id AND {_VALID.format('mm')} LEFT JOIN ml ON timed.line_id = ml.line_id AND {_VALID.format('ml')} LEFT JOIN mp ON timed.plant_id = mp.plant_id AND {_VALID.format('mp')} LEFT JOIN mr ON timed.product_id = mr.product_id AND {_VALID.format('mr')})"""
GATE = f"""{ENRICHED}, gate AS (SELECT *, CASE WHEN event_id IS NULL THEN 'MISSING_EVENT_ID' WHEN event_us IS NULL THEN 'INVALID_EVENT_TIME' WHEN plant_id IS NULL THEN 'MISSING_PLANT_ID' WHEN plant_sk IS NULL THEN 'PLANT_MASTER_NOT_FOUND'
WHEN machine_id IS NOT NULL AND machine_sk IS NULL THEN 'MACHINE_MASTER_NOT_FOUND' WHEN line_id IS NOT NULL AND line_sk IS NULL THEN 'LINE_MASTER_NOT_FOUND' WHEN product_id IS NOT NULL AND product_sk IS NULL THEN 'PRODUCT_MASTER_NOT_FOUND'
WHEN machine_line_sk <> line_sk THEN 'MACHINE_LINE_MISMATCH' WHEN machine_type <> machine_type_code THEN 'MACHINE_TYPE_MISMATCH' WHEN line_plant_sk <> plant_sk THEN 'LINE_PLANT_MISMATCH'
WHEN actual_quantity < 0 OR (actual_quantity IS NOT NULL AND (good_quantity < 0 OR rejected_quantity < 0)) THEN 'NEGATIVE_PRODUCTION_QUANTITY' WHEN good_quantity + rejected_quantity > actual_quantity THEN 'PRODUCTION_QUANTITY_INCONSISTENCY' END AS rejection_code FROM enr)"""
ACCEPTED = f"{GATE}, acc AS (SELECT timed.* FROM timed JOIN gate USING (n) WHERE rejection_code IS NULL)"
_SHIFTED = "(event_us - 1800000000) // 28800000000"
DIMS = ", ".join(f"d_{n} AS ({_table(n, True)})" for n in KEYS)
_KEYED = f"CAST(strftime(DATE '1970-01-01' + CAST({_SHIFTED} // 3 AS INT), '%Y%m%d') AS INTEGER) AS date_sk, CAST({_SHIFTED} % 3 + 1 AS INTEGER) AS shift_sk"
OPERATIONAL = ", ".join(f"'{t}'" for t in silver.OPERATIONAL)
PRODUCTION_TYPES = "'ProductionLossRecorded', 'ProductionOrderCreated', 'UnitProduced'"
FACTS = f"""{ACCEPTED}, {DIMS},
f_tel AS (SELECT s.*, {_KEYED}, m.machine_sk, m.line_sk, l.plant_sk FROM acc s JOIN d_machine m ON m.machine_id = s.machine_id AND {_VALID.format('m')} JOIN d_line l ON l.line_sk = m.line_sk AND {_VALID.format('l')} WHERE event_type = 'MachineTelemetry'),
f_op AS (SELECT s.*, {_KEYED}, m.machine_sk, m.line_sk, l.plant_sk, coalesce(a.alarm_sk, 0) AS alarm_sk, coalesce(f.failure_mode_sk, 0) AS failure_mode_sk, coalesce(o.operator_sk, 0) AS operator_sk FROM acc s JOIN d_machine m ON m.machine_id = s.machine_id AND {_VALID.format('m')} JOIN d_line l ON l.line_sk = m.line_sk AND {_VALID.format('l')}
LEFT JOIN d_alarm a ON a.alarm_code = s.alarm_code LEFT JOIN d_failure f ON f.failure_mode_code = s.failure_mode_code LEFT JOIN d_operator o ON o.operator_id = s.operator_id AND {_VALID.format('o')} WHERE event_type IN ({OPERATIONAL})),
f_prod AS (SELECT s.*, {_KEYED}, p.plant_sk, l.line_sk, m.machine_sk, r.product_sk FROM acc s JOIN d_plant p ON p.plant_id = s.plant_id AND {_VALID.format('p')} LEFT JOIN d_line l ON l.line_id = coalesce(s.line_id, 'UNKNOWN') AND {_VALID.format('l')} LEFT JOIN d_machine m ON m.machine_id = coalesce(s.machine_id, 'UNKNOWN') AND {_VALID.format('m')} LEFT JOIN d_product r ON r.product_id = coalesce(s.product_id, 'UNKNOWN') AND {_VALID.format('r')} WHERE event_type IN ({PRODUCTION_TYPES}))"""
