"""From raw event lines to accepted rows: envelope, master keys, the quality gate, lineage checks and the three domains.

Event times are timestamps; a line is parsed once, into a struct of texts, and each field is cast where it is used, so a
field of a wrong type is null and never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import all_matches, first_match
from millrace.operators.temporal import scd2_join
from millrace.sources.files import PRODUCTION
from millrace.sources.scratch import cut

#: Names of the event contract.
OPERATIONAL = ("MachineStarted", "MachineStopped", "StateChanged", "AlarmRaised", "AlarmCleared", "MachineFaulted", "MachineRecovered", "CommunicationLost", "CommunicationRestored")
#: Telemetry signals, numbers that may be absent.
SIGNALS = (
    "temperature_c", "vibration_mm_s", "pressure_bar", "spindle_rpm", "power_kw", "production_rate_unit_min", "quality_score_pct", "feed_rate_mm_min", "hydraulic_pressure_bar", "force_kn",
    "cycle_time_s", "motor_temperature_c", "torque_nm", "position_error_mm", "motor_current_a", "belt_speed_m_s", "discharge_pressure_bar", "rpm", "chamber_temperature_c", "fuel_flow_rate",
    "pressure_mbar", "inspection_cycle_time_s", "measurement_deviation_mm", "defect_probability_pct", "equipment_temperature_c", "throughput_unit_min",
)
#: Fields of each domain beside the common ones, with their types.
DOMAINS = {
    "telemetry": {"machine_type": "string", "operating_state": "string"} | dict.fromkeys(SIGNALS, "double"),
    "operational": dict.fromkeys(("machine_type", "operating_state", "previous_state", "new_state", "alarm_code", "severity", "fault_code", "failure_mode_code", "operator_id", "work_order_id"), "string") | {"is_planned": "boolean", "estimated_duration_seconds": "double", "communication_gap_seconds": "double"},
    "production": dict.fromkeys(("production_order_id", "batch_id", "product_id", "operation_id"), "string") | {"production_sequence": "long"} | dict.fromkeys(("planned_quantity", "actual_quantity", "good_quantity", "rejected_quantity"), "double") | dict.fromkeys(("quantity_uom", "pause_reason_code", "loss_reason_code", "loss_category"), "string") | dict.fromkeys(("loss_quantity", "loss_duration_seconds"), "double") | dict.fromkeys(("downtime_event_id", "machine_fault_event_id"), "string"),
}
ENVELOPE = {"event_id": "string", "event_type": "string", "schema_version": "string", "event_time": "timestamp", "ingestion_time": "timestamp", "source_system": "string", "plant_id": "string", "line_id": "string", "machine_id": "string", "simulator_run_id": "string", "generation_sequence": "long"}
LINEAGE = {"correlation_id": "string", "causation_id": "string", "scenario_id": "string", "scenario_instance_id": "string"}


def typed(text: Column, kind: str) -> Column:
    """A text as a value of a type; what isn't one is null."""
    return F.try_to_timestamp(text) if kind == "timestamp" else text if kind == "string" else text.try_cast(kind)


def envelope(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines with the eleven fields of the envelope, payload, payload_sha256 and event_date. Other columns stay."""
    names = list(ENVELOPE)
    parsed = F.from_json(line, ", ".join(f"{n} string" for n in names))
    out = lines.withColumn("__e", parsed)
    out = out.select(*[c for c in lines.columns if c not in (*names, line)], F.col(line).alias("payload"), F.sha2(line, 256).alias("payload_sha256"), *[typed(F.col("__e")[n], ENVELOPE[n]).alias(n) for n in names])
    return out.withColumn("event_date", F.to_date("event_time"))


def payload_fields(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows with fields of the payload; a field that the rows have already stays as it is."""
    new = {n: k for n, k in fields.items() if n not in rows.columns}
    if not new:
        return rows
    parsed = rows.withColumn("__p", F.from_json("payload", ", ".join(f"{n} string" for n in new)))
    return parsed.select(*rows.columns, *[typed(F.col("__p")[n], k).alias(n) for n, k in new.items()])


def domain(rows: DataFrame, name: str) -> DataFrame:
    """Rows of one domain (telemetry, operational or production) with its typed fields; no column twice."""
    kinds = {"telemetry": ("MachineTelemetry",), "operational": OPERATIONAL, "production": PRODUCTION}[name]
    out = payload_fields(rows.where(F.col("event_type").isin(*kinds)), LINEAGE | DOMAINS[name])
    wanted = [*ENVELOPE, *LINEAGE, "payload_sha256", *DOMAINS[name], *[c for c in ("is_late", "ingestion_batch_id") if c in out.columns], "payload", "event_date"]
    return out.select(*dict.fromkeys(wanted))


def enrich_master_keys(rows: DataFrame, machines: DataFrame, lines: DataFrame, plants: DataFrame, products: DataFrame) -> DataFrame:
    """Rows with the master rows that are valid on the event's date: machine_sk, machine_line_sk, machine_type_code,
    line_sk, line_plant_sk, plant_sk, product_sk; null where there is none. Master tables are versioned."""
    rows = payload_fields(rows, {"machine_type": "string", "product_id": "string", "actual_quantity": "double", "good_quantity": "double", "rejected_quantity": "double"}).withColumn("__day", F.to_date("event_time"))

    def valid(table: DataFrame, prefix: str, **columns: str) -> DataFrame:
        return table.select(F.col("effective_from").alias(f"__{prefix}_from"), F.col("effective_to").alias(f"__{prefix}_to"), *[F.col(c).alias(n) for n, c in columns.items()])

    for prefix, key, table in (
        ("m", "machine_id", valid(machines, "m", __m="machine_id", machine_sk="machine_sk", machine_line_sk="line_sk", machine_type_code="machine_type_code")),
        ("l", "line_id", valid(lines, "l", __l="line_id", line_sk="line_sk", line_plant_sk="plant_sk")),
        ("p", "plant_id", valid(plants, "p", __p="plant_id", plant_sk="plant_sk")),
        ("r", "product_id", valid(products, "r", __r="product_id", product_sk="product_sk")),
    ):
        rows = scd2_join(rows, table, key, f"__{prefix}", "__day", start=f"__{prefix}_from", end=f"__{prefix}_to").drop(f"__{prefix}", f"__{prefix}_from", f"__{prefix}_to")
    return rows.drop("__day")


def _differ(a: str, b: str) -> Column:
    return F.col(a) != F.col(b)


def gate_rules() -> list[tuple[str, Column]]:
    """The twelve rules of the gate, in order. A row has the code of the first that holds; an unknown comparison doesn't hold."""
    given, lost = (lambda c: F.col(c).isNotNull()), (lambda c: F.col(c).isNull())
    quantities = ("actual_quantity", "good_quantity", "rejected_quantity")
    return [
        ("MISSING_EVENT_ID", lost("event_id")),
        ("INVALID_EVENT_TIME", lost("event_time")),
        ("MISSING_PLANT_ID", lost("plant_id")),
        ("PLANT_MASTER_NOT_FOUND", given("plant_id") & lost("plant_sk")),
        ("MACHINE_MASTER_NOT_FOUND", given("machine_id") & lost("machine_sk")),
        ("LINE_MASTER_NOT_FOUND", given("line_id") & lost("line_sk")),
        ("PRODUCT_MASTER_NOT_FOUND", given("product_id") & lost("product_sk")),
        ("MACHINE_LINE_MISMATCH", _differ("machine_line_sk", "line_sk")),
        ("MACHINE_TYPE_MISMATCH", _differ("machine_type", "machine_type_code")),
        ("LINE_PLANT_MISMATCH", _differ("line_plant_sk", "plant_sk")),
        ("NEGATIVE_PRODUCTION_QUANTITY", given(quantities[0]) & F.greatest(*[F.coalesce(F.col(q) < 0, F.lit(False)) for q in quantities])),
        ("PRODUCTION_QUANTITY_INCONSISTENCY", F.col("good_quantity") + F.col("rejected_quantity") > F.col("actual_quantity")),
    ]


def quality_gate(enriched: DataFrame) -> DataFrame:
    """Rows with rejection_code and rejection_detail, null for accepted rows."""
    code = first_match(gate_rules())
    return enriched.withColumn("rejection_code", code).withColumn("rejection_detail", F.when(F.col("rejection_code").isNotNull(), F.concat(F.lit("Silver quality gate: "), F.col("rejection_code"))))


def audit(gated: DataFrame, versions: DataFrame) -> DataFrame:
    """One row of counters. gated: the gate's rows, with is_late; versions: rows with status of classify_versions."""
    seen = versions.agg(F.count("*").alias("source_rows"), F.count_if(F.col("status") == "DUPLICATE").alias("duplicate_rows"), F.count_if(F.col("status") == "CONFLICT").alias("conflict_rows"))
    kept = gated.agg(F.count_if(F.col("rejection_code").isNull()).alias("accepted_rows"), F.count_if(F.col("rejection_code").isNotNull()).alias("rejected_rows"), F.count_if(F.col("is_late")).alias("late_rows"), F.count_if(F.col("rejection_code").endswith("MASTER_NOT_FOUND")).alias("master_failures"))
    return seen.crossJoin(F.broadcast(kept))


# ---- checks of a run, in the order of generation ---------------------------------------------------------------------
def lineage_codes(events: DataFrame, run: str = "simulator_run_id", seq: str = "generation_sequence") -> DataFrame:
    """Events with codes: what is wrong with their lineage. The cursor is the last sequence *seen*, valid or not, so one
    bad event doesn't make all after it bad. The run is the first one that the stream (column `stream`) has."""
    order = Window.partitionBy("stream").orderBy("position")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("__run", F.first(run, True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__last", F.last(F.when(F.col(seq) >= 1, F.col(seq)), True).over(before))
    events = events.withColumn("__copy", F.row_number().over(Window.partitionBy("stream", "event_id").orderBy("position")))
    rules = [
        ("MISSING_RUN_LINEAGE", F.col(run).isNull()),
        ("MULTIPLE_RUN_IDS", F.col(run) != F.col("__run")),
        ("INVALID_GENERATION_SEQUENCE", F.col(seq).isNull() | (F.col(seq) < 1)),
        ("GENERATION_SEQUENCE_GAP", F.col(seq) != F.col("__last") + 1),
        ("MISSING_EVENT_ID", F.col("event_id").isNull()),
        ("DUPLICATE_EVENT_ID", F.col("event_id").isNotNull() & (F.col("__copy") > 1)),
    ]
    return events.withColumn("codes", all_matches(rules)).drop("__run", "__last", "__copy")


def temporal_codes(events: DataFrame, low_ms: int = 20, high_ms: int = 1500) -> DataFrame:
    """Events (stream, position, event_us, ingestion_us) with codes: ingestion before the event, a delay out of bounds, a
    time before the latest that was seen."""
    before = Window.partitionBy("stream").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    delay = F.col("ingestion_us") - F.col("event_us")
    events = events.withColumn("__top", F.max("event_us").over(before))
    rules = [
        ("INGESTION_BEFORE_EVENT", delay < 0),
        ("INGESTION_DELAY_OUT_OF_RANGE", (delay >= 0) & ~delay.between(low_ms * 1000, high_ms * 1000)),
        ("EVENT_TIME_REGRESSION", F.col("event_us") < F.col("__top")),
    ]
    return events.withColumn("codes", all_matches(rules)).drop("__top")


def business_codes(events: DataFrame) -> DataFrame:
    """Events with codes of rules on quantities and states."""
    q = lambda c: F.col(c) < 0
    rules = [
        ("NEGATIVE_QUANTITY", F.coalesce(q("actual_quantity"), F.lit(False)) | F.coalesce(q("good_quantity"), F.lit(False)) | F.coalesce(q("rejected_quantity"), F.lit(False))),
        ("QUANTITY_INCONSISTENT", F.col("good_quantity") + F.col("rejected_quantity") > F.col("actual_quantity") + 1e-9),
        ("STATE_NOT_CHANGED", (F.col("event_type") == "StateChanged") & F.col("previous_state").eqNullSafe(F.col("new_state"))),
        ("NEGATIVE_LOSS", (F.col("event_type") == "ProductionLossRecorded") & (F.col("loss_quantity") < 0)),
    ]
    return events.withColumn("codes", all_matches(rules))


def causation_codes(events: DataFrame) -> DataFrame:
    """Events (event_id, position, causation_id, correlation_id, valid; ids unique) with codes: the cause has to be an event
    that came before and was itself accepted, and both must have one correlation_id.

    An event has one cause, so refusal spreads along a chain. Pointers to causes are doubled: each round looks twice as far
    up, and as many rounds are run as the longest chain has binary digits. Causes that come later end a chain, so none is a
    loop. Each round's table is written.
    """
    up = events.select(F.col("event_id").alias("__id"), F.col("position").alias("__at"), F.col("correlation_id").alias("__group"), F.col("valid").alias("__valid"))
    linked = events.join(up, F.col("causation_id") == F.col("__id"), "left")
    prior = F.coalesce(F.col("__at") < F.col("position"), F.lit(False))
    lost = F.col("causation_id").isNotNull() & ~(prior & F.coalesce("__valid", F.lit(False)))
    other = F.col("__id").isNotNull() & ~F.col("correlation_id").eqNullSafe(F.col("__group"))
    own = cut(linked.select(*events.columns, lost.alias("__lost"), other.alias("__other"), F.when(prior, F.col("causation_id")).alias("__up")))
    state = own.select(F.col("event_id").alias("node"), (~F.col("valid") | F.col("__lost") | F.col("__other")).alias("bad"), F.col("__up").alias("next"))
    while not state.where("next is not null").isEmpty():
        far = state.select(F.col("node").alias("__n"), F.col("bad").alias("__b"), F.col("next").alias("__next"))
        state = cut(state.join(far, F.col("next") == F.col("__n"), "left").select("node", (F.col("bad") | F.coalesce("__b", F.lit(False))).alias("bad"), F.col("__next").alias("next")))
    refused = state.where("bad").select(F.col("node").alias("__bad"))
    out = own.join(refused, F.col("causation_id") == F.col("__bad"), "left")
    rules = [("CAUSATION_PARENT_NOT_FOUND", F.col("__lost") | F.col("__bad").isNotNull()), ("CORRELATION_MISMATCH", F.col("__other"))]
    return out.withColumn("codes", all_matches(rules)).select(*events.columns, "codes")


def schema_codes(rows: DataFrame, schema: dict) -> DataFrame:
    """Rows with codes of a schema of fields: {"required": [...], "fields": {name: {"enum"|"pattern"|"minimum"|"maximum"|
    "const": x}}, "when": [{"if": {field: value}, "then": [required fields]}]}. Null fields break "required" alone."""
    rules = [(f"REQUIRED:{c}", F.col(c).isNull()) for c in schema.get("required", ())]
    for name, spec in schema.get("fields", {}).items():
        c = F.col(name)
        tests = {"enum": lambda v, c=c: ~c.isin(list(v)), "const": lambda v, c=c: c != v, "pattern": lambda v, c=c: ~c.rlike(v), "minimum": lambda v, c=c: c < v, "maximum": lambda v, c=c: c > v}
        rules += [(f"{kind.upper()}:{name}", tests[kind](value)) for kind, value in spec.items()]
    for branch in schema.get("when", ()):
        holds = F.lit(True)
        for name, value in branch["if"].items():
            holds = holds & F.coalesce(F.col(name).isin(list(value)) if isinstance(value, list | tuple) else F.col(name) == value, F.lit(False))
        rules += [(f"REQUIRED:{c}", holds & F.col(c).isNull()) for c in branch["then"]]
    return rows.withColumn("codes", F.array_distinct(all_matches(rules)))


def quarantine(rows: DataFrame, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> DataFrame:
    """Rows with codes as quarantine records: quarantine_id (from the codes and the payload), reason_codes, payload."""
    from millrace.functions.columns import uuid5

    bad = rows.where(F.size("codes") > 0)
    name = F.concat(F.array_join(F.array_sort("codes"), ","), F.lit("|"), F.sha2("payload", 256))
    return bad.select(F.concat(F.lit("QUA-"), uuid5(namespace, name)).alias("quarantine_id"), "event_id", "event_type", "event_date", F.array_sort("codes").alias("reason_codes"), "payload")
