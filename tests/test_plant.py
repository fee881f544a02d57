"""Ingestion, silver, gold, features, workflow and streams on small hand-made tables."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import features, gold, keys, learning, measures, realtime, retrieval, silver
from millrace.sources import files, ingest
from millrace.streaming import jobs


def lines(spark, *events):
    return spark.createDataFrame([(json.dumps(e),) for e in events], "value string")


def manifest(batch="IBT-1", sha="aa", n=2):
    return {"ingestion_batch_id": batch, "run": "RUN-1", "file_sha256": sha, "event_count": n, "source_file": "f"}


def event(i, **more):
    return {"event_id": f"EVT-{i}", "event_type": "AlarmRaised", "event_time": "2024-01-05T10:00:00Z", "plant_id": "PLT-1"} | more


def test_ingestion_skips_replays_and_quarantines_conflicts(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    first = lines(spark, event(1), event(2), event(2))
    assert ingest.ingest(store, manifest(n=3), first, "aa") == ingest.Result("IBT-1", "COMPLETED", 2, 1, 0)
    assert ingest.ingest(store, manifest(n=3), first, "aa") == ingest.Result("IBT-1", "SKIPPED_DUPLICATE", 2, 3, 0)
    # the same payload written otherwise is a duplicate, another payload a conflict
    swapped = dict(reversed(event(1).items()))
    assert ingest.ingest(store, manifest("IBT-2"), lines(spark, swapped, event(3)), "aa") == ingest.Result("IBT-2", "COMPLETED", 1, 1, 0)
    clash = lines(spark, event(1, plant_id="PLT-2"), event(4))
    assert ingest.ingest(store, manifest("IBT-3"), clash, "aa") == ingest.Result("IBT-3", "QUARANTINED", 0, 0, 1)
    assert store.events().count() == 3
    assert ingest.ingest(store, manifest("IBT-3"), clash, "aa", partial=True) == ingest.Result("IBT-3", "COMPLETED", 1, 0, 1)
    assert ingest.ingest(store, manifest("IBT-4"), first, "bb").status == "QUARANTINED"
    with pytest.raises(FileNotFoundError):
        ingest.ingest(store, manifest("IBT-5"), first, None)
    states = {r["ingestion_batch_id"]: (r["status"], r["error_code"]) for r in store.checkpoints().collect()}
    assert states == {"IBT-1": ("COMPLETED", None), "IBT-2": ("COMPLETED", None), "IBT-3": ("COMPLETED", None), "IBT-4": ("QUARANTINED", "SOURCE_HASH_MISMATCH"), "IBT-5": ("FAILED", "SOURCE_FILE_MISSING")}
    bad = spark.read.parquet(f"{tmp_path}/quarantine")
    assert {r["reason_codes"][0] for r in bad.collect()} == {"EVENT_ID_PAYLOAD_CONFLICT"} and bad.select("quarantine_id").distinct().count() == 1


def test_recovery_registers_what_is_missing(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path))
    ingest.ingest(store, manifest(n=1), lines(spark, event(1)), "aa")
    ids = lambda *n: spark.createDataFrame([(f"EVT-{i}",) for i in n], "event_id string")
    assert ingest.recover(store, lines(spark, event(1), event(2)), ids(1, 2)) == 1
    assert ingest.recover(store, lines(spark, event(1), event(2)), ids(1, 2)) == 0
    with pytest.raises(ValueError, match="EVT-9 is missing"):
        ingest.recover(store, lines(spark, event(1)), ids(9))
    with pytest.raises(ValueError, match="conflicting payload"):
        ingest.recover(store, lines(spark, event(1, line_id="x")), ids(1))


def test_manifest_of_files(spark, tmp_path):
    for name, events in (("a", [event(1, simulator_run_id="R", generation_sequence=1), event(2, simulator_run_id="R", generation_sequence=5)]), ("b", [event(3, simulator_run_id="R"), event(4, simulator_run_id="S")]), ("c", [event(5, simulator_run_id="R"), event(6)])):
        folder = tmp_path / "in" / "event_type=operational" / "event_date=2024-01-05" / "plant_id=PLT-1"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, events)) + "\n\n")
    found = files.manifest(files.scan_lines(spark, str(tmp_path / "in")), files.file_hashes(spark, str(tmp_path / "in")))
    rows = {r["source_file"][-7:-6]: r for r in found.collect()}
    a = rows["a"]
    assert (a["event_count"], a["first_sequence"], a["last_sequence"], a["event_type"], a["event_date"], a["plant_id"], a["complete"]) == (2, 1, 5, "operational", "2024-01-05", "PLT-1", True)
    assert len(a["file_sha256"]) == 64 and a["ingestion_batch_id"].startswith("IBT-")
    assert rows["b"]["mixed_runs"] and rows["c"]["mixed_runs"] and not rows["b"]["complete"]
    with pytest.raises(ValueError, match="mixed runs"):
        files.require_complete(found)


def test_settings_and_bounded_reads(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("version: 1.0\n# note\nrules:\n  - id: A\n    when:\n      kind: x  # why\n    on: true\n  - id: B\nlist:\n- 1\n- two\nempty:\nshort: [a, 2]\n")
    assert files.read_settings(spark, str(tmp_path / "s.yaml")) == {"version": 1.0, "rules": [{"id": "A", "when": {"kind": "x"}, "on": True}, {"id": "B"}], "list": [1, "two"], "empty": None, "short": ["a", 2]}
    (tmp_path / "bad.yaml").write_text("a: &x 1\n")
    with pytest.raises(ValueError, match="subset"):
        files.read_settings(spark, str(tmp_path / "bad.yaml"))
    df = spark.range(10).select("id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("event_date"))
    files.append_by(df, str(tmp_path / "t"), "event_date")
    part = files.read_between(spark, str(tmp_path / "t"), first="2024-01-03", last="2024-01-05")
    assert sorted(r["id"] for r in part.collect()) == [2, 3, 4] and "PartitionFilters: [isnotnull(event_date" in part._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        files.required(spark, str(tmp_path / "t"), str(tmp_path / "nowhere"))
    sent = []
    counts = files.publish(df.select("id").coalesce(1), lambda batch: sent.append(batch), 25).collect()
    assert counts[0]["events"] == 10 and counts[0]["batches"] == 4
    with pytest.raises(ValueError, match="strictly"):
        files.write_json_lines(df.unionByName(df), str(tmp_path / "j"), ["event_date"], ["id"], strict="id")


def test_keys_with_nulls_and_repeats(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (None, "m"), (1, "c")], "k int, v string")
    once = keys.insert_absent(t, new, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "a"), (2, "b"), (None, "n")] and keys.insert_absent(once, new, ["k"]).count() == 3
    assert sorted(map(tuple, keys.upsert(t, new, ["k"]).collect()), key=str) == [(1, "c"), (2, "b"), (None, "m")]
    twice = new.unionByName(spark.createDataFrame([(2, "z")], "k int, v string"))
    assert ("z",) in [tuple(r)[1:] for r in keys.upsert(t, twice, ["k"], ["v"]).collect()]
    with pytest.raises(Exception, match="repeated in the new rows"):
        keys.upsert(t, twice, ["k"]).collect()


def test_gate_rules_in_order(spark):
    names = [n for n, _ in silver.gate_rules()]
    assert len(names) == 12 and names[0] == "MISSING_EVENT_ID" and names[-1] == "PRODUCTION_QUANTITY_INCONSISTENCY"
    schema = "event_id string, event_time timestamp, plant_id string, plant_sk int, machine_id string, machine_sk int, line_id string, line_sk int, product_id string, product_sk int, machine_line_sk int, machine_type string, machine_type_code string, line_plant_sk int, actual_quantity double, good_quantity double, rejected_quantity double"
    import datetime as dt

    at = dt.datetime(2024, 1, 5)
    good = ["E", at, "P", 1, "M", 1, "L", 1, "R", 1, 1, "T", "T", 1, 5.0, 4.0, 1.0]

    def row(**change):
        x = dict(zip([c.split()[0] for c in schema.split(", ")], good)) | change
        return tuple(x.values())

    cases = [({}, None), ({"event_id": None, "plant_id": None}, "MISSING_EVENT_ID"), ({"plant_sk": None}, "PLANT_MASTER_NOT_FOUND"), ({"machine_line_sk": 2, "machine_type": "X"}, "MACHINE_LINE_MISMATCH"), ({"line_plant_sk": 2}, "LINE_PLANT_MISMATCH"), ({"rejected_quantity": -1.0}, "NEGATIVE_PRODUCTION_QUANTITY"), ({"actual_quantity": None, "good_quantity": -1.0}, None), ({"good_quantity": 5.0}, "PRODUCTION_QUANTITY_INCONSISTENCY"), ({"line_id": None, "line_sk": None}, None)]
    out = silver.quality_gate(spark.createDataFrame([row(**c) for c, _ in cases], schema)).collect()
    assert [r["rejection_code"] for r in out] == [w for _, w in cases] and out[2]["rejection_detail"] == "Silver quality gate: PLANT_MASTER_NOT_FOUND"


def test_one_bad_event_makes_no_others_bad(spark):
    rows = [("s", 1, "R", 1, "a"), ("s", 2, "R", None, "b"), ("s", 3, "R", 2, "c"), ("s", 4, "R", 5, "d"), ("s", 5, "R", 6, "a")]
    df = spark.createDataFrame(rows, "stream string, position int, simulator_run_id string, generation_sequence long, event_id string")
    got = {r["position"]: r["codes"] for r in silver.lineage_codes(df).collect()}
    assert got == {1: [], 2: ["INVALID_GENERATION_SEQUENCE"], 3: [], 4: ["GENERATION_SEQUENCE_GAP"], 5: ["DUPLICATE_EVENT_ID"]}


def test_downtime_is_cut_carried_in_and_merged(spark):
    H = 3_600_000_000
    rows = [("a", 1, 1, 1, 0, 1, "FAULT", False), ("b", 1, 1, 1, 5 * H, 2, "RUNNING", None), ("c", 1, 1, 1, 6 * H, 3, "SETUP", True), ("d", 1, 1, 1, 20 * H, 4, "IDLE", None)]
    df = spark.createDataFrame(rows, "event_id string, machine_sk int, line_sk int, plant_sk int, event_us long, generation_sequence long, new_state string, is_planned boolean")
    out = gold.fact_downtime(df, 2 * H, 10 * H)
    got = sorted((r["start_event_id"], r["date_sk"], r["shift_sk"], r["downtime_category"], r["duration_seconds"]) for r in out.collect())
    assert got == [("a", 19700101, 1, "UNPLANNED_FAULT", 3 * 3600.0)]  # c ends after the window, at an event that the window doesn't see
    later = gold.fact_downtime(df, 2 * H, 24 * H)
    merged = gold.merge_downtime(out, later)
    assert merged.count() == later.count() == 4 and merged.where("start_event_id = 'a'").first()["duration_seconds"] == 3 * 3600.0
    assert {r["downtime_category"] for r in later.collect()} == {"UNPLANNED_FAULT", "PLANNED_SETUP"}


def test_oee_guards_and_groups_without_a_machine(spark):
    p = spark.createDataFrame([(1, 1, 1, 1, None, "UnitProduced", 10.0, 9.0, 1.0, 5), (1, 1, 1, 1, 7, "UnitProduced", 0.0, 0.0, 0.0, None)], "date_sk int, shift_sk int, plant_sk int, line_sk int, machine_sk int, event_type string, actual_quantity double, good_quantity double, rejected_quantity double, product_sk int")
    d = spark.createDataFrame([(1, 1, 1, 1, 7, True, 28800.0)], "date_sk int, shift_sk int, plant_sk int, line_sk int, machine_sk int, is_planned boolean, duration_seconds double")
    products = spark.createDataFrame([(5, 288.0)], "product_sk int, standard_cycle_time_seconds double")
    got = {r["machine_sk"]: r for r in gold.oee(p, d, products).collect()}
    assert got[None]["oee_pct"] == pytest.approx(100 * 0.1 * 0.9) and got[7]["availability_pct"] is None and got[7]["quality_pct"] is None and got[7]["planned_production_seconds"] == 0


def test_risk_counts_every_critical_incident(spark):
    rows = [("m", t, s, u) for t, s, u in (("MachineFaulted", None, 95), ("MachineFaulted", "LOW", 96), ("CommunicationLost", None, 97), ("AlarmRaised", "CRITICAL", 98), ("AlarmRaised", "LOW", 99), ("AlarmRaised", "HIGH", 10), ("StateChanged", "HIGH", 99))]
    e = spark.createDataFrame(rows, "machine_id string, event_type string, severity string, event_us long")
    inc = realtime.critical_incidents(e, 100, 20)
    latest = spark.createDataFrame([("m", 75.0, None), ("o", None, 8.0)], "machine_id string, temperature_c double, vibration_mm_s double")
    got = {r["machine_id"]: (r["critical_incident_count"], r["fault_count"], r["communication_loss_count"], r["machine_risk_score"], r["risk_band"]) for r in realtime.machine_risk(latest, inc).collect()}
    assert got == {"m": (4, 2, 1, 10 + 20 + 30 + 5.0, "HIGH"), "o": (0, 0, 0, 40.0, "MEDIUM")}


def test_labels_look_ahead_only(spark):
    H = 3_600_000_000
    f = spark.createDataFrame([("a", "m", 0), ("b", "m", H), ("c", "m", 3 * H)], "feature_id string, machine_id string, feature_us long")
    x = spark.createDataFrame([("m", 0, "f0", "A"), ("m", H, "f1", "B"), ("m", H, "f2", "C")], "machine_id string, event_us long, event_id string, failure_mode_code string")
    got = {r["feature_id"]: (r["label_failure"], r["next_fault_event_id"], r["label_valid"]) for r in features.causal_labels(f, x, "v").collect()}
    assert got == {"a": (1, "f1", True), "b": (0, None, True), "c": (0, None, False)}


def test_training_registers_versions_and_scores(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 13 > 0, F.rand(3)).alias("z"), (F.col("id") % 10 > 6).cast("int").alias("y"))
    params = {"random_forest": {"trees": 5, "depth": 3}, "extra_trees": {"trees": 5, "depth": 3}}
    for version in (1, 2):
        row = features.train(df, df, df, ["x", "z"], "y", params, str(tmp_path), "risk")
        assert row["model_version"] == version and row["test_roc_auc"] > 0.95
    out = features.scored(features.load_model(str(tmp_path), "risk", 2), df)
    assert out.where("score < 0 or score > 1").count() == 0
    with pytest.raises(ValueError, match="no positive example"):
        features.train(df.where("y = 0"), df, df, ["x"], "y", params, str(tmp_path), "risk")
    broken = features.enrich(df.limit(5), lambda rows: 1 / 0, "x").collect()
    assert {r["score_status"] for r in broken} == {"FAILED"} and len(broken) == 5
    assert {r["failure_risk_score"] for r in features.enrich(df.limit(5), lambda rows: [0.5] * len(rows), "x").collect()} == {0.5}


def test_gates_and_empty_drift(spark):
    m = spark.createDataFrame([(0.8, None, float("nan"))], "auc double, ap double, brier double")
    got = {r["metric"]: r["status"] for r in learning.gates(m, {"auc": ("min", 0.7), "ap": ("min", 0.3), "brier": ("max", 0.25)}).collect()}
    assert got == {"auc": "PASS", "ap": "UNKNOWN", "brier": "UNKNOWN"}
    v = spark.range(50).select(F.col("id").cast("double").alias("v"))
    assert learning.psi_with_nan(v, v.where("v < 0"), "v").first()[0] != learning.psi_with_nan(v, v.where("v < 0"), "v").first()[0]
    ties = spark.range(5000).select((F.col("id") % 977 / 977.0).alias("s"), (F.col("id") % 3 == 0).cast("long").alias("y"))
    curve = [(r["s"], r["tp"], r["fp"]) for r in learning.by_score(ties, "s", "y", parts=7).orderBy(F.desc("s")).collect()]
    tp = fp = 0
    import collections

    counts = collections.Counter((i % 977 / 977.0, int(i % 3 == 0)) for i in range(5000))
    for s, a, b in curve:
        tp, fp = tp + counts[s, 1], fp + counts[s, 0]
        assert (a, b) == (tp, fp)


def test_incident_workflow(spark):
    none = spark.createDataFrame([], "event_id string, machine_id string, kind string, event_us long, priority string, status string, resolved_us long")
    alerts = spark.createDataFrame([("a", "m", "FAULT", 10, None), ("a", "m", "FAULT", 10, None), ("b", "n", "FAULT", 20, "HIGH")], "event_id string, machine_id string, kind string, event_us long, severity string")
    nothing = spark.createDataFrame([], "machine_id string, kind string, event_us long")
    one = jobs.incidents(none, alerts, nothing, 30, 100)
    assert sorted((r["event_id"], r["priority"], r["status"]) for r in one.collect()) == [("a", "CRITICAL", "OPEN"), ("b", "HIGH", "OPEN")]
    solved = spark.createDataFrame([("m", "FAULT", 5), ("m", "FAULT", 50), ("m", "FAULT", 60)], "machine_id string, kind string, event_us long")
    two = {r["event_id"]: (r["status"], r["resolved_us"]) for r in jobs.incidents(one, alerts, solved, 120, 100).collect()}
    assert two == {"a": ("RESOLVED", 50), "b": ("ESCALATED", None)}


def test_streams_accumulate_and_window(spark, tmp_path):
    df = spark.createDataFrame([("l", t * 1_000_000, 1.0) for t in range(0, 100, 10)], "line string, us long, q double").withColumn("ts", F.timestamp_micros("us")).withColumn("got", F.timestamp_micros(F.col("us") + 500_000))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out: list = []
    jobs.run_once(jobs.accumulated(read(), "line", "us", "q"), lambda p, _: out.extend(tuple(r) for r in p.collect()), str(tmp_path / "c1"))
    assert sorted(out) == [("l", 30_000_000, 30_000_000, 4.0), ("l", 60_000_000, 30_000_000, 3.0), ("l", 90_000_000, 30_000_000, 3.0)]
    lag, both = [], []
    sink = jobs.fan_out(lambda p, _: lag.extend(r.asDict() for r in p.collect()), lambda p, _: both.append(p.count()))
    jobs.run_once(jobs.lag_health(read(), "ts", "got", ["line"], "1 hour", "1 minute"), sink, str(tmp_path / "c2"), "update")
    assert lag[0]["events"] == 10 and lag[0]["avg_lag_ms"] == 500.0 and lag[0]["p95_lag_ms"] == 500.0 and both
    hot: dict = {}
    jobs.run_once(jobs.hot(read(), "ts", ["line"], "1 minute", [F.sum("q").alias("q")], "1 minute", "30 seconds"), lambda p, _: hot.update({r["window_end"]: r["q"] for r in p.collect()}), str(tmp_path / "c3"), "update")
    assert max(hot.values()) == 6.0
    late = jobs.flagged_late(df.withColumn("got", F.col("ts") + F.expr("interval 16 minutes")), "ts", "got")
    assert late.where("is_late").count() == 10
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-03",)], "d string").select(F.to_date("d").alias("d"))
    assert [str(r["d"]) for r in jobs.expired(days, "d", "2024-01-03").collect()] == ["2024-01-01"]


def test_visibility_and_unrelated_dimensions(spark):
    c = spark.createDataFrame([(True, "ENTERPRISE", None), (True, "MACHINE_TYPE", "CNC"), (True, "MACHINE_TYPE", "ROB"), (False, "ENTERPRISE", None)], "active boolean, visibility_scope string, visibility_value string")
    assert [c.where(retrieval.visible(t)).count() for t in (None, "CNC", "XXX")] == [1, 2, 1]
    model = measures.Model({"risk": c, "date": c}, [])
    with pytest.raises(ValueError, match="no relationship"):
        model.query("risk", ["Average Failure Risk %"], ["date.calendar_date"])
