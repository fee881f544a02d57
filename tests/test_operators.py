"""Boundaries of the operators on small frames."""

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from millrace.functions.columns import all_matches, band, first_match, predicate, safe_div, uuid5
from millrace.operators import keys, learning, retrieval, semantic, temporal
from millrace.plans import catalogue
from millrace.sources import files
from millrace.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_catalogue_query_has_an_oracle_and_the_entry_runs(spark):
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div(F.col("a"), F.col("b"))).collect()] == [None, 1.5, None]
    assert [r[0] for r in df.select(band(F.col("a"), [(3, "X"), (1, "Y")], "Z")).collect()] == ["Y", "X", "Z"]
    rules = [("NULL_A", F.col("a").isNull()), ("BIG", F.col("a") > 2), ("B", F.col("b") > 0)]
    assert [r[0] for r in df.select(first_match(rules, "OK")).collect()] == ["OK", "BIG", "NULL_A"]
    assert [r[0] for r in df.select(all_matches(rules)).collect()] == [[], ["BIG", "B"], ["NULL_A", "B"]]
    assert df.where(predicate({"a": {"gte": 1, "lt": 3}, "b": 0.0})).count() == 1
    name = spark.createDataFrame([("EVT-1",), ("é",)], "n string").select("n", uuid5(str(uuid.NAMESPACE_URL), F.col("n")))
    assert all(u == str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n, u in name.collect())


def test_versions_and_upserts_are_idempotent(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", 1), (2, "b", 2), (3, "c", 1)], "id long, h string, seq int")
    assert rows(keys.classify_versions(df, "id", "h", [F.desc("seq")]).select("id", "seq", "status")) == [(1, 1, "DUPLICATE"), (1, 2, "KEEP"), (2, 1, "CONFLICT"), (2, 2, "CONFLICT"), (3, 1, "KEEP")]
    base = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "id long, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w"), (None, "m")], "id long, v string")
    once = keys.upsert(base, new, ["id"])
    assert rows(once.fillna(0)) == [(0, "m"), (1, "x"), (2, "z"), (3, "w")]
    assert rows(keys.upsert(once, new, ["id"]).fillna(0)) == rows(once.fillna(0))
    added = keys.insert_absent(base, new.dropna(), ["id"])
    assert rows(added.fillna(0)) == rows(keys.insert_absent(added, new.dropna(), ["id"]).fillna(0))


def test_intervals_are_half_open_and_shifts_conserve_time(spark):
    points = spark.createDataFrame([(0,), (9,), (10,), (19,), (20,)], "at long")
    spans = spark.createDataFrame([("a", 0, 10), ("b", 10, 20)], "n string, s long, e long")
    assert rows(temporal.interval_join(points, spans, "at", "s", "e", 7).select("at", "n")) == [(0, "a"), (9, "a"), (10, "b"), (19, "b")]
    a = spark.createDataFrame([(1, 0, 30), (2, 10, 11)], "id int, a_start long, a_end long")
    b = spark.createDataFrame([(7, 5, 10), (8, 10, 25), (9, 30, 31)], "no int, b_start long, b_end long")
    assert rows(temporal.overlap_join(a, b, 8).select("id", "no")) == [(1, 7), (1, 8), (2, 8)]
    cut = temporal.split_by_shift(spark.createDataFrame([(3, 47)], "s long, e long"), "s", "e", 10, 4).withColumn("n", F.col("piece_end") - F.col("piece_start"))
    assert rows(cut.select("piece_start", "piece_end")) == [(3, 6), (6, 16), (16, 26), (26, 36), (36, 46), (46, 47)]


def test_horizon_excludes_now_and_includes_its_end(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 10, 0), (1, 20, 1), (1, 21, 0), (1, 31, 1)], "k int, t long, f int")
    out = df.withColumn("next", temporal.next_within(df, "k", "t", F.col("f") == 1, 10))
    assert rows(out.select("t", "next").fillna(-1)) == [(0, -1), (10, 20), (20, -1), (21, 31), (31, -1)]


def test_cooldown_batch_equals_stream(spark, tmp_path):
    data = [(k, t, i) for i, (k, t) in enumerate([(1, 0), (1, 4), (1, 5), (1, 9), (1, 10), (2, 3), (2, 7), (2, 8)])]
    df = spark.createDataFrame(data, "k long, t long, id long")
    want = rows(temporal.greedy_cooldown(df, "k", "t", "id", 5))
    assert [(k, t) for k, t, _ in want] == [(1, 0), (1, 5), (1, 10), (2, 3), (2, 8)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = jobs.cooldown_alerts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "t", "id", 5)
    jobs.run_once(stream, lambda part, _: got.extend(tuple(r) for r in part.collect()), str(tmp_path / "c"))
    assert sorted(got) == want


def test_stream_windows_and_dedup(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 20).alias("id"), F.timestamp_seconds(F.lit(1_700_000_100) + F.col("id") % 20 * 60).alias("ts"), F.lit("a").alias("kind"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got: list = []
    jobs.run_once(jobs.deduplicated(read(), "id", "ts", "1 hour"), lambda p, _: got.extend(r["id"] for r in p.collect()), str(tmp_path / "c1"))
    assert sorted(got) == list(range(20))
    counts: dict = {}
    jobs.run_once(jobs.tumbling(read(), "ts", ["kind"], "5 minutes", "1 minute", [F.count("*").alias("n")]), lambda p, _: counts.update({r["window_start"]: r["n"] for r in p.collect()}), str(tmp_path / "c2"), "update")
    assert sorted(counts.values()) == [10, 10, 10, 10]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "s double, y int")
    m = learning.metric_bundle(df, "s", "y").first()
    assert m["roc_auc"] == pytest.approx((3 + 1.5) / 6) and m["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 0.5)
    assert tuple(learning.threshold_for_recall(df, "s", "y", 0.8).first())[0] == 0.7
    same = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert learning.psi(same, same, "v").first()[0] == 0.0
    assert learning.balanced_sample(df.withColumn("i", F.monotonically_increasing_id()), "y", 1, 100, "i").count() == 4


def test_chunks_cover_and_overlap(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = rows(retrieval.chunks(spark.createDataFrame([(1, text), (2, "one"), (3, " "), (4, None)], "d long, t string"), "d", "t", 10, 3).select("d", "first_word", "end_word"))
    assert got == [(1, 0, 10), (1, 7, 17), (1, 14, 24), (1, 21, 25), (2, 0, 1)]


def test_prior_day_is_a_calendar_day(spark):
    d = spark.createDataFrame([("2024-01-01", 5), ("2024-01-02", 7), ("2024-01-04", 9)], "s string, n int").select(F.to_date("s").alias("d"), "n")
    assert [r["change"] for r in semantic.prior_day(d, "d", "n").orderBy("d").collect()] == [None, 2, None]


def test_files(spark, tmp_path):
    lines = spark.createDataFrame([('{"simulator_run_id":"r","generation_sequence":1}',), ('{"simulator_run_id":"r","generation_sequence":2}',), (" ",)], "value string")
    lines.coalesce(1).write.text(str(tmp_path / "event_type=X"))
    scanned = files.scan_lines(spark, str(tmp_path))
    m = files.manifest(scanned).first()
    assert (m["event_count"], m["first_sequence"], m["last_sequence"], m["mixed_runs"], m["complete"]) == (2, 1, 2, False, False)  # no date, no plant
    kinds = spark.createDataFrame([("MachineTelemetry",), ("UnitProduced",), ("AlarmRaised",), (None,), ("",)], "t string")
    assert [r[0] for r in kinds.select(files.stream_name(F.col("t"))).collect()] == ["telemetry", "production", "operational", None, None]
    head = spark.createDataFrame([("# Guide\nDocument ID: DOC-1\nVersion: 1.2.0\nKnowledge domain: CNC\nMachine type: null",), ("",)], "text string")
    assert [tuple(r)[1:] for r in files.header_metadata(head).collect()] == [("DOC-1", "1.2.0", "Guide", "CNC", None), ("DOC-UNKNOWN", "0.0.0", "Untitled", "STANDARD_OPERATING_PROCEDURE", None)]
