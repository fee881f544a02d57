"""Registered queries: industrial analytics over the driver's tables, each with SQL for the same result.

events stand for machine events (user_id: machine, view: telemetry, click: alarm, error: fault, signup: lost communication,
purchase: unit produced), lineitem and orders for production, supplier, nation and region for machine, line and plant.
Times are microseconds, so that both engines agree to the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import all_matches, band, clamp, first_match, hash_id, json_field, micros, points, predicate, safe_div, uuid5
from millrace.operators import keys, learning, realtime, retrieval, semantic, temporal
from millrace.operators.temporal import DAY, HOUR, MINUTE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IST = 330 * MINUTE
SHIFT = 8 * HOUR
#: Shifts begin at 06:00, 14:00 and 22:00 local time; this added to UTC makes them multiples of SHIFT.
SHIFT_OFFSET = IST - 6 * HOUR
HOT = 3 * DAY


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", micros(F.col("ts")).alias("us"), "user_id", "event_type", "value", json_field(F.col("props"), "$.k", "int").alias("k"), "props")


E = "e AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props FROM events), now AS (SELECT max(us) AS t FROM e)"


def as_of(e: DataFrame, df: DataFrame, span: int) -> DataFrame:
    """Rows of the last `span` before the newest event, whose time is found first, so that the bound is a number."""
    newest = e.agg(F.max("us")).first()[0]
    return df.where(F.col("us") >= F.lit(newest) - span)


# ---- real time -------------------------------------------------------------------------------------------------------
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM e WHERE event_type = 'view') WHERE r = 1)"


def latest_views(e: DataFrame) -> DataFrame:
    return keys.latest_by(e.where("event_type = 'view'"), ["user_id"], ["us", "event_id"])


@query(f"WITH {E}, {LATEST} SELECT user_id, us, event_id, value, k FROM latest")
def latest_telemetry_per_key(spark, sf):
    return latest_views(events(spark, sf)).select("user_id", "us", "event_id", "value", "k")


CRITICAL = "event_type IN ('click', 'error', 'signup') AND (value >= 50 OR event_type IN ('error', 'signup'))"
INCIDENTS = f"inc AS (SELECT user_id, count(*) AS incidents, count(*) FILTER (event_type = 'error') AS faults, count(*) FILTER (event_type = 'signup') AS losses FROM e, now WHERE us >= t - {HOT} AND {CRITICAL} GROUP BY user_id)"


@query(f"""WITH {E}, {LATEST}, {INCIDENTS}, s AS (SELECT l.user_id, least(100, CASE WHEN l.k >= 90 THEN 40 WHEN l.k >= 80 THEN 20 WHEN l.k >= 70 THEN 10 ELSE 0 END
+ CASE WHEN l.k / 10.0 >= 8 THEN 40 WHEN l.k / 10.0 >= 6 THEN 20 WHEN l.k / 10.0 >= 4 THEN 10 ELSE 0 END
+ least(20, 5 * coalesce(incidents, 0)) + least(30, 15 * coalesce(faults, 0)) + least(10, 5 * coalesce(losses, 0))) AS risk_score FROM latest l LEFT JOIN inc USING (user_id))
SELECT user_id, CAST(risk_score AS BIGINT) AS risk_score, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM s""")
def rt_machine_risk(spark, sf):
    """Every critical incident counts; faults and losses count once more by kind."""
    e = events(spark, sf)
    recent = as_of(e, e.where(CRITICAL), HOT).groupBy("user_id").agg(F.count("*").alias("critical_incident_count"), F.count_if(F.col("event_type") == "error").alias("fault_count"), F.count_if(F.col("event_type") == "signup").alias("communication_loss_count"))
    rows = latest_views(e).join(recent, "user_id", "left").fillna(0, list(realtime.INCIDENTS))
    score = realtime.risk_score(F.col("k"), F.col("k") / 10, {n: F.col(n) for n in realtime.INCIDENTS}).cast("long")
    return rows.select("user_id", score.alias("risk_score"), band(score, realtime.BANDS, "LOW").alias("risk_band"))


@query(f"WITH {E} SELECT event_id, user_id, event_type, us, value FROM e, now WHERE us >= t - {HOT} AND event_type IN ('click', 'error', 'signup') AND (value >= 50 OR event_type = 'error')")
def recent_critical_incidents(spark, sf):
    e = events(spark, sf)
    wanted = predicate({"event_type": {"in": ["click", "error", "signup"]}}) & (predicate({"value": {"gte": 50}}) | predicate({"event_type": "error"}))
    return as_of(e, e.where(wanted), HOT).select("event_id", "user_id", "event_type", "us", "value").orderBy(F.desc("us"))


@query(f"WITH {E} SELECT user_id % 10 AS line, k % 12 AS product, count(*) AS events, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM e, now WHERE us >= t - {HOT} AND event_type = 'purchase' GROUP BY ALL")
def rt_production_window(spark, sf):
    e = events(spark, sf)
    return as_of(e, e.where("event_type = 'purchase'"), HOT).groupBy((F.col("user_id") % 10).alias("line"), (F.col("k") % 12).alias("product")).agg(F.count("*").alias("events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS loss_quantity, CASE l_linestatus WHEN 'F' THEN 'SCRAP' ELSE 'QUALITY' END AS loss_category FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def rt_production_losses(spark, sf):
    lost = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45")
    return lost.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("loss_quantity"), F.when(F.col("l_linestatus") == "F", "SCRAP").otherwise("QUALITY").alias("loss_category")).orderBy(F.desc("loss_quantity"))


@query(f"""WITH {E}, p AS (SELECT user_id % 7 AS plant, count(*) AS units, count(*) FILTER (k < 90) AS good FROM e WHERE event_type = 'purchase' GROUP BY 1),
i AS (SELECT user_id % 7 AS plant, count(*) AS incidents FROM e WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(p.plant, i.plant) AS plant, coalesce(units, 0) AS units, coalesce(incidents, 0) AS incidents, round(100.0 * good / units, 6) AS quality_pct FROM p FULL JOIN i ON p.plant = i.plant""")
def plant_realtime_kpi(spark, sf):
    e = events(spark, sf).withColumn("plant", F.col("user_id") % 7)
    made = e.where("event_type = 'purchase'").groupBy("plant").agg(F.count("*").alias("units"), F.count_if(F.col("k") < 90).alias("good"))
    bad = e.where("event_type = 'error'").groupBy("plant").agg(F.count("*").alias("incidents"))
    both = made.join(bad, "plant", "full")
    return both.select("plant", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("incidents", F.lit(0)).alias("incidents"), F.round(100 * safe_div(F.col("good"), F.col("units")), 6).alias("quality_pct"))


LAG = "(100 + (event_id * 37) % 1401)"


@query(f"WITH {E} SELECT event_type, count(*) AS events, round(avg({LAG}), 6) AS avg_lag_ms, CAST(quantile_disc({LAG}, 0.95) AS BIGINT) AS p95_lag_ms FROM e GROUP BY 1")
def stream_health(spark, sf):
    lag = F.expr(LAG)
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.avg(lag), 6).alias("avg_lag_ms"), F.percentile_approx(lag, 0.95, 10_000).cast("long").alias("p95_lag_ms"))


# ---- scores ----------------------------------------------------------------------------------------------------------
SCORED = f"WITH {E}, s AS (SELECT event_id, user_id, us, round((k + value / 1000.0) / 101, 6) AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, event_type FROM e)"


def scored(spark, sf):
    s = F.round((F.col("k") + F.col("value") / 1000) / 101, 6)
    return events(spark, sf).select("event_id", "user_id", "us", s.alias("score"), (F.col("event_type") == "error").cast("int").alias("label"), "event_type")


@query(f"{SCORED} SELECT user_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM s) WHERE r = 1")
def ml_latest_prediction(spark, sf):
    return keys.latest_by(scored(spark, sf), ["user_id"], ["us", "event_id"]).select("user_id", "event_id", "score")


@query(f"{SCORED}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS r FROM s) WHERE r = 1) SELECT user_id, score, CASE WHEN score >= 0.8 THEN 'CRITICAL' ELSE 'HIGH' END AS band FROM l WHERE score >= 0.6")
def ml_actionable_risk(spark, sf):
    last = keys.latest_by(scored(spark, sf), ["user_id"], ["us", "event_id"])
    return last.where("score >= 0.6").select("user_id", "score", band(F.col("score"), [(0.8, "CRITICAL")], "HIGH").alias("band")).orderBy(F.desc("score"))


@query(f"{SCORED} SELECT event_type, count(*) AS n, round(avg(score), 6) AS avg_score, round(quantile_cont(score, 0.95), 6) AS p95 FROM s GROUP BY 1")
def ml_endpoint_health(spark, sf):
    return scored(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.percentile("score", 0.95), 6).alias("p95"))


@query(f"""{SCORED} SELECT event_id, round(least(1, greatest(0, score)), 6) AS probability, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS band, 'PRD-' || substr(sha256(CAST(user_id AS VARCHAR) || '|' || CAST(us AS VARCHAR) || '|v1'), 1, 32) AS prediction_id FROM s""")
def ml_batch_score(spark, sf):
    s = scored(spark, sf)
    return s.select("event_id", F.round(clamp(F.col("score"), 0, 1), 6).alias("probability"), band(F.col("score"), [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.35, "MEDIUM")], "LOW").alias("band"), hash_id(F.col("user_id").cast("string"), F.col("us").cast("string"), F.lit("v1"), prefix="PRD-", length=32).alias("prediction_id"))


CURVE = f"{SCORED}, c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY 1), d AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"{CURVE}, b AS (SELECT avg((score - label) * (score - label)) AS brier FROM s) SELECT round(sum(neg * (tp - pos / 2.0)) / (max(p) * max(n)), 6) AS roc_auc, round(sum(pos * tp / CAST(tp + fp AS DOUBLE)) / max(p), 6) AS average_precision, round(max(brier), 6) AS brier, round(sqrt(max(brier)), 6) AS rmse FROM d, b")
def ml_metric_bundle(spark, sf):
    m = learning.metric_bundle(scored(spark, sf), "score", "label")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"{CURVE} SELECT score AS threshold, round(tp / CAST(p AS DOUBLE), 6) AS recall, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision FROM d WHERE tp >= 0.8 * p ORDER BY tp / CAST(tp + fp AS DOUBLE) DESC, score DESC LIMIT 1")
def ml_threshold_for_recall(spark, sf):
    return learning.threshold_for_recall(scored(spark, sf), "score", "label", 0.8).select("threshold", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(f"""WITH {E}, m AS (SELECT min(us) + (max(us) - min(us)) * 3 // 4 AS cut FROM e), a AS (SELECT value AS v FROM e, m WHERE us < cut), b AS (SELECT value AS v FROM e, m WHERE us >= cut),
q AS (SELECT unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM a),
x AS (SELECT bin, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM (SELECT (SELECT count(*) FROM q WHERE a.v > edge) AS bin FROM a) GROUP BY bin),
y AS (SELECT bin, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM (SELECT (SELECT count(*) FROM q WHERE b.v > edge) AS bin FROM b) GROUP BY bin),
z AS (SELECT greatest(coalesce(x.s, 0), 1e-6) AS p, greatest(coalesce(y.s, 0), 1e-6) AS r FROM x FULL JOIN y ON x.bin = y.bin), s AS (SELECT round(sum((r - p) * ln(r / p)), 6) AS psi FROM z)
SELECT psi, CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARN' ELSE 'OK' END AS status FROM s""")
def ml_psi_drift(spark, sf):
    e = events(spark, sf)
    low, high = e.agg(F.min("us"), F.max("us")).first()
    cut = low + (high - low) * 3 // 4
    p = learning.psi(e.where(F.col("us") < cut), e.where(F.col("us") >= cut), "value").select(F.round("psi", 6).alias("psi"))
    return p.select("psi", band(F.col("psi"), [(0.25, "CRITICAL"), (0.1, "WARN")], "OK").alias("status"))


@query(f"{SCORED}, m AS (SELECT min(us) AS lo, max(us) AS hi FROM s) SELECT CASE WHEN (us - lo) / CAST(hi - lo AS DOUBLE) < 0.7 THEN 'train' WHEN (us - lo) / CAST(hi - lo AS DOUBLE) < 0.85 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM s, m GROUP BY 1")
def ml_chronological_split(spark, sf):
    return learning.chronological_split(scored(spark, sf), "us").groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


@query(f"{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(event_id AS VARCHAR))) AS r FROM s), p AS (SELECT least(count(*), 250) AS p FROM s WHERE label = 1) SELECT event_id, label FROM r, p WHERE (label = 1 AND r <= 250) OR (label = 0 AND r <= least(3 * p, 1000 - p))")
def ml_balanced_sample(spark, sf):
    return learning.balanced_sample(scored(spark, sf), "label", 3, 1000, "event_id").select("event_id", "label")


@query(f"{SCORED}, t AS (SELECT count(DISTINCT user_id) FILTER (score >= 0) / CAST(count(DISTINCT user_id) AS DOUBLE) AS coverage, avg(CASE WHEN score >= 0.8 THEN 1.0 ELSE 0.0 END) AS critical_rate FROM s) SELECT round(coverage, 6) AS coverage, round(critical_rate, 6) AS critical_rate, CASE WHEN coverage >= 0.9 THEN 'PASS' ELSE 'BREACH' END AS coverage_status, CASE WHEN critical_rate <= 0.25 THEN 'PASS' ELSE 'BREACH' END AS critical_status FROM t")
def ml_monitoring(spark, sf):
    s = scored(spark, sf).agg((F.count_distinct(F.when(F.col("score") >= 0, F.col("user_id"))) / F.count_distinct("user_id")).alias("coverage"), F.avg((F.col("score") >= 0.8).cast("double")).alias("critical_rate"))
    verdict = lambda ok: F.when(ok.isNull(), "UNKNOWN").when(ok, "PASS").otherwise("BREACH")
    return s.select(F.round("coverage", 6).alias("coverage"), F.round("critical_rate", 6).alias("critical_rate"), verdict(F.col("coverage") >= 0.9).alias("coverage_status"), verdict(F.col("critical_rate") <= 0.25).alias("critical_status"))


@query("WITH g AS (SELECT p_brand, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY 1) SELECT * FROM (SELECT p_brand AS feature, importance, row_number() OVER (ORDER BY importance DESC, p_brand) AS rank FROM g) WHERE rank <= 15")
def ml_feature_importance_top(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_retailprice"), 4).alias("importance"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))).where("rank <= 15")


# ---- features --------------------------------------------------------------------------------------------------------
@query(f"WITH {E} SELECT user_id, (us // {5 * MINUTE} + 1) * {5 * MINUTE} AS feature_us, arg_max_null(value, us::HUGEINT * 1000000 + event_id) AS value, arg_max_null(k, us::HUGEINT * 1000000 + event_id) AS k FROM e WHERE event_type = 'view' GROUP BY 1, 2")
def ml_bucket_telemetry(spark, sf):
    w = (F.floor(F.col("us") / (5 * MINUTE)) + 1) * (5 * MINUTE)
    e = events(spark, sf).where("event_type = 'view'").groupBy("user_id", w.alias("feature_us")).agg(F.max_by(F.struct("value", "k"), F.struct("us", "event_id")).alias("last"))
    return e.select("user_id", "feature_us", "last.value", "last.k")


@query(f"WITH {E} SELECT user_id, (us // {HOUR} + 1) * {HOUR} AS feature_us, count(*) FILTER (event_type = 'click') AS alarms, count(*) FILTER (event_type = 'signup') AS losses, count(*) FILTER (event_type = 'error') AS faults FROM e WHERE event_type IN ('click', 'signup', 'error') GROUP BY 1, 2")
def ml_bucket_operational(spark, sf):
    w = (F.floor(F.col("us") / HOUR) + 1) * HOUR
    e = events(spark, sf).where(F.col("event_type").isin("click", "signup", "error"))
    return e.groupBy("user_id", w.alias("feature_us")).agg(*[F.count_if(F.col("event_type") == t).alias(n) for t, n in (("click", "alarms"), ("signup", "losses"), ("error", "faults"))])


@query(f"WITH {E} SELECT user_id % 15 AS line, us // {HOUR} AS hour_no, count(*) AS units, sum(coalesce(k, 0)) AS quantity FROM e WHERE event_type = 'purchase' GROUP BY 1, 2")
def ml_bucket_line_production(spark, sf):
    e = events(spark, sf).where("event_type = 'purchase'")
    return e.groupBy((F.col("user_id") % 15).alias("line"), F.floor(F.col("us") / HOUR).alias("hour_no")).agg(F.count("*").alias("units"), F.sum(F.coalesce("k", F.lit(0))).alias("quantity"))


@query(f"WITH {E}, h AS (SELECT event_id, user_id % 3 AS kind, ((us + {IST}) // {HOUR}) % 24 AS hour FROM e) SELECT event_id, hour, CASE WHEN hour >= 6 AND hour < 14 THEN 1 WHEN hour >= 14 AND hour < 22 THEN 2 ELSE 3 END AS shift_code, round(sin(2 * pi() * hour / 24), 6) AS hour_sin, round(cos(2 * pi() * hour / 24), 6) AS hour_cos, CASE kind WHEN 0 THEN 'CNC' WHEN 1 THEN 'ROB' END AS machine_type FROM h")
def ml_time_context(spark, sf):
    hour = F.floor((F.col("us") + IST) / HOUR) % 24
    e = events(spark, sf).select("event_id", "user_id", hour.alias("hour"))
    shift = F.when((F.col("hour") >= 6) & (F.col("hour") < 14), 1).when((F.col("hour") >= 14) & (F.col("hour") < 22), 2).otherwise(3)
    kinds = F.create_map(F.lit(0), F.lit("CNC"), F.lit(1), F.lit("ROB"))
    angle = 2 * F.pi() * F.col("hour") / 24
    return e.select("event_id", "hour", shift.alias("shift_code"), F.round(F.sin(angle), 6).alias("hour_sin"), F.round(F.cos(angle), 6).alias("hour_cos"), kinds[(F.col("user_id") % 3).cast("int")].alias("machine_type"))


@query(f"""WITH {E} SELECT event_id, round(avg(value) OVER a, 4) AS mean_6h, round(stddev_pop(value) OVER a, 4) AS std_6h, round(value - first_value(value) OVER a, 4) AS delta_6h, count(*) FILTER (event_type = 'error') OVER b AS faults_24h, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END) OVER a, 6) AS running_6h FROM e
WINDOW a AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""")
def ml_rolling_features(spark, sf):
    a, b = temporal.trailing("user_id", "us", 6 * HOUR), temporal.trailing("user_id", "us", DAY)
    e = events(spark, sf).select("event_id", "user_id", "us", "value", "event_type")
    return e.select("event_id", F.round(F.avg("value").over(a), 4).alias("mean_6h"), F.round(F.stddev_pop("value").over(a), 4).alias("std_6h"), F.round(F.col("value") - F.first("value", True).over(a), 4).alias("delta_6h"), F.count(F.when(F.col("event_type") == "error", 1)).over(b).alias("faults_24h"), F.round(F.avg((F.col("event_type") == "view").cast("double")).over(a), 6).alias("running_6h"))


@query(f"""WITH {E}, c AS (SELECT event_id, user_id, us, event_type, min(CASE WHEN event_type = 'error' THEN us END) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {HOUR} FOLLOWING) AS next_fault, max(us) OVER (PARTITION BY user_id) AS last_us FROM e)
SELECT event_id, CASE WHEN next_fault IS NULL THEN 0 ELSE 1 END AS label_failure_60m, next_fault, (next_fault IS NULL AND us > last_us - {HOUR}) AS right_censored, NOT (next_fault IS NULL AND us > last_us - {HOUR}) AS label_valid FROM c""")
def ml_causal_labels(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "us", "event_type")
    e = e.withColumn("next_fault", temporal.next_within(e, "user_id", "us", F.col("event_type") == "error", HOUR)).withColumn("last_us", F.max("us").over(Window.partitionBy("user_id")))
    censored = F.col("next_fault").isNull() & (F.col("us") > F.col("last_us") - HOUR)
    return e.select("event_id", F.col("next_fault").isNotNull().cast("int").alias("label_failure_60m"), "next_fault", censored.alias("right_censored"), (~censored).alias("label_valid"))


@query(f"WITH {E} SELECT sha256(CAST(user_id AS VARCHAR) || '|' || CAST(us AS VARCHAR) || '|v1') AS feature_id, event_id, datediff('day', DATE '2023-06-01', CAST(make_timestamp(us) AS DATE)) + user_id % 100 AS machine_age_days FROM e WHERE event_type = 'view'")
def ml_feature_identity(spark, sf):
    e = events(spark, sf).where("event_type = 'view'")
    age = F.datediff(F.timestamp_micros("us").cast("date"), F.lit("2023-06-01").cast("date")) + F.col("user_id") % 100
    return e.select(hash_id(F.col("user_id").cast("string"), F.col("us").cast("string"), F.lit("v1")).alias("feature_id"), "event_id", age.alias("machine_age_days"))


# ---- bronze and silver -----------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE) AS missing, sha256(props) AS payload_sha256, CAST(ts AS DATE)::VARCHAR AS event_date FROM events WHERE length(trim(props)) > 0")
def bronze_envelope_extract(spark, sf):
    e = table(spark, sf, "events").where(F.length(F.trim("props")) > 0)
    return e.select("event_id", "event_type", json_field(F.col("props"), "$.k", "long").alias("k"), json_field(F.col("props"), "$.missing", "double").alias("missing"), F.sha2("props", 256).alias("payload_sha256"), F.to_date("ts").cast("string").alias("event_date"))


INJECTED = f"{E}, x AS (SELECT event_id, user_id, us, event_type, sha256(props) AS h, 0 AS seq FROM e UNION ALL SELECT event_id, user_id, us, event_type, sha256(props), 1 FROM e WHERE event_id % 10 = 0 UNION ALL SELECT event_id, user_id, us, event_type, sha256(props || 'x'), 2 FROM e WHERE event_id % 25 = 0)"


def injected(spark, sf):
    e = events(spark, sf)
    pick = lambda df, tail, seq: df.select("event_id", "user_id", "us", "event_type", F.sha2(F.concat("props", F.lit(tail)), 256).alias("h"), F.lit(seq).alias("seq"))
    return pick(e, "", 0).unionByName(pick(e.where("event_id % 10 = 0"), "", 1)).unionByName(pick(e.where("event_id % 25 = 0"), "x", 2))


VERSIONS = f"WITH {INJECTED}, v AS (SELECT *, CASE WHEN min(h) OVER k <> max(h) OVER k THEN 'CONFLICT' WHEN row_number() OVER (PARTITION BY event_id ORDER BY seq DESC, h DESC) = 1 THEN 'KEEP' ELSE 'DUPLICATE' END AS status FROM x WINDOW k AS (PARTITION BY event_id))"


def versions(spark, sf):
    return keys.classify_versions(injected(spark, sf), "event_id", "h", [F.desc("seq"), F.desc("h")])


@query(f"{VERSIONS} SELECT event_id, seq, h FROM v WHERE status = 'KEEP'")
def silver_dedup(spark, sf):
    return versions(spark, sf).where("status = 'KEEP'").select("event_id", "seq", "h")


@query(f"{VERSIONS} SELECT event_id, seq, h FROM v WHERE status = 'CONFLICT'")
def silver_conflicts(spark, sf):
    return versions(spark, sf).where("status = 'CONFLICT'").select("event_id", "seq", "h")


@query(f"WITH {INJECTED}, o AS (SELECT event_id, min(h) AS h FROM x WHERE seq = 0 AND event_id % 2 = 0 GROUP BY 1) SELECT x.event_id, x.seq, CASE WHEN o.event_id IS NULL THEN 'NEW' WHEN o.h = x.h THEN 'DUPLICATE' ELSE 'CONFLICT' END AS status FROM x LEFT JOIN o USING (event_id)")
def bronze_classify(spark, sf):
    x = injected(spark, sf)
    return keys.classify_against(x, x.where("seq = 0 and event_id % 2 = 0"), "event_id", "h").select("event_id", "seq", "status")


@query(f"WITH {E}, b AS (SELECT event_id, event_id // 997 AS batch, CASE WHEN event_id % 13 = 0 THEN us - {5 * DAY} ELSE us END AS us FROM e) SELECT event_id, batch, us < max(us) OVER (PARTITION BY batch) - {4 * DAY} AS is_late FROM b")
def silver_late_flag(spark, sf):
    b = events(spark, sf).select("event_id", F.expr("event_id div 997").alias("batch"), F.when(F.col("event_id") % 13 == 0, F.col("us") - 5 * DAY).otherwise(F.col("us")).alias("us"))
    return temporal.late_flag(b, "batch", "us", 4 * DAY).select("event_id", "batch", "is_late")


RULES = [("MISSING_SUPPLIER", "l_suppkey IS NULL"), ("SUPPLIER_NOT_FOUND", "s_suppkey IS NULL"), ("NEGATIVE_QUANTITY", "l_quantity - 2 < 0"), ("TAX_ABOVE_DISCOUNT", "l_tax > l_discount + 0.05"), ("RETURNED", "l_returnflag = 'R' AND l_quantity > 40")]
CASES = " ".join(f"WHEN {c} THEN '{n}'" for n, c in RULES)


def checked_lines(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 9 != 0").select("s_suppkey")
    return table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CASE {CASES} ELSE 'ACCEPTED' END AS code FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 0) ON l_suppkey = s_suppkey")
def silver_quality_gate(spark, sf):
    return checked_lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", first_match([(n, F.expr(c)) for n, c in RULES], "ACCEPTED").alias("code"))


@query("SELECT n, count(*) AS rows FROM (SELECT " + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in RULES) + " AS n FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 <> 0) ON l_suppkey = s_suppkey) GROUP BY 1")
def silver_violation_counts(spark, sf):
    return checked_lines(spark, sf).select(F.size(all_matches([(n, F.expr(c)) for n, c in RULES])).alias("n")).groupBy("n").agg(F.count("*").alias("rows"))


@query(f"WITH {E} SELECT event_id, coalesce(event_id - lag(event_id) OVER w <> 15, false) AS gap, coalesce(us < max(us) OVER (PARTITION BY event_id % 15 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS regression, {LAG} NOT BETWEEN 120 AND 1400 AS bad_delay FROM e WINDOW w AS (PARTITION BY event_id % 15 ORDER BY event_id)")
def silver_sequence_checks(spark, sf):
    w = Window.partitionBy(F.col("event_id") % 15).orderBy("event_id")
    e = events(spark, sf)
    return e.select("event_id", F.coalesce(F.col("event_id") - F.lag("event_id").over(w) != 15, F.lit(False)).alias("gap"), F.coalesce(F.col("us") < F.max("us").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("regression"), (~F.expr(LAG).between(120, 1400)).alias("bad_delay"))


@query(f"WITH {E}, c AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_id - 7 WHEN event_id % 7 = 0 THEN event_id + 3 END AS cause, user_id FROM e) SELECT c.event_id, CASE WHEN p.event_id IS NULL THEN 'MISSING_PARENT' WHEN p.event_id >= c.event_id THEN 'PARENT_NOT_PRIOR' ELSE 'OK' END AS causation FROM c LEFT JOIN e p ON c.cause = p.event_id WHERE cause IS NOT NULL")
def silver_causation(spark, sf):
    e = events(spark, sf)
    c = e.select("event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_id") - 7).when(F.col("event_id") % 7 == 0, F.col("event_id") + 3).alias("cause")).where("cause is not null")
    p = e.select(F.col("event_id").alias("parent"))
    return c.join(p, F.col("cause") == F.col("parent"), "left").select("event_id", F.when(F.col("parent").isNull(), "MISSING_PARENT").when(F.col("parent") >= F.col("event_id"), "PARENT_NOT_PRIOR").otherwise("OK").alias("causation"))


@query(f"{VERSIONS} SELECT count(*) AS source, count(*) FILTER (status = 'KEEP') AS accepted, count(*) FILTER (status = 'DUPLICATE') AS duplicates, count(*) FILTER (status = 'CONFLICT') AS conflicts, count(DISTINCT event_id) AS ids FROM v")
def silver_audit_counters(spark, sf):
    return versions(spark, sf).agg(F.count("*").alias("source"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("KEEP", "accepted"), ("DUPLICATE", "duplicates"), ("CONFLICT", "conflicts"))], F.count_distinct("event_id").alias("ids"))


@query("SELECT 'MISSING_PARENT' AS rule, count(*) AS failures FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 6 <> 0 WHERE n_nationkey IS NULL UNION ALL SELECT 'DUPLICATE_KEY', count(*) FROM (SELECT c_custkey // 2 FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'NEGATIVE_VALUE', count(*) FROM customer WHERE c_acctbal < 0")
def master_quality_suite(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation").where("n_nationkey % 6 != 0")
    rule = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("failures"))
    orphans = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")
    twice = c.groupBy(F.expr("c_custkey div 2").alias("k")).count().where("count > 1")
    return rule("MISSING_PARENT", orphans).unionByName(rule("DUPLICATE_KEY", twice)).unionByName(rule("NEGATIVE_VALUE", c.where("c_acctbal < 0")))


@query("SELECT event_id, '5' AS version, substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('EVT-' || event_id)), 1, 8) AS head, CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS fraction FROM events")
def deterministic_identity(spark, sf):
    e = table(spark, sf, "events")
    u = uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("EVT-"), F.col("event_id").cast("string")))
    fraction = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return e.select("event_id", F.substring(u, 15, 1).alias("version"), F.substring(u, 1, 8).alias("head"), fraction.alias("fraction"))


@query("SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM events ORDER BY 2 LIMIT 500")
def deterministic_cap(spark, sf):
    return keys.deterministic_cap(table(spark, sf, "events"), 500, "event_id").select("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("h"))


# ---- gold ------------------------------------------------------------------------------------------------------------
DIM = "d AS (SELECT c_custkey, 1 AS version, c_mktsegment AS segment, DATE '1990-01-01' AS f, DATE '1995-06-30' AS t FROM customer UNION ALL SELECT c_custkey, 2, c_mktsegment || '2', DATE '1995-07-01', NULL FROM customer WHERE c_custkey % 3 <> 0)"


def customer_versions(spark, sf):
    c = table(spark, sf, "customer")
    old = c.select("c_custkey", F.lit(1).alias("version"), F.col("c_mktsegment").alias("segment"), F.lit("1990-01-01").cast("date").alias("effective_from"), F.lit("1995-06-30").cast("date").alias("effective_to"))
    return old.unionByName(c.where("c_custkey % 3 != 0").select("c_custkey", F.lit(2).alias("version"), F.concat("c_mktsegment", F.lit("2")).alias("segment"), F.lit("1995-07-01").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to")))


@query(f"WITH {DIM} SELECT o_orderkey, coalesce(version, 0) AS version, coalesce(segment, 'UNKNOWN') AS segment FROM orders LEFT JOIN d ON o_custkey = c_custkey AND CAST(o_orderdate AS DATE) >= f AND (t IS NULL OR CAST(o_orderdate AS DATE) <= t)")
def scd2_master_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    j = temporal.scd2_join(o, customer_versions(spark, sf), "o_custkey", "c_custkey", "day")
    return j.select("o_orderkey", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("segment", F.lit("UNKNOWN")).alias("segment"))


CALENDAR = f"cal AS (SELECT range AS shift_no, range * {SHIFT} - {SHIFT_OFFSET} AS s_start, (range + 1) * {SHIFT} - {SHIFT_OFFSET} AS s_end FROM range((SELECT min(us) // {SHIFT} - 1 FROM e), (SELECT max(us) // {SHIFT} + 2 FROM e)))"


def calendar(e: DataFrame) -> DataFrame:
    ends = e.agg(F.floor(F.min("us") / SHIFT).alias("lo"), F.floor(F.max("us") / SHIFT).alias("hi"))
    n = ends.select(F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("shift_no"))
    return n.select("shift_no", (F.col("shift_no") * SHIFT - SHIFT_OFFSET).alias("s_start"), ((F.col("shift_no") + 1) * SHIFT - SHIFT_OFFSET).alias("s_end"))


@query(f"WITH {E}, {CALENDAR} SELECT event_id, shift_no FROM e JOIN cal ON us >= s_start AND us < s_end")
def shift_of_event(spark, sf):
    e = events(spark, sf)
    return temporal.interval_join(e.select("event_id", "us"), calendar(e), "us", "s_start", "s_end", SHIFT).select("event_id", "shift_no")


STATES = f"{E}, n AS (SELECT user_id, event_id, event_type, us, lead(us) OVER w AS state_end, lead(event_type) OVER w AS next_state FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), i AS (SELECT * FROM n WHERE state_end > us AND event_type IN ('error', 'signup', 'click'))"


def states(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "event_type", "us")
    return temporal.state_intervals(e, "user_id", "us", ["us", "event_id"], "event_type").where(F.col("event_type").isin("error", "signup", "click"))


@query(f"WITH {STATES} SELECT event_id, user_id, event_type, us, state_end, next_state FROM i")
def state_intervals(spark, sf):
    return states(spark, sf).select("event_id", "user_id", "event_type", "us", "state_end", "next_state")


SPLIT = f"{STATES}, {CALENDAR}, p AS (SELECT event_id, user_id, shift_no, CASE event_type WHEN 'error' THEN 'UNPLANNED' WHEN 'signup' THEN 'PLANNED' ELSE 'OTHER' END AS category, least(state_end, s_end) - greatest(us, s_start) AS piece_us FROM i JOIN cal ON us < s_end AND state_end > s_start)"


def downtime(spark, sf):
    cut = temporal.split_by_shift(states(spark, sf), "us", "state_end", SHIFT, SHIFT_OFFSET)
    return cut.select("event_id", "user_id", "shift_no", F.when(F.col("event_type") == "error", "UNPLANNED").when(F.col("event_type") == "signup", "PLANNED").otherwise("OTHER").alias("category"), (F.col("piece_end") - F.col("piece_start")).alias("piece_us"))


@query(f"WITH {SPLIT} SELECT event_id, shift_no, category, piece_us FROM p")
def downtime_by_shift(spark, sf):
    return downtime(spark, sf).select("event_id", "shift_no", "category", "piece_us")


@query(f"WITH {STATES}, {CALENDAR} SELECT i.event_id, cal.shift_no FROM i JOIN cal ON us < s_end AND state_end > s_start")
def overlap_join_shifts(spark, sf):
    a = states(spark, sf).select("event_id", F.col("us").alias("a_start"), F.col("state_end").alias("a_end"))
    b = calendar(events(spark, sf)).select("shift_no", F.col("s_start").alias("b_start"), F.col("s_end").alias("b_end"))
    return temporal.overlap_join(a, b, SHIFT).select("event_id", "shift_no")


OEE = f"""{SPLIT}, m AS (SELECT user_id, (us + {SHIFT_OFFSET}) // {SHIFT} AS shift_no, sum(k) AS total, sum(CASE WHEN k < 90 THEN k ELSE 0 END) AS good, sum(k * 2) AS ideal FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
w AS (SELECT user_id, shift_no, sum(CASE WHEN category = 'PLANNED' THEN piece_us ELSE 0 END) // 1000000 AS planned, sum(CASE WHEN category = 'UNPLANNED' THEN piece_us ELSE 0 END) // 1000000 AS unplanned FROM p GROUP BY 1, 2),
g AS (SELECT user_id, shift_no, coalesce(total, 0) AS total, coalesce(good, 0) AS good, coalesce(ideal, 0) AS ideal, 28800 AS scheduled, coalesce(planned, 0) AS planned, coalesce(unplanned, 0) AS unplanned FROM (SELECT user_id, shift_no FROM m UNION SELECT user_id, shift_no FROM w) LEFT JOIN m USING (user_id, shift_no) LEFT JOIN w USING (user_id, shift_no)),
o AS (SELECT *, greatest(0, scheduled - planned - unplanned) AS run, scheduled - planned AS loading FROM g)"""


def oee(spark, sf):
    e = events(spark, sf)
    made = e.where("event_type = 'purchase'").groupBy("user_id", F.floor((F.col("us") + SHIFT_OFFSET) / SHIFT).alias("shift_no")).agg(F.sum("k").alias("total"), F.sum(F.when(F.col("k") < 90, F.col("k")).otherwise(0)).alias("good"), F.sum(F.col("k") * 2).alias("ideal"))
    lost = downtime(spark, sf).groupBy("user_id", "shift_no").agg(*[F.expr(f"sum(case when category = '{c}' then piece_us else 0 end) div 1000000").alias(n) for c, n in (("PLANNED", "planned"), ("UNPLANNED", "unplanned"))])
    both = made.join(lost, ["user_id", "shift_no"], "full").fillna(0).withColumn("scheduled", F.lit(28800))
    return both.withColumn("run", F.greatest(F.lit(0), F.col("scheduled") - F.col("planned") - F.col("unplanned"))).withColumn("loading", F.col("scheduled") - F.col("planned"))


RATIOS = "CASE WHEN {l} > 0 THEN round(100.0 * {r} / {l}, 6) END AS availability_pct, CASE WHEN {r} > 0 THEN round(100.0 * {i} / {r}, 6) END AS performance_pct, CASE WHEN {t} > 0 THEN round(100.0 * {g} / {t}, 6) END AS quality_pct"


@query(f"WITH {OEE} SELECT user_id, shift_no, CAST(total AS BIGINT) AS total, CAST(run AS BIGINT) AS run, " + RATIOS.format(l="loading", r="run", i="ideal", t="total", g="good") + " FROM o")
def oee_refresh(spark, sf):
    pct = lambda n, d: F.round(100 * safe_div(F.col(n), F.col(d)), 6)
    return oee(spark, sf).select("user_id", "shift_no", "total", "run", pct("run", "loading").alias("availability_pct"), pct("ideal", "run").alias("performance_pct"), pct("good", "total").alias("quality_pct"))


@query(f"WITH {OEE} SELECT shift_no // 3 AS business_day, " + RATIOS.format(l="sum(loading)", r="sum(run)", i="sum(ideal)", t="sum(total)", g="sum(good)") + " FROM o GROUP BY 1")
def oee_daily(spark, sf):
    pct = lambda n, d: F.round(100 * semantic.ratio(n, d), 6)
    day = oee(spark, sf).withColumn("business_day", F.floor(F.col("shift_no") / 3))
    return semantic.measure_query(day, {"availability_pct": pct("run", "loading"), "performance_pct": pct("ideal", "run"), "quality_pct": pct("good", "total")}, ["business_day"])


@query(f"WITH {SPLIT} SELECT shift_no // 3 AS business_day, category, count(*) AS pieces, CAST(sum(piece_us) AS BIGINT) AS downtime_us FROM p GROUP BY 1, 2")
def downtime_daily(spark, sf):
    return downtime(spark, sf).groupBy(F.floor(F.col("shift_no") / 3).alias("business_day"), "category").agg(F.count("*").alias("pieces"), F.sum("piece_us").alias("downtime_us"))


@query("SELECT r_name, n_name, count(*) AS events, sum(CAST(l_quantity AS BIGINT)) AS actual, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS rejected FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def production_daily(spark, sf):
    made = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q"), "l_returnflag")
    # The facts are added up by machine before any dimension is joined.
    by = made.groupBy("l_suppkey").agg(F.count("*").alias("events"), F.sum("q").alias("actual"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("q")).otherwise(0)).alias("rejected"))
    star = by.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return star.groupBy("r_name", "n_name").agg(*[F.sum(c).alias(c) for c in ("events", "actual", "rejected")])


@query("SELECT o_orderpriority AS defect_code, count(*) AS findings, round(avg(o_totalprice), 2) AS avg_measurement, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1")
def quality_summary(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("defect_code")).agg(F.count("*").alias("findings"), F.round(F.avg("o_totalprice"), 2).alias("avg_measurement"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


@query("SELECT p_brand AS spare_part, count(*) AS orders, sum(CAST(l_quantity AS BIGINT)) AS consumed FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1")
def maintenance_summary(spark, sf):
    used = table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return used.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("spare_part")).agg(F.sum("n").alias("orders"), F.sum("q").alias("consumed"))


@query("WITH n AS (SELECT c_custkey, c_name || '*' AS c_name, 1 AS src FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, 1 FROM customer WHERE c_custkey % 50 = 0) SELECT c_custkey, c_name FROM n UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 4 = 0").withColumn("c_name", F.concat("c_name", F.lit("*"))).unionByName(c.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return keys.upsert(c, new, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name || '+' FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0")
def insert_absent_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.lit("+")))
    return keys.insert_absent(c.where("c_custkey % 2 = 0"), new, ["c_custkey"])


# ---- alerts ----------------------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {E}, c AS (SELECT user_id, us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM e WHERE event_type = 'error'),
f AS (SELECT user_id, us, event_id, r, us AS fired, true AS fires FROM c WHERE r = 1 UNION ALL SELECT c.user_id, c.us, c.event_id, c.r, CASE WHEN c.us - f.fired >= {12 * HOUR} THEN c.us ELSE f.fired END, c.us - f.fired >= {12 * HOUR} FROM f JOIN c ON c.user_id = f.user_id AND c.r = f.r + 1)
SELECT user_id, us, event_id FROM f WHERE fires""")
def cooldown_alerts(spark, sf):
    return temporal.greedy_cooldown(events(spark, sf).where("event_type = 'error'"), "user_id", "us", "event_id", 12 * HOUR)


@query(f"WITH {E}, c AS (SELECT event_id, user_id, us, event_type, min(CASE WHEN event_type = 'view' THEN us END) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {6 * HOUR} FOLLOWING) AS resolved FROM e) SELECT event_id, resolved, CASE WHEN resolved IS NULL THEN 'ESCALATED' ELSE 'RESOLVED' END AS status FROM c WHERE event_type = 'error'")
def incident_escalation(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "us", "event_type")
    e = e.withColumn("resolved", temporal.next_within(e, "user_id", "us", F.col("event_type") == "view", 6 * HOUR)).where("event_type = 'error'")
    return e.select("event_id", "resolved", F.when(F.col("resolved").isNull(), "ESCALATED").otherwise("RESOLVED").alias("status"))


@query(f"WITH {E}, g AS (SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM e) SELECT user_id, us, gap FROM g WHERE gap > {12 * HOUR}")
def communication_gaps(spark, sf):
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return events(spark, sf).select("user_id", "us", "event_id", gap.alias("gap")).where(F.col("gap") > 12 * HOUR).select("user_id", "us", "gap")


@query(f"WITH {E} SELECT event_type, us // {5 * MINUTE} * {5 * MINUTE} AS window_us, count(*) AS n FROM e GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n")).select("event_type", micros(F.col("w.start")).alias("window_us"), "n")


# ---- semantic layer --------------------------------------------------------------------------------------------------
@query("SELECT r_name, sum(CAST(l_quantity AS BIGINT)) AS units, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS yield, count(*) FILTER (l_returnflag = 'A') AS alarms, count(DISTINCT l_suppkey) AS machines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_linestatus = 'F' GROUP BY 1")
def semantic_measures(spark, sf):
    fact = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fact = fact.withColumn("good", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0))
    measures = {"units": F.sum(F.col("l_quantity").cast("long")), "yield": F.round(semantic.ratio("good", "l_quantity"), 6), "alarms": F.count_if(F.col("l_returnflag") == "A"), "machines": F.count_distinct("l_suppkey")}
    return semantic.measure_query(fact, measures, ["r_name"], F.col("l_linestatus") == "F")


DAILY = "d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)"


@query(f"WITH {DAILY} SELECT CAST(d.day AS VARCHAR) AS day, CAST(sum(d.n) OVER (PARTITION BY year(d.day) ORDER BY d.day) AS BIGINT) AS ytd, d.n - p.n AS change FROM d LEFT JOIN d p ON d.day = p.day + 1")
def semantic_time_intelligence(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return semantic.prior_day(semantic.year_to_date(d, "day", "n"), "day", "n").select(F.col("day").cast("string").alias("day"), "ytd", "change")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 8 = 1)")
def row_level_security(spark, sf):
    grants = table(spark, sf, "nation").select(F.concat(F.lit("User"), (F.col("n_nationkey") % 4).cast("string"), F.lit("@Example.org")).alias("user_name"), F.col("n_nationkey").alias("plant_id"), (F.col("n_nationkey") % 8 == 1).alias("is_active"))
    return semantic.secured(table(spark, sf, "supplier"), grants, "USER1@example.org", "s_nationkey").select("s_suppkey", "s_nationkey")


# ---- retrieval -------------------------------------------------------------------------------------------------------
@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 80) / 440.0), 1) AS BIGINT))) AS i FROM w WHERE len(w) > 0),
t AS (SELECT doc_id, i, i * 440 AS first_word, least(i * 440 + 520, len(w)) AS end_word, array_to_string(list_slice(w, i * 440 + 1, i * 440 + 520), ' ') AS x FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(first_word AS INTEGER) AS first_word, CAST(end_word AS INTEGER) AS end_word, 'KCH-' || substr(sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(i AS VARCHAR) || '|' || x), 1, 32) AS chunk_id FROM t""")
def rag_chunks(spark, sf):
    return retrieval.chunks(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "chunk_no", "first_word", "end_word", "chunk_id")


@query("WITH q AS (SELECT vec_id AS q_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q_id, b.vec_id AS b_id, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM q, embeddings b WHERE b.vec_id <> q_id) SELECT q_id, b_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, b_id) AS rank FROM p) WHERE rank <= 5")
def rag_vector_top_k(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    return retrieval.top_vectors(q, e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_vec")), 5).select("q_id", "b_id", "rank")


TERMS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')"
BM25 = f"""d AS (SELECT doc_id, {TERMS} AS terms FROM documents), q AS (SELECT item_id AS q_id, list_distinct({TERMS}) AS terms FROM benchmark), s AS (SELECT count(*) AS n, avg(len(terms)) AS al FROM d),
qt AS (SELECT q_id, unnest(terms) AS term FROM q), dt AS (SELECT doc_id, len(terms) AS l, unnest(terms) AS term FROM d), tf AS (SELECT doc_id, l, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT q_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), s GROUP BY 1, 2), ranked AS (SELECT q_id, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 4) DESC, doc_id) AS rank FROM sc)"""


def words(text: str = "text"):
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def lexical(spark, sf, k: int):
    """The k best documents by BM25 for each benchmark text, all of its words asked for."""
    docs = table(spark, sf, "documents").select("doc_id", words().alias("terms"))
    s = retrieval.bm25(docs, table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), words().alias("terms"))).withColumn("score", F.round("score", 4))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


@query(f"WITH {BM25} SELECT q_id, doc_id, score FROM ranked WHERE rank <= 5")
def rag_lexical_top_k(spark, sf):
    return lexical(spark, sf, 5).select("q_id", "doc_id", "score")


VECTORS = f"""slot AS (SELECT 'd' AS side, doc_id AS id, unnest({TERMS}) AS w FROM documents UNION ALL SELECT 'q', item_id, unnest({TERMS}) FROM benchmark), sv AS (SELECT side, id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64 AS slot, CAST(count(*) AS DOUBLE) AS n FROM slot GROUP BY ALL), nv AS (SELECT side, id, sqrt(sum(n * n)) AS norm FROM sv GROUP BY 1, 2),
cs AS (SELECT q.id AS q_id, d.id AS doc_id, round(sum(q.n * d.n) / (any_value(nq.norm) * any_value(nd.norm)), 6) AS score FROM sv q JOIN sv d ON q.slot = d.slot AND q.side = 'q' AND d.side = 'd' JOIN nv nq ON nq.side = 'q' AND nq.id = q.id JOIN nv nd ON nd.side = 'd' AND nd.id = d.id WHERE d.id <> q.id GROUP BY 1, 2)"""


def vector_ranks(spark, sf, k: int, where=None):
    base = retrieval.embed(table(spark, sf, "documents"), "doc_id", words()).select(F.col("doc_id").alias("b_id"), F.col("vector").alias("b_vec"))
    asked = retrieval.embed(table(spark, sf, "benchmark"), "item_id", words()).select(F.col("item_id").alias("q_id"), F.col("vector").alias("q_vec"))
    return retrieval.top_vectors(asked, base, k, where).select("q_id", F.col("b_id").alias("doc_id"), "score", "rank")


@query(f"WITH {BM25}, {VECTORS}, u AS (SELECT q_id, doc_id, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT q_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM cs) WHERE rank <= 20) SELECT q_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM u GROUP BY 1, 2")
def rag_hybrid_fusion(spark, sf):
    """Ranks by words and by vectors of the same texts, fused."""
    return retrieval.fuse(lexical(spark, sf, 20).select("q_id", "doc_id", "rank"), vector_ranks(spark, sf, 20).select("q_id", "doc_id", "rank"))


@query("WITH q AS (SELECT vec_id AS q_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q_id, b.vec_id AS b_id, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM q, embeddings b WHERE b.vec_id <> q_id AND label IN (1, 3)) SELECT q_id, b_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, b_id) AS rank FROM p) WHERE rank <= 5")
def rag_filtered_vector_top_k(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    return retrieval.top_vectors(q, e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b_vec"), "label"), 5, F.col("label").isin(1, 3)).select("q_id", "b_id", "rank")


#: Knowledge documents made of the driver's: a header, then the text as two sections.
HEADER = "'# Guide ' || doc_id || chr(10) || 'Document ID: DOC-' || doc_id || chr(10) || 'Version: 1.' || doc_id % 10 || '.0' || chr(10) || 'Knowledge domain: REPAIR' || chr(10) || 'Machine type: ' || CASE doc_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'CNC' ELSE 'ROB' END || chr(10)"
FLAT = "regexp_replace(coalesce(text, ''), '[\\s#]+', ' ', 'g')"
GUIDES = f"g AS (SELECT doc_id, 'Guide ' || doc_id AS title, CASE doc_id % 3 WHEN 1 THEN 'CNC' WHEN 2 THEN 'ROB' END AS mt, unnest([struct_pack(h := 'First aid', b := {FLAT}), struct_pack(h := 'Second', b := 'See ' || {FLAT})]) AS x FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(x.b, '\\s+'), lambda y: y <> '') AS ws FROM g), c AS (SELECT *, unnest(range(0, CAST(greatest(ceil((len(ws) - 80) / 440.0), 1) AS BIGINT))) AS i FROM w WHERE len(ws) > 0)"


def guides(spark, sf):
    from millrace.sources import files

    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s#]+", " ")
    text = f"{HEADER} || '## First aid' || chr(10) || flat || chr(10) || '## Second' || chr(10) || 'See ' || flat"
    docs = table(spark, sf, "documents").withColumn("flat", flat).selectExpr("CAST(doc_id AS STRING) AS source_file", f"{text} AS text")
    return retrieval.section_chunks(files.header_metadata(docs))


@query(f"WITH {GUIDES} SELECT CAST(doc_id AS VARCHAR) AS source_file, 'DOC-' || doc_id AS document_id, '1.' || doc_id % 10 || '.0' AS version, title || ' > ' || x.h AS heading_path, 'section:' || x.h || ';words:' || i * 440 || '-' || least(i * 440 + 520, len(ws)) AS source_locator, CASE WHEN mt IS NULL THEN 'ENTERPRISE' ELSE 'MACHINE_TYPE' END AS visibility_scope, mt AS visibility_value, 'KCH-' || substr(sha256('DOC-' || doc_id || '|' || '1.' || doc_id % 10 || '.0' || '|' || doc_id || '|' || 'section:' || x.h || ';words:' || i * 440 || '-' || least(i * 440 + 520, len(ws)) || '|' || array_to_string(list_slice(ws, i * 440 + 1, i * 440 + 520), ' ')), 1, 32) AS chunk_id FROM c WHERE mt IS NULL OR mt = 'CNC'")
def rag_section_chunks(spark, sf):
    """Chunks of sections that a question about CNC machines may see, without the header's own section."""
    c = guides(spark, sf).where(retrieval.visible("CNC") & (F.col("section_no") > 0))
    return c.select("source_file", "document_id", "version", "heading_path", "source_locator", "visibility_scope", "visibility_value", "chunk_id")


@query("WITH c AS (SELECT conv_id, turn, [('C' || conv_id % 5, 'D1', '1.0', 'a'), ('C' || conv_id % 7, 'D1', '1.0', 'a'), ('C0', 'D1', '1.1', 'a')] AS cited, [('C' || turn % 5, 'D1', '1.0', 'a'), ('C' || conv_id % 7, 'D1', '1.0', 'b')] AS got FROM conversations) SELECT conv_id, turn, len(list_filter(cited, lambda x: list_contains(got, x))) AS valid, CASE WHEN turn % 2 = 0 AND len(list_filter(cited, lambda x: list_contains(got, x))) = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN turn % 2 = 0 THEN 'GROUNDED' ELSE 'REFUSED' END AS status FROM c")
def rag_citation_validation(spark, sf):
    """A citation is a chunk, a document, a version and a locator; all four have to be those of a retrieved chunk."""
    cite = lambda n, version="1.0", locator="a": F.struct(F.concat(F.lit("C"), n.cast("string")), F.lit("D1"), F.lit(version), F.lit(locator))
    c = table(spark, sf, "conversations")
    cited = F.array(cite(F.col("conv_id") % 5), cite(F.col("conv_id") % 7), cite(F.lit(0), "1.1"))
    got = F.array(cite(F.col("turn") % 5), cite(F.col("conv_id") % 7, locator="b"))
    c = c.withColumn("valid_citations", retrieval.valid_citations(cited, got))
    return c.select("conv_id", "turn", F.size("valid_citations").alias("valid"), retrieval.grounded(F.when(F.col("turn") % 2 == 0, "GROUNDED").otherwise("REFUSED"), F.col("valid_citations")).alias("status"))


def _passages(sql: str) -> str:
    return f"SELECT DISTINCT id, array_to_string(list_slice(t, i + 1, i + 8), ' ') AS p FROM (SELECT id, t, unnest(range(0, len(t) - 7)) AS i FROM ({sql}))"


@query(f"WITH {BM25}, dp AS ({_passages(f'SELECT doc_id AS id, {TERMS} AS t FROM documents')}), qp AS ({_passages(f'SELECT item_id AS id, {TERMS} AS t FROM benchmark')}), x AS (SELECT DISTINCT qp.id AS q_id, dp.id AS doc_id FROM qp JOIN dp USING (p)) SELECT x.q_id, max(CASE WHEN r.rank IS NULL THEN 0 ELSE 1 END) = 1 AS hit, round(avg(CASE WHEN r.rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM x LEFT JOIN ranked r ON r.q_id = x.q_id AND r.doc_id = x.doc_id AND r.rank <= 5 GROUP BY 1")
def rag_retrieval_evaluation(spark, sf):
    """Questions are benchmark texts, expected are documents that share a passage of eight words with them, retrieved are the
    five best by words."""

    def passages(rows, key):
        grams = F.transform(F.sequence(F.lit(1), F.size("t") - 7), lambda i: F.array_join(F.slice("t", i, F.lit(8)), " "))
        return rows.select(F.col(key), words().alias("t")).where(F.size("t") >= 8).select(key, F.explode(grams).alias("p"))

    asked = passages(table(spark, sf, "benchmark"), "item_id").distinct()
    expected = passages(table(spark, sf, "documents"), "doc_id").join(asked, "p").select(F.col("item_id").alias("q_id"), F.col("doc_id").alias("d_id")).distinct()
    found = retrieval.evaluate(expected, lexical(spark, sf, 5).select("q_id", F.col("doc_id").alias("d_id"), "rank"), 5)
    return found.select("q_id", "hit", F.round("recall", 6).alias("recall"))


@query("SELECT CASE conv_id % 3 WHEN 0 THEN 'FAULT' WHEN 1 THEN 'SAFETY' ELSE 'OEE' END AS category, count(*) AS answers, count(*) FILTER (turn % 2 = 0) AS grounded, round(avg(CAST(length(text) AS DOUBLE)), 6) AS avg_length FROM conversations GROUP BY 1")
def rag_evaluation_health(spark, sf):
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("conv_id") % 3 == 0, "FAULT").when(F.col("conv_id") % 3 == 1, "SAFETY").otherwise("OEE")
    return c.groupBy(kind.alias("category")).agg(F.count("*").alias("answers"), F.count_if(F.col("turn") % 2 == 0).alias("grounded"), F.round(F.avg(F.length("text").cast("double")), 6).alias("avg_length"))


@query("SELECT conv_id, turn, role, length(text) AS answer_length, CASE WHEN turn % 2 = 0 THEN 'GROUNDED' ELSE 'REFUSED' END AS status FROM conversations WHERE role = 'assistant'")
def rag_answer_audit(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", "role", F.length("text").alias("answer_length"), F.when(F.col("turn") % 2 == 0, "GROUNDED").otherwise("REFUSED").alias("status"))
