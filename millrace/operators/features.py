"""Features of failure prediction: unified signals, five-minute buckets, trailing statistics, causal labels, training.

Times are microseconds. A bucket's feature time is its end, so a feature never looks ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import hash_id
from millrace.operators.temporal import DAY, HOUR, MINUTE, trailing

BUCKET = 5 * MINUTE
#: The physical columns that a unified signal is taken from, in order.
SIGNALS = {
    "temperature_c": ("temperature_c", "motor_temperature_c", "chamber_temperature_c", "equipment_temperature_c"),
    "vibration_mm_s": ("vibration_mm_s",),
    "pressure_bar": ("pressure_bar", "hydraulic_pressure_bar", "discharge_pressure_bar"),
    "power_kw": ("power_kw",),
    "cycle_time_s": ("cycle_time_s",),
    "throughput_unit_min": ("production_rate_unit_min", "throughput_unit_min"),
    "quality_score_pct": ("quality_score_pct",),
    "position_error_mm": ("position_error_mm",),
    "motor_current_a": ("motor_current_a",),
    "torque_nm": ("torque_nm",),
}
#: Signals with trailing statistics, and machine type codes as numbers.
ROLLING = ("temperature_c", "vibration_mm_s", "pressure_bar", "power_kw")
SPANS = {"15m": 15 * MINUTE, "60m": HOUR}


def unified(telemetry: DataFrame, sources: dict[str, tuple[str, ...]] = SIGNALS) -> DataFrame:
    """Telemetry with one column a signal: the first of its physical columns that isn't null; columns that the table lacks
    count as null."""
    columns = {name: F.coalesce(*[F.col(c).cast("double") for c in found]) if (found := [c for c in cs if c in telemetry.columns]) else F.lit(None).cast("double") for name, cs in sources.items()}
    return telemetry.withColumns(columns)


def bucket_end(us: Column) -> Column:
    return ((F.floor(us / BUCKET) + 1) * BUCKET).cast("long")


def bucket_telemetry(telemetry: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """The last row of each machine and bucket, ties by event_id: machine_id, line_id, feature_us, operating_state, machine_type and the signals."""
    rest = ["line_id", "operating_state", "machine_type", *signals]
    last = telemetry.groupBy("machine_id", bucket_end(F.col("event_us")).alias("feature_us")).agg(F.max_by(F.struct(*rest), F.struct("event_us", "event_id")).alias("last"))
    return last.select("machine_id", "feature_us", *[F.col("last")[c].alias(c) for c in rest])


def bucket_operational(events: DataFrame) -> DataFrame:
    kinds = {"alarm_count": "AlarmRaised", "fault_count": "MachineFaulted", "communication_loss_count": "CommunicationLost"}
    return events.groupBy("machine_id", bucket_end(F.col("event_us")).alias("feature_us")).agg(*[F.count_if(F.col("event_type") == t).alias(n) for n, t in kinds.items()])


def bucket_lines(production: DataFrame) -> DataFrame:
    q = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)))
    return production.where("line_id is not null").groupBy("line_id", bucket_end(F.col("event_us")).alias("feature_us")).agg(q("actual_quantity").alias("line_actual_quantity"), q("loss_quantity").alias("line_loss_quantity"))


def time_context(features: DataFrame, codes: dict[str, int], offset: int = 330 * MINUTE) -> DataFrame:
    """shift_code 1 to 3 by the local hour, the hour as a point on a circle, the machine type as a number."""
    hour = F.pmod(F.floor((F.col("feature_us") + offset) / HOUR), F.lit(24)).cast("int")
    turn = 2 * F.pi() * hour / 24
    code = F.lit(None).cast("int")
    for name, number in codes.items():
        code = F.when(F.col("machine_type") == name, number).otherwise(code)
    shift = F.when((hour >= 6) & (hour < 14), 1).when((hour >= 14) & (hour < 22), 2).otherwise(3)
    return features.withColumns({"shift_code": shift, "hour_sin": F.sin(turn), "hour_cos": F.cos(turn), "machine_type_code": code})


def rolling(features: DataFrame, lines: DataFrame) -> DataFrame:
    """33 trailing columns. Signals and counts look back over a machine's features; line quantities over the line's own
    buckets (line_id, feature_us, line_actual_quantity, line_loss_quantity), so that a line with many machines isn't counted
    many times."""
    columns: dict[str, Column] = {}
    for label, span in SPANS.items():
        w = trailing("machine_id", "feature_us", span)
        for s in ROLLING:
            columns |= {f"{s}_mean_{label}": F.avg(s).over(w), f"{s}_std_{label}": F.stddev_pop(s).over(w), f"{s}_delta_{label}": F.col(s) - F.first(s, True).over(w)}
        columns[f"alarm_count_{label}"] = F.sum("alarm_count").over(w)
    columns["communication_loss_count_60m"] = F.sum("communication_loss_count").over(trailing("machine_id", "feature_us", HOUR))
    columns["fault_count_24h"] = F.sum("fault_count").over(trailing("machine_id", "feature_us", DAY))
    columns["utilization_proxy_15m"] = F.avg((F.coalesce(F.col("operating_state") == "RUNNING", F.lit(False))).cast("double")).over(trailing("machine_id", "feature_us", 15 * MINUTE))
    out = features.withColumns(columns)
    # Line windows at the features' own times: buckets and asked times of a line in one sorted run.
    asked = features.select("line_id", "feature_us").distinct().withColumn("__asked", F.lit(True)).withColumn("line_actual_quantity", F.lit(0.0)).withColumn("line_loss_quantity", F.lit(0.0))
    both = asked.unionByName(lines.withColumn("__asked", F.lit(False)))
    sums = {f"line_{k}_quantity_{label}": F.sum(f"line_{k}_quantity").over(trailing("line_id", "feature_us", span)) for label, span in SPANS.items() for k in ("actual", "loss")}
    at = both.withColumns(sums).where("__asked").select(F.col("line_id").alias("__line"), F.col("feature_us").alias("__us"), *sums)
    return out.join(at, F.col("line_id").eqNullSafe(F.col("__line")) & (F.col("feature_us") == F.col("__us")), "left").drop("__line", "__us")


def machine_age(features: DataFrame, machines: DataFrame) -> DataFrame:
    """machine_age_days since the installation date of the machine's current row; null where there is none."""
    now = machines.where("is_current").select(F.col("machine_id").alias("__m"), "installation_date")
    day = F.timestamp_micros("feature_us").cast("date")
    return features.join(now, F.col("machine_id") == F.col("__m"), "left").withColumn("machine_age_days", F.datediff(day, F.col("installation_date")).cast("double")).drop("__m", "installation_date")


def build(telemetry: DataFrame, operational: DataFrame, production: DataFrame, machines: DataFrame, codes: dict[str, int], version: str) -> DataFrame:
    """All features: buckets, counts (0 where there are none), context, trailing columns, age, feature_id."""
    base = bucket_telemetry(unified(telemetry), tuple(SIGNALS))
    base = base.join(bucket_operational(operational), ["machine_id", "feature_us"], "left").fillna(0, ["alarm_count", "fault_count", "communication_loss_count"])
    out = machine_age(rolling(time_context(base, codes), bucket_lines(production)), machines)
    return out.withColumn("feature_id", hash_id(F.col("machine_id"), F.timestamp_micros("feature_us").cast("string"), F.lit(version))).withColumn("feature_version", F.lit(version))


def causal_labels(features: DataFrame, faults: DataFrame, version: str, horizon: int = HOUR) -> DataFrame:
    """Labels of features (feature_id, machine_id, feature_us) from faults (machine_id, event_us, event_id,
    failure_mode_code): whether the machine faults in (t, t + horizon], which fault is next, and whether the horizon
    reaches beyond the machine's last feature without one (censored, so not valid).

    Features and faults are sorted into one run for each machine; the next fault comes from one forward window, so a
    machine with many faults gives no pairs.
    """
    x = features.select("machine_id", F.col("feature_us").alias("us"), "feature_id", F.lit(None).cast("struct<us:bigint,id:string,mode:string>").alias("fault"))
    y = faults.select("machine_id", F.col("event_us").alias("us"), F.lit(None).cast("string").alias("feature_id"), F.struct(F.col("event_us").alias("us"), F.col("event_id").alias("id"), F.col("failure_mode_code").alias("mode")).alias("fault"))
    ahead = Window.partitionBy("machine_id").orderBy("us").rangeBetween(1, horizon)
    every = Window.partitionBy("machine_id")
    rows = x.unionByName(y).withColumn("next", F.min("fault").over(ahead)).withColumn("end", F.max(F.when(F.col("feature_id").isNotNull(), F.col("us"))).over(every)).where("feature_id is not null")
    censored = F.col("next").isNull() & (F.col("us") > F.col("end") - horizon)
    return rows.select("feature_id", F.lit(version).alias("label_version"), F.lit(horizon // MINUTE).cast("int").alias("label_horizon_minutes"), F.col("next").isNotNull().cast("int").alias("label_failure"), (~censored).alias("label_valid"), F.col("next.id").alias("next_fault_event_id"), F.col("next.us").alias("next_fault_us"), F.col("next.mode").alias("label_failure_mode_code"), F.lit("CAUSAL_MACHINE_FAULT_EVENT").alias("label_source"), censored.alias("right_censored"))


def training_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with valid labels, without those of machines that stand for a fault or maintenance; an unknown state goes too."""
    return features.join(labels.where("label_valid"), "feature_id").where(~F.col("operating_state").isin("FAULT", "MAINTENANCE"))


# ---- training, registry, scoring -------------------------------------------------------------------------------------
def candidates(columns: list[str], label: str, params: dict[str, dict]) -> dict:
    """Pipelines by name: tree regressors on a 0/1 label. `random_forest` draws bootstrap samples; `extra_trees` stands for
    trees that see all rows and fewer features and split points, the nearest that MLlib has."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    def pipeline(name: str, p: dict):
        extra = {"bootstrap": False, "maxBins": 8, "featureSubsetStrategy": "onethird"} if name == "extra_trees" else {"featureSubsetStrategy": "sqrt"}
        forest = RandomForestRegressor(featuresCol="__vector", labelCol=label, predictionCol="__score", seed=p.get("seed", 42), numTrees=p.get("trees", 50), maxDepth=p.get("depth", 8), minInstancesPerNode=p.get("leaf", 5), **extra)
        filled = [f"__{c}" for c in columns]
        return Pipeline(stages=[Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__vector"), forest])

    return {name: pipeline(name, p) for name, p in params.items()}


def scored(model, rows: DataFrame, score: str = "score") -> DataFrame:
    """Rows with the model's score, clamped to 0 and 1."""
    out = model.transform(rows)
    return out.select(*rows.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__score")).alias(score))


def train(train_rows: DataFrame, validation: DataFrame, test: DataFrame, columns: list[str], label: str, params: dict[str, dict], registry: str, name: str, recall: float = 0.8) -> dict:
    """Fits the candidates, picks the best by average precision (then AUC, then RMSE), fits it again on training and
    validation rows, saves it as the next version under registry/name and returns its audit row. Every split has to hold
    positive rows."""
    from millrace.operators import learning

    for part, df in (("train", train_rows), ("validation", validation), ("test", test)):
        if df.where(F.col(label) == 1).isEmpty():
            raise ValueError(f"the {part} rows hold no positive example")
    spark, results = train_rows.sparkSession, []
    pipelines = candidates(columns, label, params)
    for candidate, pipeline in pipelines.items():
        on = scored(pipeline.fit(train_rows), validation)
        m = learning.metric_bundle(on, "score", label).first()
        t = learning.threshold_for_recall(on, "score", label, recall).first()
        results.append((-m["average_precision"], -m["roc_auc"], m["rmse"], candidate, t["threshold"] if t else 0.5))
    best = min(results)
    model = pipelines[best[3]].fit(train_rows.unionByName(validation))
    m = learning.metric_bundle(scored(model, test), "score", label).first()
    version = next_version(spark, f"{registry}/{name}")
    model.write().save(f"{registry}/{name}/{version}")
    return {"model_name": name, "model_version": version, "candidate": best[3], "operational_threshold": float(best[4]), "test_roc_auc": m["roc_auc"], "test_average_precision": m["average_precision"], "test_rmse": m["rmse"], "test_brier": m["brier"]}


def next_version(spark, path: str) -> int:
    """One more than the highest version saved under a path, which may be in any store that Spark reads."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()] if fs.exists(root) else []
    return max(found, default=0) + 1


def load_model(path: str, name: str, version: int):
    """A model by its explicit name and version."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/{name}/{version}")


def enrich(rows: DataFrame, call, key: str, score: str = "failure_risk_score") -> DataFrame:
    """Rows with a score and a status from an endpoint: call(list of dicts) -> list of numbers. A batch that fails keeps its
    rows, with a null score and status FAILED."""
    schema = rows.schema

    def work(batches):
        for pdf in batches:
            try:
                got, status = list(call(pdf.to_dict("records"))), "SCORED"
            except Exception:  # noqa: BLE001  the policy: never lose rows to the endpoint
                got, status = [None] * len(pdf), "FAILED"
            yield pdf.assign(**{score: got, "score_status": status}).astype({score: "float64"})

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return rows.mapInPandas(work, StructType([*schema.fields, StructField(score, DoubleType()), StructField("score_status", StringType())]))
