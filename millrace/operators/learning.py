"""Evaluation, drift and sampling for scored rows, all as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_score(df: DataFrame, score: str, label: str, parts: int = 256) -> DataFrame:
    """One row a distinct score: positives, negatives, and both cumulated from the highest score down.

    The sums go in two levels: within ranges of scores of about equal width, which tasks sort on their own, and over the
    ranges' totals, of which there are at most `parts`.
    """
    counts = df.groupBy(score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    ends = counts.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(parts - 1), F.floor((F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * parts))).otherwise(0).cast("int")
    dealt = counts.crossJoin(F.broadcast(ends)).withColumn("__part", at).drop("__lo", "__hi")
    higher = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # over at most `parts` rows
    before = dealt.groupBy("__part").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    before = before.select(F.col("__part").alias("__q"), F.coalesce(F.sum("__p").over(higher), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__n").over(higher), F.lit(0)).alias("__fp"))
    down = Window.partitionBy("__part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down)).join(F.broadcast(before), F.col("__part").eqNullSafe(F.col("__q")))
    return summed.select(score, "pos", "neg", (F.col("tp") + F.col("__tp")).alias("tp"), (F.col("fp") + F.col("__fp")).alias("fp"))


def metric_bundle(df: DataFrame, score: str, label: str) -> DataFrame:
    """roc_auc, average_precision, brier and rmse in one row; ties share a threshold."""
    curve = by_score(df.select(F.col(score).alias("s"), F.col(label).cast("long").alias("y")), "s", "y")
    total = curve.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    errors = df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))
    return total.crossJoin(errors).select((F.col("area") / (F.col("p") * F.col("n"))).alias("roc_auc"), (F.col("ap") / F.col("p")).alias("average_precision"), "brier", F.sqrt("brier").alias("rmse"))


def threshold_for_recall(df: DataFrame, score: str, label: str, recall: float) -> DataFrame:
    """The threshold with the best precision among those with the recall; the highest such threshold of equals."""
    curve = by_score(df.select(F.col(score).alias("s"), F.col(label).cast("long").alias("y")), "s", "y")
    total = curve.crossJoin(F.broadcast(curve.agg(F.sum("pos").alias("p"))))
    fit = total.where(F.col("tp") >= recall * F.col("p")).select(F.col("s").alias("threshold"), (F.col("tp") / F.col("p")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    return fit.orderBy(F.desc("precision"), F.desc("threshold")).limit(1)


def psi(baseline: DataFrame, recent: DataFrame, value: str, bins: int = 10, floor: float = 1e-6, accuracy: int | None = None) -> DataFrame:
    """Population stability index over quantile bins of the baseline; fewer than three edges: 0. The edges, bins + 1 numbers,
    are found once. Exact quantiles gather the distinct values in one task; `accuracy` asks for approximate ones instead."""
    shares_of = [i / bins for i in range(bins + 1)]
    quantiles = F.percentile(value, shares_of) if accuracy is None else F.percentile_approx(value, shares_of, accuracy)
    edges = baseline.agg(F.array_sort(F.array_distinct(quantiles)).alias("edges")).first()["edges"] or []
    inner = [float(e) for e in edges[1:-1]]

    def counts(df: DataFrame, name: str) -> DataFrame:
        v = F.col(value).cast("double")
        place = sum(((v > e).cast("int") for e in inner), F.lit(0))
        return df.where(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias(name))

    both = counts(baseline, "a").join(counts(recent, "b"), "bin", "full").fillna(0, ["a", "b"])
    every = Window.partitionBy(F.lit(1))  # over at most `bins` rows
    a, b = (F.greatest(F.col(c) / F.greatest(F.sum(c).over(every), F.lit(1)), F.lit(floor)) for c in ("a", "b"))
    return both.select(((b - a) * F.log(b / a)).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("psi"))


def chronological_split(df: DataFrame, at: str, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Adds split by shares of the time span, not of the rows. The two ends of the span are found first."""
    low, high = df.agg(F.min(at), F.max(at)).first()
    place = F.try_divide(F.col(at) - F.lit(low), F.lit(None if low is None else high - low))  # no span: all is test
    return df.withColumn("split", F.when(place < train, "train").when(place < train + valid, "validation").otherwise("test"))


def balanced_sample(df: DataFrame, label: str, ratio: int, most: int, *key: str) -> DataFrame:
    """At most `most` rows with at most `ratio` negatives a positive, chosen by a hash of the key. The limits are the
    sample; each task keeps its first rows, so no label is sorted in one task."""
    order = F.sha2(F.concat_ws("|", *key), 256)
    cap = most // (ratio + 1)
    positives = df.where(F.col(label) == 1).orderBy(order).limit(cap)
    n = positives.count()
    return positives.unionByName(df.where(F.col(label) == 0).orderBy(order).limit(min(ratio * n, most - n)))


def psi_with_nan(baseline: DataFrame, recent: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """As psi, but NaN where either side has no value."""
    some = baseline.agg(F.count(value).alias("__a")).crossJoin(F.broadcast(recent.agg(F.count(value).alias("__b"))))
    found = psi(baseline, recent, value, bins).crossJoin(F.broadcast(some))
    return found.select(F.when((F.col("__a") > 0) & (F.col("__b") > 0), F.col("psi")).otherwise(F.lit(float("nan"))).alias("psi"))


def prediction_outcomes(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions with the valid label of their feature."""
    return predictions.join(labels.where("label_valid").select("feature_id", "label_failure"), "feature_id")


def gates(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """A row a metric of a one-row table: metric, value, threshold, status. limits: metric -> ("min" or "max", threshold);
    an unknown or NaN value is UNKNOWN."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.lit(kind).alias("kind")) for m, (kind, t) in limits.items()])
    out = metrics.select(F.explode(rows).alias("r")).select("r.*")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return out.select("metric", "value", "threshold", F.when(F.col("value").isNull() | F.isnan("value"), "UNKNOWN").when(ok, "PASS").otherwise("BREACH").alias("status"))
