"""Mixing of sources to target weights: hash keys, a range sort within each source, prefix sums, a cut at the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, word_count


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """sources (source, source_size) with rank and target.

    Sources rank by code point, null last, and weigh `weights` in turn. They share `budget` times all sizes, none more than
    `most` times its own size; what is above is shared anew by weight until none is above. That end is reached directly:
    with sources by size over weight, those before the first that the shared level doesn't fill stop at their bound.
    Sources of size 0 have target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.col("rank") - 1) % len(weights)
    weight = F.coalesce(*[F.when(turn == i, F.lit(w)) for i, w in enumerate(weights)])
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("stopped", F.coalesce(F.sum(most * F.col("source_size")).over(ahead), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(behind))
        .withColumn("open", F.col("weight") * (budget * F.col("total") - F.col("stopped")) <= most * F.col("source_size") * F.col("open_weight"))
    )
    first = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "rank", "stopped", "open_weight"))).over(everything)
    level = level.withColumn("first", first)
    share = (budget * F.col("total") - F.col("first.stopped")) * F.col("weight") / F.col("first.open_weight")
    target = F.when(F.col("first").isNull() | (F.struct(F.col("source_size") / F.col("weight"), "rank") < F.struct("first.col1", "first.rank")), (most * F.col("source_size")).cast("double")).otherwise(share)
    return level.select("source", "source_size", "rank", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, cut: str = "exact", rows_a_bucket: int = 4_000) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken, epochs.

    Each source goes through its documents in the order of md5("mix:" + doc_id): as many whole epochs as its target
    holds, then once more until the rest is used up. The last document of a source is cut at the exact budget
    (cut="exact"), or is taken whole if at least half of it fits (cut="whole"). Null text: size 0; a null doc_id is the
    text "null" in its key; rows of one key go by size, and equal ones in any order, which gives the same rows.

    Prefix sums have two levels: sums of hash ranges of each source, then sums within a range. A range has about
    `rows_a_bucket` rows whatever share of the rows its source has.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("key", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    rows = Scratch(docs.sparkSession, "mixture").cut(rows, "rows")  # texts are read once; what follows works on sizes
    counted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).select("source", "source_size"), weights, budget, most)
    per_source = rows.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_rows"))
    counted = counted.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # The source table has a row a source; the hint is left to the size that the optimizer sees.
    named = rows.withColumnRenamed("source", "own").join(counted, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    named = named.withColumn("bucket", F.floor(spread * F.ceil(F.col("n_rows") / rows_a_bucket)).cast("long"))
    sums = named.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = named.withColumn("upto", F.sum("size").over(inside)).join(sums.drop("bucket_size"), ["rank", "bucket"])
    ahead = F.col("before") + F.col("upto") - F.col("size")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    if cut == "exact":
        once_more = F.greatest(F.lit(0), F.least(F.col("size"), rest - ahead))
    else:
        once_more = F.when(ahead + F.col("size") / 2 <= rest, F.col("size")).otherwise(0)
    fits = (once_more > 0).cast("long") if cut == "exact" else ((ahead + F.col("size") / 2 <= rest) & (rest > 0)).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + once_more).cast("long").alias("taken"), (whole + fits).alias("epochs"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of docs as often as the mix takes them, whole, with all their columns. Rows without words count as taken.

    A source's cut is a place in its order, so each row decides by its own key: a row a source is all that is joined.
    """
    taken = mix(docs, weights, budget, most, cut="whole")
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("int")
    ends = taken.withColumn("whole", whole).groupBy(F.col("source").alias("__source")).agg(F.first("whole").alias("__whole"), F.max(F.when(F.col("epochs") > F.col("whole"), F.struct(key.alias("key"), F.col("size").alias("size")))).alias("__end"))
    place = F.struct(key.alias("key"), word_count(F.col("text")).alias("size"))
    joined = docs.join(ends, F.col("source").eqNullSafe(F.col("__source")))
    times = F.col("__whole") + F.coalesce((place <= F.col("__end")).cast("int"), F.lit(0))
    return joined.withColumn("__times", F.explode(F.sequence(F.lit(0), times))).where("__times > 0").select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped, sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, row_number() OVER (ORDER BY source_size / weight, rank) AS place FROM w),
f AS (SELECT place, stopped, open_weight FROM l WHERE weight * (CAST(1.5 AS DOUBLE) * total - stopped) <= 2 * source_size * open_weight ORDER BY place LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN f.place IS NULL OR l.place < f.place THEN CAST(2 * source_size AS DOUBLE) ELSE (CAST(1.5 AS DOUBLE) * CAST(total AS DOUBLE) - CAST(f.stopped AS DOUBLE)) * weight / CAST(f.open_weight AS DOUBLE) END AS target FROM l LEFT JOIN f ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(whole * size + greatest(0, least(size, round(target - whole * source_size) - ahead)) AS BIGINT) AS taken FROM p
"""
