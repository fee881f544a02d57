"""Balanced label propagation: linked rows move towards their neighbours' shards under capacity quotas.

A link is a named set of rows, such as all rows with one text. A row's neighbours are the other rows of its links, and
their shards are counted by link, never by pairs. Each round every row that has links proposes the shard that most of its
neighbours hold among those with room; the proposals for a shard are let in, the largest links first, as far as its quota
goes. Rows without links then even the sizes out: they are dealt by prefix sums to what each shard lacks, the large ones
first and the small ones last, so that what one step misses the next one fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

ROWS_A_BUCKET = 20_000


def _prefix(rows: DataFrame, n_rows: int, by: list[str], key: str, size: str) -> DataFrame:
    """Adds `ahead`: the sum of size before each row in the order of a 32-bit hash key, within each value of `by`, in two levels."""
    n = max(1, -(-n_rows // ROWS_A_BUCKET))
    rows = rows.withColumn("bucket", F.floor(F.col(key) * n / F.lit(1 << 32)).cast("long"))
    sums = rows.groupBy(*by, "bucket").agg(F.sum(size).alias("bucket_size"))
    outer = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(outer), F.lit(0))).drop("bucket_size")
    inner = Window.partitionBy(*by, "bucket").orderBy(key, "row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ahead", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(sums, [*by, "bucket"]).withColumn("ahead", F.col("ahead") + F.col("before")).drop("before", "bucket")


def _key(seed: str):
    return F.crc32(F.concat_ws(":", F.lit(seed), F.col("row")).cast("binary"))


def _loads(spark, rows: DataFrame, n_shards: int) -> list[int]:
    found = {r["shard"]: r["load"] for r in rows.where("shard is not null").groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    return [found.get(s, 0) for s in range(n_shards)]


def balanced_labels(rows: DataFrame, links: DataFrame, n_shards: int, scratch: Scratch, rounds: int = 3, slack: float = 0.02) -> DataFrame:
    """rows (row, size) with unique row texts, links (row, link) -> row, size, shard.

    A link that is larger than a quarter of a shard is divided into parts, by hash, before the rounds: shards fill up with
    parts that small, and links between the parts are given up for even sizes. Quotas are (1 + slack) times the mean. Only
    sums by shard reach the driver.
    """
    spark = rows.sparkSession
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    quota = (1 + slack) * total / n_shards
    sizes = links.join(rows, "row").groupBy("link").agg(F.sum("size").alias("link_size"), F.count("*").alias("members")).where("members > 1")
    sizes = sizes.select("link", F.ceil(F.col("link_size") / F.lit(max(1.0, quota / 4))).alias("parts"))
    member = links.join(rows, "row").join(sizes, "link").select("row", "size", F.concat_ws("/", "link", F.pmod(_key("part"), F.col("parts"))).alias("link"))
    member = scratch.cut(member.groupBy("row", "size", "link").agg(F.lit(1).alias("one")).drop("one"), "member")
    nodes = member.select("row", "size").distinct()
    nodes = scratch.cut(nodes.withColumn("shard", F.pmod(_key("start"), F.lit(n_shards)).cast("int")), "nodes")
    for turn in range(rounds):
        loads = _loads(spark, nodes, n_shards)
        room = [max(0, int(quota) - x) for x in loads]
        votes = member.drop("size").join(nodes, "row").groupBy("link", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
        # A part that fits goes where most of it lies; the whole part counts, so that its rows move as one.
        roomy = F.coalesce(*[F.when(F.col("shard") == s, F.lit(r)) for s, r in enumerate(room)])
        whole = votes.groupBy("link").agg(F.sum("weight").alias("all"))
        best = votes.join(whole, "link").withColumn("fits", (F.col("all") - F.col("weight") <= roomy).cast("int"))
        best = best.groupBy("link").agg(F.max(F.struct("fits", "n", F.xxhash64("link", "shard").alias("tie"), F.col("shard").alias("goal"))).alias("b"), F.max("all").alias("all"))
        best = best.select("link", "all", F.col("b.n").alias("n"), F.col("b.goal").alias("goal"))
        # A row in several links follows the one with most neighbours in the shard.
        goals = member.drop("size").join(best, "link").groupBy("row").agg(F.max(F.struct("n", "link", "goal", "all")).alias("b")).select("row", "b.link", "b.goal", "b.all")
        nodes = nodes.join(goals, "row")
        moving = nodes.where("goal != shard")
        unit = moving.groupBy("goal", F.col("link").alias("row")).agg(F.sum("size").alias("coming")).withColumn("key", _key(f"turn{turn}"))
        unit = scratch.cut(unit, "unit")
        unit = _prefix(unit, max(1, unit.count()), ["goal"], "key", "coming")
        left = F.coalesce(*[F.when(F.col("goal") == s, F.lit(r)) for s, r in enumerate(room)])
        admitted = unit.where(F.col("ahead") + F.col("coming") <= left).select(F.col("row").alias("link"), F.col("goal").alias("into"))
        nodes = scratch.cut(nodes.join(admitted, "link", "left").select("row", "size", F.when((F.col("into") == F.col("goal")), F.col("goal")).otherwise(F.col("shard")).cast("int").alias("shard")), "nodes")
    loads = _loads(spark, nodes, n_shards)
    free = scratch.cut(rows.join(nodes.select("row"), "row", "left_anti").withColumn("key", _key("free")), "free")
    bounds = free.agg(F.percentile_approx("size", [0.1, 0.3, 0.6], 1000)).first()[0] or []
    steps = [None, *sorted(set(bounds))]
    done = [nodes]
    remaining = free.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    for i in reversed(range(len(steps))):  # the largest sizes first
        some = free
        if steps[i] is not None:
            some = some.where(F.col("size") > steps[i])
        if i + 1 < len(steps):
            some = some.where(F.col("size") <= steps[i + 1])
        count, bulk = some.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not count:
            continue
        # What each shard still lacks of an equal share of all that is placed after this step, no less than nothing.
        level, order = 0.0, sorted(loads)
        for k in range(1, n_shards + 1):
            level = (bulk + sum(order[:k])) / k
            if k == n_shards or level <= order[k]:
                break
        ends, at = [], 0.0
        for x in loads:
            at += max(0.0, level - x)
            ends.append(at)
        middle = F.col("ahead") + F.col("size") / 2
        shard = F.coalesce(*[F.when(middle < e, F.lit(s)) for s, e in enumerate(ends)], F.lit(max(range(n_shards), key=lambda s: level - loads[s])))
        put = scratch.cut(_dealt(some, count, shard), "put")
        loads = [a + b for a, b in zip(loads, _loads(spark, put, n_shards))]
        done.append(put)
        remaining -= bulk
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _dealt(rows: DataFrame, n_rows: int, shard) -> DataFrame:
    return _prefix(rows.withColumn("all", F.lit(0)), n_rows, ["all"], "key", "size").select("row", "size", shard.cast("int").alias("shard"))


def slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """Adds `slot`, gapless from 0 within each shard, in the order of a hash of the row."""
    return _prefix(rows.withColumn("key", _key("slot")).withColumn("unit", F.lit(1)), n_rows, ["shard"], "key", "unit").withColumnRenamed("ahead", "slot").drop("key", "unit")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law: bytes. Size is the text's UTF-8 bytes plus 1; a null text has no bytes and crc32 0 and is linked with nothing.
    Rows with equal texts are linked. Repeated doc_ids, null ones too, are rows of their own. Placement follows from ids
    and texts alone, so reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.col("text").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), F.sha2(text, 256).alias("link"))
    # Equal rows get a number among themselves; their group is as small as the repeats of one id with one text.
    again = F.row_number().over(Window.partitionBy("doc_id", "link").orderBy("size"))
    rows = rows.withColumn("again", again).select("doc_id", "size", "text_crc32", "link", F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(F.col("again") > 1, F.concat_ws(",", "link", "again"))).alias("row"))
    rows = scratch.cut(rows, "rows")
    if rows.isEmpty():
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    placed = balanced_labels(rows.select("row", "size"), rows.where("link is not null").select("row", "link"), n_shards, scratch)
    numbered = slots(placed, rows.count())
    return rows.drop("size", "link").join(numbered, "row").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
