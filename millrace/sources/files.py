"""Sources and sinks: partitioned JSON lines, manifests, tables with date bounds, seeds, documents, settings, audit rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The production event types of the contract.
PRODUCTION = (
    "ProductionOrderCreated", "ProductionOrderReleased", "ProductionStarted", "BatchStarted", "UnitProduced",
    "BatchCompleted", "ProductionPaused", "ProductionResumed", "ProductionCompleted", "ProductionLossRecorded",
)


def stream_name(event_type: Column) -> Column:
    """telemetry, production or operational; a null or empty type has no stream."""
    return F.when(event_type == "MachineTelemetry", "telemetry").when(event_type.isin(*PRODUCTION), "production").when(event_type != "", "operational")


# ---- reading ---------------------------------------------------------------------------------------------------------
def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with partition columns (event_type=, event_date=, plant_id=), file and SHA-256; blank lines are left out.
    Spark lists the files; a result sorted by source_file is in the order of their names."""
    lines = spark.read.text(path).withColumn("source_file", F.col("_metadata.file_path"))
    return lines.where(F.length(F.trim("value")) > 0).withColumn("payload_sha256", F.sha2("value", 256))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("file_sha256"))


def manifest(lines: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """A row a file: counts, sequence range, run, first schema version, stream and plant, batch id; with hashes
    (source_file, file_sha256) of the file's bytes. mixed_runs marks a file of several runs (or of rows without one beside
    rows with one); a complete file has one run, a stream, a date, a plant and rows."""
    field = lambda n: F.get_json_object("value", f"$.{n}")
    run, seq = field("simulator_run_id"), field("generation_sequence").try_cast("long")
    of = lambda n: F.first(F.col(n), True) if n in lines.columns else F.first(F.lit(None).cast("string"), True)
    out = lines.groupBy("source_file").agg(
        F.count("*").alias("event_count"), F.min(seq).alias("first_sequence"), F.max(seq).alias("last_sequence"), F.min(run).alias("run"), F.max(run).alias("__last"), F.count(run).alias("__runs"),
        F.min(field("schema_version")).alias("schema_version"), F.coalesce(F.first(stream_name(field("event_type")), True), of("event_type")).alias("event_type"), of("event_date").cast("string").alias("event_date"), F.coalesce(F.first(field("plant_id"), True), of("plant_id")).alias("plant_id"),
    )
    out = out.withColumn("mixed_runs", (F.col("run") != F.col("__last")) | ((F.col("__runs") > 0) & (F.col("__runs") < F.col("event_count"))))
    out = out.withColumn("complete", F.col("run").isNotNull() & ~F.col("mixed_runs") & F.col("event_type").isNotNull() & F.col("event_date").isNotNull() & F.col("plant_id").isNotNull()).drop("__last", "__runs")
    out = out.join(hashes, "source_file", "left") if hashes is not None else out.withColumn("file_sha256", F.lit(None).cast("string"))
    key = F.concat_ws("|", "run", "source_file", "file_sha256", F.coalesce(F.col("first_sequence").cast("string"), F.lit("")), F.coalesce(F.col("last_sequence").cast("string"), F.lit("")), "event_count")
    return out.withColumn("ingestion_batch_id", F.concat(F.lit("IBT-"), F.sha2(key, 256)))


def require_complete(manifests: DataFrame) -> DataFrame:
    """The manifests, or an error that names a file which isn't complete."""
    bad = manifests.where(~F.col("complete")).orderBy("source_file").limit(1).collect()
    if bad:
        raise ValueError(("mixed runs in " if bad[0]["mixed_runs"] else "incomplete partition: ") + bad[0]["source_file"])
    return manifests


def read_between(spark: SparkSession, path: str, column: str = "event_date", first: str | None = None, last: str | None = None) -> DataFrame:
    """A table with inclusive date bounds on a partition column, so only those folders are read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col(column) >= F.lit(first).cast("date"))
    return df if last is None else df.where(F.col(column) <= F.lit(last).cast("date"))


def required(spark: SparkSession, *paths: str) -> list[DataFrame]:
    """Tables that have to be there; the first one that isn't raises before anything runs."""
    jvm, out = spark._jvm, []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(path)
    for path in paths:
        out.append(spark.read.parquet(path))
    return out


def read_csv(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).csv(path)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{path}: {n} rows, {rows} expected")
    return df


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark questions, one JSON object a line."""
    return spark.read.schema("question_id string, question string, expected_documents array<string>, category string").json(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings from a YAML subset: nested `key: value` and `- item` by indentation, comments, JSON scalars or plain texts.
    Anchors, flow mappings of plain texts and multi-line texts raise."""
    rows = []
    for line in spark.read.text(path, wholetext=True).first()[0].splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if line.strip():
            rows.append((len(line) - len(line.lstrip()), line.strip()))
    value, at = _settings(rows, 0, rows[0][0]) if rows else ({}, 0)
    if at != len(rows):
        raise ValueError(f"not in the subset: {rows[at][1]}")
    return value


def _scalar(text: str):
    if text[:1] in ("&", "*", "|", ">", "{"):
        raise ValueError(f"not in the subset: {text}")
    if text.startswith("["):
        return [_scalar(x.strip()) for x in text.strip("[]").split(",") if x.strip()]
    try:
        return json.loads(text)
    except ValueError:
        return {"true": True, "false": False, "null": None, "~": None}.get(text.lower(), text.strip("'"))


def _settings(rows: list[tuple[int, str]], at: int, depth: int):
    """The block that begins at a row, and the row after it."""
    out: dict | list = [] if rows[at][1].startswith("-") else {}
    while at < len(rows) and rows[at][0] == depth:
        text = rows[at][1]
        if isinstance(out, list):
            if not text.startswith("-"):
                break
            inner = text[1:].strip()
            if re.match(r"[^\s:]+:(\s|$)", inner):  # an entry that begins on the dash's own line
                rows[at] = (depth + 2, inner)
                value, at = _settings(rows, at, depth + 2)
            else:
                value, at = _scalar(inner), at + 1
            out.append(value)
            continue
        key, _, value = text.partition(":")
        at += 1
        if value.strip():
            out[key] = _scalar(value.strip())
        elif at < len(rows) and (rows[at][0] > depth or (rows[at][0] == depth and rows[at][1].startswith("-"))):
            out[key], at = _settings(rows, at, rows[at][0])
        else:
            out[key] = None
    return out, at


def stream_lines(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of JSON objects, one a line, from files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def context_row(view: DataFrame, machine: str) -> DataFrame:
    """The row of one machine of a view that has one each; the limit is the lookup."""
    return view.where(F.col("machine_id") == machine).limit(1)


def last_incidents(incidents: DataFrame, machine: str, n: int = 10) -> DataFrame:
    """A machine's last n incidents, newest first; the limit is the feature."""
    return incidents.where(F.col("machine_id") == machine).orderBy(F.desc("event_us"), F.desc("event_id")).limit(n)


def header_metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """Document id, version, title, domain and machine type from a document's head, with defaults."""
    get = lambda p, other: F.coalesce(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(other))
    return docs.select("*", get(r"Document ID:\s*(DOC-[A-Z0-9-]+)", "DOC-UNKNOWN").alias("document_id"), get(r"Version:\s*([0-9]+\.[0-9]+\.[0-9]+)", "0.0.0").alias("version"), F.trim(get(r"(?m)^#\s+(.+)$", "Untitled")).alias("title"), get(r"Knowledge domain:\s*([A-Z_]+)", "STANDARD_OPERATING_PROCEDURE").alias("domain"), F.nullif(get(r"Machine type:\s*([A-Z_]+|null)", "null"), F.lit("null")).alias("machine_type"))


# ---- writing ---------------------------------------------------------------------------------------------------------
def write_json_lines(df: DataFrame, path: str, partitions: list[str], order: list[str], strict: str | None = None) -> None:
    """JSON lines by partition, in order. `strict` names a sequence that has to grow in each partition, or nothing is written."""
    if strict is not None:
        counts = df.groupBy(*partitions).agg(F.count("*").alias("n"), F.count_distinct(strict).alias("d"))
        if not counts.where("n <> d").isEmpty():
            raise ValueError(f"{strict} doesn't grow strictly in every partition")
    df.repartition(*partitions).sortWithinPartitions(*partitions, *order).write.mode("append").partitionBy(*partitions).json(path)


def run_manifest(events: DataFrame, stream: str, at: str, seq: str) -> DataFrame:
    """A row a stream: how many events, the first and last time and sequence."""
    return events.groupBy(stream).agg(F.count("*").alias("event_count"), F.min(at).alias("first_time"), F.max(at).alias("last_time"), F.min(seq).alias("first_sequence"), F.max(seq).alias("last_sequence"))


def write_production(events: DataFrame, path: str) -> DataFrame:
    """Production events as JSON lines by date and plant, ordered by time, sequence and id; returns their manifest."""
    write_json_lines(events, path, ["event_date", "plant_id"], ["event_time", "generation_sequence", "event_id"])
    return events.groupBy("event_date", "plant_id").agg(F.count("*").alias("event_count"), F.min("generation_sequence").alias("first_sequence"), F.max("generation_sequence").alias("last_sequence"))


def write_quarantine(records: DataFrame, path: str) -> None:
    """Quarantine records as JSON lines by date and type."""
    records.write.mode("append").partitionBy("event_date", "event_type").json(path)


def reload_dimension(dim: DataFrame, path: str) -> None:
    """Replaces a dimension. Spark's commit moves files into place only when all are written."""
    dim.write.mode("overwrite").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a table with whatever schema the new rows have."""
    df.write.mode("overwrite").option("overwriteSchema", "true").parquet(path)


def append_by(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def append_audit(spark: SparkSession, path: str, counts: DataFrame) -> None:
    counts.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def publish(events: DataFrame, send: Callable[[list[str]], None], limit: int = 1 << 20) -> DataFrame:
    """Sends rows as JSON texts in batches of at most `limit` bytes, each partition on its own; an event that is larger
    raises. Returns (batches, events, bytes) of each partition; nothing is sent before the result is read."""

    def work(tables):
        for table in tables:
            batches = events_ = total = size = 0
            held: list[str] = []
            for text in table.column(0).to_pylist():
                n = len(text.encode())
                if n > limit:
                    raise ValueError(f"an event of {n} bytes is larger than a batch")
                if size + n > limit:
                    send(held)
                    batches, held, size = batches + 1, [], 0
                held.append(text)
                events_, total, size = events_ + 1, total + n, size + n
            if held:
                send(held)
                batches += 1
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"batches": [batches], "events": [events_], "bytes": [total]}, pa.schema([("batches", pa.int64()), ("events", pa.int64()), ("bytes", pa.int64())]))

    return events.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(work, "batches long, events long, bytes long")
