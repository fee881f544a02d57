"""Idempotent ingestion of event files: a checkpoint for each batch, registered payload hashes for each event.

Tables live under a root folder: `checkpoint` (one row a state of a batch, the last counts), `event` (registered events),
`quarantine`. A batch that was completed is skipped; one whose file has changed, or which conflicts with what is registered,
is quarantined whole unless told otherwise. Running a batch again after a failure changes nothing that was done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import keys, silver

CHECKPOINT = "ingestion_batch_id string, simulator_run_id string, source_file_sha256 string, event_count long, accepted_event_count long, rejected_event_count long, status string, error_code string, state_no long, updated_at timestamp"


@dataclass(frozen=True)
class Result:
    ingestion_batch_id: str
    status: str
    accepted: int = 0
    duplicates: int = 0
    conflicts: int = 0


def canonical(line: str = "value"):
    """A JSON object with its keys in order, so that equal payloads have equal hashes however they were written."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(line, "map<string,string>")))))


class Store:
    """The tables of an ingestion. Reads see what is committed; a table that isn't there yet is empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def checkpoints(self) -> DataFrame:
        rows = self.spark.read.schema(CHECKPOINT).parquet(f"{self.root}/checkpoint") if self._there("checkpoint") else self.spark.createDataFrame([], CHECKPOINT)
        return keys.latest_by(rows, ["ingestion_batch_id"], ["state_no"])

    def put(self, batch: str, run: str | None, sha: str | None, status: str, events: int = 0, accepted: int = 0, rejected: int = 0, error: str | None = None) -> None:
        last = self.checkpoints().where(F.col("ingestion_batch_id") == batch).select("state_no").first()
        row = [(batch, run, sha, events, accepted, rejected, status, error, (last[0] if last else 0) + 1)]
        schema = CHECKPOINT.replace(", updated_at timestamp", "")
        self.spark.createDataFrame(row, schema).withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/checkpoint")

    def events(self) -> DataFrame:
        schema = "event_id string, payload_sha256 string"
        return self.spark.read.parquet(f"{self.root}/event").select("event_id", "payload_sha256") if self._there("event") else self.spark.createDataFrame([], schema)


def classified(store: Store, lines: DataFrame) -> DataFrame:
    """Envelopes of lines with the hash of their canonical payload and status: NEW, DUPLICATE or CONFLICT against what is
    registered, and among themselves (of equal rows one is NEW; an id with two payloads is in conflict)."""
    rows = silver.envelope(lines).withColumn("payload_sha256", F.sha2(canonical("payload"), 256))
    own = keys.classify_versions(rows, "event_id", "payload_sha256", [F.col("payload_sha256"), F.col("payload")]).withColumnRenamed("status", "__own")
    out = keys.classify_against(own, store.events(), "event_id", "payload_sha256")
    return out.withColumn("status", F.when((F.col("__own") == "CONFLICT") | (F.col("status") == "CONFLICT"), "CONFLICT").when((F.col("status") == "DUPLICATE") | (F.col("__own") == "DUPLICATE"), "DUPLICATE").otherwise("NEW")).drop("__own")


def ingest(store: Store, manifest, lines: DataFrame, sha: str | None, partial: bool = False) -> Result:
    """Ingests one batch. manifest: a row of `files.manifest`; lines: its rows (value); sha: the hash of the file as it is
    now, None if the file is gone. With `partial`, rows without a conflict are accepted and the others quarantined."""
    batch, run, want, n = manifest["ingestion_batch_id"], manifest["run"], manifest["file_sha256"], manifest["event_count"]
    done = store.checkpoints().where(F.col("ingestion_batch_id") == batch).first()
    if done is not None and done["status"] == "COMPLETED":
        return Result(batch, "SKIPPED_DUPLICATE", done["accepted_event_count"], n)
    if sha is None:
        store.put(batch, run, want, "FAILED", n, rejected=n, error="SOURCE_FILE_MISSING")
        raise FileNotFoundError(manifest["source_file"])
    if sha != want:
        store.put(batch, run, sha, "QUARANTINED", n, rejected=n, error="SOURCE_HASH_MISMATCH")
        return Result(batch, "QUARANTINED", conflicts=n)
    store.put(batch, run, want, "LOADING", n)
    rows = classified(store, lines)
    counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
    new, same, conflicts = (counts.get(s, 0) for s in ("NEW", "DUPLICATE", "CONFLICT"))
    if conflicts:
        bad = rows.where("status = 'CONFLICT'").withColumn("codes", F.array(F.lit("EVENT_ID_PAYLOAD_CONFLICT")))
        silver.quarantine(bad).withColumn("ingestion_batch_id", F.lit(batch)).write.mode("append").parquet(f"{store.root}/quarantine")
        if not partial:
            store.put(batch, run, want, "QUARANTINED", n, rejected=conflicts, error="EVENT_ID_PAYLOAD_CONFLICT")
            return Result(batch, "QUARANTINED", 0, same, conflicts)
    fresh = rows.where("status = 'NEW'").drop("status").withColumn("ingestion_batch_id", F.lit(batch))
    if new:  # one folder a batch and day, replaced as a whole, so a run after a failure doesn't add rows twice
        keys.overwrite_partitions(fresh, f"{store.root}/event", ["ingestion_batch_id", "event_date"])
    store.put(batch, run, want, "COMPLETED", n, new, conflicts)
    return Result(batch, "COMPLETED", new, same, conflicts)


def recover(store: Store, lines: DataFrame, ids: DataFrame) -> int:
    """Registers events (ids: event_id) from a source file again. An id that the file lacks, or that conflicts with what is
    registered, raises and nothing is registered; returns how many were new."""
    wanted = ids.select("event_id").distinct()
    rows = classified(store, lines).join(wanted, "event_id", "left_semi")
    if lost := wanted.join(rows.select("event_id"), "event_id", "left_anti").orderBy("event_id").first():
        raise ValueError(f"event {lost[0]} is missing from the source file")
    if bad := rows.where("status = 'CONFLICT'").orderBy("event_id").first():
        raise ValueError(f"conflicting payload for event {bad['event_id']}")
    fresh = rows.where("status = 'NEW'").drop("status").withColumn("ingestion_batch_id", F.lit("RECOVERY"))
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy("ingestion_batch_id", "event_date").parquet(f"{store.root}/event")
    return n
