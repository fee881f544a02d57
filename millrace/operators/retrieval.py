"""Chunks, embeddings, lexical and vector retrieval under filters, rank fusion, citations, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import hash_id
from millrace.sources.scratch import cut

#: Query vectors that one pass over the base holds; more queries take more passes.
QUERIES_A_PASS = 20_000


def chunks(docs: DataFrame, key: str, text: str, size: int = 520, overlap: int = 80) -> DataFrame:
    """Runs of `size` words, each beginning `overlap` words before the end of the one before; the last ends with the text."""
    step = size - overlap
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    rows = docs.select(key, words.alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.ceil((F.size("w") - overlap) / F.lit(step)), F.lit(1)).cast("int")
    rows = rows.select(key, "w", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("chunk_no", "i"))
    part = F.slice("w", F.col("i") * step + 1, F.lit(size))
    out = rows.select(key, "chunk_no", (F.col("i") * step).alias("first_word"), F.least(F.col("i") * step + size, F.size("w")).alias("end_word"), F.array_join(part, " ").alias("chunk_text"))
    return out.withColumn("chunk_id", hash_id(F.col(key).cast("string"), F.col("chunk_no").cast("string"), F.col("chunk_text"), prefix="KCH-", length=32))


def section_chunks(docs: DataFrame, size: int = 520, overlap: int = 80) -> DataFrame:
    """docs of `files.header_metadata` (source_file, text, document_id, version, title, domain, machine_type): chunks of each
    section. A section begins at a line `## heading`; what stands before the first one is a section headed by its first line.
    heading_path, source_locator, visibility and chunk_id are those of the knowledge base."""
    parts = docs.select("*", F.posexplode(F.split("text", r"(?m)^##[ \t]+")).alias("section_no", "section"))
    head = F.trim(F.regexp_extract(F.ltrim("section"), r"^([^\n]*)", 1))
    body = F.regexp_replace(F.ltrim("section"), r"^[^\n]*\n?", "")
    rows = parts.where(F.length(F.trim("section")) > 0).withColumn("heading", head).withColumn("body", body)
    keyed = rows.withColumn("__key", F.struct("source_file", "section_no"))
    cut = chunks(keyed.select("__key", "body"), "__key", "body", size, overlap).select(F.col("__key.source_file").alias("source_file"), F.col("__key.section_no").alias("section_no"), "chunk_no", "first_word", "end_word", "chunk_text")
    about = rows.select("source_file", "section_no", "document_id", "version", "title", "domain", "machine_type", "heading")
    out = cut.join(about, ["source_file", "section_no"])
    locator = F.concat(F.lit("section:"), F.col("heading"), F.lit(";words:"), F.col("first_word").cast("string"), F.lit("-"), F.col("end_word").cast("string"))
    out = out.withColumn("heading_path", F.concat_ws(" > ", "title", "heading")).withColumn("source_locator", locator).withColumn("active", F.lit(True))
    out = out.withColumn("visibility_scope", F.when(F.col("machine_type").isNull(), "ENTERPRISE").otherwise("MACHINE_TYPE")).withColumn("visibility_value", F.col("machine_type"))
    return out.withColumn("chunk_id", hash_id(F.col("document_id"), F.col("version"), F.col("source_file"), F.col("source_locator"), F.col("chunk_text"), prefix="KCH-", length=32))


def visible(machine_type: str | None) -> Column:
    """Active chunks that a question may see: all of the enterprise, and those of its own machine type."""
    own = F.lit(False) if machine_type is None else F.col("visibility_value") == machine_type
    return F.col("active") & ((F.col("visibility_scope") == "ENTERPRISE") | ((F.col("visibility_scope") == "MACHINE_TYPE") & F.coalesce(own, F.lit(False))))


def embed(rows: DataFrame, key: str, words: Column, d: int = 64) -> DataFrame:
    """(key, vector of d numbers): how many words fall into each slot of a hash. Deterministic, needs no model; a model's
    vectors can take its place. Rows without words have a vector of zeros."""
    slots = rows.select(key, F.explode_outer(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % d)).alias("slot"))
    counts = slots.groupBy(key, "slot").agg(F.count("slot").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("slot", F.lit(-1)).alias("slot"), "n"))).alias("m"))
    return counts.select(key, F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)).cast("float")).alias("vector"))


def _nearest(qs: np.ndarray, q: np.ndarray, k: int):
    """For mapInArrow over (b_id, b_vec): the k nearest rows of a task to each query, by rounded cosine, then id."""

    def merged(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores), axis=1)[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids, best = np.zeros((len(qs), 0), np.int64), np.zeros((len(qs), 0))
        for table in tables:
            rows = [(i, v) for i, v in zip(table.column(0).to_pylist(), table.column(1).to_pylist()) if i is not None and v and len(v) == q.shape[1] and None not in v]
            for at in range(0, len(rows), 2000):
                ids = np.array([i for i, _ in rows[at : at + 2000]], np.int64)
                x = np.array([v for _, v in rows[at : at + 2000]], np.float64)
                norm = np.linalg.norm(x, axis=1)
                ids, x = ids[norm > 0], x[norm > 0] / norm[norm > 0, None]
                if not len(ids):
                    continue
                s = np.round(q @ x.T, 6)
                s[qs[:, None] == ids[None, :]] = -2  # not the query itself
                some = np.broadcast_to(ids, s.shape)
                if len(ids) > 4 * k + 16:  # the k-th largest first, so that few are sorted; ties at it stay
                    floor = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                    s = np.where(s >= floor[:, None], s, -2)
                best_ids, best = merged(np.concatenate([best_ids, some], 1), np.concatenate([best, s], 1))
        i, j = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(qs[i]), pa.array(best_ids[i, j]), pa.array(best[i, j])], names=["q_id", "b_id", "score"])

    return work


def top_vectors(queries: DataFrame, base: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """queries (q_id, q_vec), base (b_id, b_vec, ...): the k nearest rows by cosine of each query, not itself; `where` is a
    filter of the base. A stated set of queries is held QUERIES_A_PASS at a time, each pass reads the base once: every task
    multiplies matrices and keeps its k best, so what is shuffled is k rows a query and task. Null vectors and zeros are
    near nothing."""
    if where is not None:
        base = base.where(where)
    rows = base.select(F.col("b_id").cast("long").alias("b_id"), "b_vec")
    asked = queries.select(F.col("q_id").cast("long").alias("q_id"), F.col("q_vec").cast("array<double>").alias("q_vec")).where(F.exists("q_vec", lambda x: x != 0) & F.forall("q_vec", lambda x: x.isNotNull()))
    passes = max(1, -(-asked.count() // QUERIES_A_PASS))
    out = None
    for part in range(passes):
        some = asked.where(F.pmod(F.xxhash64("q_id"), F.lit(passes)) == part).toArrow()
        by: dict[int, list[tuple[int, list[float]]]] = {}
        for i, v in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
            by.setdefault(len(v), []).append((i, v))
        for vectors in by.values():
            q = np.array([v for _, v in vectors])
            found = rows.mapInArrow(_nearest(np.array([i for i, _ in vectors], np.int64), q / np.linalg.norm(q, axis=1, keepdims=True), k), "q_id long, b_id long, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = base.sparkSession.createDataFrame([], "q_id long, b_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "b_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """docs (doc_id, terms array), queries (q_id, terms array) -> q_id, doc_id, score."""
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg_len"))
    wanted = queries.select("q_id", F.explode(F.array_distinct("terms")).alias("term"))
    tf = docs.select("doc_id", F.size("terms").alias("len"), F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    tf = cut(tf)  # asked words only; counted and scored from one table
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = tf.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "doc_id", weight.alias("weight"))
    return scored.join(wanted, "term").groupBy("q_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))


def fuse(a: DataFrame, b: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (q_id, doc_id, rank)."""
    both = a.unionByName(b)
    return both.groupBy("q_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"))


def valid_citations(cited: Column, retrieved: Column) -> Column:
    """Citations that are among what was retrieved; either may be structs, e.g. of chunk, document, version and locator."""
    return F.filter(cited, lambda c: F.exists(retrieved, lambda r: r == c))


def grounded(status: Column, valid: Column) -> Column:
    """An answer that claims to be grounded without a valid citation isn't."""
    return F.when((status == "GROUNDED") & (F.size(valid) == 0), "INSUFFICIENT_EVIDENCE").otherwise(status)


def evaluate(expected: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """expected (q_id, d_id), retrieved (q_id, d_id, rank): for each asked question whether one of its documents is among
    the first k, and the share of them that is."""
    top = retrieved.where(F.col("rank") <= k).select(F.col("q_id").alias("__q"), F.col("d_id").alias("__d")).distinct()
    hit = expected.select("q_id", "d_id").distinct().join(top, (F.col("q_id") == F.col("__q")) & (F.col("d_id") == F.col("__d")), "left")
    return hit.groupBy("q_id").agg(F.max(F.col("__q").isNotNull()).alias("hit"), F.avg(F.col("__q").isNotNull().cast("double")).alias("recall"))
