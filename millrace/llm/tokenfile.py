"""Token files with directly addressable codes: ids split into chunk levels, continuation bitmaps and rank directories.

A segment is one self-contained file image: a header, the documents' ids and offsets, and the levels. Level 1 has the low
bits of every id; a set bit in its bitmap says that the id goes on in level 2, at the place that the number of set bits
before it gives. Any token is read in one step a level, without decoding a block.

Segments are rows of a Parquet table (segment_part, segment_no, n_ids, n_docs, body), so that Spark's committer makes the
write whole or absent on any store, whatever executors are lost meanwhile.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoder
from .common import Scratch

MAGIC, RANK_BITS = b"DAC1", 512
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
SEGMENT = "segment_part int, segment_no int, n_ids long, n_docs long, body binary"


def _pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers of 4 to 32 bits, a multiple of 4: whole bytes as planes, then a plane of half bytes."""
    out = [((values >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8).tobytes() for k in range(width // 8)]
    if width % 8:
        half = ((values >> np.uint32(width - 4)) & np.uint32(15)).astype(np.uint8)
        half = np.append(half, np.zeros(len(half) % 2, np.uint8))
        out.append((half[::2] | half[1::2] << 4).tobytes())
    return b"".join(out)


def _unpack(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k in range(width // 8):
        out |= np.frombuffer(raw, np.uint8, n, k * n).astype(np.uint32) << np.uint32(8 * k)
    if width % 8:
        pairs = np.frombuffer(raw, np.uint8, (n + 1) // 2, width // 8 * n)
        half = np.empty(2 * len(pairs), np.uint32)
        half[::2], half[1::2] = pairs & 15, pairs >> 4
        out |= half[:n] << np.uint32(width - 4)
    return out


def _packed_size(n: int, width: int) -> int:
    return n * (width // 8) + (n + 1) // 2 * (width % 8 == 4)


def level_widths(ids: np.ndarray) -> list[int]:
    """The chunk widths, in multiples of 4 bits, that take the least space for these ids."""
    need = 4 * max(1, -(-int(ids.max(initial=0)).bit_length() // 4))
    reach = {b: int((ids >> np.uint32(b)).astype(bool).sum()) if b else len(ids) for b in range(0, need, 4)}
    best: dict[int, tuple[float, list[int]]] = {need: (0, [])}
    for at in range(need - 4, -1, -4):
        best[at] = min(((reach[at] * (to - at + (to < need) * (1 + 32 / RANK_BITS)) + best[to][0], [to - at, *best[to][1]]) for to in range(at + 4, need + 1, 4)), key=lambda x: x[0])
    return best[0][1]


def encode_segment(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """ids of all documents in a row; doc_ids may hold None; lengths count the ids of each document."""
    ids = ids.astype(np.uint32)
    widths = level_widths(ids)
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts, counts, rest = [], [], ids
    for k, width in enumerate(widths):
        counts.append(len(rest))
        parts.append(_pack(rest, width))
        if k + 1 < len(widths):
            high = rest >> np.uint32(width)
            more = high > 0
            bits = np.packbits(more, bitorder="little")
            blocks = np.append(bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)).reshape(-1, RANK_BITS // 8)
            ones = _POP[blocks].sum(1, dtype=np.uint32)
            parts += [blocks.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()]
            rest = high[more]
    head = struct.pack("<4sIQB", MAGIC, len(doc_ids), len(ids), len(widths)) + bytes(widths) + struct.pack(f"<{len(widths)}Q", *counts)
    return b"".join([head, valid.tobytes(), keys.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes(), *parts])


class Segment:
    """Reads a segment: token(i) and document(k) by address, all_ids() in one go."""

    def __init__(self, body: bytes):
        magic, self.n_docs, self.n_ids, levels = struct.unpack_from("<4sIQB", body)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        view, at = memoryview(body), struct.calcsize("<4sIQB")
        widths = list(body[at : at + levels])
        at += levels
        counts = struct.unpack_from(f"<{levels}Q", body, at)
        at += 8 * levels
        valid = np.frombuffer(view, np.uint8, self.n_docs, at)
        at += self.n_docs
        keys = np.frombuffer(view, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.doc_ids = [int(k) if v else None for k, v in zip(keys, valid)]
        self.offsets = np.frombuffer(view, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for k, (width, n) in enumerate(zip(widths, counts)):
            chunk = view[at : (at := at + _packed_size(n, width))]
            bits = ranks = None
            if k + 1 < levels:
                blocks = -(-n // RANK_BITS)
                bits = np.frombuffer(view, np.uint8, blocks * RANK_BITS // 8, at)
                at += blocks * RANK_BITS // 8
                ranks = np.frombuffer(view, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((width, n, chunk, bits, ranks))

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for width, n, chunk, bits, ranks in self.levels:
            for k in range(width // 8):
                value |= chunk[k * n + i] << (shift + 8 * k)
            if width % 8:
                value |= (chunk[width // 8 * n + i // 2] >> 4 * (i % 2) & 15) << (shift + width - 4)
            if bits is None or not bits[i // 8] >> i % 8 & 1:
                break
            block, byte = i // RANK_BITS, i // 8
            i = int(ranks[block]) + int(_POP[bits[block * RANK_BITS // 8 : byte]].sum()) + int(_POP[bits[byte] & ((1 << i % 8) - 1)])
            shift += width
        return value

    def document(self, k: int) -> list[int]:
        return [self.token(i) for i in range(int(self.offsets[k]), int(self.offsets[k + 1]))]

    def all_ids(self) -> np.ndarray:
        out, where, shift = np.zeros(self.n_ids, np.uint32), None, 0
        for width, n, chunk, bits, _ in self.levels:
            values = _unpack(chunk, n, width) << np.uint32(shift)
            out[slice(None) if where is None else where] |= values
            if bits is not None:
                more = np.unpackbits(bits, count=n, bitorder="little").astype(bool)
                where = np.flatnonzero(more) if where is None else where[more]
            shift += width
        return out


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, segment_ids: int = 1 << 20, end_id: int = 0) -> None:
    """Writes the ids of docs (doc_id, text) as segments, in ascending order of doc_id, nulls first, ties by text.

    A null or empty text is only its end id. No document is split, so a segment holds at least one whole document.
    The texts are dealt by ranges of doc_id once; ids never leave the task that makes them but in a segment.
    """

    def segments(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        keys: list = []
        raw: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal no, held
            lengths = np.array([len(x) for x in raw], np.int64)
            body = encode_segment(np.concatenate(raw), keys, lengths)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([body], pa.binary())], names=["segment_part", "segment_no", "n_ids", "n_docs", "body"])
            no, held = no + 1, 0
            keys.clear()
            raw.clear()
            return row

        for table in tables:
            doc_ids = table.column(0).to_pylist()
            for first, ids, stops in enc.ended(table.column(1), end_id):
                last = 0
                for key, stop in zip(doc_ids[first : first + len(stops)], stops.tolist()):
                    if raw and held + stop - last > segment_ids:
                        yield flush()
                    keys.append(key)
                    raw.append(ids[last:stop])
                    held += stop - last
                    last = stop
        if raw:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(segments, SEGMENT)
    rows.write.option("compression", "none").option("parquet.page.size", 1 << 22).parquet(folder)


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from a table of segments, each document's ids decoded from its segment."""

    def documents(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for part, no, body in zip(*(table.column(i).to_pylist() for i in range(3))):
                s = Segment(body)
                ids = s.all_ids().astype("<u4").tobytes()
                at = (4 * s.offsets).tolist()
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([part] * s.n_docs, pa.int32()), pa.array([no] * s.n_docs, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.offsets[:-1], pa.int64()), pa.array(np.diff(s.offsets), pa.int64()), pa.array(crcs, pa.int64())], names=["segment_part", "segment_no", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = segments.select("segment_part", "segment_no", "body").mapInArrow(documents, "segment_part int, segment_no int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # One row a segment: a millionth of the tokens.
    order = Window.orderBy("segment_part", "segment_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("segment_part", "segment_no", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    return rows.join(starts, ["segment_part", "segment_no"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(segments: DataFrame, asked: DataFrame, width: int = 1 << 20) -> DataFrame:
    """asked (token_index: a place among the ids of all documents) -> token_index, token; null for places that there aren't.

    Indexes meet their segment through bins of a width, then each segment answers its own by address. Repeated indexes are
    answered once each; a segment with none is not decoded.
    """
    order = Window.orderBy("segment_part", "segment_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    starts = segments.select("segment_part", "segment_no", "n_ids", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    spans = starts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("n_ids") - 1) / width))))
    wanted = asked.select(F.col("token_index").cast("long").alias("token_index")).distinct()
    placed = wanted.withColumn("bin", F.floor(F.col("token_index") / width)).join(spans, "bin").where((F.col("token_index") >= F.col("before")) & (F.col("token_index") < F.col("before") + F.col("n_ids")))
    placed = placed.select(F.col("segment_part").alias("p"), F.col("segment_no").alias("n"), "token_index", (F.col("token_index") - F.col("before")).alias("within"))

    def answer(bodies: pa.Table, places: pa.Table) -> pa.Table:
        out = []
        if bodies.num_rows and places.num_rows:
            s = Segment(bodies.column("body")[0].as_py())
            out = [s.token(i) for i in places.column("within").to_pylist()]
        return pa.table({"token_index": places.column("token_index").slice(0, len(out)), "token": pa.array(out, pa.int64())})

    key = ["segment_part", "segment_no"]
    named = placed.select("p", "n").distinct()
    held = segments.join(named, (segments["segment_part"] == named["p"]) & (segments["segment_no"] == named["n"]), "left_semi").select(*key, "body")
    found = held.groupBy(*key).cogroup(placed.groupBy("p", "n")).applyInArrow(answer, "token_index long, token long")
    return asked.select(F.col("token_index").cast("long").alias("token_index")).join(found, "token_index", "left")


def token_file(docs: DataFrame, tokenizer: str, segment_ids: int = 1 << 20, end_id: int = 0) -> DataFrame:
    """Writes a token file of all documents into the shared folder and describes what is read back from it."""
    spark = docs.sparkSession
    folder = Scratch(spark, "tokens").root
    write_tokens(docs, folder, tokenizer, segment_ids, end_id)
    return read_tokens(spark.read.schema(SEGMENT).option("mergeSchema", "false").parquet(folder))
