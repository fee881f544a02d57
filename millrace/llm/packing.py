"""Packing of token runs into windows by Karmarkar-Karp multiway differencing.

Whole windows are cut from the head of each document. What remains is cut into pieces, and a block of pieces is divided
into k near-equal windows: partial partitions wait in a heap by the gap between their largest and least sums, and the
two with the widest gaps are merged, large sums meeting small ones. If a sum exceeds the capacity, k rises by one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _leaves(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        elif x is not None:
            out.append(x)
    return out


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Divides indices of sizes among k sets with near-equal sums."""
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Each holds its sums above the least one, descending, without trailing empty sets.
        n = len(a) + len(b)
        if n <= k:
            sums = sorted(a + b, key=lambda x: -x[0])
        else:
            apart = k - len(b)  # so many of a's largest meet none of b's
            sums = a[:apart] + [(x + y, (s, t)) for (x, s), (y, t) in zip(a[apart:], reversed(b[k - len(a) :]))] + b[: k - len(a)]
            sums.sort(key=lambda x: -x[0])
        if len(sums) == k and sums[-1][0]:
            least = sums[-1][0]
            sums = [(x - least, s) for x, s in sums]
        heapq.heappush(heap, (sums[-1][0] * (len(sums) == k) - sums[0][0], tie, sums))
        tie += 1
    sets = [_leaves(s) for _, s in heap[0][2]] if heap else []
    return sets + [[] for _ in range(k - len(sets))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of indices with sums up to the capacity, as few as near-equal division gives; no size exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if max(sum(sizes[i] for i in s) for s in sets) <= capacity:
            return [s for s in sets if s]
        k += 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, piece: int = 256, block: int = 128, end_id: int = 0) -> DataFrame:
    """One row for each piece of docs (doc_id, text): where it lies in its document and in which sequence, at what offset.

    A null or empty text is its end id alone; repeated rows are packed each. Blocks of `block` windows are formed within a
    task from rows in the order of its input, so nothing is shuffled, memory is bounded, and a task that runs again, on
    whatever executor, gives the same rows. Sequence ids are unique, not gapless.
    """

    def pieces(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, next_id = encoder(tokenizer), TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []  # doc_id, start, length, crc, doc_tokens
        held, out = 0, []

        def place(all_: bool):
            nonlocal waiting, held, next_id
            while held >= block * capacity or all_ and waiting:
                n = total = 0
                while n < len(waiting) and total + waiting[n][2] <= block * capacity:
                    total += waiting[n][2]
                    n += 1
                now, waiting = waiting[:n], waiting[n:]
                held -= total
                for s in windows([x[2] for x in now], capacity):
                    at = 0
                    for i in sorted(s):
                        out.append((*now[i], next_id, at))
                        at += now[i][2]
                    next_id += 1

        def batch():
            columns = list(zip(*out)) or [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for table in tables:
            keys = table.column(0).to_pylist()
            for first, ids, stops in enc.ended(table.column(1), end_id):
                raw, last = memoryview(ids.astype("<u4")).cast("B"), 0
                for key, stop in zip(keys[first : first + len(stops)], stops.tolist()):
                    n = stop - last
                    whole = n - n % capacity
                    for at in range(0, whole, capacity):
                        out.append((key, at, capacity, zlib.crc32(raw[4 * (last + at) : 4 * (last + at + capacity)]), n, next_id, 0))
                        next_id += 1
                    for at in range(whole, n, piece):
                        size = min(piece, n - at)
                        waiting.append((key, at, size, zlib.crc32(raw[4 * (last + at) : 4 * (last + at + size)]), n))
                        held += size
                    last = stop
                place(False)
                yield batch()
            tidy()
        place(True)
        yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)
