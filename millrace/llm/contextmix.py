"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A token is coded as bits: the path to its leaf in a Huffman tree. The most frequent words have leaves of their own, the
other words share one for each class of spellings, and words that were never seen share one. The tree's own counts predict
each bit, and hashed tables of counts predict it after the word before, after the two words before, and after the last
very frequent word. A gated set of weights adds what each table says to what the tree says, on the logistic scale; weights
and a correction by confidence follow the document as it is read, from the same start for each document. Within a class a
word has its share of the class's counts. So the probabilities of all tokens add up to one at every place.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, remainder5

#: Words with leaves of their own, and classes of the others.
OWN, CLASSES = 2047, 256
#: The tables (after one word, after two, after the last of the FREQUENT most frequent words) grow with the training tokens:
#: one slot for about two of them, up to 2 ** MOST_BITS slots of two bytes, which bounds what executors hold.
MOST_BITS, FREQUENT = 21, 64
CHUNK = 1 << 16
#: So many of the most frequent words (12 bytes each) are sent to all executors; counts of the others come by a join.
SEND = 4_000_000
#: Tables that one task adds up.
FAN_IN = 64
#: Places of a text before which the weights are updated: after 4 tokens, then after a quarter more each time, at least 4 and
#: at most 64, so that short texts are learned from too. Far texts go on in steps of 64.
BLOCKS = [4]
while BLOCKS[-1] < 1 << 22:
    BLOCKS.append(BLOCKS[-1] + max(4, min(64, BLOCKS[-1] // 4)))
BLOCKS = np.array(BLOCKS)
GATES, BUCKETS = 12, 24
START = (0.3, 0.6, 0.6)
END = b"\n"  # no word holds white space
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def slot_bits(tokens: int) -> tuple[int, int, int]:
    """Bits of the slots of the three tables."""
    most = min(MOST_BITS, max(14, (max(1, tokens) - 1).bit_length() - 1))
    return most, most, max(12, most - 2)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1  # fits a signed long


def _class(word: bytes) -> int:
    head = word[:2] if word[:2].isascii() else word[:8].decode("utf-8", "replace")[:2].encode()  # two characters
    return zlib.crc32(head) % CLASSES


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in known, which is ascending; whether the key is there) of each key."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class _Index(dict):
    """Numbers of words. A new word gets the next number and is listed in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, cls, n) of all words of texts (text binary) and of their ends."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(c: Counter) -> pa.RecordBatch:
            words = list(c)
            return pa.RecordBatch.from_arrays([pa.array(list(map(_hash, words)), pa.int64()), pa.array(list(map(_class, words)), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["h", "cls", "n"])

        counts: Counter = Counter()
        for table in tables:
            for t in table.column(0).to_pylist():
                counts.update((t or b"").lower().split())
            counts[END] += table.num_rows
            if len(counts) > 400_000:
                yield rows(counts)
                counts.clear()
        if counts:
            yield rows(counts)

    return texts.mapInArrow(work, "h long, cls int, n long").groupBy("h").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))


class Tree:
    """Leaves: own words by hash, classes, the unseen. Codes as node and bit sequences, and each node's probability of a 1."""

    def __init__(self, own: list[tuple[int, int]], masses: dict[int, float], tokens: int = 1 << 20):
        self.slot_bits = slot_bits(tokens)
        keys = np.array([h for h, _ in own], np.int64)
        self.own_leaf = np.argsort(keys)
        self.own_keys = keys[self.own_leaf]
        self.frequent = min(FREQUENT, len(own))
        self.class_leaf, self.masses = np.full(CLASSES, -1), np.ones(CLASSES)
        weights = [n + 0.5 for _, n in own]
        for c in sorted(masses):
            self.class_leaf[c], self.masses[c] = len(weights), masses[c]
            weights.append(masses[c])
        self.unseen = len(weights)
        weights.append(0.5)
        heap = [(w, i, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        n, nodes = len(weights), []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            nodes.append((a[2], b[2], b[0] / (a[0] + b[0])))
            heapq.heappush(heap, (a[0] + b[0], n + len(nodes), n + len(nodes) - 1))
        paths: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
        for k in reversed(range(len(nodes))):
            path = paths.pop(n + k)
            for bit in (0, 1):
                paths[nodes[k][bit]] = [*path, (k, bit)]
        self.size = np.array([len(paths[i]) for i in range(n)])
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        flat = [x for i in range(n) for x in paths[i]]
        self.nodes = np.array([k for k, _ in flat], np.int64)
        self.bits = np.array([b for _, b in flat], np.int8)
        p = np.array([x[2] for x in nodes] or [0.5])
        self.stretch = np.log(p / (1 - p))
        self.one = p


class Reader:
    """Turns texts into arrays of tokens. counts: (sorted hashes, counts), or None if only leaves are asked for. What `given`
    says of a word that they lack has to be its count in any text, as a word is looked up once."""

    def __init__(self, tree: Tree, counts: tuple[np.ndarray, np.ndarray] | None):
        self.tree, self.counts = tree, counts
        self._reset()

    def _reset(self):
        self.index = _Index()
        self.leaf = np.zeros(1 << 12, np.int32)
        self.key = np.zeros(1 << 12, np.uint64)
        self.n = np.zeros(1 << 12, np.int64)
        self.share = np.zeros(1 << 12)

    def _learn(self, words: list[bytes], given: dict[int, int] | None):
        end, tree = len(self.index), self.tree
        start = end - len(words)
        while end > len(self.leaf):
            for name in ("leaf", "key", "n", "share"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros_like(x)]))
        keys = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)).view(np.int64)
        if self.counts is not None:
            at, there = _find(self.counts[0], keys)
            n = np.zeros(len(keys), np.int64)
            n[there] = self.counts[1][at[there]]
            if given:
                others = np.flatnonzero(~there)
                n[others] = [given.get(k, 0) for k in keys[others].tolist()]
        else:
            n = np.ones(len(keys), np.int64)
        at, own = _find(tree.own_keys, keys)
        leaf, share = np.full(len(keys), tree.unseen), np.zeros(len(keys))
        leaf[own] = tree.own_leaf[at[own]]
        rest = np.flatnonzero(~own & (n > 0))
        classes = np.fromiter((_class(words[i]) for i in rest.tolist()), np.int64, len(rest))
        within = tree.class_leaf[classes] >= 0
        rest, classes = rest[within], classes[within]
        leaf[rest], share[rest] = tree.class_leaf[classes], np.log10((n[rest] + 0.5) / tree.masses[classes])
        self.leaf[start:end], self.share[start:end], self.n[start:end] = leaf, share, n
        self.key[start:end] = keys.astype(np.uint64) * _K[0]

    def read(self, texts: list[bytes], given: dict[int, int] | None = None):
        words = [[*t.lower().split(), END] for t in texts]
        if len(self.index) > 400_000:
            self._reset()
        sizes = np.array([len(w) for w in words])
        idx = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if self.index.new:
            self._learn(self.index.new, given)
            self.index.new = []
        return idx, sizes


def _slots(reader: Reader, idx: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(document of each token, place in it, hashes of its three contexts)."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(idx)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = reader.key[idx]
    one = np.where(place > 0, np.concatenate([key[:1], key[:-1]]), _K[1])
    two = np.where(place > 1, np.concatenate([key[:2], key[:-2]]), _K[2])[: len(idx)]
    sign = reader.leaf[idx] < reader.tree.frequent
    last = np.maximum.accumulate(np.where(sign, np.arange(len(idx)), -1))
    last = np.concatenate([[-1], last[:-1]])
    sign_key = np.where(last >= np.arange(len(idx)) - place, key[np.maximum(last, 0)], _K[3])
    mix = lambda x: (x ^ (x >> np.uint64(29))) * _K[1]
    return doc, place, [mix(one), mix(one * _K[2] + two), mix(sign_key ^ _K[3])]


def _expand(tree: Tree, leaf: np.ndarray, contexts: list[np.ndarray]):
    """For each bit: its token, node, value, and slots in the three tables."""
    size = tree.size[leaf]
    token = np.repeat(np.arange(len(leaf)), size)
    at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size) + tree.at[leaf][token]
    node, bit = tree.nodes[at], tree.bits[at]
    salt = (node + 1).astype(np.uint64) * _K[3]
    slots = [((c[token] ^ salt) * _K[0] >> np.uint64(64 - s)).astype(np.int64) for c, s in zip(contexts, tree.slot_bits)]
    return token, node, bit, slots


def _groups(texts: list[bytes], size: int):
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 20
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _table_parts(tree: Tree):
    """For mapInArrow: the tables of one task's training texts, cut into pieces of CHUNK slots."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader, sums, any_ = Reader(tree, None), [np.zeros(2 << s, np.uint32) for s in tree.slot_bits], False
        for table in tables:
            texts = [t or b"" for t in table.column(0).to_pylist()]
            for a, b in _groups(texts, 1 << 18):
                idx, sizes = reader.read(texts[a:b])
                _, _, contexts = _slots(reader, idx, sizes)
                _, _, bit, slots = _expand(tree, reader.leaf[idx], contexts)
                for k, s in enumerate(slots):
                    np.add.at(sums[k], 2 * s + bit, np.uint32(1))  # of one type, or it is many times slower
                any_ = True
        if any_:
            part = TaskContext.get().partitionId()
            for k, x in enumerate(sums):
                for piece in range(0, len(x), 2 * CHUNK):
                    if not x[piece : piece + 2 * CHUNK].any():
                        continue
                    body = zlib.compress(x[piece : piece + 2 * CHUNK].astype("<u4").tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece // (2 * CHUNK)], pa.int32()), pa.array([part], pa.int64()), pa.array([body], pa.binary())], names=["k", "piece", "part", "body"])

    return work


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(b.as_py()), "<u4").astype(np.uint64) for b in table.column("body"))
    body = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
    return pa.table({"k": table.column("k").slice(0, 1), "piece": table.column("piece").slice(0, 1), "part": table.column("part").slice(0, 1), "body": pa.array([body], pa.binary())})


def context_tables(texts: DataFrame, tree: Tree, scratch: Scratch) -> list[np.ndarray]:
    """The packed counts of zeros and ones of each table. Tasks' tables are added up in steps of at most FAN_IN of them."""
    schema = "k int, piece int, part long, body binary"
    parts = scratch.cut(texts.mapInArrow(_table_parts(tree), schema), "tables", "none")
    most = parts.agg(F.max("part")).first()[0]
    while most is not None:
        last, parts = parts, parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("k", "piece", "part").applyInArrow(_added, schema)
        parts, most = scratch.cut(parts, "tables", "none"), most // FAN_IN
        scratch.drop(last)
        scratch.sweep()
        if most == 0:
            break
    out = [np.zeros(1 << s, np.uint16) for s in tree.slot_bits]
    for r in parts.collect():  # a fixed number of pieces of a fixed size
        x = np.frombuffer(zlib.decompress(r["body"]), "<u4").reshape(-1, 2)
        out[r["k"]][r["piece"] * CHUNK : r["piece"] * CHUNK + len(x)] = _packed(x)
    return out


#: What the two bytes of a slot stand for.
_SHARES, _AMOUNTS = (np.arange(256) / 255).astype(np.float32), (np.exp2(np.arange(256) / 16) - 1).astype(np.float32)


def _packed(table: np.ndarray) -> np.ndarray:
    """Of each slot: the share of ones in 255ths, and above it the logarithm of its count, a byte each."""
    n = table.sum(1, dtype=np.float64)
    return np.round(255 * table[:, 1] / np.maximum(n, 1)).astype(np.uint16) | np.minimum(255, np.round(16 * np.log2(n + 1))).astype(np.uint16) << np.uint16(8)


def score_texts(reader: Reader, tables, texts: list[bytes], given: dict[int, int] | None = None):
    """(n_tokens, n_known, counts of the tokens, log10 of the model's probability) of each text."""
    tree = reader.tree
    idx, sizes = reader.read(texts, given)
    doc, place, contexts = _slots(reader, idx, sizes)
    leaf = reader.leaf[idx]
    result = np.bincount(doc, reader.share[idx], len(sizes))
    # Blocks of all documents in turn: the first of each, the second of each, ...
    block = np.searchsorted(BLOCKS, place, side="right")
    order = np.argsort(block, kind="stable")
    token, node, bit, slots = _expand(tree, leaf[order], [c[order] for c in contexts])
    base, first = tree.stretch.astype(np.float32)[node], (0.6 * tree.one).astype(np.float32)[node]
    inputs, seen = [], []
    for table, s in zip(tables, slots):
        both = table[s]
        n = _AMOUNTS[both >> 8]
        ones = n * _SHARES[both & 255]
        ones += first
        odds = np.log(np.clip(ones / (n + np.float32(0.6) - ones), np.float32(1e-4), np.float32(1e4)))
        inputs.append(odds - base)
        seen.append(n)
    one, two = seen[0], seen[1]
    gate = ((one >= 0.5).astype(np.int64) + (one >= 3) + (one >= 30)) * 3 + (two >= 0.5) + (two >= 3)
    d = doc[order][token]
    weights = [np.full(len(sizes) * GATES, w, np.float32) for w in START]
    bias = np.zeros(len(sizes) * BUCKETS, np.float32)
    ends = np.searchsorted(block[order][token], np.arange(int(block.max(initial=-1)) + 2))
    for a, b in zip(ends, ends[1:]):
        x = [i[a:b] for i in inputs]
        g = d[a:b] * GATES + gate[a:b]
        z = base[a:b] + weights[0][g] * x[0]
        z += weights[1][g] * x[1]
        z += weights[2][g] * x[2]
        np.clip(z, -11.5, 11.5, out=z)
        y = bit[a:b]
        bucket = d[a:b] * BUCKETS + (z + np.float32(BUCKETS // 2)).astype(np.int64)
        refined = np.clip(z + bias[bucket], -13, 13)
        sign = (1 - 2 * y).astype(np.float32)
        result -= np.bincount(d[a:b], np.log1p(np.exp(sign * refined)), len(sizes)) / np.log(10)
        wrong, again = y - 1 / (1 + np.exp(-z)), y - 1 / (1 + np.exp(-refined))
        n = np.bincount(g, minlength=len(weights[0])) + 60
        for k in range(3):
            weights[k] += (0.8 * np.bincount(g, wrong * x[k], len(n)) / n).astype(np.float32)
        bias += (0.5 * np.bincount(bucket, again, len(bias)) / (np.bincount(bucket, minlength=len(bias)) + 40)).astype(np.float32)
    n_known = np.bincount(doc, reader.n[idx] > 0, len(sizes)).astype(int)
    return sizes, n_known, reader.n[idx], doc, result


def scores(docs: DataFrame, held_out: int = 1, send: int = SEND) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), bits_per_byte:
    the model's total bits over the bytes of the text, null where it has none.

    Counts and tables are learned from all rows whose crc32(doc_id) mod 5 isn't `held_out`; a null doc_id isn't held out.
    A null text is empty: one token, its end. Without training rows every token is unseen, with probability 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    held = F.coalesce(remainder5(F.col("doc_id")) == held_out, F.lit(False))
    train = rows.where(~held).select("text")
    vocab = scratch.cut(word_counts(train), "vocabulary")
    tokens, kinds = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = _hash(END)
    own = [(r["h"], r["n"]) for r in vocab.orderBy((F.col("h") == end).desc(), F.desc("n"), "h").limit(OWN + 1).collect()]
    own.sort(key=lambda x: (-x[1], x[0]))
    mass = vocab.join(F.broadcast(spark.createDataFrame([(h,) for h, _ in own], "h long")), "h", "left_anti").groupBy("cls").agg(F.sum(F.col("n") + 0.5).alias("mass"))
    tree = Tree(own, {r["cls"]: float(r["mass"]) for r in mass.collect()}, tokens)  # CLASSES rows at most
    tables = context_tables(train, tree, scratch)
    total = tokens + 0.5 * (kinds + 1)
    least = 0 if kinds <= send else _least_sent(vocab, send)
    found = vocab.where(F.col("n") >= least).select("h", "n").toArrow().sort_by("h")
    shared = spark.sparkContext.broadcast((found.column("h").to_numpy(), np.minimum(found.column("n").to_numpy(), 0x7FFFFFFF).astype(np.int32) if tokens < 1 << 31 else found.column("n").to_numpy()))
    del found
    if least:
        rows = _with_counts(rows, scratch.cut(vocab.where(F.col("n") < least).select("h", "n"), "seldom"), shared, scratch)
    else:
        rows = rows.withColumn("counts", F.lit(None).cast("array<struct<h:bigint,n:bigint>>"))
    model = spark.sparkContext.broadcast((tree, tables))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_, tables_ = model.value
        reader = Reader(tree_, shared.value)
        for part in parts:
            texts = [t or b"" for t in part.column(1).to_pylist()]
            counts = part.column(2).to_pylist() if least else None
            out: list[list] = [[], [], [], []]
            for a, b in _groups(texts, 250_000):
                given = None
                if counts is not None:
                    given = {x["h"]: x["n"] for c in counts[a:b] for x in c or ()}
                n, known, c, doc, s = score_texts(reader, tables_, texts[a:b], given)
                base = np.bincount(doc, np.log10((c + 0.5) / total), len(n))
                for column, x in zip(out, (n, known, base, s)):
                    column += x.tolist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    out = rows.select("doc_id", "text", "counts").mapInArrow(work, "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / float(np.log10(2)) / F.col("n_bytes"))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def _least_sent(vocab: DataFrame, send: int) -> int:
    """A count that `send` words at most reach, so that all of them can be sent: the least such to one part in 256."""

    def down(ranges: DataFrame) -> tuple[int, bool]:
        """The range in which the words get too many, from the highest on."""
        nonlocal left
        at = 0
        for at, c in sorted(map(tuple, ranges.groupBy("at").count().collect()), reverse=True):
            if c > left:
                return at, True
            left -= c
        return at, False

    left = send
    # Counts by their powers of two, then those of one of them in 256 parts: few rows, whatever the vocabulary.
    bits, over = down(vocab.select((F.length(F.bin("n")) - 1).alias("at")))
    if not over:
        return 1
    part, over = down(vocab.where((F.col("n") >= 1 << bits) & (F.col("n") < 2 << bits)).select(F.floor(F.col("n") * 256 / (1 << bits)).alias("at")))
    return -(-((part + 1) << bits) // 256)


def _with_counts(rows: DataFrame, seldom: DataFrame, sent, scratch: Scratch) -> DataFrame:
    """rows with counts: (h, n) of each distinct word of the text that isn't sent and that the vocabulary has.

    Words that aren't sent are seldom, so these are few, and each text is shuffled once. A task looks equal texts up once.
    """

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = sent.value[0], set()
        for table in tables:
            keys, hs = [], []
            for text in (t or b"" for t in table.column(0).to_pylist()):
                key = hashlib.sha256(text).digest()[:16]
                if key in seen:
                    continue
                seen.add(key)
                words = np.fromiter(map(_hash, {*text.lower().split(), END}), np.int64)
                seldom_ = words[~_find(known, words)[1]].tolist()
                keys += [key] * len(seldom_)
                hs += seldom_
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hs, pa.int64())], names=["key", "h"])

    asked = rows.select("text").mapInArrow(work, "key binary, h long")
    found = scratch.cut(asked.join(seldom, "h").groupBy("key").agg(F.collect_set(F.struct("h", "n")).alias("counts")), "counts")
    scratch.sweep()
    return rows.withColumn("key", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit(b"")), 256), 1, 32))).join(found, "key", "left").drop("key")
