"""Near duplicates of embeddings by spherical-cap filters of a structured random product code.

The space is rotated at random and cut into blocks; each block has a code of random unit vectors, and a filter direction
is one code vector from each block. A vector is list-decoded to all directions whose inner product with it exceeds a
threshold: partial sums are dropped as soon as the best rest can't lift them over it. Vectors that share a filter meet
there first with the signs of projections, 32 bytes each; those that may have a partner there bring their numbers and are
compared in double precision. A pair counts only at the first filter that both share.

Filters get narrower as the table grows, so one code misses more pairs of a large table than of a small one. There are as
many codes, each with a rotation of its own, as it takes for a pair at the asked cosine to share no filter with a
probability of at most MISS: the miss rate of one code is taken from random pairs at that cosine, whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import numbered, row_pairs, whole_cells
from .common import Scratch
from .graph import components

#: Vectors that one cell of a filter compares; a filter with more is split into cells for pairs of parts.
CELL = 1500
#: Bound of the modelled probability that a pair at the asked cosine shares no filter, and random pairs that model it.
MISS, TRIALS = 1e-4, 1000
#: Random directions whose signs are a vector's sketch, and the normal deviate that a pair's unequal signs may reach.
SIGNS, DEVIATE = 256, 6.5


class ProductCode:
    """Filters for vectors of dimension d. `expected` is the mean number of filters a vector falls into."""

    def __init__(self, d: int, n: int, expected: int = 22, least: int = 18, seed: int = 20240229):
        rng = np.random.default_rng([seed, d])
        self.d, self.least = d, least
        blocks = min(4, d)
        # About one vector of a random cloud for each filter: the number of filters grows as the number of vectors.
        self.size = max(6, round((max(n, 1) * expected) ** (1 / blocks)))
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        self.cuts = np.linspace(0, d, blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = rng.standard_normal((self.size, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(blocks))
        share = min(0.5, expected / self.size**blocks)
        self.threshold = NormalDist().inv_cdf(1 - share) / np.sqrt(d)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector its filters, ascending. A vector with fewer than `least` lowers its threshold step by step."""
        y = x @ self.rotation
        scores = [y[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)]
        best = np.stack([s.max(1) for s in scores], 1)
        rest = np.concatenate([np.cumsum(best[:, ::-1], 1)[:, ::-1], np.zeros((len(x), 1))], 1)
        out, index = [], np.arange(self.size)
        every = self.size ** len(scores)
        for i in range(len(x)):
            limit = min(self.threshold, rest[i, 0])
            while True:
                total, ids = scores[0][i], index
                keep = total + rest[i, 1] >= limit
                total, ids = total[keep], ids[keep]
                for j in range(1, len(scores)):
                    sums = total[:, None] + scores[j][i][None, :]
                    keep = sums + rest[i, j + 1] >= limit
                    total, ids = sums[keep], (ids[:, None] * self.size + index[None, :])[keep]
                if len(ids) >= min(self.least, every):
                    break
                limit -= 0.03
            out.append(np.sort(ids).astype("<i8"))
        return out


def pairs_at(d: int, cosine: float, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors of dimension d (2 or more) at this cosine."""
    rng = np.random.default_rng([seed, d])
    x, y = rng.standard_normal((2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y


def codes_needed(d: int, n: int, cosine: float) -> int:
    """Codes such that all of them miss a pair at this cosine with a probability of at most MISS."""
    if d < 2 or n < 2:
        return 1
    code, missed, tried = ProductCode(d, n), 0, 0
    x, y = pairs_at(d, min(cosine, 1.0), TRIALS)
    for k in range(0, TRIALS, 50):
        missed += sum(not len(np.intersect1d(a, b, True)) for a, b in zip(code.decode(x[k : k + 50]), code.decode(y[k : k + 50])))
        tried += 50
    # A miss and two standard errors more than what was seen, so that chance doesn't flatter the code.
    rate = min(0.99, (missed + 1 + 2 * np.sqrt(missed + 1)) / tried)
    return max(1, int(np.ceil(np.log(MISS) / np.log(rate))))


class Codes:
    """`count` product codes with rotations of their own; the filters of the k-th come after those of the ones before."""

    def __init__(self, d: int, n: int, count: int):
        self.codes = [ProductCode(d, n, seed=20240229 + k) for k in range(count)]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        found = [[ids + k * c.size ** len(c.codes) for ids in c.decode(x)] for k, c in enumerate(self.codes)]
        return [np.concatenate(lists) for lists in zip(*found)]


def _pairs_in(a: np.ndarray, b: np.ndarray | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with an inner product of at least `limit`; b None: within a. Exactly, whatever the order of sums."""
    s = a @ (a if b is None else b).T
    i, j = np.nonzero(s >= limit - 1e-9)
    if b is None:
        i, j = i[i < j], j[i < j]
        b = a
    if len(i):
        near = np.abs(s[i, j] - limit) < 1e-9
        sure = np.array([np.dot(a[p], b[q]) >= limit for p, q in zip(i[near], j[near])], bool)
        keep = np.ones(len(i), bool)
        keep[near] = sure
        i, j = i[keep], j[keep]
    return i, j


def _share_lower(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which rows of a cell share any of their lists' filters. Row k has flat[ends[k - 1]:ends[k]]."""
    m = len(ends)
    row = np.repeat(np.arange(m), np.diff(ends, prepend=0))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.cumsum(count > 1) - 1  # filters of one row alone don't matter
    twice = count[column] > 1
    row, column, width = row[twice], order[column[twice]], int((count > 1).sum())
    shared = np.zeros((m, m), bool)
    for at in range(0, width, 4096):
        some = (column >= at) & (column < at + 4096)
        table = np.zeros((m, min(4096, width - at)), np.float32)
        table[row[some], column[some] - at] = 1
        shared |= table @ table.T > 0.5
    return shared


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph on 0..n-1."""
    up, out = list(range(n)), []

    def top(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = top(a), top(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def unequal_signs(cosine: float) -> int:
    """Unequal signs of a pair at this cosine, at most: more have a probability of less than 1 in 10 ** 9."""
    p = float(np.arccos(np.clip(cosine, -1.0, 1.0))) / np.pi
    return int(np.ceil(SIGNS * p + DEVIATE * np.sqrt(SIGNS * p * (1 - p)) + 1))


def _sketches(x: np.ndarray) -> list[bytes]:
    directions = np.random.default_rng([31, x.shape[1]]).standard_normal((x.shape[1], SIGNS))
    return [r.tobytes() for r in np.packbits(x @ directions > 0, axis=1)]


def _exact(v: list[float]) -> bytes:
    """A vector's numbers: 4 bytes each if that loses nothing, else 8."""
    x = np.array(v, "<f8")
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return short.tobytes() if (short.astype("<f8") == x).all() else x.tobytes()


def _units(vec: list[bytes], d: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * d else "<f8").astype(np.float64) for v in vec])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cell_links(node: np.ndarray, x: np.ndarray, flat: np.ndarray, ends: np.ndarray, weight: np.ndarray, one: np.ndarray, limit: float) -> list[tuple[int, int | None, int]]:
    """Links of one cell: (node, None, weight of its partners) and (node, node, 0) of a spanning forest. one: rows of the
    first side. A pair counts if the lists of lower filters, flat and ends, have nothing in common."""
    if one.all():
        left = right = np.arange(len(node))
        i, j = _pairs_in(x, None, limit)
    else:
        left, right = np.flatnonzero(one), np.flatnonzero(~one)
        i, j = _pairs_in(x[left], x[right], limit) if len(left) else (np.zeros(0, int), np.zeros(0, int))
    i, j = left[i], right[j]
    if not len(i):
        return []
    keep = ~_share_lower(flat, ends)[i, j]
    # A pair that counts in a lower filter is joined there.
    i, j = i[keep], j[keep]
    sums = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
    return [(int(node[k]), None, int(sums[k])) for k in np.flatnonzero(sums)] + [(int(node[a]), int(node[b]), 0) for a, b in _forest(len(node), i, j)]


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """One row for each input row: id, n_links, component_id, kept.

    Rows with equal labels, not null, and vectors of one length are compared. Null, empty or zero vectors, and those with
    null or non-finite components, link with nothing, nor do rows with a null id; such a row is its own component and is
    kept (a null id: component null, kept false). Rows with equal vectors are found by hash and compared once; a row's
    links count all other rows. Each row is a vector of its own: rows that repeat an id are linked by their vectors alone.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = v.withColumn("fine", fine).withColumn("h1", F.when(F.col("fine"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(7), "v", "label")))
    classes = rows.where("fine").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v"))
    # Nodes are numbered in the written table, so that a row made once more keeps its number.
    classes = scratch.cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    counts = classes.groupBy("label", F.size("v").alias("d")).agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()  # a row for each length of vectors
    most = {r["d"]: (r["n"], codes_needed(r["d"], r["n"], cosine)) for r in counts}

    def decoded(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for table in tables:
            node, w, kind, vs = (table.column(k) for k in range(4))
            by: dict[int, list[int]] = {}
            vs = vs.to_pylist()
            for k, x in enumerate(vs):
                by.setdefault(len(x), []).append(k)
            order, vec, sketches, lists = [], [], [], []
            for d, at in by.items():
                if d not in codes:
                    codes[d] = Codes(d, *most[d])
                raw = [_exact(vs[k]) for k in at]
                x = _units(raw, d)
                order += at
                vec += raw
                sketches += _sketches(x)
                lists += codes[d].decode(x)
            take = pa.array(order, pa.int64())
            columns = [node.take(take), w.take(take), kind.take(take), pa.array([len(vs[k]) for k in order], pa.int32()), pa.array(vec, pa.binary()), pa.array(sketches, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "w", "kind", "d", "vec", "sketch", "filters"])

    # kind stands for the label and the length: only rows of one kind meet.
    coded = classes.select("node", "w", F.xxhash64("label", F.size("v")).alias("kind"), "v").mapInArrow(decoded, "node long, w long, kind long, d int, vec binary, sketch binary, filters array<long>")
    coded = scratch.cut(coded, "coded")
    posts = coded.select("node", "kind", F.explode("filters").alias("f"))
    busy = scratch.cut(posts.groupBy("kind", "f").agg(F.count("*").alias("n")).where("n > 1").select("kind", "f", F.ceil(F.col("n") / CELL).cast("int").alias("parts")), "busy")
    met = scratch.cut(posts.join(busy, ["kind", "f"]), "met")
    scratch.sweep()
    # A member of a part is in the cell of that part, and on either side of the cells that pair it with another part.
    cells = met.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("mine") == F.col("with"), 0).when(F.col("mine") < F.col("with"), 1).otherwise(2)
    cells = cells.select("kind", "f", F.least("mine", "with").alias("part"), F.greatest("mine", "with").alias("other"), side.alias("side"), "node")
    most_unequal = unequal_signs(cosine)
    key = ["kind", "f", "part", "other"]

    def flagged(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(tables, 4):
            side = rows.column(4).to_numpy()
            bits = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint64).reshape(rows.num_rows, -1)
            hit = np.zeros(rows.num_rows, bool)
            for x, y in row_pairs(numbered(rows, 4)):
                ok = (side[x] != side[y]) | (side[x] == 0)
                x, y = x[ok], y[ok]
                ok = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= most_unequal
                hit[x[ok]] = hit[y[ok]] = True
            yield from rows.drop_columns(["sketch"]).filter(pa.array(hit)).to_batches()

    near = cells.join(coded.select("node", "sketch"), "node").select(*key, "side", "node", "sketch").repartition(*key).sortWithinPartitions(*key)
    near = scratch.cut(near.mapInArrow(flagged, "kind long, f long, part int, other int, side int, node long"), "near")
    scratch.drop(met)
    scratch.sweep()
    # Of a row's filters, those below the cell's are asked for, in 4 bytes each if all fit.
    width = 4 if all(count * c.size ** len(c.codes) < 1 << 31 for c, count in ((ProductCode(d, n), count) for d, (n, count) in most.items())) else 8
    below = F.filter("filters", lambda g: g < F.col("f"))
    full = near.join(coded.select("node", "w", "d", "vec", "filters"), "node").select(*key, "side", "node", "w", "d", "vec", (below.cast("array<int>") if width == 4 else below).alias("below"))

    def linked(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(tables, 4):
            starts = np.flatnonzero(np.diff(numbered(rows, 4), prepend=-1))
            side, node, d = (rows.column(k).to_numpy() for k in (4, 5, 7))
            weight, vec, lists = rows.column(6).to_numpy().astype(np.float64), rows.column(8).to_pylist(), rows.column(9).combine_chunks()
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
            out: list[tuple[int, int | None, int]] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                if b - a > 1:
                    low = ends[a - 1] if a else 0
                    out += _cell_links(node[a:b], _units(vec[a:b], int(d[a])), flat[low : ends[b - 1]], ends[a:b] - low, weight[a:b], side[a:b] < 2, cosine)
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    links = scratch.cut(full.repartition(*key).sortWithinPartitions(*key).mapInArrow(linked, "a long, b long, n long"), "links")
    scratch.drop(near, coded)
    degree = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    found = components(links.where("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "of")
    about = classes.select("h1", "h2", "node", "w", "least").join(degree, "node", "left").join(found, F.col("node") == F.col("of"), "left")
    about = scratch.cut(about.select("h1", "h2", "least", (F.coalesce("others", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "node").alias("group")), "about")
    firsts = about.groupBy("group").agg(F.min("least").alias("component"))
    out = rows.select("id", "h1", "h2").join(about.join(firsts, "group").select("h1", "h2", "links", "component"), ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
