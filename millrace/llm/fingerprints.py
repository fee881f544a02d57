"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Each word shingle is hashed once. The top bits of the hash name a bin and the least hash of a bin is its value. An empty
bin takes the value of a bin that a hash of (bin, attempt) names, over and over until one isn't empty; after ATTEMPTS of
them it goes on through all bins in the order of a hash of (bin, other bin), so it always ends at a full one. Of each value the
low bits are kept, as hexadecimal digits in the order of the bins. All of it is DataFrame functions on arrays, so a text
is fingerprinted where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE

#: Bins, and bits kept of each: one hexadecimal digit.
BINS, BITS = 256, 4
#: Attempts before an empty bin goes through all bins in a hashed order; with a share q of bins empty, one in q ** ATTEMPTS gets there.
ATTEMPTS = 24


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, n: int) -> Column:
    """Hashes of the n-word shingles. Fewer words are one shingle; no words are one too, the empty one."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")

    def grams(h: Column) -> Column:
        last = F.size(h) - n
        many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(last >= 0, many).otherwise(F.array(F.xxhash64(h)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def bins(hashes: Column) -> Column:
    """The BINS densified values of hashes. A bin is the top bits of a signed hash; its largest number marks its end.

    With an end mark for every bin among the sorted hashes, the first number of each bin is its value, or the mark if it
    is empty.
    """
    shift = 64 - BINS.bit_length() + 1
    mark = (1 << shift) - 1
    ends = F.array(*[F.lit(((b - BINS // 2) << shift) + mark) for b in range(BINS)])

    def least(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(h, F.greatest(i - 1, F.lit(0))), shift)))

    def valued(h: Column) -> Column:
        return F.transform(least(h), lambda v: F.when(v.bitwiseAND(F.lit(mark)) != mark, v))

    def full(d: Column) -> Column:
        return F.filter(F.transform(d, lambda v, b: F.struct(b.alias("b"), v.alias("v"))), lambda x: x["v"].isNotNull())

    def filled(d: Column) -> Column:
        def probe(b: Column) -> Column:
            tries = F.sequence(F.lit(1), F.lit(ATTEMPTS))
            return F.aggregate(tries, F.lit(None).cast("long"), lambda got, a: F.coalesce(got, F.get(d, F.pmod(F.xxhash64(b, a), F.lit(BINS)).cast("int"))))

        def walk(b: Column, known: Column) -> Column:
            return F.array_min(F.transform(known, lambda x: F.struct(F.xxhash64(b, F.lit("walk"), x["b"]).alias("h"), x["v"].alias("v"))))["v"]

        return _let(full(d), lambda known: F.transform(d, lambda v, b: F.coalesce(v, probe(b), walk(b, known))))

    return _let(_let(F.sort_array(F.concat(hashes, ends)), valued), filled)


def fingerprint(text: Column, n: int = 5) -> Column:
    """BINS hexadecimal digits. Texts with the same words in the same order have equal ones."""
    return F.array_join(F.transform(bins(shingle_hashes(text, n)), lambda v: F.lower(F.hex(v.bitwiseAND((1 << BITS) - 1)))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets: equal digits, less those that are equal by chance."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))


def fingerprints(docs: DataFrame, n: int = 5, rows_a_range: int = 4_000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's, by ascending doc_id, nulls first and ties by text; the first follows the last. Null text: empty.

    Documents are dealt by ranges of doc_id once. The first of each range also goes to the range before it, so that every
    document finds its successor in its own task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low, high, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ranges = max(1, min(-(-count // rows_a_range), 1 << 16))
    bounds = []
    if low is not None and ranges > 1:
        found = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges))).first()[0]
        bounds = sorted({b for b in found if b > low})
    # bounds: the least doc_id of each range but the first. One number a range, found by halving.
    cuts = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(b).cast("long") for b in bounds])
        cuts = _rank(edges, len(bounds))
    rows = rows.withColumn("range", F.coalesce(cuts, F.lit(0)).cast("int")).withColumn("own", F.lit(True))
    # Each range's least row once more, at the end of the range before; the first row of all after the last range.
    firsts = rows.select("range", "doc_id", "text").groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    before = F.lag("range").over(Window.orderBy("range"))
    last = F.max("range").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = firsts.select(F.coalesce(before, last).alias("range"), F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"), F.lit(False).alias("own"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    both = rows.select("range", "doc_id", "text", "own").unionByName(heads)
    if bounds:
        both = both.repartition(max(parts, min(ranges, 2 * parts)), "range")
    order = Window.partitionBy("range").orderBy(F.desc("own"), F.asc_nulls_first("doc_id"), "text")
    chars, after = F.length("text"), F.lead("text").over(order)
    pairs = both.withColumn("after", after).withColumn("n_chars", chars)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("after", F.lit(1), half)))
    pairs = pairs.select("range", "doc_id", "own", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text"), n).alias("fingerprint"), F.when(F.col("own"), fingerprint(F.col("edited"), n)).alias("edited_fingerprint"), F.col("text"))
    pairs = pairs.withColumn("next_print", F.lead("fingerprint").over(order)).where("own")
    return pairs.select("doc_id", F.col("n_chars").cast("long"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))


def _rank(edges: Column, n: int) -> Column:
    """How many of n ascending edges doc_id reaches."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    at = F.array(*[F.lit(s) for s in steps])
    return F.aggregate(at, F.lit(0), lambda got, s: F.when((got + s <= n) & (F.get(edges, got + s - 1) <= F.col("doc_id")), got + s).otherwise(got))
