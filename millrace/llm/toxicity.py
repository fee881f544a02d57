"""Toxicity by a lexicon trie met with Levenshtein automata, and scores of the context of each hit.

The lexicon (words and stems) is learned from labelled rows: beginnings of words that toxic texts have in many contexts
and other texts hardly ever. Words are read by the automaton of all edits of all terms at once: a state is a set of (trie
node, edits so far); states and steps are made when first met and kept. Words that are a few edits from a term but which
texts of label 0 hold are themselves and no misspelling. A hit counts by its edits, by whether it stands in quotation marks
or after a reporting word, and by other hits nearby; a logistic model fitted on those strengths gives the score. No hit
outside of a quotation can lower it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import exp, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import alone, remainder5

#: Rows of either label, at most about, that the model is fitted on. Chosen by a hash of the id.
SAMPLE = 8_000
#: Terms of the lexicon at most.
TERMS = 2_000
#: Beginnings of words at most, about, that a task counts before it sends what it has.
COUNTED = 100_000
#: Words to either side of a hit that are its context.
WINDOW = 6
_EDGE, _END = re.compile(r"^\W+|\W+$"), re.compile(r"\W+$")
_QUOTES = re.compile(r"[\"“”„«»]")
#: Words that report another's speech or speak of a word.
REPORTING = frozenset({"said", "says", "called", "word", "words", "term", "quote", "quoted", "wrote", "reported", "sagte", "sagt", "wort", "dit", "mot", "dijo", "dice", "palabra"})
#: Signs that stand for letters.
SIGNS = str.maketrans("013457@$!", "oieastasi")
#: What a hit with 0, 1 or 2 edits is worth.
FACTOR = (1.0, 0.8, 0.5)
#: Strength, whether there is any, strength near other hits, density, strength of quoted hits. All but the last can only raise.
FEATURES, RAISING = 5, 4


class Terms(NamedTuple):
    """What is learned of words: terms as (text, whole), and words near a term that aren't misspellings of it."""

    terms: list[tuple[str, bool]]
    innocent: frozenset[str] = frozenset()


def quoted_places(text: str, words: list[str]) -> set[int]:
    """Places of words that stand in quotation marks or at most WINDOW words after a reporting word."""
    out: set[int] = set()
    if _QUOTES.search(text):
        opened = False
        for i, w in enumerate(words):
            marks = len(_QUOTES.findall(w))
            if opened or marks:
                out.add(i)
            opened ^= marks % 2 == 1
    if not REPORTING.isdisjoint(bare := [_EDGE.sub("", w) for w in words]):
        for i, w in enumerate(bare):
            if w in REPORTING:
                out.update(range(i + 1, min(i + 1 + WINDOW, len(words))))
    return out


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Lexicon:
    """terms: (text, whole): a whole word, or a stem that a word begins with. find(word) -> (edits, exact) or None.

    Edits may be anywhere in a whole word; the first letter of a stem is never changed, dropped or put off.
    """

    def __init__(self, terms: list[tuple[str, bool]], states: int = 50_000):
        self.terms, self.limit = terms, states
        self.children: list[dict[str, int]] = [{}]
        self.edits: list[int] = [0]  # the most that any term below a node allows
        self.ends: list[tuple[bool, bool, int] | None] = [None]  # whole, stem, edits
        for text, whole in terms:
            node, k = 0, allowed_edits(text)
            self.edits[0] = max(self.edits[0], k)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.edits.append(0)
                    self.ends.append(None)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], k)
            old = self.ends[node] or (False, False, 0)
            self.ends[node] = (old[0] or whole, old[1] or not whole, max(old[2], k))
        self._reset()

    def _reset(self):
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[int] = []  # least edits of a whole word that ends here, or 9
        self.begun: list[int] = []  # least edits of a stem that ends here, or 9
        self.start = self._number(frozenset([(0, 0)]))

    def _number(self, states: frozenset) -> int:
        # Nodes from `size` on are the same ones, reached by an edit of the first letter: only whole words may end there.
        size, least = len(self.children), {}
        todo = list(states)
        while todo:  # a missing letter: on to the children without reading
            node, e = todo.pop()
            if least.get(node, 9) <= e:
                continue
            least[node] = e
            plain = node % size
            over = size if node >= size or not plain else 0
            todo += [(child + over, e + 1) for child in self.children[plain].values() if e + 1 <= self.edits[child]]
        key = frozenset(least.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ended = [(n < size, e, self.ends[n % size]) for n, e in key if self.ends[n % size]]
            self.final.append(min((e for _, e, (whole, _, k) in ended if whole and e <= k), default=9))
            self.begun.append(min((e for first, e, (_, stem, k) in ended if first and stem and e <= k), default=9))
        return self.numbers[key]

    def _step(self, at: int, c: str) -> int:
        out, size = set(), len(self.children)
        for node, e in self.sets[at]:
            plain = node % size
            for letter, child in self.children[plain].items():
                cost = e + (letter != c)
                if cost <= self.edits[child]:
                    out.add((child + size if node >= size or not plain and letter != c else child, cost))
            if e + 1 <= self.edits[plain]:
                out.add((node if plain else size, e + 1))
        to = self.steps[at][c] = self._number(frozenset(out)) if out else -1
        return to

    def find(self, word: str) -> int | None:
        """The least number of edits to a term, or None."""
        if len(self.sets) > self.limit:
            self._reset()
        at, best = self.start, 9
        for c in word:
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if at < 0:
                break
            best = min(best, self.begun[at])
        else:
            best = min(best, self.final[at])
        return None if best == 9 else best


class Scanner:
    """Features of texts under what was learned. At most `memo` words that were met are remembered; features don't depend on it."""

    def __init__(self, words: Terms, memo: int = 100_000):
        self.lexicon, self.innocent, self.memo, self.known = Lexicon(words.terms), words.innocent, memo, {}

    def _edits(self, word: str) -> int:
        """0 to 2 edits, or -1. Signs that stand for letters count as an edit."""
        bare = _EDGE.sub("", word)
        found = self.lexicon.find(bare) if bare else None
        if found is None:
            # A sign may stand for the first letter; at the end it is punctuation.
            for plain in {bare.translate(SIGNS), _EDGE.sub("", _END.sub("", word).translate(SIGNS))} - {bare, ""}:
                if (e := self.lexicon.find(plain)) is not None:
                    found = min(max(1, e), 9 if found is None else found)
        if found and bare in self.innocent:
            found = None
        if len(self.known) >= self.memo:
            self.known.clear()
        self.known[word] = e = -1 if found is None else min(found, 2)
        return e

    def marks(self, words: list[str]) -> list[int]:
        for w in set(words).difference(self.known):
            self._edits(w)
        marks = list(map(self.known.get, words))
        if None in marks:  # the memo was cleared while the words were learned
            marks = [self._edits(w) if e is None else e for w, e in zip(words, marks)]
        return marks

    def features(self, text: str) -> list[float]:
        words = text.lower().split()
        hits = [(i, e) for i, e in enumerate(self.marks(words)) if e >= 0]
        if not hits:
            return [0.0] * FEATURES
        aside = quoted_places(text, words)
        strength = near = quoted = 0.0
        for k, (i, e) in enumerate(hits):
            if i in aside:
                quoted += FACTOR[e]
                continue
            strength += FACTOR[e]
            if (k > 0 and i - hits[k - 1][0] <= WINDOW) or (k + 1 < len(hits) and hits[k + 1][0] - i <= WINDOW):
                near += FACTOR[e]
        return [log1p(strength), min(1.0, strength), log1p(near), log1p(100 * strength / (len(words) + 20)), log1p(quoted)]


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled rows outside of the held-out fold; rows are chosen by id alone."""
    fold = labels.where(remainder5(F.col("doc_id")) != 0).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in fold.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, F.lit(SAMPLE * 1e6 / max(1, n.get(1, 0)))).otherwise(F.lit(SAMPLE * 1e6 / max(1, n.get(0, 0))))
    chosen = fold.where(place < share).select(F.col("doc_id").alias("id"), "toxic")  # about 2 * SAMPLE ids, so small enough to send
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["id"]).select("doc_id", "text", "toxic")


def _texts(table: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, str]]:
    """The texts of a batch with their places; about 1 MB of them are Python's at a time. A null is an empty one."""
    texts = table.column(column)
    for a, b in slices(texts, 1 << 20):
        for i, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
            yield i, text or ""


def _beginnings(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, whole, toxic, n, contexts): in how many texts of a label a beginning of a word occurs outside of quotations, and 64 bits of the words before it.

    A term may have several rows: those of a task are added up until there are COUNTED.
    """
    found: dict[tuple[str, bool, int], list[int]] = {}

    def counted() -> pa.RecordBatch:
        keys = list(found)
        bits = [found[k][1] - (1 << 64) * (found[k][1] >> 63) for k in keys]
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array(bits, pa.int64())], names=["term", "whole", "toxic", "n", "bits"])
        found.clear()
        return out

    for table in tables:
        labels = table.column(2).to_pylist()
        for at, text in _texts(table):
            here: dict[tuple[str, bool], int] = {}
            before, words = "", text.lower().split()
            aside = quoted_places(text, words)
            for i, w in enumerate(words):
                bare = _EDGE.sub("", w)
                if i not in aside and len(bare) > 3 and bare[:4].isalpha():
                    bit = 1 << (zlib.crc32(before.encode()) & 63)
                    for k in range(4, min(len(bare), 9)):
                        here[bare[:k], False] = here.get((bare[:k], False), 0) | bit
                    if len(bare) <= 16:
                        here[bare, True] = here.get((bare, True), 0) | bit
                before = bare
            for key, bits in here.items():
                x = found.setdefault((*key, labels[at]), [0, 0])
                x[0] += 1
                x[1] |= bits
            if len(found) >= COUNTED:
                yield counted()
    yield counted()


def learn_lexicon(sample: DataFrame, support: float = 0.01, contexts: int = 6, lift: float = 12.0) -> list[tuple[str, bool]]:
    """Terms of a labelled sample (doc_id, text, toxic). A term occurs in `support` of the toxic texts or more, after at
    least `contexts` different words (so that copies of one text don't teach it), and `lift` times as often as in others."""
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not size.get(1):
        return []
    counted = sample.mapInArrow(alone(_beginnings), "term string, whole boolean, toxic int, n long, bits long").groupBy("term", "whole").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"), F.bit_count(F.bit_or(F.when(F.col("toxic") == 1, F.col("bits")).otherwise(0))).alias("contexts"))
    rate = (F.col("bad") / size[1]) / ((F.col("good") + 0.5) / max(1, size.get(0, 0)))
    good = counted.where((F.col("bad") >= max(3, support * size[1])) & (F.col("contexts") >= contexts) & (rate >= lift))
    rows = {(r["term"], r["whole"]): r["bad"] for r in good.orderBy(F.desc("bad"), "term", "whole").limit(20 * TERMS).collect()}
    chosen: list[tuple[str, bool]] = []
    # The longest beginning that hardly fewer texts have stands for its shorter ones; a whole word stands for itself.
    for (term, whole), n in sorted(rows.items(), key=lambda x: (len(x[0][0]), x[0])):
        if any(term.startswith(t) and not w for t, w in chosen):
            continue
        if whole:
            chosen.append((term, True))
        elif rows.get((term, True), 0) < 0.9 * n and not any(t.startswith(term) and len(t) > len(term) and m >= 0.9 * n for (t, _), m in rows.items()):
            chosen.append((term, False))
    return chosen[:TERMS]


def learn_innocent(sample: DataFrame, terms: list[tuple[str, bool]], lift: float = 12.0) -> frozenset[str]:
    """Words of a labelled sample that are near a term and in texts of label 0, and not `lift` times as often in the others."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Terms(terms))
        for table in tables:
            words, labels, toxics = [], [], table.column(2).to_pylist()
            for i, text in _texts(table):
                here = sorted(set(text.lower().split()))
                near = {_EDGE.sub("", w) for w, e in zip(here, scanner.marks(here)) if e > 0}
                words += near
                labels += [toxics[i]] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], names=["word", "toxic"])

    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counts = sample.mapInArrow(alone(work), "word string, toxic int").groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")).where("good > 0")
    often = (F.col("bad") / max(1, size.get(1, 0))) >= lift * (F.col("good") / max(1, size.get(0, 0)))
    return frozenset(r["word"] for r in counts.where(~often).select("word").collect())  # words of at most about 2 * SAMPLE texts


def _features(sample: DataFrame, words: Terms) -> np.ndarray:
    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(words)
        for table in tables:
            x = [scanner.features(t) for _, t in _texts(table)]
            yield pa.RecordBatch.from_arrays([table.column(2), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(alone(work), "toxic int, x array<double>").collect()  # about 2 * SAMPLE rows of FEATURES numbers
    return np.array([[r["toxic"], *r["x"]] for r in rows]).reshape(len(rows), FEATURES + 1)


def fit(data: np.ndarray, base_rate: float) -> list[float]:
    """Weights (the first is the constant) of a logistic model by Newton's method with a ridge; classes weigh as in all rows.
    Weights of raising features are held at zero or above: one that would fall below stays there while its slope says so."""
    if not len(data):
        return [-4.0] + [0.0] * FEATURES
    order = np.lexsort(data.T[::-1])
    y, x = data[order, 0], np.concatenate([np.ones((len(data), 1)), data[order, 1:]], 1)
    share = y.mean()
    weight = np.where(y == 1, base_rate / max(share, 1e-9), (1 - base_rate) / max(1 - share, 1e-9))
    w, ridge = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 0.5)
    ridge[0] = 1e-3
    held = np.zeros(FEATURES + 1, bool)
    held[1 : RAISING + 1] = True
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        free = ~(held & (w <= 0) & (grad > 0))
        some = x[:, free]
        hess = (some * (weight * p * (1 - p) + 1e-9)[:, None]).T @ some + np.diag(ridge[free])
        step = np.linalg.solve(hess, grad[free])
        before = w.copy()
        w[free] -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        w[held] = np.maximum(w[held], 0)
        if np.abs(w - before).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Terms, list[float]]:
    """Words and weights from documents (doc_id, text) and labels (doc_id, toxic); no other column is read."""
    sample = _training(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).persist()
    try:
        terms = learn_lexicon(sample)
        words = Terms(terms, learn_innocent(sample, terms))
        fold = labels.where((remainder5(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
        return words, fit(_features(sample, words), min(0.5, max(0.01, fold or 0.01)))
    finally:
        sample.unpersist()


def score(docs: DataFrame, words: Terms, weights: list[float], column: str = "score") -> DataFrame:
    """docs with one more column: the probability that the text is toxic. A null text is an empty one."""
    schema = docs.schema

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(words)
        for table in tables:
            scores = []
            for _, t in _texts(table, table.schema.get_field_index("text")):
                z = weights[0] + sum(a * b for a, b in zip(weights[1:], scanner.features(t)))
                scores.append(1 / (1 + exp(-max(-40.0, min(40.0, z)))))
            yield table.append_column(column, pa.array(scores, pa.float64()))

    return docs.mapInArrow(alone(work), type(schema)([*schema.fields, *_double(column)]))


def _double(name: str):
    from pyspark.sql.types import DoubleType, StructField

    return [StructField(name, DoubleType())]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted.

    Labels of rows whose crc32(doc_id) mod 5 is 0 are never read. Without any label of 1 in the rest, no text is toxic.
    Repeated rows get equal scores; several labels of one id count as 1 if any is.
    """
    words, weights = learn(docs, labels)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words, weights)
    return out.select("doc_id", F.coalesce(remainder5(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
