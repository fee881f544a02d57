"""Contracts of the training-data operators against brute force, their edge cases, and the pipeline stage by stage."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, capfilters, common, contextmix, fingerprints, jaccardjoin, packing, shards, toxicity
from millrace.llm.queries import tokenizer_path

from .test_llm import SCHEMA, frame, odd_texts


def sets_of(texts, n):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()) for w in words]


def groups_of(linked, size):
    """The least member of each component."""
    up = list(range(size))

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(size)]


def similar_pairs(sets, percent):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


# ---- op4 -------------------------------------------------------------------------------------------------------------
def test_a_shingle_of_all_texts_and_groups_in_parts(spark, monkeypatch):
    # 600 texts that share a line, of which some are near copies just above and just below the bound.
    rng = np.random.default_rng(12)
    line = "all of these texts hold this one line of words"
    texts = []
    for i in range(600):
        w = [f"a{rng.integers(10**6)}" for _ in range(14)]
        texts.append(" ".join([*w[:7], line, *w[7:]]))
    base = [f"b{k}" for k in range(60)]
    for i in range(150):
        w = list(base)
        for p in rng.choice(60, 1 + i % 5, replace=False):
            w[p] = f"c{rng.integers(10**6)}"
        texts.append(" ".join(w))
    want = groups_of(similar_pairs(sets_of(texts, 4), 85), len(texts))
    for part in (2_000, 7):
        monkeypatch.setattr(jaccardjoin, "PART", part)
        monkeypatch.setattr(jaccardjoin, "CLUSTER", part)
        got = {r["doc_id"]: r["component_id"] for r in jaccardjoin.jaccard_components(frame(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want
    monkeypatch.setattr(jaccardjoin, "SEND", 0)  # texts by a shuffle
    got = {r["doc_id"]: r["component_id"] for r in jaccardjoin.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_what_is_shuffled_at_once_is_a_share_of_the_input(spark, monkeypatch):
    """Near copies of everything: whole sets of all texts meet, twice and in the cells of parts, but never all at once."""
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(40):
        base = [f"w{rng.integers(10**6)}" for _ in range(80)]
        for i in range(6):
            w = list(base)
            for p in rng.choice(80, i % 3, replace=False):
                w[p] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(w))
    want = groups_of(similar_pairs(sets_of(texts, 4), 85), len(texts))
    monkeypatch.setattr(jaccardjoin, "ROUND", 1, raising=False)
    monkeypatch.setattr(jaccardjoin, "SHARE", 3, raising=False)
    cut, sizes = common.Scratch.cut, {}

    def spied(self, df, name, *more):
        out = cut(self, df, name, *more)
        if name in ("sets", "shared", "classes"):
            sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "cut", spied)
    got = {r["doc_id"]: r["component_id"] for r in jaccardjoin.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(sizes["classes"]) > 1 and sum(sizes["classes"]) == len(set(texts))
    assert max(sizes["classes"] + sizes["sets"]) < 0.8 * len(set(texts)), sizes


def test_tokens_and_seeds_go_in_rounds_too(spark, monkeypatch):
    rng = np.random.default_rng(23)
    texts = []
    for _ in range(40):
        base = " ".join(f"w{rng.integers(10**6)}" for _ in range(60))
        texts += [base, f"copy {base}", f"{base} copy"]
    want = groups_of(similar_pairs(sets_of(texts, 4), 85), len(texts))
    monkeypatch.setattr(jaccardjoin, "ROUND", 1)
    monkeypatch.setattr(jaccardjoin, "SHARE", 3)
    cut, drop, tables = common.Scratch.cut, common.Scratch.drop, {}

    def spied(self, df, name, *more):
        out = cut(self, df, name, *more)
        tables.setdefault(name, []).append(out.count())
        return out

    def dropped(self, *frames):  # tables of prefixes are large, so each goes once it is read
        tables.setdefault("dropped", []).append(sum(len(f.columns) == 5 and "hubs" in f.columns for f in frames))
        drop(self, *frames)

    monkeypatch.setattr(common.Scratch, "cut", spied)
    monkeypatch.setattr(common.Scratch, "drop", dropped)
    got = {r["doc_id"]: r["component_id"] for r in jaccardjoin.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    for name in ("agreeing", "known", "met"):
        assert len(tables[name]) > 1, (name, tables)
    assert sum(tables["known"]) == len(texts) and max(tables["known"]) < 0.8 * len(texts), tables
    assert sum(tables["dropped"]) == len(tables["known"])


def test_rows_of_a_cell_are_joined_by_whole_components():
    x, y = np.array([3, 3, 5, 1]), np.array([5, 6, 7, 7])
    assert jaccardjoin._joined(8, x, y).tolist() == [0, 1, 2, 1, 4, 1, 1, 1]
    rng = np.random.default_rng(24)
    for _ in range(300):
        size = int(rng.integers(2, 60))
        x, y = rng.integers(0, size, (2, int(rng.integers(1, size))))
        want = list(range(size))
        for a, b in zip(x.tolist(), y.tolist()):
            low, high = sorted((want[a], want[b]))
            want = [low if w == high else w for w in want]
        assert jaccardjoin._joined(size, x, y).tolist() == want


def test_a_word_is_encoded_once_for_all_marks_that_end_it():
    enc = bpe.PieceEncoder(tokenizer_path())
    tok, asked = enc.tok, []

    class Spy:
        def encode_batch_fast(self, texts, **more):
            asked.append(sum(map(len, texts)))
            return tok.encode_batch_fast(texts, **more)

    words = [f"{a}ä{b}onung{c}é" for a in "abcdefgh" for b in "ijklmn" for c in "opqrst"]
    text = " ".join(w + m for m in ("", ".", ",", "?!", ";") for w in words)
    odd = ["", " ", "a", " a", "a ", "a  b.", ".\n x,", "a.\nb c.\n", "x <|endoftext|>. y", "don't we'll, 's. 12. ½. ǆ. Ωx. 中文。, x\x00. y", "a\u00a0. b\u2028, c"]
    enc.tok = Spy()
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode([text, *odd, text])]
    assert got == [e.ids for e in tok.encode_batch([text, *odd, text], add_special_tokens=False)]
    assert sum(asked) < len(text) / 2


def test_a_word_is_encoded_once_whatever_stands_around_it():
    from tokenizers import Tokenizer

    enc = bpe.PieceEncoder(tokenizer_path())
    tok, asked = enc.tok, []

    class Spy:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **more):
            asked.append(sum(map(len, texts)))
            return self.tok.encode_batch_fast(texts, **more)

    words = [f"{a}ä{b}onung{c}é" for a in "abcdefgh" for b in "ijklmn" for c in "opqrst"]
    for name, x in list(vars(enc).items()):
        if isinstance(x, Tokenizer):
            setattr(enc, name, Spy(x))
    texts = [" " + f"{mark} ".join(words) + mark for mark in ("", ".", "$$$", "|", ".\n", "'s", '")', "-12", "\n\n")]
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert 0 < sum(asked) < 2 * sum(len(f" {w}".encode()) for w in words)


def test_ids_are_the_tokenizer_s_for_any_characters():
    import pyarrow as pa

    enc, rng = bpe.PieceEncoder(tokenizer_path(), memo=500), np.random.default_rng(11)
    parts = [*"abstmd19!-<|>' \n\t\r", "'s", "'ll", "'re", "'LL", "  ", " \n", "\u001c", "\u0085", "\u00a0", "\u2028", "\u3000", "½", "Ⅷ", "é", "ª", "ǅ", "Ω", "中", "क", "\u093f", "\u0301", "😀", "\u200d", "\ue000", "\U0010ffff", "\x00", "<|endoftext|>"]
    odds = np.array([1.0] * (len(parts) - 1) + [0.05])
    points = [c for c in rng.integers(0, 0x30000, 4000).tolist() if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40), p=odds / odds.sum())) for _ in range(1500)]
    texts += [f"a{c}b 1{c}2 !{c}? {c}x\n{c} {c}" for c in map(chr, points)] + [None, "", " ", "'s", "a'"]
    want = [e.ids for e in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for array in (pa.array(texts), pa.array(["x", None, *texts], pa.large_string()).slice(2)):
        got = []
        for first, ids, ends in enc.ended(array, 7, size=3000):
            assert first == len(got)
            got += [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())]
        assert got == [[*w, 7] for w in want]


def test_null_and_repeated_ids_of_texts(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "x y z u v w")
    rows = [(1, a), (4, a), (4, b), (3, b), (None, a), (None, c), (None, None), (7, None), (4, a)]
    out = jaccardjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)
    assert got == sorted([(1, 3, 1), (4, 3, 1), (4, 2, 3), (3, 2, 3), (None, 3, 1), (None, 3, None), (None, 0, None), (7, 0, 7), (4, 3, 1)], key=str)


def test_maps_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 900, np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(2))
        a, b = jaccardjoin._bit_map(x), jaccardjoin._bit_map(y)
        size = min(len(a), len(b))
        for s in (size, jaccardjoin.SHORT // 8):
            assert int(np.bitwise_count(jaccardjoin._folded(a, s) ^ jaccardjoin._folded(b, s)).sum()) <= len(np.setxor1d(x, y))


# ---- op1 -------------------------------------------------------------------------------------------------------------
def test_recall_near_the_bound_components_and_cells(spark, monkeypatch):
    rng = np.random.default_rng(17)
    x, y = capfilters.pairs_at(64, 0.935, 400, seed=23)
    hot = rng.standard_normal((1, 64)) + 0.04 * rng.standard_normal((150, 64))
    vecs = np.float32(np.concatenate([x, y, hot, rng.standard_normal((400, 64))]))
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int")
    v = vecs.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & ~np.eye(len(v), dtype=bool)
    want = groups_of(zip(*np.nonzero(np.triu(near))), len(v))
    for cell in (1_500, 40):
        monkeypatch.setattr(capfilters, "CELL", cell)
        got = {r["vec_id"]: r for r in capfilters.near_duplicate_vectors(df).collect()}
        found = np.array([got[i]["n_links"] for i in range(len(v))])
        assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()
        assert (found[800:950] == near.sum(1)[800:950]).all()
        assert np.mean([got[i]["component_id"] == want[i] for i in range(len(v))]) >= 0.99
        assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(v)))


def test_rows_that_repeat_an_id_are_linked_by_their_vectors(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near_a, near_b = [1.0, 0.1, 0.0, 0.0], [0.1, 1.0, 0.0, 0.0]
    rows = [(1, a, 0), (7, near_a, 0), (7, b, 0), (2, near_b, 0), (9, a, 0), (9, a, 0), (5, a, 1), (None, a, 0)]
    out = capfilters.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out), key=str)
    assert got == sorted([(1, 3, 1, True), (7, 3, 1, False), (7, 1, 2, False), (2, 1, 2, True), (9, 3, 1, False), (9, 3, 1, False), (5, 0, 5, True), (None, 0, None, False)], key=str)


# ---- op2, op6 --------------------------------------------------------------------------------------------------------
def test_shards_hold_even_bytes_and_whole_groups(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdef "), rng.integers(20, 400))) for _ in range(900)]
    texts += [t for k in range(25) for t in [texts[k]] * (1 + k % 4)] + [None, None, ""]
    rows = shards.shard_documents(frame(spark, texts), 8).collect()
    loads, at, where = [0] * 8, {}, {}
    for r in rows:
        t = texts[r["doc_id"]]
        raw = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        loads[r["shard"]] += r["size"]
        at.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(t, set()).add(r["shard"])
    assert max(loads) - min(loads) <= 401 and all(sorted(s) == list(range(len(s))) for s in at.values())
    assert sum(len(s) > 1 for t, s in where.items() if t) == 0


def test_pieces_are_the_tokenizer_s_ids(spark):
    from tokenizers import Tokenizer

    tok, texts = Tokenizer.from_file(tokenizer_path()), odd_texts()
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    rows = packing.pack(frame(spark, texts), tokenizer_path()).collect()
    seen = [[] for _ in texts]
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert all(sorted(s) == list(range(len(i))) for s, i in zip(seen, ids))


# ---- op8 -------------------------------------------------------------------------------------------------------------
def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last


def test_automaton_equals_edit_distances():
    rng = np.random.default_rng(9)
    draw = lambda lo, hi: "".join(rng.choice(list("abc"), rng.integers(lo, hi)))
    terms = sorted({(draw(3, 11), bool(rng.integers(2))) for _ in range(25)})
    lex = toxicity.Lexicon(terms, states=400)
    for _ in range(1500):
        word, best = draw(0, 13), 9
        for term, whole in terms:
            e = edits(term, word)[-1] if whole else 9 if word[:1] != term[0] else min(edits(term[1:], word[1:]))
            if e <= toxicity.allowed_edits(term):
                best = min(best, e)
        assert lex.find(word) == (None if best == 9 else best), word


def test_beginnings_of_many_words_are_counted_in_little_memory():
    """Texts whose words hardly ever repeat: a task sends what it has counted before it holds those of a whole batch."""
    rng, letters = np.random.default_rng(5), np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join("".join(letters[w]) for w in rng.integers(0, 26, (100, 9))) for _ in range(700)]
    texts += ["odd shortword shortword", None, ""] * 2
    labels = [i % 2 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array(labels, pa.int32())], names=["doc_id", "text", "toxic"])
    wanted: dict = {}
    for text, toxic in zip(texts, labels):
        words = set((text or "").split())
        for key in {(w[:k], False) for w in words for k in range(4, 9) if len(w) > max(3, k)} | {(w, True) for w in words if len(w) > 3}:
            wanted[(*key, toxic)] = wanted.get((*key, toxic), 0) + 1
    tracemalloc.start()
    next(toxicity._beginnings(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6, f"{peak / 1e6:.0f} MB"
    found: dict = {}
    for out in toxicity._beginnings(iter([batch.slice(0, 300), batch.slice(300)])):
        for term, whole, toxic, n in zip(*(out.column(k).to_pylist() for k in range(4))):
            found[term, whole, toxic] = found.get((term, whole, toxic), 0) + n
    assert found == wanted


def test_a_task_begins_without_the_encoders_of_earlier_ones():
    """Spark uses a Python worker again: what the packing kept there isn't added to what the next operator takes."""
    bpe.encoder(tokenizer_path()).encode(["some words to keep"])
    assert bpe._ENCODERS and list(common.alone(lambda tables: tables)(iter(()))) == []
    assert not bpe._ENCODERS


def test_misspelled_abuse_is_abuse_and_quoted_abuse_is_not(spark):
    rng = np.random.default_rng(3)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"] + ["idiom"]
    texts, labels = [], []
    for i in range(600):
        w = list(rng.choice(words, 40))
        if i % 3 == 0:
            for p in rng.choice(40, 3, replace=False):
                w[p] = rng.choice(["idiot", "stupid", "worthless"])
        elif i % 3 == 1 and i % 2:
            w[10:13] = ["he", "said", f'"{rng.choice(["idiot", "stupid", "worthless"])}"']
        texts.append(" ".join(w))
        labels.append((i, int(i % 3 == 0)))
    asked = ["you stupid idiot", "you stupidd idiiot", "you ztupid xidiot", "you $tupid !diot", "a tupid idot", 'she said "stupid" or "idiot"', "an idiom", "", None]
    calm = " ".join(words[:30])
    every = [*texts, *[f"{calm} {a}" if a else a for a in asked]]
    out = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, every), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [out[len(texts) + k]["predicted"] for k in range(len(asked))] == [1, 1, 1, 1, 1, 0, 0, 0, 0]
    held = [r for i, r in out.items() if r["held_out"] and i < len(texts)]
    assert held and all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held)


def test_odd_labels_and_rows_of_toxicity(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 7)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "idiot " * 9), (1, "idiot " * 9), (None, "x"), (2, "y" * 50_000), (3, "")], "doc_id long, text string")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1 and [r["held_out"] for r in out if r["doc_id"] is None] == [False]


# ---- op9 -------------------------------------------------------------------------------------------------------------
def spark_hash(*values):
    """xxhash64 of Spark: each value's hash is the seed of the next one's."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(v[1], "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_print(text, n=5):
    w = [spark_hash(x) for x in text.split()]
    grams = [spark_hash(*[(x, 8) for x in w[i : i + n]]) for i in range(len(w) - n + 1)] if len(w) >= n else [spark_hash(*[(x, 8) for x in w])]
    least = {}
    for g in grams:
        if g & ((1 << 56) - 1) != (1 << 56) - 1:
            least[(g >> 56) + 128] = min(g, least.get((g >> 56) + 128, g))
    out = []
    for b in range(256):
        v = least.get(b)
        for a in range(1, fingerprints.ATTEMPTS + 1):
            v = least.get(spark_hash((b, 4), (a, 4)) % 256) if v is None else v
        if v is None:
            v = least[min(least, key=lambda x: spark_hash((b, 4), "walk", (x, 4)))]
        out.append(f"{v & 15:x}")
    return "".join(out)


def brute_likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (1 - 1 / 16))


def test_fingerprints_equal_brute_force(spark):
    texts = [t or "" for t in odd_texts()]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(spark, odd_texts()), rows_a_range=20).collect()}
    plain = [t for t in texts if t.isascii()]
    prints = {t: brute_print(t) for t in plain}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        if t in prints:
            assert got[i]["fingerprint"] == prints[t]
        if t in prints and edited.isascii():
            assert got[i]["edited_fingerprint"] == brute_print(edited)
            assert got[i]["near_edited"] == pytest.approx(brute_likeness(prints[t], got[i]["edited_fingerprint"]))
        if t in prints and after in prints:
            assert got[i]["near_next"] == pytest.approx(brute_likeness(prints[t], prints[after]))


def test_one_row_null_ids_and_ties_of_fingerprints(spark):
    one = fingerprints.fingerprints(frame(spark, ["a b c d e f"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    rows = [(None, "b"), (None, "a"), (3, "z z z"), (3, "y y y"), (3, None)]
    out = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and len({r["fingerprint"] for r in out}) == 5


# ---- op10 ------------------------------------------------------------------------------------------------------------
class Bare(contextmix.Reader):
    """Texts without an end of their own; the word <end> is one."""

    def read(self, texts, given=None):
        words = [[contextmix.END if w == b"<end>" else w for w in t.split()] for t in texts]
        sizes = np.array([len(w) for w in words])
        idx = np.array([self.index[w] for some in words for w in some], np.int64)
        if self.index.new:
            self._learn(self.index.new, given)
            self.index.new = []
        return idx, sizes


def test_mixed_probabilities_of_all_next_words_add_up_to_one():
    rng = np.random.default_rng(8)
    counts = {contextmix.END: 40} | {f"{c}{k}".encode(): int(rng.integers(1, 50)) for c in "abcdef" for k in range(12)}
    order = sorted(counts, key=lambda w: (-counts[w], contextmix._hash(w)))
    own, rest = order[:30], order[30:]
    masses = {c: sum(counts[w] + 0.5 for w in rest if contextmix._class(w) == c) for c in {contextmix._class(w) for w in rest}}
    tree = contextmix.Tree([(contextmix._hash(w), counts[w]) for w in own], masses, 1 << 13)
    known = sorted((contextmix._hash(w), n) for w, n in counts.items())
    reader = Bare(tree, (np.array([h for h, _ in known]), np.array([n for _, n in known])))
    tables = [rng.integers(0, 1 << 16, 1 << b, dtype=np.uint16) for b in tree.slot_bits]
    score = lambda texts: contextmix.score_texts(reader, tables, texts)[4]
    every = [w if w != contextmix.END else b"<end>" for w in counts] + [b"never-seen"]
    for prefix in (b"", b"a1", b" ".join([b"a1", b"b2", b"c3"] * 7)):
        before = score([prefix])[0] if prefix else 0.0
        assert (10 ** (score([prefix + b" " + w for w in every]) - before)).sum() == pytest.approx(1.0, abs=1e-4)


def test_odd_rows_of_scores(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, "A  b"), (4, "x" * 5000)]
    out = contextmix.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add((r["n_tokens"], r["n_known"], r["score"]))
    for r in out:
        size = len(({i: t for i, t in rows if i is not None}.get(r["doc_id"]) or "").encode())
        assert r["bits_per_byte"] == (pytest.approx(-r["score"] / np.log10(2) / size) if r["doc_id"] is not None and size else r["bits_per_byte"])
    assert [r["bits_per_byte"] for r in out if r["doc_id"] == 2] == [None]
    assert len(out) == 6 and len(by[1]) == 1 and {x[0] for x in by[2]} == {1} and by[3] == by[1] == by[None]


def test_only_seldom_words_are_looked_up_by_a_join(spark, monkeypatch):
    """A joined row for each word of each text is many times the input."""
    texts = [" ".join(f"common{k}" for k in range(60)) + f" once{i} twice{i // 2}" for i in range(80)]
    cut, looked_up = contextmix.Scratch.cut, []

    def spied(self, df, name, *more):
        out = cut(self, df, name, *more)
        if name == "counts":
            looked_up.append(out)
        return out

    monkeypatch.setattr(contextmix.Scratch, "cut", spied)
    some, every = (sorted(map(tuple, contextmix.scores(frame(spark, texts), send=send).collect())) for send in (70, 10**6))
    assert len(looked_up) == 1
    found = [x["h"] for r in looked_up[0].collect() for x in r["counts"]]
    assert 0 < len(found) <= 160 and not {contextmix._hash(b"common%d" % k) for k in range(60)} & set(found)
    assert [r[:5] for r in some] == [r[:5] for r in every]
    assert np.allclose([r[5:7] for r in some], [r[5:7] for r in every])


def test_so_many_words_are_sent(spark):
    rng = np.random.default_rng(3)
    n = np.concatenate([np.floor(rng.pareto(0.7, 3000) + 1), [2.0**k for k in range(30)]]).astype(np.int64)
    vocab = spark.createDataFrame([(int(x),) for x in n], "n long")
    for send in (0, 1, 7, 300, 2000, len(n) - 1, len(n)):
        least = contextmix._least_sent(vocab, send)
        assert (n >= least).sum() <= send, send
        assert (n >= least - 1 - least // 128).sum() > send or least == 1, send



# ---- the pipeline ----------------------------------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(21)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    texts, labels = [], []
    for i in range(300):
        w = list(rng.choice(words, 50))
        if i % 5 == 0:
            w[5], w[20], w[40] = "idiot", "idiot", "stupid"
        texts.append(" ".join(w))
        labels.append((i, int(i % 5 == 0)))
    texts += [texts[k] for k in (1, 2, 3, 3, 3)] + [f"{texts[4]} tail", None, "", "one"]
    rows = [(i, t, ["a", "b", None][i % 3], "en", 1, 2) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixture", "packing"]
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        kept[name], before = spark.read.parquet(str(tmp_path / name)), docs
        docs = kept[name]
        if name != "packing":
            assert docs.columns == before.columns
    civil = sorted(r["doc_id"] for r in kept["toxicity"].collect())
    assert civil == [i for i in range(len(texts)) if i >= 300 or i % 5]
    sets = sets_of([texts[i] for i in civil], 5)
    best = groups_of(similar_pairs(sets, 80), len(sets))
    assert sorted(r["doc_id"] for r in kept["near_duplicates"].collect()) == sorted({civil[g] for g in best})
    size, source = {}, {}
    for r in kept["near_duplicates"].collect():
        size[r["doc_id"]] = len((r["text"] or "").split())
        source.setdefault(r["source"], []).append(r["doc_id"])
    totals = {s: sum(size[i] for i in ids) for s, ids in source.items()}
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight, budget, want = dict(zip(order, (3, 1, 2))), 1.5 * sum(totals.values()), {}
    while True:  # what is above twice a source's size is shared anew
        open_ = [s for s in order if s not in want]
        left = budget - sum(want.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * totals[s]]
        if not over:
            want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        want |= {s: 2.0 * totals[s] for s in over}
    taken = {s: 0 for s in order}
    for r in kept["mixture"].collect():
        taken[r["source"]] += size[r["doc_id"]]
    assert all(abs(taken[s] - want[s]) <= 51 for s in order)
    pieces = kept["packing"].collect()
    copies = {}
    for r in kept["mixture"].collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    tokens = {}
    for r in pieces:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {r["doc_id"]: r["doc_tokens"] * copies[r["doc_id"]] for r in pieces}
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert ran.count() == len(pieces) and ran.columns == kept["packing"].columns


def test_near_copies_of_the_pipeline_meet_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(22)
    texts = []
    for _ in range(30):
        base = " ".join(f"w{rng.integers(10**6)}" for _ in range(80))
        texts += [base, f"copy {base}"]
    monkeypatch.setattr(jaccardjoin, "ROUND", 1, raising=False)
    monkeypatch.setattr(jaccardjoin, "SHARE", 3, raising=False)
    cut, sets = common.Scratch.cut, []

    def spied(self, df, name, *more):
        out = cut(self, df, name, *more)
        if name == "sets":
            sets.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "cut", spied)
    kept = corpus_pipeline.keep_one_of_each(spark, frame(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 60, 2))
    assert max(sets) < 0.8 * len(texts), sets


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_has_to_name_its_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_clashing_columns_are_not_looked_at(spark):
    docs = frame(spark, ["a b c d e", "a b c d e"]).withColumn("component_id", F.lit("x")).withColumn("cls", F.lit(1)).withColumn("score", F.lit("s")).withColumn("range", F.lit(9)).withColumn("h", F.lit(0))
    assert {r["component_id"] for r in jaccardjoin.jaccard_components(docs).collect()} == {0}
    assert contextmix.scores(docs).count() == fingerprints.fingerprints(docs).count() == shards.shard_documents(docs, 2).count() == 2
    assert toxicity.toxicity(docs, spark.createDataFrame([(0, 1, "z")], "doc_id long, toxic int, text string")).count() == 2


# ---- op7 -------------------------------------------------------------------------------------------------------------
def test_each_template_is_found_in_its_own_text_alone(spark):
    from millrace.llm import licenses

    names = list(licenses.TEMPLATES)
    texts = [f"some words before it\n{licenses.TEMPLATES[n].upper()}\n and after it" for n in names]
    found = sorted((names[r["doc_id"]], r["license"]) for r in licenses.scan(frame(spark, [*texts, texts[0], None])).where(F.col("doc_id") < len(names)).collect())
    assert found == sorted([(n, n) for n in names] + [("Apache-2.0-header", "Apache-2.0")])  # the header begins with the short notice
    twice = spark.createDataFrame([(5, "All rights reserved"), (5, "All rights reserved"), (None, "ALL RIGHTS RESERVED!")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license"]) for r in licenses.scan(twice).collect() if r["doc_id"]) == [(5, "Rights-reserved")] * 2 and licenses.scan(twice).count() == 3


# ---- op3 -------------------------------------------------------------------------------------------------------------
def test_any_token_by_its_place_among_all(spark, tmp_path):
    from tokenizers import Tokenizer

    from millrace.llm import tokenfile

    tok, texts = Tokenizer.from_file(tokenizer_path()), odd_texts()
    ids = [x for t in texts for x in [*tok.encode(t or "", add_special_tokens=False).ids, 0]]
    tokenfile.write_tokens(frame(spark, texts), str(tmp_path / "f"), tokenizer_path(), segment_ids=700)
    segments = spark.read.schema(tokenfile.SEGMENT).parquet(str(tmp_path / "f"))
    asked = [0, 1, 699, 700, 701, len(ids) - 1, len(ids) // 2, 5, 5]
    got = tokenfile.tokens_at(segments, spark.createDataFrame([(i,) for i in [*asked, len(ids), -1, None]], "token_index long"), width=512).collect()
    assert sorted(((r["token_index"], r["token"]) for r in got), key=str) == sorted([*((i, ids[i]) for i in asked), (len(ids), None), (-1, None), (None, None)], key=str)


def test_segments_are_as_full_as_whole_documents_allow(spark, tmp_path):
    from tokenizers import Tokenizer

    from millrace.llm import tokenfile

    tok, texts = Tokenizer.from_file(tokenizer_path()), odd_texts()
    sizes = [len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    tokenfile.write_tokens(frame(spark, texts).coalesce(1), str(tmp_path / "g"), tokenizer_path(), segment_ids=700)
    rows = spark.read.schema(tokenfile.SEGMENT).parquet(str(tmp_path / "g")).orderBy("segment_part", "segment_no").collect()
    at = 0
    for k, r in enumerate(rows):
        held = sizes[at : at + r["n_docs"]]
        at += r["n_docs"]
        assert sum(held) == r["n_ids"] and (r["n_ids"] <= 700 or r["n_docs"] == 1)
        last = k + 1 == len(rows) or rows[k + 1]["segment_part"] != r["segment_part"]
        assert last or r["n_ids"] + sizes[at] > 700
    assert at == len(texts)
