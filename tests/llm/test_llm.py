"""Brute force, exact round trips and edge cases for the training-data operators."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, capfilters, contextmix, fingerprints, jaccardjoin, licenses, mixture, packing, shards, tokenfile, toxicity
from millrace.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, lang string, taken int, shard int"


def frame(spark, texts, source=lambda i: "ab"[i % 2]):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, source(i), "en", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def odd_texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    near = [b.replace(" ", "  ", 1) + " tail" for b in base[:15]]
    return [*base, *near, *[base[0]] * 30, None, "", " ", "one", "one two three", "é ñ\n　x", "a  b\t c ", " ".join(rng.choice(words, 5000))]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_texts()).persist()


def test_token_file_round_trip_and_random_access(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: r for r in tokenfile.token_file(docs, tokenizer_path(), segment_ids=700).collect()}
    at = 0
    for i, t in enumerate(odd_texts()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rng = np.random.default_rng(1)
    for top in (1, 16, 300, 70000, 1 << 31):
        ids = np.minimum(rng.geometric(4 / top if top > 4 else 0.9, 1500), top).astype(np.uint32)
        s = tokenfile.Segment(tokenfile.encode_segment(ids, [None, 5], np.array([600, 900])))
        assert (s.all_ids() == ids).all() and [s.token(i) for i in range(1500)] == ids.tolist() and s.doc_ids == [None, 5] and s.document(1)[:3] == ids[600:603].tolist()
    assert tokenfile.Segment(tokenfile.encode_segment(np.zeros(0), [], np.zeros(0, int))).n_ids == 0


def test_packing_covers_every_token_once(spark, docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(odd_texts())
    for pieces in by_doc.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == pieces[0]["doc_tokens"]
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert [sorted(x) for x in packing.differencing([8, 7, 6, 5, 4], 2)] and sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_jaccard_components_equal_brute_force(spark, docs):
    texts = odd_texts()
    for n, percent in ((4, 85), (3, 40), (5, 80)):
        sets = []
        for t in texts:
            w = (t or "").encode().lower().split()
            sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
        up = list(range(len(texts)))

        def top(v):
            while up[v] != v:
                v = up[v]
            return v

        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = sorted((top(i), top(j)))
                    up[b] = a
        got = {r[0]: (r[1], r[2]) for r in jaccardjoin.jaccard_components(docs, n, percent).collect()}
        assert got == {i: (len(s), top(i)) for i, s in enumerate(sets)}


def test_prefixes_of_similar_sets_share_as_many_tokens_as_said():
    rng = np.random.default_rng(8)
    for percent in (40, 80, 85):
        for _ in range(3000):
            na = int(rng.integers(1, 400))
            nb = int(rng.integers(max(1, -(-percent * na // 100)), max(2, 100 * na // percent + 1)))
            both = -(-percent * (na + nb) // (100 + percent))  # the least overlap, the hardest case
            if both > min(na, nb):
                continue
            pool = rng.permutation(np.uint64(1) + np.arange(na + nb - both, dtype=np.uint64))
            x, y = pool[:na], pool[na - both :]
            firsts = [s if (k := jaccardjoin.prefix_size(len(s), percent)) >= len(s) else np.sort(jaccardjoin._mix(s, 2))[:k] for s in (x, y)]
            firsts = [jaccardjoin._mix(s, 2) if len(f) == len(s) else f for s, f in zip((x, y), firsts)]
            need = jaccardjoin.shared_tokens(na, nb, percent)
            assert need >= 1 and len(set(firsts[0].tolist()) & set(firsts[1].tolist())) >= need
            sketches = [set(np.frombuffer(jaccardjoin._sketch(s, jaccardjoin.prefix_size(len(s), percent), 2), "<u2").tolist()) for s in (x, y)]
            merged = min(jaccardjoin.prefix_size(len(s), percent) - len(z) for s, z in zip((x, y), sketches))
            assert len(sketches[0] & sketches[1]) >= need - merged


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    vecs = np.concatenate([base, base[:30] + 0.08 * rng.standard_normal((30, 16)), base[:5]])
    data = [(i, [float(x) for x in np.float32(v)], i % 2 if i < 90 else i % 2) for i, v in enumerate(vecs)]
    data += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, data[0][1], None), (204, [1.0, None], 0), (205, [], 0)]
    got = {r["vec_id"]: r for r in capfilters.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([d[1] for d in data[:95]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([d[2] for d in data[:95]])
    near = (x @ x.T >= 0.93) & (same[:, None] == same[None, :]) & ~np.eye(95, dtype=bool)
    assert [got[i]["n_links"] for i in range(95)] == near.sum(1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(200, 206))


def test_pairs_share_a_filter_whatever_the_size_of_the_table():
    x, y = capfilters.pairs_at(64, 0.931, 1000, seed=11)
    for n in (10_000, 300_000, 3_000_000):
        codes = capfilters.Codes(64, n, capfilters.codes_needed(64, n, 0.93))
        missed = sum(not set(a.tolist()) & set(b.tolist()) for a, b in zip(codes.decode(x), codes.decode(y)))
        alone = capfilters.Codes(64, n, 1)
        before = sum(not set(a.tolist()) & set(b.tolist()) for a, b in zip(alone.decode(x), alone.decode(y)))
        assert missed <= 1 < before, (n, missed, before)


def test_shards_are_even_and_keep_copies(spark, docs):
    rows = shards.shard_documents(docs, 4).collect()
    assert len(rows) == len(odd_texts())
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for t in odd_texts())


def test_mixture_meets_its_targets(spark, docs):
    rows = mixture.mix(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for some in by.values():
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 1 and all(r["taken"] <= 2 * r["size"] for r in some)
    assert mixture.mixed_rows(docs).columns == docs.columns


def test_license_scan_finds_planted_notices(spark):
    found = licenses.scan(frame(spark, ["x " * 300 + "Released under the MIT License." + " y" * 40, "licensed under nothing", None, "All rights reserved.", "This work is LICENSED under the GNU general public license, version 3"]))
    assert sorted((r[0], r[1]) for r in found.collect()) == [(0, "MIT"), (3, "Rights-reserved"), (4, "GPL-3.0")]


def test_license_scan_finds_every_notice_at_either_end(spark):
    # One shingle at the end, at the start or inside of texts of all lengths: none may be missed by chance.
    known = {f"q{k}": f"Held by keeper q{k}." for k in range(60)}
    body = F.expr("array_join(transform(sequence(1, 3 + id % 11), i -> concat('w', hex(xxhash64(id, i)))), ' ')")
    notice = F.expr("concat(' Held by keeper q', id % 60, '. ')")
    place = F.floor(F.col("id") / 60) % 3
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(place == 0, F.concat(notice, body)).when(place == 1, F.concat(body, notice)).otherwise(F.concat(body, notice, body)).alias("text"))
    found = licenses.scan(rows, known)
    assert found.where("license = concat('q', doc_id % 60)").count() == found.count() == 9000
    # A long template, of which a text has every fifth shingle broken or pieces far apart.
    words = [f"t{i}" for i in range(104)]
    pieces = [" ".join(words[i : i + 44]) + " x" * 30 for i in (0, 40, 60)]
    found = licenses.scan(frame(spark, ["".join(f" {p}" for p in pieces), " ".join(words[:80])]), {"T": " ".join(words)})
    assert [(r[0], r[2]) for r in found.collect()] == [(0, 1.0)]


def test_toxicity_automaton_and_fit(spark):
    lex = toxicity.Lexicon([("idiot", True), ("worthless", True), ("vequ", False)])
    found = {w: lex.find(w) for w in ("idiot", "idiott", "idot", "idi0t", "jdiot", "worthles", "wrthles", "vequar", "vexu", "idiom", "table", "")}
    assert found["idiot"] == 0 and found["idiott"] == found["idot"] == found["idi0t"] == 1 and found["worthles"] == 1 and found["wrthles"] == 2 and found["vequar"] == 0
    assert found["jdiot"] == 1 and found["vexu"] is found["table"] is found[""] is None
    rng = np.random.default_rng(2)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    texts, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, 40))
        if i % 4 == 0:
            for p in rng.choice(40, 4):
                w[p] = "idiot"
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    out = toxicity.toxicity(frame(spark, [*texts, None, ""]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert held and all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) and all(0 <= r["score"] <= 1 for r in out) and len(out) == 402
    none = toxicity.toxicity(frame(spark, texts[:5]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert all(r["predicted"] == 0 for r in none)


def test_toxicity_features_do_not_depend_on_the_memo():
    lex = toxicity.Terms([("idiot", True), ("worthless", True), ("vequ", False)])
    texts = ["a idiot b c d idiott e a idiot", 'he said "worthless" x y z vequar', "", "a b c d e f g", " ".join(f"w{i}" for i in range(50)) + " idiot"]
    wanted = [toxicity.Scanner(lex).features(t) for t in texts]
    for memo in (1, 2, 3, 5, 7):
        scanner = toxicity.Scanner(lex, memo)
        assert [scanner.features(t) for t in texts] == wanted and len(scanner.known) <= memo


def test_fingerprints(spark, docs):
    texts = [t or "" for t in odd_texts()]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs, rows_a_range=20).collect()}

    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        if t.isascii() and len(t.split()) > 20 and len(edited.split()) > 20:
            a, b = sh(t), sh(edited)
            assert abs(len(a & b) / len(a | b) - got[i]["near_edited"]) < 0.2
    assert got[0]["fingerprint"] == got[55]["fingerprint"]


def test_fingerprints_of_short_texts_estimate_as_well_as_those_of_long_ones(spark):
    # Sets of k hashes that share half of all: the share of equal values of 256 bins.
    rng = np.random.default_rng(6)
    for k, most in ((6, 0.1), (12, 0.08), (60, 0.06)):
        sets = rng.integers(-(1 << 63), 1 << 63, (100, 4 * k // 3), np.int64)
        pairs = spark.createDataFrame([(x[:k].tolist(), x[k // 3 :].tolist()) for x in sets], "a array<long>, b array<long>")
        got = np.array(pairs.select(fingerprints.bins(F.col("a")), fingerprints.bins(F.col("b"))).collect())
        assert got.shape == (100, 2, fingerprints.BINS)
        assert np.sqrt(np.mean(((got[:, 0] == got[:, 1]).mean(1) - 0.5) ** 2)) < most, k
    one = spark.createDataFrame([([5],)], "a array<long>").select(fingerprints.bins(F.col("a"))).first()[0]
    assert one == [5] * fingerprints.BINS


def test_scores_and_base(spark, docs):
    texts = [t or "" for t in odd_texts()]
    toks = [[*t.encode().lower().split(), b"\n"] for t in texts]
    train = Counter(w for i, t in enumerate(toks) if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(train.values()), len(train)
    for send in (10**6, 0):
        got = {r["doc_id"]: r for r in contextmix.scores(docs, send=send).collect()}
        for i, t in enumerate(toks):
            assert got[i]["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
            assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(train[w] > 0 for w in t), n)
            assert got[i]["score"] <= 0
    # Over all next tokens the probabilities add up to one.
    words = sorted(train, key=lambda w: (-train[w], contextmix._hash(w)))
    tree = contextmix.Tree([(contextmix._hash(w), train[w]) for w in words[:20]], {c: sum(train[w] + 0.5 for w in words[20:] if contextmix._class(w) == c) for c in {contextmix._class(w) for w in words[20:]}})
    assert sum(2.0 ** -int(s) for s in tree.size) == pytest.approx(1.0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tokenfile.token_file(none, tokenizer_path()).count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0
    assert jaccardjoin.jaccard_components(none).count() == 0
    assert shards.shard_documents(none).count() == 0
    assert mixture.mix(none).count() == 0 and mixture.mixed_rows(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert fingerprints.fingerprints(none).count() == 0
    assert contextmix.scores(none).count() == 0
    assert capfilters.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert list(bpe.batches([])) == []
