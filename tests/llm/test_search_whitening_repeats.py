"""Ranked search, whitening and removal of repeats against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import ball_tree, substring_dedup, whitening

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(ball_tree.UPPER, ball_tree.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for d, b, n in bags:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def corpus(rng, n):
    words = ["the", "The", "of", "é-x", "12", "Ünder", "café", "a_b", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(n)]
    docs += [(1000 + i, "the w1 of copies copies") for i in range(90)] + [(2000, None), (2001, ""), (2002, " -- "), (None, "the w1 of copies copies"), (None, "w2 w3"), (5, "repeated copies"), (5, "repeated copies")]
    items = [(1, "the W1 of copies"), (1, "the W1 of copies"), (1, "another text w5 w6"), (2, "w7 W8, w9; café ünder"), (3, None), (4, "nothing-here zzz"), (None, "w2 w2 w2 x"), (6, "copies")]
    items += [(10 + i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("leaf, tree, seeds, pairs, dims", [(64, 8192, 256, 400_000, 8192), (3, 40, 2, 30, 12)])
def test_search_is_exact(spark, monkeypatch, leaf, tree, seeds, pairs, dims):
    for name, value in (("LEAF", leaf), ("TREE", tree), ("SEEDS", seeds), ("PAIRS", pairs), ("DIMS", dims), ("PIECE", 16)):
        monkeypatch.setattr(ball_tree, name, value)
    docs, items = corpus(random.Random(6), 300)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, score int").repartition(5)
    got = ball_tree.ranked(frame, spark.createDataFrame(items, "item_id long, text string"), 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(docs, items, 10)


def test_search_in_one_tree_drops_nodes_safely(monkeypatch):
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    rng = np.random.default_rng(2)
    dims, n = 30, 200
    rows = [np.sort(rng.choice(dims, rng.integers(1, 6), replace=False)) for _ in range(n)]
    rows[50:150] = [rows[50]] * 100
    ptr = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    val = rng.integers(1, 900_000, ptr[-1])
    for i in range(51, 150):
        val[ptr[i] : ptr[i + 1]] = val[ptr[50] : ptr[51]]
    docs = rng.permutation(n).astype(np.int64)
    tree = ball_tree.grow(docs, np.zeros(n, bool), ptr, np.concatenate(rows), val, dims)
    full = np.zeros((n, dims), np.int64)
    full[np.repeat(np.arange(n), np.diff(tree.ptr)), tree.idx] = tree.val
    for i in range(len(tree.lo)):
        centre = np.zeros(dims, np.int64)
        centre[tree.cidx[tree.cptr[i] : tree.cptr[i + 1]]] = tree.cval[tree.cptr[i] : tree.cptr[i + 1]]
        own = full[tree.lo[i] : tree.hi[i]]
        assert len(own) and ((own - centre) ** 2).sum(axis=1).max() == tree.r2[i] and tree.docs[tree.lo[i] : tree.hi[i]].min() == tree.least[i]
    at = np.array([1, 4, 9, 17])
    block = ball_tree.Block(np.arange(dims), [(7, at, np.array([30_000, 900, 12, 2500]))])
    want = sorted((-int(s), int(d)) for s, d in zip(full[:, at] @ block.items[0][2], tree.docs, strict=True) if s > 0)
    for bound in ({}, {7: (-want[19][0], want[19][1])}):
        [(q, best)] = ball_tree.search(tree, block, bound, 20)
        assert q == 7 and [(-s, d) for s, d, _ in best] == want[:20]


def test_search_of_nothing(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    empty = spark.createDataFrame([], docs)
    some = spark.createDataFrame([(1, "a b"), (2, None)], docs)
    asked = spark.createDataFrame([(1, "a")], items)
    assert [tuple(r) for r in ball_tree.ranked(some, asked).collect()] == plain_ranking([(1, "a b")], [(1, "a")], 50)
    for d, i in ((empty, asked), (some, spark.createDataFrame([], items)), (some, spark.createDataFrame([(1, None)], items)), (spark.createDataFrame([(1, None)], docs), asked)):
        assert ball_tree.ranked(d, i).collect() == []


def plain_whitening(vectors, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    z = x * n - sums
    y = (z / n).astype(float)
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return [int((r**2).sum()) for r in z], y @ basis / np.sqrt(values), values / np.trace(y.T @ y / n)


@pytest.mark.parametrize("d, k", [(24, 3), (6, 32)])
def test_whitening(spark, d, k):
    rng = np.random.default_rng(d)
    good = (rng.normal(size=(300, d)) * np.linspace(3, 0.3, d)).astype(np.float32)
    good = np.concatenate((good, np.repeat(good[:1], 40, axis=0)))
    rows = [(i, [float(c) for c in v], 7) for i, v in enumerate(good)]
    bad = [(900, None, 1), (901, [math.nan] * d, 1), (902, [math.inf] + [0.0] * (d - 1), 1), (903, [None] + [0.0] * (d - 1), 1), (904, [1.0], 1)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component int").repartition(6)
    got = whitening.whiten(frame, k).toPandas().sort_values(["vec_id", "component"])
    deviations, white, explained = plain_whitening(good, k)
    k = white.shape[1]
    made = got["whitened"].to_numpy().reshape(-1, k)
    assert sorted(set(got["vec_id"])) == list(range(len(good))) and set(got["n"]) == {len(good)} and got["deviation"].to_numpy().reshape(-1, k)[:, 0].tolist() == deviations
    assert np.abs(made * np.sign((made * white).sum(axis=0)) - white).max() < 1e-8
    assert np.abs(got["explained"].to_numpy()[:k] / explained - 1).max() < 1e-10 and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


def test_subspace_iteration_leaves_out_nothing():
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(80, 80)))[0]
    values = np.concatenate((np.linspace(50, 30, 12), np.linspace(29.5, 0, 68)))
    matrix, steps = basis * values @ basis.T, []

    def times(block):
        steps.append(block.shape)
        return matrix @ block

    found, vectors = whitening.leading(times, 80, 12, guard=6)
    assert np.abs(found - values[:12]).max() < 1e-9 and np.abs(matrix @ vectors - vectors * found).max() < 1e-8 and len(steps) > whitening.DEGREE and set(steps) == {(80, 18)}


def test_whitening_of_nothing(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).collect() == []
    huge = whitening.whiten(spark.createDataFrame([(None, [1e15, 0.0]), (2, [-1e15, 0.5])], kind)).collect()
    assert {(r.vec_id, r.component, r.deviation) for r in huge} == {(None, 1, None), (2, 1, None)} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in huge)


def plain_repeats(docs, size):
    words = [(d, WHITE.findall(t or "")) for d, t in docs]
    lowest = {}
    for d, ws in words:
        for i in range(len(ws) - size + 1) if d is not None else ():
            w = tuple(ws[i : i + size])
            lowest[w] = min(d, lowest.get(w, d))
    out = []
    for d, ws in words:
        gone = {i + j for i in range(len(ws) - size + 1) if d is not None and lowest[tuple(ws[i : i + size])] < d for j in range(size)}
        out.append((d, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(rng, size):
    words = [f"w{i}" for i in range(40)] + ["É", "x y", "W1"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t \r"]) for _ in range(n))
    shared = [text(size + rng.randint(0, 30)) for _ in range(6)]
    docs = [(i, " ".join(rng.choice([text(rng.randint(1, 40)), rng.choice(shared), rng.choice(shared)]) for _ in range(rng.randint(1, 4)))) for i in rng.sample(range(10**6), 60)]
    docs += [(5, "a " * 200), (9, "a " * 70), (3, "a " * 30), (7, None), (8, ""), (11, " \n"), (None, shared[0]), (None, shared[1]), (12, shared[2]), (12, shared[2]), (12, shared[3]), (13, f" {shared[2]}\n"), (14, shared[2].upper()), (2**40, shared[4]), (-3, shared[4])]
    return docs + [(2_000_000 + i, f"{shared[5]} tail {i}") for i in range(40)] + [(3_000_000 + i, docs[0][1]) for i in range(20)]


@pytest.mark.parametrize("size, chunk", [(50, 1 << 23), (12, 600), (7, 3000)])
def test_removal_of_repeats(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "BUCKET", 500)
    docs = passages(random.Random(size), size)
    frame = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n_words int, key string").repartition(7)
    got = substring_dedup.remove_repeats(frame, size)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_repeats(docs, size)
    clean = substring_dedup.cleaned_documents(frame, size)
    assert clean.columns == frame.columns and clean.schema == frame.schema
    kept = sorted((d, n, r, s) for d, n, r, s in plain_repeats([x for x in docs if x[0] is not None], size))
    assert sorted((r.doc_id, hashlib.sha256(" ".join(WHITE.findall(r.text or "")).encode()).hexdigest()) for r in clean.collect() if r.doc_id is not None) == sorted((d, s) for d, _, _, s in kept)


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = substring_dedup.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert tuple(only) == (1, 0, 0, hashlib.sha256(b"").hexdigest())


def test_anchors_are_least_hashes():
    words = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64)
    for size in (7, 12, 50):
        _, anchors = substring_dedup.window_hashes(words, size)
        half = substring_dedup.mix(substring_dedup.rolling(words, (size + 1) // 2))
        assert anchors.tolist() == [int(half[i : i + size - (size + 1) // 2 + 1].min()) for i in range(len(words) - size + 1)]
