"""Exact ranked search: for each item the documents of the largest inner product, by sparse ball trees.

A document is the vector of (10^9 tf) div (1000 tf + 20 m) over terms, an item that of its terms' weights; both are integers,
and so is their product, the score. Only terms that some item has count, so vectors hold no others.

1. One pass over the texts counts terms and writes the vectors; from these come N, L and the document frequencies.
2. Items with a common frequent term form a block of bounded vocabulary. Each task makes a tree per block of every few
   thousand vectors that it reads: halves along the line through two far points, level by level, down to LEAF documents. A
   node has a centre (the mean in integers) and the largest squared distance from it. Trees are rows of a written table.
3. A bounded number of trees is searched one leaf deep for a first bound: the K-th best of what they hold.
4. All trees are searched best first: the centre's score plus the item's length times the radius, rounded up, bounds what a
   node can hold; at equal scores its least doc_id does. A node below the bound is dropped with all that is under it, a leaf
   is scored exactly. Each tree gives at most K rows an item, the best K of all are ranked.

Items go in passes of about PAIRS item-term pairs, which bounds what is broadcast; each pass reads the texts once. Texts may be
null, empty or of any length (they are counted in pieces). Equal rows of items are one item; an item of a null id is
one too. Every row of documents counts and is ranked for itself, equal ones too; a null doc_id comes after all others.
Without items, documents or common terms there are no rows. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

K, LEAF, TREE, ENTRIES = 50, 64, 8192, 1 << 22
PAIRS, DIMS, ITEMS, SEEDS = 400_000, 8192, 16, 256
PIECE = 1 << 22
LAST = (1 << 63) - 1
EXACT = 1 << 53
# Characters of terms: digits, ASCII letters (lower-cased) and all from U+0080 on.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_VECTOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("idx", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_LISTS = {"docs": pa.int64(), "nulls": pa.bool_(), "ptr": pa.int32(), "idx": pa.int32(), "val": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "r2": pa.int64(), "least": pa.int64(), "cptr": pa.int32(), "cidx": pa.int32(), "cval": pa.int32()}
_TREE = pa.schema([("block", pa.int32()), *((name, pa.list_(kind)) for name, kind in _LISTS.items())])
_TREE_DDL = "block int, docs array<long>, nulls array<boolean>, ptr array<int>, idx array<int>, val array<int>, lo array<int>, hi array<int>, r2 array<long>, least array<long>, cptr array<int>, cidx array<int>, cval array<int>"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def count_terms(raw: bytes, number: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a UTF-8 text has, and how often those that have a number."""
    raw, n, found, at = raw.translate(_FOLD), 0, Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE) if len(raw) - at > PIECE else -1
        words = raw[at : end if end >= 0 else len(raw)].split()
        n += len(words)
        found.update(map(number.get, words))
        at = end if end >= 0 else len(raw)
    found.pop(None, None)
    return n, found


def _vectors(number):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            size, ptr, idx, tf = [], [0], [], []
            for raw in batch.column(1).cast(pa.large_binary()):
                n, found = count_terms(raw.as_py() or b"", known)
                size.append(n)
                own = sorted(found)
                idx += own
                tf += [found[i] for i in own]
                ptr.append(len(idx))
            at = pa.array(ptr, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.ListArray.from_arrays(at, pa.array(idx, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], schema=_VECTOR)

    return run


@dataclass
class Block:
    """Items that are searched together: their terms' numbers, ascending; each item's number, places in these terms and weights."""

    terms: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray]]


def blocks_of(items: list[list[int]], weight: np.ndarray) -> list[Block]:
    """Items in the order of the term that most items have, cut where that changes or the vocabulary would pass DIMS."""
    often = Counter(t for own in items for t in own)
    lead = sorted((min((-often[t], t) for t in own), q) for q, own in enumerate(items) if own)
    groups: list[tuple[set[int], list[int], tuple]] = []
    for top, q in lead:
        if not groups or len(groups[-1][0].union(items[q])) > DIMS or top != groups[-1][2] and len(groups[-1][1]) >= ITEMS:
            groups.append((set(), [], top))
        groups[-1][0].update(items[q])
        groups[-1][1].append(q)
    out = []
    for terms, own, _ in groups:
        at = np.array(sorted(terms), np.int64)
        out.append(Block(at, [(q, np.searchsorted(at, sorted(items[q])), weight[sorted(items[q])]) for q in own]))
    return out


@dataclass
class Tree:
    """Documents in the order of the leaves, their sparse vectors, and a full binary tree: below node i are 2i + 1 and 2i + 2."""

    docs: np.ndarray
    nulls: np.ndarray
    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    r2: np.ndarray
    least: np.ndarray
    cptr: np.ndarray
    cidx: np.ndarray
    cval: np.ndarray


def _gather(ptr: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New row starts, and the places of the entries of the rows in this order."""
    n = np.diff(ptr)[order]
    made = np.concatenate(([0], np.cumsum(n)))
    return made, np.repeat(ptr[order] - made[:-1], n) + np.arange(made[-1])


def grow(docs: np.ndarray, nulls: np.ndarray, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, dims: int) -> Tree:
    """A tree over vectors that all have an entry. All nodes of a level are made at once."""
    val, count, depth = val.astype(np.int64), len(docs), 0
    while count >> depth > LEAF:
        depth += 1
    square = np.add.reduceat(val * val, ptr[:-1])
    cuts, order = np.array([0, count]), np.arange(count)
    los, his, radii, leasts, centres = [], [], [], [], []

    def against(rows: np.ndarray) -> np.ndarray:
        """The product of each document with its node's row."""
        return np.add.reduceat(val * rows[np.repeat(node, np.diff(ptr)), idx], ptr[:-1])

    for level in range(depth + 1):
        nodes = len(cuts) - 1
        node = np.repeat(np.arange(nodes), np.diff(cuts))
        size = np.diff(cuts)
        total = np.bincount(np.repeat(node, np.diff(ptr)) * dims + idx, weights=val, minlength=nodes * dims).reshape(nodes, dims)
        centre = np.rint(total / size[:, None]).astype(np.int64)
        far = square - 2 * against(centre) + (centre * centre).sum(axis=1)[node]
        los.append(cuts[:-1])
        his.append(cuts[1:])
        radii.append(np.maximum.reduceat(far, cuts[:-1]))
        leasts.append(np.minimum.reduceat(docs, cuts[:-1]))
        centres.append(centre)
        if level == depth:
            break

        def farthest(distance: np.ndarray) -> np.ndarray:
            return np.lexsort((-distance, node))[cuts[:-1]]

        def dense(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((nodes, dims), np.int64)
            at, entries = _gather(ptr, rows)
            out[np.repeat(np.arange(nodes), np.diff(at)), idx[entries]] = val[entries]
            return out

        one = farthest(far)
        a = dense(one)
        two = farthest(square - 2 * against(a) + square[one][node])
        order = np.lexsort((docs, against(dense(two) - a), node))
        ptr, entries = _gather(ptr, order)
        idx, val, docs, nulls, square = idx[entries], val[entries], docs[order], nulls[order], square[order]
        cuts = np.sort(np.concatenate((cuts, (cuts[:-1] + cuts[1:]) // 2)))
    flat = np.concatenate(centres)
    row, col = np.nonzero(flat)
    cptr = np.searchsorted(row, np.arange(len(flat) + 1))
    return Tree(docs, nulls, ptr, idx, val, np.concatenate(los), np.concatenate(his), np.concatenate(radii), np.concatenate(leasts), cptr, col, flat[row, col])


def search(tree: Tree, block: Block, bound: dict[int, tuple[int, int]], k: int, leaves: int | None = None) -> Iterator[tuple[int, list[tuple[int, int, bool]]]]:
    """(item, its best k as (score, doc, null)): above 0 and no worse than its `bound` (score, doc); with `leaves`, from so many only."""
    dims, nodes = len(block.terms), len(tree.lo)
    asked = np.zeros((len(block.items), dims), np.int64)
    for j, (_, at, w) in enumerate(block.items):
        asked[j, at] = w
    centre = np.zeros((nodes, dims), np.int64)
    centre[np.repeat(np.arange(nodes), np.diff(tree.cptr)), tree.cidx] = tree.cval
    safe = int(asked.sum(axis=1).max()) * int(max(tree.cval.max(initial=0), 1)) < EXACT
    kind = np.float64 if safe else np.int64
    middle = (asked.astype(kind) @ centre.T.astype(kind)).astype(np.int64)
    # Roots and sums of squares are off by far less than this factor.
    reach = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1)[:, None] * tree.r2.astype(np.float64)[None, :]) * (1 + 1e-9)
    most = middle + np.floor(reach).astype(np.int64)
    inner = nodes // 2
    for j, (q, _, _) in enumerate(block.items):
        worst, best, left = bound.get(q, (1, LAST)), [], leaves
        queue = [(-int(most[j, 0]), int(tree.least[0]), 0)]
        while queue:
            high, least, i = heapq.heappop(queue)
            if (high, least) > (-worst[0], worst[1]):
                break
            if i < inner:
                for c in (2 * i + 1, 2 * i + 2):
                    heapq.heappush(queue, (-int(most[j, c]), int(tree.least[c]), c))
                continue
            lo, hi = tree.lo[i], tree.hi[i]
            a, b = tree.ptr[lo], tree.ptr[hi]
            score = np.add.reduceat(asked[j, tree.idx[a:b]] * tree.val[a:b], tree.ptr[lo:hi] - a)
            near = np.flatnonzero(score >= worst[0])
            best += [(-int(s), int(d), bool(z)) for s, d, z in zip(score[near], tree.docs[lo:hi][near], tree.nulls[lo:hi][near], strict=True) if (-s, d) <= (-worst[0], worst[1])]
            best.sort()
            del best[k:]
            if len(best) == k:
                worst = (-best[-1][0], best[-1][1])
            left = left - 1 if left else left
            if left == 0:
                break
        yield q, [(-s, d, z) for s, d, z in best]


def _grown(blocks, n_docs: int, n_terms: int):
    def planted(b: int, block: Block, docs, nulls, ptr, idx, val) -> Iterator[pa.RecordBatch]:
        """Trees of the documents that have a term of the block."""
        local = np.searchsorted(block.terms, idx)
        held = block.terms[np.minimum(local, len(block.terms) - 1)] == idx
        owner = np.repeat(np.arange(len(docs)), np.diff(ptr))[held]
        rows = np.unique(owner)
        if not len(rows):
            return
        own = np.searchsorted(owner, np.append(rows, len(docs)))
        local, val = local[held], val[held]
        for a in range(0, len(rows), TREE):
            part, cut = rows[a : a + TREE], own[a : a + TREE + 1]
            tree = grow(docs[part], nulls[part], cut - cut[0], local[cut[0] : cut[-1]], val[cut[0] : cut[-1]], len(block.terms))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for (name, kind) in _LISTS.items() for x in (getattr(tree, name),)]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *lists], schema=_TREE)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of a task, some TREE documents or ENTRIES entries at a time."""
        held, rows, entries = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, TREE // 8):
                part = batch.slice(a, TREE // 8)
                held.append(part)
                rows, entries = rows + part.num_rows, entries + len(part.column(2).flatten())
                if rows >= TREE or entries >= ENTRIES:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, rows, entries = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, lists = part.column(0), part.column(2)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            docs = ids.fill_null(LAST).to_numpy()
            idx, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
            n = pa.compute.list_value_length(lists).to_numpy()
            ptr = np.concatenate(([0], np.cumsum(n)))
            m = np.array([50 + 50 * size * n_docs // n_terms for size in part.column(1).to_pylist()], np.int64)
            val = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, n))
            for b, block in enumerate(blocks.value):
                yield from planted(b, block, docs, nulls, ptr, idx, val)

    return run


def _searched(blocks, bound: dict[int, tuple[int, int]], k: int, leaves: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree = Tree(*(batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in _LISTS))
                found = [(q, d, z, s) for q, best in search(tree, blocks.value[batch.column("block")[row].as_py()], bound, k, leaves) for s, d, z in best]
                nulls = np.array([f[2] for f in found], bool)
                docs = pa.array(np.array([f[1] for f in found], np.int64), mask=nulls)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), docs, pa.array([f[3] for f in found], pa.int64())], ["q", "doc_id", "score"])

    return run


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))


def _pass(docs: DataFrame, items: list[tuple[object, list[str]]], k: int) -> DataFrame | None:
    """(q, doc_id, score, rank) for the items of one pass, q being their place in the list."""
    spark = docs.sparkSession
    every = sorted({t for _, own in items for t in own})
    number = {t.encode(): i for i, t in enumerate(every)}
    vectors = stash(docs.mapInArrow(_vectors(spark.sparkContext.broadcast(number)), "doc_id long, n long, idx array<int>, tf array<long>"), "ball-vectors")
    n_docs, n_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not n_terms:
        return None
    weight = np.zeros(len(every), np.int64)
    for i, df in vectors.select(F.explode("idx").alias("i")).groupBy("i").count().collect():
        weight[i] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    blocks = spark.sparkContext.broadcast(blocks_of([[number[t.encode()] for t in own] for _, own in items], weight))
    trees = stash(vectors.filter("size(idx) > 0").mapInArrow(_grown(blocks, n_docs, n_terms), _TREE_DDL), "ball-trees")

    kinds = "q int, doc_id long, score long"
    some = F.pmod(F.hash("block", "least", "r2"), F.lit(max(1, math.ceil(trees.count() / SEEDS)))) == 0
    seeds = trees.filter(some).mapInArrow(_searched(blocks, {}, k, 1), kinds).withColumn("rank", _rank()).filter(F.col("rank") == k)
    bound = {r["q"]: (r["score"], LAST if r["doc_id"] is None else r["doc_id"]) for r in seeds.collect()}
    return trees.mapInArrow(_searched(blocks, bound, k, None), kinds).withColumn("rank", _rank()).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, falling; equal scores by ascending doc_id."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = stash(items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).distinct().select("item_id", F.array_distinct(terms_of(F.col("text"))).alias("terms"), F.xxhash64("item_id", "text").alias("h")), "ball-items")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, math.ceil(pairs / PAIRS))
    kind = dict(asked.dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for p in range(passes if pairs else 0):
        own = [(r["item_id"], r["terms"]) for r in asked.filter(F.pmod("h", F.lit(passes)) == p).orderBy("h").collect()]
        found = _pass(given, own, k)
        if found is not None:
            names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(own)], f"q int, item_id {kind}")
            out = out.unionByName(found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    return out
