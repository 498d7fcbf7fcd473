"""Grouped prefix join on word shingles: every pair of documents with a Jaccard similarity of at least 75 %.

All shingles have one order, rarest first: by how often a count sketch of all documents (of fixed size, so that it can be
broadcast) has seen their hash, then by the hash. The sketch only orders; whatever it says, no link is lost. A document's
prefix are the first p = n - ceil(0.75 n) + 1 shingles of its n, of which any partner must share one, and SLACK more. Of
those p + SLACK a partner must share more than SLACK: of two documents, the one whose prefix ends first in the order has
the overlap that is missing behind its end only in its n - p - SLACK shingles there.

1. Documents with identical prefix and size collapse into one group (exact copies always do).
2. Groups join on the shingles of their prefixes. A shingle of few groups (at most RARE) pairs those of compatible sizes.
   Pairs are counted over all shingles and filtered: they need more than SLACK of them, and as many as the overlap that
   their two sizes ask for leaves, less those common ones that both have at most.
3. A shingle of many groups would pair everything with everything. Groups that share no rare shingle must share more than
   SLACK common ones. A group with c of them needs only its c - SLACK least common ones for that, and a group with
   c <= SLACK ("sparse") none. As rare shingles come first, a passage or a template costs nothing unless it makes up most
   of its documents. The other groups ("dense") are mostly one family of near copies.
4. Group pairs expand to their members, the distinct shingle sets in them: all pairs of up to EXPAND members a side; the
   members of larger pairs, and those of dense groups with a common shingle, are first chained to neighbours in a few
   pseudorandom orders. All are verified on whole shingle sets. What then lies outside the largest component of a shingle
   (or larger pair) meets all of its members, but in blocks: members sit in blocks of about BLOCK near ones, an outsider
   goes once to each block that any of its shingles leads to, and only the links come out. So a family of m makes about m
   rows and not m squared, and no link is lost or made up.

Nulls and texts without a word have the empty set and no links. Repeated rows are copies of each other. Documents of
a null doc_id take part in linking but name no component. Other columns are passed on by one_of_each() whatever their
names. An empty table has no links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_rows, by_merge, chunks_of, components, join_hot, maybe_among, stash
from .wordhash import mix, shingle_sets

PERCENT = 75
SLACK = 32
RARE = 16
ORDERS = 4
BLOCK = 256
GUESTS = 512
EXPAND = 16
SKETCH_BITS = 20
SLICES = 16
# Bytes of text at a time in a task: the words and hashes of a chunk take some twenty times as much.
CHUNK = 1 << 22

_POSTING = np.dtype([("key", "<u4"), ("grp", "<u8"), ("n", "<u4"), ("spare", "u1")])
_PAIR = np.dtype([("a", "<u8"), ("b", "<u8"), ("na", "<u4"), ("nb", "<u4"), ("spare", "u1")])
_ROW = np.dtype([("doc", "<i8"), ("null", "u1"), ("cls", "<u8"), ("grp", "<u8"), ("n", "<u4"), ("key", "<i8")])


def _class_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") if len(hashes) else 0


def _group_of(prefix: np.ndarray, n: int) -> int:
    """Identical prefix and size."""
    return int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little")


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """How many texts have a shingle whose hash begins with these SKETCH_BITS bits: 4 MB, whatever the table."""
    cells, width = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for batch in (part for whole in batches for part in chunks_of(whole, 0, CHUNK)):
            held, size = [], 0
            for _, own in shingle_sets(batch.column(0)):
                held.append((own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                size += len(own)
                if size > cells:
                    total += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(SLICES)], pa.binary())], ["slice", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint32)
        for blob in table.column("counts"):
            total += np.frombuffer(blob.as_py(), np.uint32)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    kinds, sketch = "slice int, counts binary", np.zeros(cells, np.uint32)
    for r in docs.select("text").mapInArrow(count, kinds).groupBy("slice").applyInArrow(add, kinds).collect():
        sketch[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(bytes(r.counts), np.uint32)
    return sketch


def _postings(bits: int, percent: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, sketch = np.uint64(64 - bits - 32), held.value
        for batch in (part for whole in batches for part in chunks_of(whole, 1, CHUNK)):
            rows, parts, owners, seen = np.zeros(batch.num_rows, _ROW), [], [], set()
            ids = batch.column(0)
            rows["doc"], rows["null"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            rows["key"] = batch.column(2).to_numpy()
            for i, own in shingle_sets(batch.column(1)):
                n = len(own)
                rows["cls"][i], rows["n"][i] = _class_of(own), n
                if n:
                    p = n - (percent * n + 99) // 100 + 1
                    wide = min(n, p + SLACK)
                    prefix = own[np.argsort(sketch[own >> np.uint64(64 - SKETCH_BITS)], kind="stable")[:wide]]
                    rows["grp"][i] = grp = _group_of(prefix, n)
                    if grp not in seen:
                        seen.add(grp)
                        parts.append(prefix)
                        owners.append((grp, n, wide - p, wide))
            out: list[tuple[int, int, bytes]] = []
            if parts:
                hashes = np.concatenate(parts)
                wide = np.array([o[3] for o in owners])
                made = np.zeros(len(hashes), _POSTING)
                made["key"] = (hashes >> shift) & np.uint64(0xFFFFFFFF)
                for name, j in (("grp", 0), ("n", 1), ("spare", 2)):
                    made[name] = np.repeat(np.array([o[j] for o in owners], dtype=np.uint64), wide)
                bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                made, bucket = made[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                out += [(int(bucket[a]), 1, made[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
            dealt = (mix(rows["doc"].view(np.uint64)) >> np.uint64(60)).astype(np.int64)
            for k in np.unique(dealt):
                out.append((int((k * 0x9E3779B1 + len(seen)) % (1 << bits)), 0, rows[dealt == k].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int8()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "kind", "blob"])

    return run


_OUT = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("nx", pa.int64()), ("ny", pa.int64()), ("spare", pa.int32())])


def _table(kind: int, x: np.ndarray, null: np.ndarray | None = None, **columns: np.ndarray) -> pa.Table:
    signed = lambda v: np.ascontiguousarray(v).astype(np.int64 if v.dtype == np.int64 else np.uint64).view(np.int64)
    made = {"kind": np.full(len(x), kind, np.int32), "x": pa.array(signed(x), mask=null), "spare": columns.get("spare", np.zeros(len(x))).astype(np.int32)}
    return pa.table([made[c] if c in made else signed(columns[c]) if c in columns else np.zeros(len(x), np.int64) for c in _OUT.names], schema=_OUT)


def _meet(bits: int, percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """kind 0: document x of class y in group z, with its size nx and text key ny. 1: groups x < y of sizes nx and ny with z
        rare shingles. 2: a shingle x, common in ny groups, of group y."""
        kinds, out = table.column("kind").to_numpy(), [_OUT.empty_table()]
        blobs = {k: b"".join(b.as_py() for b, kind in zip(table.column("blob"), kinds, strict=True) if kind == k) for k in (0, 1)}
        rows = np.frombuffer(blobs[0], _ROW)
        if len(rows):
            out.append(_table(0, rows["doc"], rows["null"].astype(bool), y=rows["cls"], z=rows["grp"], nx=rows["n"], ny=rows["key"]))
        made = np.frombuffer(blobs[1], _POSTING)
        made = made[np.lexsort((made["grp"], made["key"]))]
        if len(made):
            same = np.concatenate(([False], (made["key"][1:] == made["key"][:-1]) & (made["grp"][1:] == made["grp"][:-1])))
            made = made[~same]
            cuts = np.flatnonzero(np.concatenate(([True], made["key"][1:] != made["key"][:-1])))
            sizes = np.diff(np.append(cuts, len(made)))
            found = []
            for m in range(2, RARE + 1):
                at = cuts[sizes == m]
                for i in range(m - 1):
                    for j in range(i + 1, m):
                        a, b = made[at + i], made[at + j]
                        fit = 100 * np.minimum(a["n"], b["n"]).astype(np.int64) >= percent * np.maximum(a["n"], b["n"]).astype(np.int64)
                        pair = np.zeros(int(fit.sum()), _PAIR)
                        pair["a"], pair["b"], pair["na"], pair["nb"], pair["spare"] = a["grp"][fit], b["grp"][fit], a["n"][fit], b["n"][fit], np.minimum(a["spare"], b["spare"])[fit]
                        found.append(pair)
            if found:
                pairs, shared = np.unique(np.concatenate(found), return_counts=True)
                out.append(_table(1, pairs["a"], y=pairs["b"], z=shared, nx=pairs["na"], ny=pairs["nb"], spare=pairs["spare"]))
            wide = np.repeat(sizes, sizes)
            common, often = made[wide > RARE], wide[wide > RARE]
            if len(common):
                bucket = np.uint64(key[0].as_py() << 32)
                out.append(_table(2, bucket | common["key"].astype(np.uint64), y=common["grp"], nx=common["n"], ny=often, spare=common["spare"]))
        return pa.concat_tables(out)

    return run


def _verify(percent: int):
    def run(key: tuple, pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        """The linked pairs of one chunk, with their overlap."""
        sets = dict(zip(texts["cls"], (own for _, own in shingle_sets(pa.array(texts["text"], pa.string()))), strict=True))
        sets = {c: own for c, own in sets.items() if _class_of(own) == c % (1 << 64)}
        out = []
        for a, b in zip(pairs["a"], pairs["b"], strict=True):
            x, y = sets.get(a), sets.get(b)
            if x is None or y is None:
                continue
            both = np.concatenate((x, y))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= percent * (len(both) - shared):
                out.append((a, b, shared, len(both) - shared))
        return pd.DataFrame(out, columns=["a", "b", "shared", "union"]).astype("int64")

    return run


def verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, n_pairs: int, percent: int) -> DataFrame:
    """Pairs in chunks by their first member, of which one with many pairs has several; each chunk gets the texts that it
    needs once, and makes their sets."""
    chunks = max(1, n_pairs // 128)
    busy = pairs.groupBy("a").agg(F.count("*").alias("n")).filter("n > 128").select("a", F.ceil(F.col("n") / 128).alias("slices"))
    part = F.pmod(F.xxhash64("b"), F.coalesce("slices", F.lit(1)))
    dealt = stash(pairs.join(by_merge(busy), "a", "left").select("a", "b", F.pmod(F.xxhash64("a", part), F.lit(chunks)).cast("int").alias("chunk")), "ngram-dealt")
    need = dealt.select("chunk", F.explode(F.array("a", "b")).alias("cls")).distinct()
    need = need.join(by_merge(_named(members)), "cls").groupBy("cls", "d").agg(F.collect_set("chunk").alias("parts")).select("cls", "d.doc_id", "d.text_key", "parts")
    need = stash(need, "ngram-need")
    texts = maybe_among(docs, F.col("doc_id"), need.select("doc_id")).filter("maybe").join(need, ["doc_id", "text_key"])
    sent = texts.select(F.explode("parts").alias("part"), "cls", "text")
    return dealt.groupBy("chunk").cogroup(sent.groupBy("part")).applyInPandas(_verify(percent), "a long, b long, shared long, union long")


def ngram_join(docs: DataFrame, percent: int = PERCENT, doc_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, labels): members (doc_id, cls, grp, n, text_key) has a row per document, links (a, b, shared, union)
    verified pairs of classes (equal shingle sets) that connect every component, and labels (cls, component_id) for classes
    with a link.
    """
    given = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    n_docs = given.count()
    bits = min(22, max(7, int(n_docs * 200 // (1 << 17)).bit_length()))
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(given))
    posted = given.mapInArrow(_postings(bits, percent, sketch), "bucket int, kind byte, blob binary")
    met = stash(posted.groupBy("bucket").applyInArrow(_meet(bits, percent), "kind int, x long, y long, z long, nx long, ny long, spare int"), "ngram-met", ["kind"])

    members = met.filter("kind = 0").select(F.col("x").alias("doc_id"), F.col("y").alias("cls"), F.col("z").alias("grp"), F.col("nx").alias("n"), F.col("ny").alias("text_key"))
    own = stash(members.filter("n > 0").select("grp", "cls").distinct(), "ngram-groups")
    common = met.filter("kind = 2").select(F.col("x").alias("h"), F.col("y").alias("grp"), F.col("nx").alias("n"), F.col("ny").alias("often"), "spare")
    hits = stash(common.groupBy("grp").agg(F.count("*").alias("hits")), "ngram-hits")
    pairs = _expanded(stash(_group_pairs(met.filter("kind = 1"), hits, percent), "ngram-group-pairs"), own)

    least_common = Window.partitionBy("grp").orderBy("often", "h")
    dense = common.join(by_merge(hits), "grp").filter("hits > spare").withColumn("rank", F.row_number().over(least_common))
    dense = dense.filter("rank <= hits - spare").select("h", "grp", "often").join(by_merge(own), "grp").select("h", "cls", "often")
    used = stash(dense.unionByName(pairs[1]), "ngram-common")

    first = stash(stash(pairs[0], "ngram-pairs").unionByName(_chain(used)).distinct(), "ngram-first")
    linked = stash(verified(first, members, given, first.count(), percent), "ngram-linked")
    label = stash(components(linked.select("a", "b"), "ngram-label"), "ngram-label")
    rest = stash(_across(used, label, members, given, percent), "ngram-rest")
    if rest.limit(1).count():
        linked = stash(linked.unionByName(rest), "ngram-linked")
        label = stash(components(linked.select("a", "b"), "ngram-label"), "ngram-label")
    lowest = members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    named = label.join(by_merge(lowest), label.node == lowest.cls).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    labels = label.join(named, "label").select(F.col("node").alias("cls"), "component_id")
    return members, linked, labels


def _group_pairs(met: DataFrame, hits: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of groups that share enough of their prefixes; what holds for two groups holds for all their members."""
    pairs = met.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("z").alias("shared"), F.min("spare").alias("spare"), F.max("nx").alias("na"), F.max("ny").alias("nb"))
    for side in ("a", "b"):
        pairs = pairs.join(by_merge(hits.select(F.col("grp").alias(side), F.col("hits").alias(f"hits_{side}"))), side, "left")
    pairs = pairs.withColumn("most", F.col("shared") + F.least(F.coalesce("hits_a", F.lit(0)), F.coalesce("hits_b", F.lit(0))))
    # Behind the prefix that ends first, only its own document's rest can still overlap.
    rest = lambda n: F.expr(f"greatest(0, {n} - ({n} - ceil({percent} * {n} / 100) + 1 + {SLACK}))")
    needed = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    return pairs.filter((F.col("most") > F.col("spare")) & (F.col("most") + F.greatest(rest("na"), rest("nb")) >= needed)).select("a", "b")


def _expanded(pairs: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b) of the pairs of groups, and of groups with themselves; of groups with over EXPAND classes
    instead (h, cls, often): all classes of the pair under one number."""
    sizes = stash(own.groupBy("grp").agg(F.count("*").alias("k")).filter("k > 1"), "ngram-multi")
    both = pairs.unionByName(sizes.select(F.col("grp").alias("a"), F.col("grp").alias("b")))
    for side in ("a", "b"):
        both = both.join(by_merge(sizes.select(F.col("grp").alias(side), F.col("k").alias(f"k_{side}"))), side, "left")
    both = both.select("a", "b", F.coalesce("k_a", F.lit(1)).alias("k_a"), F.coalesce("k_b", F.lit(1)).alias("k_b"))
    few = both.filter(f"greatest(k_a, k_b) <= {EXPAND}")
    x, y = own.select(F.col("grp").alias("a"), F.col("cls").alias("x")), own.select(F.col("grp").alias("b"), F.col("cls").alias("y"))
    made = few.join(by_merge(x), "a").join(by_merge(y), "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    many = both.filter(f"greatest(k_a, k_b) > {EXPAND}").select(F.xxhash64("a", "b").alias("h"), F.explode(F.array_distinct(F.array("a", "b"))).alias("grp"), (F.col("k_a") + F.col("k_b")).alias("often"))
    return made, many.join(own, "grp").select("h", "cls", "often")


def _chain(used: DataFrame) -> DataFrame:
    """Neighbours among the classes of each common shingle, in ORDERS orders of its own; 256 cells each, then the cells' heads."""
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))
    keyed = used.select("h", "cls", orders.alias("r")).withColumn("o", F.xxhash64("cls", "r")).withColumn("cell", F.pmod("o", F.lit(256)))
    inner = Window.partitionBy("h", "r", "cell").orderBy("o", "cls")
    heads = keyed.groupBy("h", "r", "cell").agg(F.min_by("cls", "o").alias("cls"))
    outer = Window.partitionBy("h", "r").orderBy("cell")
    pairs = keyed.select("cls", F.lag("cls").over(inner).alias("prev")).unionByName(heads.select("cls", F.lag("cls").over(outer).alias("prev")))
    return pairs.filter("prev is not null").select(F.least("cls", "prev").alias("a"), F.greatest("cls", "prev").alias("b"))


def _meet_block(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between a block's guests and its own classes: for each guest, one to each component."""
        sets = [own for _, own in shingle_sets(pa.array(rows["text"], pa.string()))]
        sound = np.array([_class_of(own) == c % (1 << 64) for c, own in zip(rows["cls"], sets, strict=True)])
        cls, label, guest = rows["cls"].to_numpy(), rows["c"].to_numpy(), rows["guest"].to_numpy()
        home = np.flatnonzero(~guest & sound)
        hashes = np.concatenate([sets[i] for i in home]) if len(home) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(home)), [len(sets[i]) for i in home])
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        sizes = np.array([len(sets[i]) for i in home])
        out = []
        for g in np.flatnonzero(guest & sound) if len(home) else []:
            low, high = np.searchsorted(hashes, sets[g], "left"), np.searchsorted(hashes, sets[g], "right")
            spans = high - low
            at = np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            shared = np.bincount(owner[at], minlength=len(home))
            union = sizes + len(sets[g]) - shared
            found = np.flatnonzero((100 * shared >= percent * union) & (label[home] != label[g]))
            for i in found[np.unique(label[home[found]], return_index=True)[1]]:
                out.append((min(cls[g], cls[home[i]]), max(cls[g], cls[home[i]]), shared[i], union[i]))
        return pd.DataFrame(out, columns=["a", "b", "shared", "union"]).astype("int64")

    return run


def _places(used: DataFrame, label: DataFrame) -> DataFrame:
    """(cls, c, block, at, guest): which blocks each class sits in or visits, for those that share one of their least common
    shingles and are in different components (c) so far.

    The largest component of a shingle needn't meet itself: one side (the guest) is always outside it.
    """
    own = stash(used.join(by_merge(label), used.cls == label.node, "left").select("h", "cls", "often", F.coalesce("label", "cls").alias("c")), "ngram-own")
    per = own.groupBy("h", "c").agg(F.count("*").alias("m"))
    main = stash(per.groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts")).filter("parts > 1"), "ngram-main")
    own = stash(join_hot(own, main, "h", "inner").select("h", "cls", "often", "c", (F.col("c") != F.col("main")).alias("outside")), "ngram-own")
    # A class sits with those that have the same most common shingle.
    seats = own.groupBy("cls").agg(F.min("c").alias("c"), F.max_by("h", F.struct("often", "h")).alias("home"), F.max("outside").alias("outside"))
    rooms = seats.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    seats = stash(seats.join(rooms, "home").select("cls", "c", "outside", F.xxhash64("home", F.pmod(F.xxhash64("cls"), "k")).alias("block")), "ngram-seats")
    # A shingle's blocks are dealt to 16 tasks, and its guests come to each.
    blocks = own.join(by_merge(seats.select("cls", "block")), "cls").select("h", "block", F.pmod(F.xxhash64("block"), F.lit(16)).cast("int").alias("part")).distinct()
    tours = own.filter("outside").select("h", "cls", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part")).join(blocks, ["h", "part"]).select("cls", "block").distinct()
    guests = tours.join(by_merge(seats.select("cls", "c")), "cls")
    tables = guests.groupBy("block").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("tables"))
    guests = guests.join(tables, "block").select("cls", "c", "block", F.pmod(F.xxhash64("cls"), "tables").cast("int").alias("at"), F.lit(True).alias("guest"))
    hosts = seats.join(tables, "block").select("cls", "c", "block", F.explode(F.sequence(F.lit(0), F.col("tables") - 1)).alias("at"), F.lit(False).alias("guest"))
    return guests.unionByName(hosts)


def _across(used: DataFrame, label: DataFrame, members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between classes of different components, found block by block."""
    places = stash(_places(used, label), "ngram-places").groupBy("cls", "c").agg(F.collect_list(F.struct("block", "at", "guest")).alias("places"))
    need = stash(places.join(by_merge(_named(members)), "cls").select("cls", "c", "places", "d.doc_id", "d.text_key"), "ngram-need")
    texts = maybe_among(docs, F.col("doc_id"), need.select("doc_id")).filter("maybe").join(need, ["doc_id", "text_key"])
    rows = texts.select("cls", "c", "text", F.explode("places").alias("p")).select("cls", "c", "text", "p.block", "p.at", "p.guest")
    return rows.groupBy("block", "at").applyInPandas(_meet_block(percent), "a long, b long, shared long, union long").distinct()


def _named(members: DataFrame) -> DataFrame:
    """One document (d: doc_id, text_key) of each class."""
    return members.filter("n > 0 and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "text_key")).alias("d"))


def near_duplicate_components(docs: DataFrame, percent: int = PERCENT, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the smallest doc_id that links reach."""
    members, _, labels = ngram_join(docs, percent, doc_col, text_col)
    lowest = members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("lowest"))
    known = lowest.join(labels, "cls", "left").select("cls", F.coalesce("component_id", "lowest").alias("component_id"))
    found = join_hot(members.filter("n > 0"), known, "cls", "inner").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each group of linked documents: its smallest doc_id (of equal ones, the smallest text key).

    Rows without words stay, and so do rows of null doc_id, which nothing could name. Only rows that may go are shuffled.
    """
    members, _, labels = ngram_join(docs, percent)
    worded = members.filter("n > 0 and doc_id is not null")
    grouped = join_hot(worded, labels, "cls").withColumn("g", F.coalesce("component_id", "cls")).withColumn("linked", F.col("component_id").isNotNull())
    first = grouped.groupBy("linked", "g").agg(F.min(F.struct("doc_id", "text_key")).alias("f")).select("f.doc_id", "f.text_key", F.lit(True).alias("first"))
    rows = worded.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).join(first, ["doc_id", "text_key"], "left")
    concerned = stash(rows.filter("first is null or rows > 1").select("doc_id", "text_key", F.coalesce("first", F.lit(False)).alias("first")), "ngram-concerned")
    own = as_rows(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))).alias("text_key"))
    flagged = maybe_among(own, F.xxhash64("doc_id", "text_key"), concerned.select(F.xxhash64("doc_id", "text_key")))
    left = flagged.filter("maybe").join(concerned, ["doc_id", "text_key"], "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("first"))
    left = left.withColumn("nth", nth).filter("first is null or first and nth = 1")
    return flagged.filter("not maybe").select("row.*").unionByName(left.select("row.*"))
