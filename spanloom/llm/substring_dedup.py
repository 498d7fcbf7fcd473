"""Removal of passages that an earlier document holds: Rabin-Karp hashes of every window of 50 words, counted in Spark.

A word goes if a window over it also starts in a document of a smaller doc_id. Windows are judged on the input.

1. Documents are counted by the digest of their words. Of equal ones only the lowest is looked at; the others go whole.
2. Every window of these has two polynomial hashes, folded into 64 bits. It is dealt by its anchor, the least hash of the 25-word
   runs in it: equal windows have equal anchors, and neighbours mostly the same one, so windows travel as runs of some 13
   under one header, and what is to be removed comes back as runs. Windows that a chunk of texts holds twice are settled
   there, so a passage that many documents share is sent once a chunk, not once a document.
3. Each bucket is read as a stream of batches. It keeps for each window the lowest document so far; whatever is not lowest
   is given out at once. So a bucket takes the memory of its different windows, however often they occur.
4. Overlapping and adjacent runs merge into maximal intervals per document. Only texts of which a part goes are shuffled.

Null and empty texts have no words and keep the digest of the empty text. Texts of fewer than 50 words are kept. Documents of
a null doc_id have no place in the order: nothing is removed from them or on their account. Equal rows and rows of one
doc_id don't remove from each other, and each has a row in the result. Repeats within one document stay. An empty table has
no rows; other columns are not looked at, and cleaned_documents() passes them on whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, as_rows, by_merge, chunks_of, join_hot, maybe_among, n_words_of, stash
from .wordhash import mix, rolling, word_hashes

SIZE = 50
# Bytes of text at a time in a task, and windows in a bucket (of which there are at most 1 << MOST_BITS).
CHUNK, BUCKET, MOST_BITS = 1 << 22, 1 << 20, 22
FILES = 4
EMPTY = hashlib.sha256(b"").hexdigest()

_RUN = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<u4"), ("n", "<u4")])
_FLAT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<u4")])
_POSTED = pa.schema([("bucket", pa.int32()), ("runs", pa.binary()), ("hashes", pa.binary()), ("gone", pa.binary())])
_GONE = "doc_id long, key long, start int, stop int"


def window_hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, anchor) of every `size` consecutive word hashes; the anchor is the least hash of the runs of half the size in it."""
    one, two = rolling(words, size), rolling(mix(words + np.uint64(size)), size)
    half = (size + 1) // 2
    least, width, wanted = mix(rolling(words, half)), 1, size - half + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    left = wanted - width
    least = np.minimum(least[: len(least) - left], least[left:]) if left else least
    return mix(one ^ mix(two)), least[: len(one)]


def to_runs(doc: np.ndarray, key: np.ndarray, at: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive places of one document as one run (and where each starts); runs also end where `cut` changes."""
    if not len(doc):
        return np.zeros(0, _RUN), np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    if cut is not None:
        new[1:] |= cut[1:] != cut[:-1]
    first = np.flatnonzero(new)
    runs = np.zeros(len(first), _RUN)
    runs["doc"], runs["key"], runs["start"], runs["n"] = doc[first], key[first], at[first], np.diff(np.append(first, len(doc)))
    return runs, first


def from_runs(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = runs["n"].astype(np.int64)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(runs["doc"], n), np.repeat(runs["key"], n), (np.repeat(runs["start"].astype(np.int64), n) + inner).astype(np.uint32)


def not_lowest(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of these windows are also in a document of a smaller number."""
    out = np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    order, group = order[several], group[several]
    if len(order):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        lowest = np.minimum.reduceat(doc[order], first)
        out[order] = doc[order] > np.repeat(lowest, np.diff(np.append(first, len(order))))
    return out


def _posted(bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk of texts and bucket: the windows that are the chunk's lowest; once a chunk, the runs of the others."""
        for batch in (part for whole in batches for part in chunks_of(whole, 2, CHUNK)):
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hs, anchors, rows, places = [], [], [], []
            for row, words, cuts in word_hashes(batch.column(2), lower=False):
                n = np.diff(cuts)
                fit = np.maximum(n - size + 1, 0)
                if not fit.sum():
                    continue
                h, anchor = window_hashes(words, size)
                owner = np.repeat(np.arange(len(n)), fit)
                inner = np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit)
                place = cuts[:-1][owner] + inner
                hs.append(h[place])
                anchors.append(anchor[place])
                rows.append(owner + row)
                places.append(inner.astype(np.uint32))
            if not hs:
                continue
            h, row, at = np.concatenate(hs), np.concatenate(rows), np.concatenate(places)
            bucket = (mix(np.concatenate(anchors)) >> np.uint64(64 - bits)).astype(np.int32)
            gone = not_lowest(h, ids[row])
            lost, _ = to_runs(ids[row[gone]], keys[row[gone]], at[gone])
            order = np.flatnonzero(~gone)
            order = order[np.argsort(bucket[order], kind="stable")]
            h, row, at, bucket = h[order], row[order], at[order], bucket[order]
            runs, first = to_runs(ids[row], keys[row], at, bucket)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends, of_run = np.append(cuts[1:], len(h)), np.searchsorted(first, np.append(cuts, len(h)))
            made = [(int(bucket[a]), runs[r:s].tobytes(), h[a:b].tobytes(), b"") for a, b, r, s in zip(cuts, ends, of_run[:-1], of_run[1:], strict=True)]
            if len(lost):
                made.append((int(lost["key"][0]) & ((1 << bits) - 1), b"", b"", lost.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(_POSTED)], schema=_POSTED)

    return run


def _meet(size: int):
    def given_out(runs: np.ndarray) -> pa.RecordBatch:
        start = runs["start"].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(runs["doc"])), pa.array(np.ascontiguousarray(runs["key"])), pa.array(start), pa.array(start + runs["n"].astype(np.int32) + np.int32(size - 1))], ["doc_id", "key", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = np.zeros(0, _FLAT)
        for batch in batches:
            joined = {c: b"".join(batch.column(c).to_pylist()) for c in ("runs", "hashes", "gone")}
            yield given_out(np.frombuffer(joined["gone"], _RUN))
            new = np.zeros(len(joined["hashes"]) // 8, _FLAT)
            new["h"] = np.frombuffer(joined["hashes"], np.uint64)
            new["doc"], new["key"], new["at"] = from_runs(np.frombuffer(joined["runs"], _RUN))
            owners = np.concatenate((owners, new))
            gone = not_lowest(owners["h"], owners["doc"])
            lost, owners = owners[gone], owners[~gone]
            lost = lost[np.lexsort((lost["at"], lost["key"], lost["doc"]))]
            yield given_out(to_runs(lost["doc"], lost["key"], lost["at"])[0])

    return run


def few_files(df: DataFrame) -> DataFrame:
    """df in at most FILES parts a core, whatever the number of shuffle partitions: it is small beside the texts, or short."""
    return df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism)


def identified(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_words, sha): every row, its text's hash, its number of words and the digest of its words joined by one space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = F.trim(F.regexp_replace(text, WORD_BREAK, " "))
    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), n_words_of(text).alias("n_words"), F.sha2(joined.cast("binary"), 256).alias("sha"))


def _found(docs: DataFrame, size: int, doc_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every row as in identified(), with `whole` (it goes whole, as a copy), and the maximal intervals
    [start, stop) of words to remove from the others (doc_id, key, spans, n_removed)."""
    rows = stash(few_files(identified(docs, doc_col, text_col)), "repeat-rows")
    able = F.coalesce((F.col("n_words") >= size) & F.col("doc_id").isNotNull(), F.lit(False))
    lowest = stash(few_files(rows.filter(able).groupBy("sha").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("_n"), F.max("n_words").alias("words"))), "repeat-lowest")
    total = lowest.agg(F.sum("words")).first()[0] or 0
    bits = min(MOST_BITS, max(5, int(total // BUCKET).bit_length()))

    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).filter("doc_id is not null")
    first = maybe_among(given, F.col("doc_id"), lowest.select("lowest")).filter("maybe").select("doc_id", "key", "text")
    posted = first.mapInArrow(_posted(bits, size), "bucket int, runs binary, hashes binary, gone binary")
    gone = posted.groupBy("bucket").applyInArrow(_meet(size), _GONE)
    before = Window.partitionBy("doc_id", "key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    parted = gone.withColumn("new", F.when(F.col("start") <= F.max("stop").over(before), 0).otherwise(1)).withColumn("island", F.sum("new").over(upto))
    merged = parted.groupBy("doc_id", "key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = merged.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.sum(F.col("stop") - F.col("start")).alias("n_removed"))
    copies = join_hot(rows.filter(able), lowest.select("sha", "lowest"), "sha", "inner", counts=lowest.select("sha", "_n")).withColumn("whole", F.col("doc_id") > F.col("lowest"))
    every = copies.select(*rows.columns, "whole").unionByName(rows.filter(~able).withColumn("whole", F.lit(False)))
    return every, stash(few_files(spans), "repeat-spans")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each row without its spans: words joined by one space."""
    for batch in batches:
        out = []
        for raw, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words, kept, at = raw.split(), [], 0
            for s in spans:
                kept += words[at : s["start"]]
                at = s["stop"]
            out.append(b" ".join(kept + words[at:]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "key", "kept"])


def _rewritten(docs: DataFrame, rows: DataFrame, spans: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, kept) of the texts of which a part goes."""
    sizes = rows.filter("not whole").groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"))
    partly = spans.join(by_merge(sizes), ["doc_id", "key"]).filter("n_removed < n_words").select("doc_id", "key", "spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    near = maybe_among(given, F.col("doc_id"), spans.select("doc_id")).filter("maybe").select("doc_id", "key", "text")
    found = near.join(by_merge(partly), ["doc_id", "key"]).select("doc_id", "key", "text", "spans")
    return found.mapInArrow(_kept, "doc_id long, key long, kept string").dropDuplicates(["doc_id", "key"])


def remove_repeats(docs: DataFrame, size: int = SIZE, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, joined by one space, of every row."""
    rows, spans = _found(docs, size, doc_col, text_col)
    kept = _rewritten(docs, rows, spans, doc_col, text_col).select("doc_id", "key", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha"))
    held = rows.filter("doc_id is not null").join(by_merge(spans.select("doc_id", "key", "n_removed")), ["doc_id", "key"], "left").join(by_merge(kept), ["doc_id", "key"], "left")
    alone = rows.filter("doc_id is null").select("*", F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_sha"))
    n_removed = F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    sha = F.when(F.col("n_removed") == 0, F.col("sha")).when(F.col("n_removed") == F.col("n_words"), F.lit(EMPTY)).otherwise(F.col("kept_sha"))
    return few_files(held.unionByName(alone, allowMissingColumns=True).withColumn("n_removed", n_removed).select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256")))


def cleaned_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of `docs`: a text of which words go becomes the kept words joined by one space, all others stay as they are."""
    rows, spans = _found(docs, size, "doc_id", "text")
    kept = _rewritten(docs, rows, spans, "doc_id", "text")
    emptied = rows.join(by_merge(spans.select("doc_id", "key", "n_removed")), ["doc_id", "key"], "left").filter("whole or n_removed = n_words").select("doc_id", "key", F.lit("").alias("kept"))
    changed = kept.unionByName(emptied).dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "kept")
    own = as_rows(docs).withColumn("_doc", F.col("row.doc_id").cast("long")).withColumn("_key", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    near = maybe_among(own, F.col("_doc"), changed.select("_doc"))
    text = F.coalesce("kept", "row.text")
    far = near.filter("not maybe").select("row.*")
    joined = near.filter("maybe").join(by_merge(changed), ["_doc", "_key"], "left").withColumn("row", F.col("row").withField("text", text))
    return far.unionByName(joined.select("row.*"))
