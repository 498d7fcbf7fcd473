"""Order MinHash fingerprints, and the likeness of texts by them.

Every k-mer of code points counts with its occurrence number, so repeats differ. A hash deals the numbered k-mers to
PARTS cells; each cell selects its LEAST smallest, puts them back in text order and hashes the tuple. As the tuple
depends on order, two texts agree in a cell when the k-mers selected there are the same and in the same order: likeness
falls with edit distance, and not just with shared content. A cell draws its own pseudorandom part of the k-mers (one
permutation for all cells), so a fingerprint costs two sorts whatever PARTS is.

Texts of fewer than K code points are one k-mer; the empty text has no k-mer and its own fingerprint. Cells with fewer
than LEAST k-mers hash those that they have; cells that are empty in both texts don't count. Null counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix

K = 12
PARTS = 64
LEAST = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POSITION = 24


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40-bit keys in ascending order (ties by position), and their positions."""
    n = len(keys)
    if n < 1 << _POSITION:
        packed = np.sort((keys << np.uint64(_POSITION)) | np.arange(n, dtype=np.uint64))
        return packed >> np.uint64(_POSITION), (packed & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    at = np.argsort(keys, kind="stable")
    return keys[at], at


def fingerprint(text: str) -> np.ndarray:
    """PARTS 32-bit values; 0 where a cell has no k-mer."""
    out = np.zeros(PARTS, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return out
    k = min(K, len(codes))
    n = len(codes) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = total * _STEP + codes[j : j + n]
    kmers, at = _ranked(mix(total) >> np.uint64(24))
    first = np.concatenate(([True], kmers[1:] != kmers[:-1]))
    index = np.arange(n)
    occurrence = index - np.maximum.accumulate(np.where(first, index, 0))
    numbered = np.empty(n, np.uint64)
    numbered[at] = mix((kmers << np.uint64(24)) + occurrence.astype(np.uint64)) >> np.uint64(24)
    low, where = _ranked(numbered)
    cells = np.searchsorted(low, np.arange(PARTS, dtype=np.uint64) << np.uint64(40 - PARTS.bit_length() + 1))
    ends = np.append(cells[1:], n)
    pick = cells[:, None] + np.arange(LEAST)
    real = pick < ends[:, None]
    pick = np.minimum(pick, n - 1)
    place = np.where(real, where[pick], np.iinfo(np.int64).max)
    order = np.argsort(place, axis=1, kind="stable")
    values = np.take_along_axis(np.where(real, low[pick], np.uint64(0)), order, axis=1)
    made = np.zeros(PARTS, np.uint64)
    for j in range(LEAST):
        made = mix(made * _STEP + values[:, j] + np.uint64(1))
    made = (made >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.where(real[:, 0], made, np.uint32(0))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of cells that agree, of those that either text fills; 1 for two empty texts."""
    used = int(((a > 0) | (b > 0)).sum())
    return float(((a == b) & (a > 0)).sum() / used) if used else 1.0


def _hex(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with its fingerprint as hexadecimal text, for use in joins or for storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_hex(fingerprint(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, rows_per_part: int = 4000, most_parts: int = 20_000) -> DataFrame:
    """(part, extra, doc_id, key, text): documents in descending order of doc_id (null last, ties by text) within parts.

    Every part also has, last and marked `extra`, the row that comes after it: the head of the next part, or for the
    last part the head of the first. Cuts and heads come from ids alone, a row a part; texts are shuffled once.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    parts = min(most_parts, max(1, slim.count() // rows_per_part))
    cuts = np.unique(slim.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) + 1 - np.searchsorted(cuts, ids.fillna(-np.inf).to_numpy(float), "right") - ids.notna().to_numpy().astype(int))

    heads = sorted((r.part, r.head.doc_id, r.head.key) for r in slim.withColumn("part", part_of("doc_id")).groupBy("part").agg(F.max(F.struct("doc_id", "key")).alias("head")).collect())
    before = [(part, heads[i - 1][0], doc, key) for i, (part, doc, key) in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(before, "part int, before int, head long, head_key long")).alias("h")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    given = given.withColumn("key", F.xxhash64("text")).withColumn("part", part_of("doc_id")).alias("g")
    same = (F.col("g.part") == F.col("h.part")) & F.col("g.doc_id").eqNullSafe(F.col("h.head")) & (F.col("g.key") == F.col("h.head_key"))
    own, extra = F.struct(F.col("g.part").alias("part"), F.lit(False).alias("extra")), F.struct(F.col("h.before").alias("part"), F.lit(True).alias("extra"))
    sent = given.join(table, same, "left").select(F.explode(F.when(F.col("h.part").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("to"), "g.doc_id", "g.key", "g.text")
    sent = sent.select("to.part", "to.extra", "doc_id", "key", "text").repartition("part")
    return sent.sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), F.col("key").desc())


def edited(text: str, after: str) -> str:
    """`text` with its last third of code points replaced by the first as many (or all) of `after`."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how alike they and the next document's are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for whole in batches:
            out: list[tuple] = []
            for at in range(0, whole.num_rows, 512):
                for part, extra, doc, text in zip(*(whole.slice(at, 512).column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                    own = fingerprint(text)
                    if waiting and waiting[0] == part:
                        _, d, t, f = waiting
                        changed = edited(t, text)
                        other = fingerprint(changed) if changed != t else f
                        out.append((d, len(t), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), _hex(f), _hex(other), likeness(f, other), likeness(f, own)))
                    waiting = None if extra else (part, doc, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
