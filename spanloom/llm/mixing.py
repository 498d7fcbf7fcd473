"""Mixing sources to target weights.

Words of a source, document after document in a pseudorandom order, form a line that is cut to blocks of `block` words (of
fewer in a source with less than PIECES blocks, so that small sources meet their targets too).
The mix is a list of slots, dealt to output shards. Every shard draws how many of its slots each source gets (a
multinomial); slots that a source has beyond its quota go to sources that fell short, so totals meet the targets and no
source passes `most` times its size. The k-th slot of a source takes, in epoch k // blocks, the block that a keyed
permutation of the block numbers gives for k mod blocks: each block once an epoch, so no document is taken more often
than its blocks' epochs. Slots and blocks are then joined by block number.

Only tables with one row per source come to the driver. Running sums are in two levels (see prefix_sum), so a source
with a third of all rows is spread over many tasks. Null text has no words; documents without words take part with 0.
Null is a source like any other, the last one. Repeated rows have places of their own on the line. Columns of the documents
may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_rows, n_words_of, prefix_sum, small, stash
from .wordhash import mix

BLOCK = 128
SHARD = 4096
MOST = 3
PIECES = 64
SEED = 20260101


def targets(sizes: list[tuple[str | None, int]], weights: list[float] | None = None, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source: by weight (1, 2, 3 repeating over sources in code point order, null last), together as
    many as there are; none above `most` times its size, the excess shared again by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: (weights[i] if weights else i % 3 + 1) for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    left, open_, out = float(sum(n for _, n in order)), [s for s, _ in order], {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share >= cap[s]]
        if not full:
            return out | {s: weight[s] * share for s in open_}
        for s in full:
            out[s] = float(cap[s])
            left -= cap[s]
        open_ = [s for s in open_ if s not in out]
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of range(n) takes i: a four-round Feistel network on the next even number of bits,
    walked on until it is inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, n))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix(right ^ k ^ np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n.astype(np.uint64)[todo]]
    return out.astype(np.int64)


def block_of(size: int, block: int = BLOCK) -> int:
    """How many words a block of a source of this size has."""
    return max(1, min(block, size // PIECES))


def layout(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, size, start): where each document's words begin on its source's line."""
    slim = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("source").cast("string").alias("source"), n_words_of(F.col("text")).alias("size"))
    slim = stash(slim, "mix-sizes")
    cells = max(1, min(1 << 16, slim.count() // 2000))
    return stash(prefix_sum(slim, ["source"], ["doc_id", "text_key"], "size", "start", cells), "mix-layout")


def slots(spark: SparkSession, sizes: list[tuple[str | None, int]], want: dict[str | None, float], block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(shard, s, block_index): the mix. s is the place of the source in `sizes`."""
    n_blocks = np.array([-(-n // block_of(n, block)) for _, n in sizes], dtype=np.int64)
    quota = np.array([min(MOST * b, round(want[s] * b / n)) if n else 0 for (s, n), b in zip(sizes, n_blocks, strict=True)], dtype=np.int64)
    total = int(quota.sum())
    n_shards = max(1, math.ceil(total / SHARD))
    chance = quota / max(1, total)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                size = max(0, min(SHARD, total - int(shard) * SHARD))
                counts = np.random.default_rng([seed, int(shard)]).multinomial(size, chance) if total else np.zeros(len(quota), int)
                got = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": np.int64(shard), "s": got.astype(np.int32), "n": counts[got].astype(np.int64)})

    drawn = stash(spark.range(0, n_shards, 1, max(1, min(2000, n_shards // 8))).mapInPandas(draw, "shard long, s int, n long"), "mix-draws")
    placed = prefix_sum(drawn, ["s"], ["shard"], "n", "first", max(1, n_shards // 512))
    # What a source has drawn beyond its quota, in order of source, goes to what others lack, in order of source.
    made = np.zeros(len(quota), np.int64)
    for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect():
        made[r.s] = r.n
    over, under = np.maximum(made - quota, 0), np.maximum(quota - made, 0)
    over_at, under_at = np.cumsum(over) - over, np.cumsum(under)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = batch.iloc[at : at + 256]
                n = rows["n"].to_numpy()
                s = np.repeat(rows["s"].to_numpy(), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(rows["first"].to_numpy(), n)
                beyond = k >= quota[s]
                g = over_at[s[beyond]] + k[beyond] - quota[s[beyond]]
                to = np.searchsorted(under_at, g, "right")
                k[beyond] = made[to] + g - (under_at - under)[to]
                s[beyond] = to
                blocks = n_blocks[s]
                key = mix(np.uint64(seed) ^ mix(s.astype(np.uint64) << np.uint64(32) | (k // blocks).astype(np.uint64)))
                yield pd.DataFrame({"shard": np.repeat(rows["shard"].to_numpy(), n), "s": s.astype(np.int32), "block_index": permuted(k % blocks, blocks, key)})

    return placed.select("shard", "s", "n", "first").mapInPandas(take, "shard long, s int, block_index long")


def mix_sources(docs: DataFrame, block: int = BLOCK, weights: list[float] | None = None, most: float = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces): placed has a row per document with size, source_size, target and start; pieces says of each part
    of a document in a block (by source, start, block_index; words lo to hi of the document) how many `times` the mix has it.
    """
    spark = docs.sparkSession
    line = layout(docs)
    sizes = sorted(((r.source, r.n) for r in line.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    want = targets(sizes, weights, most)
    table = spark.createDataFrame([(i, s, n, float(want[s]), block_of(n, block)) for i, (s, n) in enumerate(sizes)], "s int, name string, source_size long, target double, width int")
    line = line.join(small(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    times = slots(spark, sizes, want, block, seed).groupBy("s", "block_index").agg(F.count("*").alias("times"))
    own = line.filter("size > 0").select("s", "start", "size", "width", F.explode(F.expr("sequence(start div width, (start + size - 1) div width)")).alias("block_index"))
    span = own.withColumn("lo", F.greatest(F.expr("block_index * width"), "start") - F.col("start")).withColumn("hi", F.least(F.expr("(block_index + 1) * width"), F.col("start") + F.col("size")) - F.col("start"))
    pieces = span.join(times, ["s", "block_index"]).select("s", "start", "block_index", "lo", "hi", "times")
    return line, pieces


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (the words of it in the mix, repeats counted) of every document."""
    line, pieces = mix_sources(docs, **options)
    got = pieces.groupBy("s", "start").agg(F.sum(F.expr("(hi - lo) * times")).alias("taken"))
    full = line.filter("size > 0").join(got, ["s", "start"], "left").unionByName(line.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: per document and copy, a row for each run of neighbouring blocks that the mix has that often.

    A run that is the whole document keeps its text as it is; others start and end at words. Columns are those of `docs`.
    """
    line, pieces = mix_sources(docs, **options)
    runs = pieces.groupBy("s", "start").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("_runs"))
    line = line.filter("size > 0").join(runs, ["s", "start"]).select("doc_id", "text_key", F.col("source").alias("_source"), F.col("size").alias("_size"), "_runs", "start")
    keys = ["doc_id", "text_key", "_source"]
    nth = lambda df, by: df.withColumn("_nth", F.row_number().over(_window(keys, by)))
    own = as_rows(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))).alias("text_key"), F.col("row.source").cast("string").alias("_source"))
    own = nth(own, "text_key").alias("d")
    taken = nth(line, "start").alias("t")
    same = F.col("d._nth") == F.col("t._nth")
    for k in keys:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}"))
    names = docs.columns
    held = "_".join(["_mix", *names])  # a name that no column has
    both = own.join(taken, same).select(F.struct("_runs", "_size").alias(held), "row.*")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            at, texts = [], []
            for i, (text, mix_) in enumerate(zip(batch["text"], batch[held], strict=True)):
                ends, runs, size = None, mix_["_runs"], mix_["_size"]
                for copy in range(max(r["times"] for r in runs)):
                    spans: list[list[int]] = []
                    for r in runs:
                        if r["times"] > copy:
                            if spans and spans[-1][1] == r["lo"]:
                                spans[-1][1] = r["hi"]
                            else:
                                spans.append([r["lo"], r["hi"]])
                    for lo, hi in spans:
                        if lo == 0 and hi == size:
                            texts.append(text)
                        else:
                            ends = ends or [m.span() for m in word.finditer(text)]
                            texts.append(text[ends[lo][0] : ends[hi - 1][1]])
                        at.append(i)
            out = batch[names].iloc[at].reset_index(drop=True)
            out["text"] = texts
            if "n_chars" in out:
                out["n_chars"] = np.array([len(t) for t in texts], dtype=np.int64)
            yield out

    return both.mapInPandas(cut, docs.schema)


def _window(keys: list[str], by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(by)
