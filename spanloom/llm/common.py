"""Shared pieces: reading tables, shared-folder tables, words, bitmaps, joins on hot keys, prefix sums, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space (0x20, 0x09-0x0D).
WORD_BREAK = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
MOST_BITS = 25
ROWS = 1000
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where none is set, one of our own, if there is but one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", path) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return path


def stash(df: DataFrame, what: str, by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{what}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    with short_batches(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, rows go to Python workers by at most BATCH_ROWS and BATCH_BYTES at a time, as whole texts are large; an
    even smaller setting of the session stays."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in most}
    try:
        for k, v in most.items():
            own = re.fullmatch(r"([1-9]\d*)b?", before[k])
            spark.conf.set(k, str(min(v, int(own[1])) if own else v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def chunks_of(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a text column; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """How many words, without making them: each word starts where white space is followed by anything else."""
    flat = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "\t\n\x0b\f\r", "     ")
    return F.regexp_count(flat, F.lit(r"\x20[^\x20]")).cast("long")


def as_rows(df: DataFrame) -> DataFrame:
    """(row): every row as one struct, so that columns added later can't clash with its own; `select("row.*")` undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast in a join if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def by_merge(df: DataFrame) -> DataFrame:
    """df, as a side of a join that grows with the input: sorted and merged at every size, so the driver never holds it."""
    return df.hint("merge")


def maybe_among(df: DataFrame, key: Column, wanted: DataFrame, out: str = "maybe") -> DataFrame:
    """df with a flag: false where `key` is for certain not in `wanted` (one column), true where it is or may be.

    The bitmap has 8 bits a wanted value, but at most 1 << MOST_BITS (4 MB), so it can be broadcast whatever the table.
    """
    bits = 1 << min(MOST_BITS, max(16, int(8 * wanted.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word, bit = (lambda s: F.expr(f"cast({s} div 64 as int)")), (lambda s: F.expr(f"shiftleft(1L, cast({s} % 64 as int))"))
    held = wanted.select(slot(F.col(wanted.columns[0])).alias("_s")).groupBy(word("_s").alias("_w")).agg(F.bit_or(bit("_s")).alias("_bits"))
    joined = df.withColumn("_s", slot(key)).withColumn("_w", word("_s")).join(F.broadcast(held), "_w", "left")
    return joined.withColumn(out, F.coalesce(F.col("_bits").bitwiseAND(bit("_s")) != 0, F.lit(False))).drop("_s", "_w", "_bits")


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has each key once, when a key may have a large share of left's rows.

    Keys with more than a `share`-th of all rows (and of ROWS) are hot: there are at most `share`, so their list can be
    broadcast. Their rows go to several tasks by a hash of all columns, and right's row to each of these. `counts` (key, _n)
    may say how many rows left has.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n")) if counts is None else counts
    total = counts.agg(F.sum("_n")).first()[0] or 0
    most = max(ROWS, total // share)
    hot = counts.filter(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    own = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    other = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return own.join(other, [key, "_salt"], how).drop("_salt")


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, cells: int) -> DataFrame:
    """Exclusive running sum of `value` within `keys`, in two levels so that a hot key is spread over `cells` tasks.

    Rows are dealt by a hash of `order` to cells; sums of cells are added up per key (at most `cells` rows a key), then
    rows within each cell. The order is thus that of (cell, order columns): pseudorandom, but the same in every run.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int")
    df = df.withColumn("_cell", cell)
    sums = df.groupBy(*keys, "_cell").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left, right = df.alias("l"), sums.alias("r")
    same = F.lit(True)
    for k in [*keys, "_cell"]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.join(right, same).select("l.*", "r._base")
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_cell", "_base")


def components(edges: DataFrame, what: str = "components", rounds: int = 40) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the smallest node of its component.

    Alternating large-star and small-star steps, each a minimum per node and a join, written to the shared folder one by
    one, so that no plan holds more than one of them. Minima combine before the shuffle, and the joins are plain ones that
    Spark splits where a node is hot.
    """
    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def large(df: DataFrame) -> DataFrame:
        both = df.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return pairs(both.filter("b > a").join(by_merge(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small_star(df: DataFrame) -> DataFrame:
        low = df.groupBy("a").agg(F.min("b").alias("m"))
        moved = df.join(by_merge(low), "a")
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        return pairs(moved.select(ends.alias("e")).select("e.*"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stash(pairs(edges), what)
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = stash(small_star(stash(large(now), what)), what)
        after = mark(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
