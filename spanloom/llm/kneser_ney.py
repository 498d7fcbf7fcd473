"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the letters of words, one per language: the n-grams (up to ORDER) of ^word$. It is counted on all
trusted documents. Counts, continuation counts (how many different letters come before a gram), count-of-counts with the
three discounts of every order, context totals and the interpolated probabilities are joins and aggregations of tables
that are sharded by a hash of their gram, so they grow with the text and are never in one place:

    P(x | h) = max(a(hx) - D(a), 0) / A(h) + (D1 N1(h) + D2 N2(h) + D3 N3(h)) / A(h) * P(x | h')

where a is the count for grams of full order or at a word's beginning, and else the continuation count.

Scoring needs the log probability of each word of a document. A model of at most `most` rows (checked) is broadcast and
words are looked up in it. A larger one stays sharded: the distinct words of all documents are joined to the shards and
their scores to the documents. Both give the same perplexities.

A document's perplexity is per letter; `WEIGHT` letters at the language's mean are added, so that a short text isn't
judged on a few letters. The threshold comes from two quantiles of its language's trusted documents that the model hasn't
seen: it lies REACH times as far from their median, in the logarithm, as their quantile KEEP. A FOLDS-th of the trusted
texts, by a hash (so copies go together), is held out of the training for that. (Where a language has none, its other
trusted documents stand in.)

Texts in a language without a model take the model that fits them best. Null, empty and white-space texts are rejected:
nothing speaks for them. With no trusted text at all, every document with a word is kept. Repeated rows get equal verdicts;
a null doc_id is never trusted; other columns are passed on by kept_documents() whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, as_rows, by_merge, join_hot, maybe_among, small, stash
from .wordhash import mix

ORDER = 5
KEEP = 0.99
REACH = 2.0
FOLDS = 5
WEIGHT = 60
MOST = 2_000_000
KNOWN = 200_000
HELD = 30_000
LETTERS = 200
_TINY = 1e-7
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of `docs` (lang, text), as they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    seen.setdefault(lang, Counter()).update(_words(text))
                if sum(map(len, seen.values())) > KNOWN:
                    yield from rows()
        yield from rows()

    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _chunks(word: str) -> list[str]:
    """A word of over LETTERS letters counts as several, so that no row holds more."""
    return [f"^{word[i : i + LETTERS]}$" for i in range(0, len(word), LETTERS)]


def raw_grams(words: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): grams of full order, and shorter ones from a word's beginning. Counted in tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams: Counter = Counter()
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for w in _chunks(word):
                    for i in range(1, len(w)):
                        grams[lang, w[max(0, i - order + 1) : i + 1]] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in grams], pa.string()), pa.array([k[1] for k in grams], pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp, logb): the log probability of a seen gram's last letter; what backing off from it, as a context,
    costs. A null logp or logb: not seen as such. The empty gram holds the log probability of an unseen letter."""
    raw = stash(raw_grams(word_counts(trusted.filter("text is not null and lang is not null")), order), "kn-raw")
    # Every other gram ends a longer one, and counts the letters before it there; those from a word's beginning have none.
    ends = raw.filter("length(gram) > 1").select("lang", F.explode(F.expr("transform(sequence(1, length(gram) - 1), i -> substring(gram, i))")).alias("longer"))
    inner = ends.groupBy("lang", F.expr("substring(longer, 2)").alias("gram")).agg(F.count_distinct(F.expr("left(longer, 1)")).alias("a"))
    levels = stash(raw.select("lang", "gram", F.col("n").alias("a")).unionByName(inner).withColumn("size", F.length("gram")), "kn-levels")
    of = levels.groupBy("lang", "size").agg(*[F.count(F.when(F.col("a") == i, 1)).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)])
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    discount = lambda i: F.when((F.col(f"c{i}") > 0) & (F.col("c1") > 0), F.greatest(F.lit(0.1 * i), F.least(F.lit(i - 0.1), i - (i + 1) * y * F.col(f"c{i + 1}") / F.col(f"c{i}")))).otherwise(0.5 * i)
    of = of.select("lang", "size", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    take = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = levels.join(small(of), ["lang", "size"]).withColumn("take", F.least(take, F.col("a") - 0.05)).withColumn("h", F.expr("left(gram, size - 1)"))
    context = own.groupBy("lang", "h").agg((F.sum("take") / F.sum("a")).alias("gamma"), F.sum("a").alias("total"))
    terms = own.join(by_merge(context), ["lang", "h"]).select("lang", "gram", "size", "h", ((F.col("a") - F.col("take")) / F.col("total")).alias("own"), "gamma")
    terms = stash(terms, "kn-terms")
    # Below single letters lies a uniform share for letters that were never seen.
    below = terms.filter("size = 1").select("lang", "gram", (F.col("own") + F.col("gamma") * _TINY).alias("p"))
    made = terms.select("lang", F.col("h").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("gamma").alias("logb"))
    for n in range(1, order + 1):
        if n > 1:
            low = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
            level = terms.filter(F.col("size") == n).withColumn("suffix", F.expr("substring(gram, 2)")).join(by_merge(low), ["lang", "suffix"], "left")
            below = stash(level.select("lang", "gram", (F.col("own") + F.col("gamma") * F.coalesce("low", F.lit(_TINY))).alias("p")), "kn-p")
        made = made.unionByName(below.select("lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logb")))
    return stash(made.groupBy("lang", "gram").agg(F.max("logp").alias("logp"), F.max("logb").alias("logb")), "kn-model")


def _codes(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _longer(shorter: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rolling hashes of the n letters that end at each place, from those of n - 1."""
    out = codes.copy()
    out[1:] += shorter[:-1] * _BASE
    return out


_ENTRY = np.dtype([("key", "<u8"), ("logp", "<f8"), ("logb", "<f8")])


def _keys(grams: list[str]) -> np.ndarray:
    """64-bit hashes of whole grams, as scores() makes them."""
    sizes = np.array([len(g) for g in grams])
    codes, keys = _codes(grams), np.zeros(len(grams), np.uint64)
    ends, rolling = np.cumsum(sizes) - 1, np.zeros(len(codes), np.uint64)
    for n in range(1, int(sizes.max(initial=0)) + 1):
        rolling = _longer(rolling, codes)
        keys[sizes == n] = rolling[ends[sizes == n]]
    return mix(keys + sizes.astype(np.uint64))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, out = np.array(batch.column(0).to_pylist(), object), []
        made = np.zeros(batch.num_rows, _ENTRY)
        made["key"] = _keys(batch.column(1).to_pylist()) if batch.num_rows else 0
        made["logp"], made["logb"] = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        out = [(lang, made[langs == lang].tobytes()) for lang in sorted(set(langs))]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["lang", "blob"])


class Model:
    """A whole model in memory: grams as sorted 64-bit hashes with their log probabilities and costs of backing off.

    The driver gets it as packed entries of 24 bytes, never as rows.
    """

    def __init__(self, model: DataFrame):
        blobs: dict[str, list[bytes]] = {}
        for row in model.select("lang", "gram", "logp", "logb").mapInArrow(_entries, "lang string, blob binary").toLocalIterator():
            blobs.setdefault(row.lang, []).append(bytes(row.blob))
        self.langs = sorted(blobs)
        self.tables = {}
        for lang in self.langs:
            own = np.sort(np.frombuffer(b"".join(blobs.pop(lang)), _ENTRY), order="key")
            self.tables[lang] = tuple(np.ascontiguousarray(own[c]) for c in ("key", "logp", "logb"))

    def scores(self, lang: str, words: list[str], order: int = ORDER) -> np.ndarray:
        """(words, 2): the log probability of each word, and its letters with the end."""
        keys, logp, logb = self.tables[lang]
        chunks, owners = [], []
        for i, w in enumerate(words):
            for c in _chunks(w):
                chunks.append(c)
                owners.append(i)
        sizes = np.array([len(c) for c in chunks])
        codes = _codes(chunks)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rolling = [np.zeros(len(codes), np.uint64)]
        for _ in range(order):
            rolling.append(_longer(rolling[-1], codes))
        total, done = np.zeros(len(codes)), place == 0

        def look(values: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
            key = mix(hashes + np.uint64(n))
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, values[at], np.nan)

        for n in range(order, 0, -1):
            cells = np.flatnonzero(~done & (place >= n - 1))
            p = look(logp, rolling[n][cells], n)
            seen = ~np.isnan(p)
            total[cells[seen]] += p[seen]
            done[cells[seen]] = True
            rest = cells[~seen]
            total[rest] += np.nan_to_num(look(logb, rolling[n - 1][rest - 1] if n > 1 else np.zeros(len(rest), np.uint64), n - 1))
        total[~done] += math.log(_TINY)
        owner = np.repeat(np.array(owners), sizes)
        real = place > 0
        return np.stack([np.bincount(owner[real], total[real], len(words)), np.bincount(owner[real], minlength=len(words))], axis=1)


_SCORE = "model string, logp double, letters long"


def _broadcast_scores(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """doc_id, text_key and lang of every document with its model's verdict on it, where its row lies: nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(Model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        known: dict[str, dict[str, int]] = {lang: {} for lang in own.langs}
        tables: dict[str, np.ndarray] = {}
        for whole in batches:
            best: list[tuple] = []
            for at in range(0, whole.num_rows, 128):
                langs, texts = (whole.column(i).slice(at, 128).to_pylist() for i in (2, 3))
                words = [_words(t) for t in texts]
                tried = [[lang] if lang in known else own.langs for lang in langs]
                for lang in own.langs:
                    wanted = {w for own_words, t in zip(words, tried, strict=True) if lang in t for w in own_words}
                    new = [w for w in wanted if w not in known[lang]]
                    if len(known[lang]) + len(new) > HELD:
                        known[lang].clear()
                        new = list(wanted)
                        tables.pop(lang, None)
                    if new:
                        old = tables.get(lang, np.zeros((0, 2)))
                        known[lang].update(zip(new, range(len(old), len(old) + len(new)), strict=True))
                        tables[lang] = np.concatenate((old, own.scores(lang, new, order)))
                for own_words, langs_tried in zip(words, tried, strict=True):
                    made = []
                    for lang in langs_tried if own_words else []:
                        logp, n = tables[lang][list(map(known[lang].__getitem__, own_words))].sum(axis=0)
                        made.append((logp / n, lang, logp, int(n)))
                    best.append(max(made)[1:] if made else (None, None, None))
            kinds = (pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(whole.column(i) for i in range(3)), *(pa.array([b[i] for b in best], t) for i, t in enumerate(kinds))], ["doc_id", "text_key", "lang", "model", "logp", "letters"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_key", "lang", "text").mapInArrow(run, f"doc_id {kind}, text_key long, lang string, {_SCORE}")


def _sharded_scores(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """The same by joins: distinct words to the model's shards, then their scores to the words of distinct texts, and these
    to all their copies."""
    every, docs = docs, docs.select(F.col("text_key").alias("row"), "lang", "text").dropDuplicates(["row"])
    langs = model.select("lang").distinct().withColumnRenamed("lang", "model")
    parted = F.flatten(F.transform(F.filter(F.split("text", WORD_BREAK), lambda w: w != ""), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / LETTERS).cast("int")), lambda i: F.substring(w, i * LETTERS + 1, F.lit(LETTERS)))))
    words = docs.select("row", "lang", F.explode(parted).alias("word")).groupBy("row", "lang", "word").agg(F.count("*").alias("n"))
    known = docs.select("row", "lang").join(langs, F.col("lang") == F.col("model"), "left_semi").select("row", F.lit(True).alias("known"))
    words = words.join(known, "row", "left")
    pairs = words.filter("known").withColumn("model", F.col("lang")).unionByName(words.filter("known is null").crossJoin(F.broadcast(langs)))
    marked = pairs.select("model", "word").distinct().withColumn("w", F.concat(F.lit("^"), "word", F.lit("$")))
    cells = marked.select("model", "word", "w", F.explode(F.expr("sequence(2, length(w))")).alias("end"))
    grams = cells.select("model", "word", "end", F.explode(F.expr(f"filter(sequence(1, {order}), n -> n <= end)")).alias("n"), "w")
    grams = grams.withColumn("gram", F.expr("substring(w, end - n + 1, n)")).withColumn("h", F.expr("substring(w, end - n + 1, n - 1)")).drop("w")
    m = model.select(F.col("lang").alias("model"), "gram", "logp").filter("logp is not null")
    b = model.select(F.col("lang").alias("model"), F.col("gram").alias("h"), "logb").filter("logb is not null")
    found = grams.join(m, ["model", "gram"], "left").join(b, ["model", "h"], "left")
    hit = F.coalesce(F.max(F.when(F.col("logp").isNotNull(), F.col("n"))).over(_over(["model", "word", "end"])), F.lit(0))
    found = found.withColumn("hit", hit).groupBy("model", "word", "end").agg(
        F.coalesce(F.sum(F.when(F.col("n") == F.col("hit"), F.col("logp"))), F.lit(math.log(_TINY))).alias("p"),
        F.coalesce(F.sum(F.when(F.col("n") > F.col("hit"), F.col("logb"))), F.lit(0.0)).alias("back"))
    scored = found.groupBy("model", "word").agg(F.sum(F.col("p") + F.col("back")).alias("score"), F.count("*").alias("size"))
    scores = pairs.join(scored, ["model", "word"]).groupBy("row", "model").agg(F.sum(F.col("score") * F.col("n")).alias("logp"), F.sum(F.col("size") * F.col("n")).alias("letters"))
    best = scores.groupBy("row").agg(F.max_by(F.struct("model", "logp", "letters"), F.struct(F.col("logp") / F.col("letters"), F.col("model"))).alias("b")).select(F.col("row").alias("text_key"), "b.*")
    return join_hot(every.select("doc_id", "text_key", "lang"), stash(best, "kn-best"), "text_key")


def _over(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def document_scores(docs: DataFrame, model: DataFrame, order: int = ORDER, most: int = MOST) -> DataFrame:
    """doc_id, text_key and lang of `docs` (and text) with model, logp and letters: null without a word; the best model
    where lang has none."""
    return _broadcast_scores(docs, model, order) if model.count() <= most else _sharded_scores(docs, model, order)


def _key(text: str, lang: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(lang).cast("string"), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _key("text", "lang").alias("text_key"), F.col("lang").cast("string").alias("lang"), "text")


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, keep: float = KEEP, most: int = MOST) -> DataFrame:
    """(doc_id, text_key, lang, perplexity, threshold, kept). Trusted documents are those labelled quality 1 and toxic 0."""
    good = stash(labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct(), "kn-good")
    keyed = _keyed(docs)
    held_out = F.pmod("text_key", F.lit(FOLDS)) == 0
    # Only texts that may be trusted are shuffled.
    trusted = maybe_among(keyed.filter(~held_out), F.col("doc_id"), good).filter("maybe").join(good, "doc_id", "left_semi")
    model = train(trusted, order)
    if not model.limit(1).count():
        fine = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        return keyed.select("doc_id", "text_key", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), fine.alias("kept"))
    scores = document_scores(keyed, model, order, most)
    slim = stash(scores.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left"), "kn-scores")
    mean = slim.filter("trusted and letters > 0").groupBy("model").agg((F.sum("logp") / F.sum("letters")).alias("mean"))
    slim = slim.join(small(mean), "model", "left")
    slim = slim.withColumn("perplexity", F.exp(-(F.col("logp") + WEIGHT * F.col("mean")) / (F.col("letters") + WEIGHT)))
    at = F.array(F.lit(0.5), F.lit(keep))
    unseen = F.percentile_approx(F.when(held_out, F.col("perplexity")), at, 10_000)
    limit = slim.filter("trusted and letters > 0").groupBy("model").agg(F.coalesce(unseen, F.percentile_approx("perplexity", at, 10_000)).alias("q"))
    limit = limit.select("model", (F.col("q")[0] * (F.col("q")[1] / F.col("q")[0]) ** REACH).alias("threshold"))
    judged = slim.join(small(limit), "model", "left")
    return judged.select("doc_id", "text_key", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that judge() keeps, with their columns. Only rows that may be among the rejected are shuffled."""
    dropped = stash(judge(docs, labels, **options).filter("not kept").select("doc_id", "text_key").distinct(), "kn-dropped")
    own = as_rows(docs).select("row", F.col("row.doc_id").alias("doc_id"), _key("row.text", "row.lang").alias("text_key"))
    flagged = maybe_among(own, F.col("text_key"), dropped.select("text_key"))
    d, v = flagged.filter("maybe").alias("d"), dropped.alias("v")
    same = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("d.text_key") == F.col("v.text_key"))
    return flagged.filter("not maybe").select("row.*").unionByName(d.join(v, same, "left_anti").select("row.*"))
