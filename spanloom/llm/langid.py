"""Language identification by n-gram filters that hold a bit per language.

Training counts the letter n-grams of words (2 to 4 letters, word ends included, and whole words) per language. A gram
that makes up at least 1 / RARE of a language's grams, and is not rarer there by a factor OTHERS than in the language
where it is commonest, enters that language's filter: so a language has at most RARE grams, whatever the corpus. All
filters are one Bloom filter, bit-sliced: a slot holds a mask with one bit per language, and the AND of a gram's slots
gives all languages that contain it. A document's hits per language, corrected for the share of false positives that
the language's filled slots give, decide; ties go to the first language by name.

Documents without a letter (Unicode category L), and null, are `und` with score 0. Training skips null text and null
language. With nothing to learn from, every document is `und`. Repeated rows get equal predictions; other columns are passed
on by predict() under their names. Up to 63 languages a slice of masks; more take more slices.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash
from .wordhash import mix

RARE = 100_000
OTHERS = 6.0
SLOT_BITS = 20
HASHES = 3
LETTERS = re.compile(r"[^\W\d_]+")
KNOWN = 200_000
CHUNK = 20_000
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_in(text: str) -> list[str]:
    """Lower-case runs of letters. Numerals such as ½ or Ⅷ look like letters to the pattern, so those without any go."""
    words = LETTERS.findall(text.lower())
    return words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of lower-case words and of the words as such, and the word that each belongs to."""
    marked = [f"^{w}$" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner, starts = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - starts[owner]
    rolling, grams, owners = codes, [], []
    for n in (2, 3, 4):
        longer = codes.copy()
        longer[1:] += rolling[:-1] * _BASE
        rolling, whole = longer, place >= n - 1
        grams.append(longer[whole] + np.uint64(n))
        owners.append(owner[whole])
    if words:
        powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
        grams.append(np.add.reduceat(codes * powers[place], starts))
        owners.append(np.arange(len(words)))
    return mix(np.concatenate(grams)), np.concatenate(owners)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of `labelled` (text, lang); words are counted first, then their grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in words.items():
                own, times, parts = list(counts), np.array(list(counts.values()), np.int64), []
                for at in range(0, len(own), CHUNK):
                    made, owner = grams_of(own[at : at + CHUNK])
                    parts.append(_summed(made, times[at:][owner]))
                if parts:
                    grams, n = _summed(*map(np.concatenate, zip(*parts, strict=True)))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            words.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(words_in(text))
                if sum(map(len, words.values())) > KNOWN:
                    yield from rows()
        yield from rows()

    given = labelled.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    return given.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """The languages, and the masks of every slot: an array of (slices, slots)."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks = langs, masks
        self.false = [float(((masks[i // 63] >> np.uint64(i % 63)) & np.uint64(1)).mean()) ** HASHES for i in range(len(langs))]

    def hits(self, words: list[str]) -> np.ndarray:
        """(words, languages + 1): how many grams of a word each language has, and how many there are."""
        out = np.zeros((len(words), len(self.langs) + 1), np.int64)
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            flat, owner = grams_of(part)
            found = np.full((self.masks.shape[0], len(flat)), np.uint64(2**64 - 1))
            for j in range(HASHES):
                found &= self.masks[:, (flat >> np.uint64(SLOT_BITS * j)) & np.uint64((1 << SLOT_BITS) - 1)]
            for i in range(len(self.langs)):
                has = (found[i // 63] >> np.uint64(i % 63)) & np.uint64(1)
                out[at : at + len(part), i] = np.bincount(owner[has > 0], minlength=len(part))
            out[at : at + len(part), -1] = np.bincount(owner, minlength=len(part))
        return out


def train(labelled: DataFrame) -> Filters:
    """Only slots come to the driver: 1 << SLOT_BITS at most for each 63 languages."""
    counts = stash(gram_counts(labelled), "lang-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r.lang for r in totals.select("lang").collect())
    masks = np.zeros((max(1, -(-len(langs) // 63)), 1 << SLOT_BITS), np.uint64)
    if langs:
        shares = counts.join(small(totals), "lang").withColumn("share", F.col("n") / F.col("total")).filter(f"share >= {1 / RARE}")
        most = shares.groupBy("gram").agg(F.max("share").alias("most"))
        table = counts.sparkSession.createDataFrame([(name, i) for i, name in enumerate(langs)], "lang string, place int")
        kept = shares.join(most, "gram").filter(f"share * {OTHERS} >= most").join(small(table), "lang")
        slots = F.array(*[F.shiftrightunsigned("gram", SLOT_BITS * j).bitwiseAND((1 << SLOT_BITS) - 1).cast("int") for j in range(HASHES)])
        rows = kept.select(F.explode(slots).alias("slot"), F.expr("place div 63").alias("slice"), F.expr("shiftleft(1L, place % 63)").alias("mask"))
        made = rows.groupBy("slice", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
        masks[made["slice"].to_numpy(), made["slot"].to_numpy()] = made["mask"].to_numpy().view(np.uint64)
    return Filters(langs, masks)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, text, lang_pred, score) columns appended to doc_id: score is the winner's share of all corrected hits."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    passed = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[str, int] = {}
        rows, used = np.zeros((0, len(own.langs) + 1), np.int64), 0
        for whole in batches:
            langs, scores = [], []
            for at in range(0, whole.num_rows, 512):
                texts = [words_in(t or "") for t in whole.column("text").slice(at, 512).to_pylist()]
                new = list({w for words in texts for w in words}.difference(known))
                if len(known) + len(new) > KNOWN:
                    known.clear()
                    new, used = list({w for words in texts for w in words}), 0
                if new:
                    found = own.hits(new)
                    if used + len(new) > len(rows):
                        rows = np.concatenate((rows[:used], found, np.zeros((max(len(found), used), rows.shape[1]), np.int64)))
                    else:
                        rows[used : used + len(new)] = found
                    known.update(zip(new, range(used, used + len(new)), strict=True))
                    used += len(new)
                for words in texts:
                    if not words or not own.langs:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = rows[list(map(known.__getitem__, words))].sum(axis=0)
                    real = [max(0.0, (h - total[-1] * p) / (1 - p)) if p < 1 else 0.0 for h, p in zip(total[:-1].tolist(), own.false, strict=True)]
                    best = max(range(len(real)), key=lambda i: (real[i], -i))
                    langs.append(own.langs[best])
                    scores.append(real[best] / sum(real) if real[best] else 0.0)
            yield pa.RecordBatch.from_arrays([*(whole.column(c) for c in passed), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*passed, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.select(*passed, "text").mapInArrow(run, f"{kinds}, lang_pred string, score double")
