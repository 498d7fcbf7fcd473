"""Functions on text: matches with their offsets, joins of spans, hashes, budgets. Patterns run inside the JVM; of the matches
only lengths go to Python, a batch of texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, word lists and stop words that results depend on. (?U): Unicode classes and word borders.
# A sentence begins behind the end of another, so no other place is tried: long lines without an end stay linear.
SENTENCE = r"(?d)(?<![^.!?\n])[^.!?\n]++(?:[.!?]|$)"
CLAIM = r"[^\n.!?]++[.!?]*+"
CLASSES = {
    "temporal.date": r"(?U)\b\d{4}[-/]\d{2}[-/]\d{2}\b",
    "identifier.version": r"(?U)(?<!\w)v?\d+\.\d+(?:\.\d+)+(?:[-+][0-9A-Za-z.-]+)?\b",
    "temporal.timestamp": r"(?U)\b\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\b",
    "numeric.number": r"(?U)(?<![\w.])[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w.])",
    "numeric.currency": r"(?Ui)(?:[$€£₹]\s*[+-]?\d+(?:\.\d+)?|[+-]?\d+(?:\.\d+)?\s+(?:USD|EUR|GBP|INR|JPY|CAD|AUD)\b)",
    "numeric.percentage": r"(?U)(?<![\w.])[+-]?\d+(?:\.\d+)?\s*%",
    "numeric.unit": r"(?Ui)(?<![\w.])[+-]?(?:\d+(?:\.\d+)?|\.\d+)\s*(?:ms|milliseconds?|seconds?|minutes?|hours?|days?|kg|g|mg|mb|gb|kb|bytes?|px|meters?|m|cm|mm|hz|khz|%)\b",
    "identifier.uuid": r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b",
    "identifier.hex": r"(?U)\b[0-9a-fA-F]{32,64}\b",
    "identifier.ticket": r"(?Ui)\b(?:CVE-\d{4}-\d+|(?:ID|REQ|TICKET|TRACE|SPAN|SESSION)[-_][A-Za-z0-9._-]+)\b",
    "entity.named": r"(?U)\b[A-Z][a-z][A-Za-z0-9_-]*\b(?:\s+\b[A-Z][a-z][A-Za-z0-9_-]*\b)*",
}
# A number or hexadecimal identity that starts within one of these is part of it.
HOLDERS, HELD = ("temporal.date", "identifier.version"), ("numeric.number", "identifier.hex")
STOP_WORDS = ("The", "A", "An", "This", "That", "Use", "Limit", "Error", "Warning", "Info")
MARKERS = {
    "logic.negation": ("not", "no", "never", "without", "cannot", "can't", "didn't", "doesn't", "isn't", "won't", "shouldn't", "mustn't"),
    "logic.quantifier": ("all", "any", "some", "none", "only", "each", "every", r"at\s+least", r"at\s+most", "exactly"),
    "policy.permission": ("may", "can", "allowed", "permitted", "authori[sz]ed", "shall"),
    "policy.prohibition": (r"must\s+not", r"do\s+not", "don't", "prohibited", "forbidden", "cannot", "can't"),
    "logic.condition": ("if", "when", r"provided\s+that", r"only\s+if", r"as\s+long\s+as"),
    "logic.exception": ("unless", "except", r"other\s+than", "excluding"),
    "temporal.correction": ("actually", "instead", "correction", "corrected", "supersedes", "updated?", "update"),
    "dialogue.commitment": ("will", "shall", "promise", "promised", "agree(?:d)?", "commit(?:ted)?", "must"),
}
SIGN = "\uffff"
ROLE = r"(?im)^(system|developer|user|assistant|tool)\s*:"


def marker(name: str) -> str:
    return rf"(?Ui)\b(?:{'|'.join(MARKERS[name])})\b"


def parted(text: Column, pattern: str) -> Column:
    """An array of what lies before each match of `pattern` and the match, in turn, then the tail. One pass puts a sign around
    the matches that cuts the text; one that has the sign already is cut by the pattern. A match is never empty."""
    one = F.split(F.regexp_replace(text, f"({pattern})", f"{SIGN}$1{SIGN}"), SIGN, -1)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("lexeme"))
    two = F.array_compact(F.flatten(F.transform(pairs, lambda m: F.array(m["gap"], m["lexeme"]))))
    return F.when(F.contains(text, F.lit(SIGN)), two).otherwise(one)


def matches(text: Column, pattern: str) -> Column:
    """An array of (gap, lexeme): what lies before each match of `pattern`, and the match; one more for the tail."""
    zipped = F.transform(F.array(parted(text, pattern)), lambda p: F.arrays_zip(F.filter(p, lambda x, i: i % 2 == 0).alias("gap"), F.filter(p, lambda x, i: i % 2 == 1).alias("lexeme")))
    return F.get(zipped, F.lit(0))


def running(lists: pa.Array) -> pa.Array:
    """Running sums within each list of each row's list of lists."""
    inner = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(inner.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    within = sums[1:] - np.repeat(sums[ends[:-1]], np.diff(ends))
    outer = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(within)))


def match_arrays(df: DataFrame, keys: list[str], text: str, patterns: dict[str, str], places: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, found): for each text that isn't null, per pattern in order an array of (class, start, end, lexeme). `places` may make
    the running sums of lengths in its own way; a match whose sum is null there is left out."""
    names = [f"_m{i}" for i in range(len(patterns))]
    rows = df.filter(F.col(text).isNotNull()).select(*keys, *[parted(F.col(text), p).alias(n) for n, p in zip(names, patterns.values(), strict=True)])
    places = places or F.arrow_udf(lambda lists: running(lists), "array<array<bigint>>")
    rows = rows.withColumn("_ends", places(F.array(*[F.transform(n, F.length) for n in names])))

    def listed(i: int, name: str, kind: str) -> Column:
        made = F.transform(F.arrays_zip(F.get("_ends", F.lit(i)).alias("end"), F.col(name).alias("lexeme")), lambda m: F.struct(F.lit(kind).alias("class"), (m["end"] - F.length(m["lexeme"])).alias("start"), m["end"].alias("end"), m["lexeme"].alias("lexeme")))
        return F.filter(made, lambda m, j: (j % 2 == 1) & m["end"].isNotNull())

    return rows.select(*keys, F.array(*[listed(i, n, k) for i, (n, k) in enumerate(zip(names, patterns, strict=True))]).alias("found"))


def match_rows(df: DataFrame, keys: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """(keys, class, start, end, lexeme): the matches of all patterns in order, by code points, end exclusive.

    A match starts behind the gaps and matches before it: running sums over the matches of a text, so that a text of any number
    of matches costs their number. A text's matches are made where it lies: nothing is shuffled.
    """
    return match_arrays(df, keys, text, patterns).select(*keys, F.explode(F.flatten("found")).alias("m")).select(*keys, "m.*")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 1024, contains: bool = False) -> DataFrame:
    """Rows of left (l) and right (r) of equal keys whose [start, end) overlap, or where left contains right.

    Both sides go to the cells of `width` that they touch; a pair meets in several cells but counts in the first common one.
    """
    cells = lambda df: df.withColumn("_cell", F.explode(F.expr(f"sequence(start div {width}, greatest(start, end - 1) div {width})")))
    l, r = cells(left).alias("l"), cells(right).alias("r")
    same = F.col("l._cell") == F.col("r._cell")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    meet = F.expr("l.start <= r.start and r.end <= l.end") if contains else F.expr("l.start < r.end and r.start < l.end")
    return l.join(r, same & meet & (F.col("l._cell") == F.expr(f"greatest(l.start, r.start) div {width}")))


def normalized(text: Column) -> Column:
    """Without a byte order mark, with every line end as one line feed."""
    return F.regexp_replace(F.regexp_replace(text, "^\\x{FEFF}", ""), r"\r\n?", "\n")


def domain_hash(domain: str, payload: Column) -> Column:
    """sha256 over domain, a zero byte and the payload, so equal payloads of two domains differ."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.unhex(F.lit("00")), F.encode(payload, "UTF-8")), 256))


def terms(text: Column) -> Column:
    """Lower-case terms of letters, digits and the signs that identifiers hold."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_./:@%+-]+)"), F.lit(1))


def ratio(part: Column, whole: Column) -> Column:
    """With six digits, ties to even; null without a whole."""
    return F.when(whole != 0, F.bround((part / whole).cast("decimal(38,20)"), 6).cast("double"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 0) without trials."""
    p, zz = successes / n, z * z
    middle, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    bound = lambda x: F.when(n > 0, x / (1 + zz / n)).otherwise(0.0)
    return bound(middle - spread), bound(middle + spread)
