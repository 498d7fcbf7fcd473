"""Quality rules as weak supervision. DataFrame functions only.

Every rule looks at evidence of its own and votes good (1), bad (0) or abstains (null). Documents are good, or bad in one of
a few ways (symbols, shouting, repetition, fragments), and the rules of a way bear each other out. Expectation-maximisation
(a Dawid-Skene model with a class per way) estimates, from all documents and without labels, how common each class is and
how often each rule's votes are right on it. So a bad vote weighs as much as its rule proves to be worth: little where good
documents get it too, and enough to outweigh any number of harmless good votes where it comes with others of its way. The
model needs only how often each combination of votes occurs: at most 3 ** rules rows, so that table, and nothing else, comes
to the driver; the posterior of a document then is a sum of constants per class and vote. A document is kept when its
posterior of being good reaches `least` and no hard rule fails.

Null text counts as empty; an empty table keeps the starting values. Equal texts get equal verdicts, repeated rows stay
repeated, a null doc_id is kept as it is, and other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, words_of

LEAST = 0.5
WINDOW = 5


def text_features(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document, each over the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    base = docs.select(F.col(doc_col).alias("doc_id"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), (F.length("text") - found(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        found(r"[#*$%&|<>]").alias("n_symbols"), found(r"[#*$%&|<>]+").alias("n_symbol_runs"), found(r"[A-Z]").alias("n_upper"), found(r"[!]").alias("n_bangs"), found(r"[.?!](?=\s|$)").alias("n_stops"),
        lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    base = base.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    at = lambda i, j: F.get(F.col("h"), i + j)
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)])))
    base = base.withColumn("w", windows).drop("h")
    # Most texts repeat no window; only the others sort theirs.
    base = base.withColumn("s", F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("w")
    twice = F.filter("s", lambda x, k: (x["h"] == F.get(F.col("s"), k - 1)["h"]) | (x["h"] == F.get(F.col("s"), k + 1)["h"]))
    base = base.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    # A repeated window covers its five words, or those up to the next repeated window.
    cover = F.aggregate(F.transform("p", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return base.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("p")


# The ways of being bad, and the rules that speak for each.
WAYS = {"symbols": ("symbol_chars", "symbol_places"), "shouting": ("capitals", "bangs"), "repetition": ("lines", "windows"), "fragments": ("word_length", "sentences", "size")}
RULES = [r for own in WAYS.values() for r in own]


def rules() -> dict[str, Column]:
    """Votes by name, over text_features(); each on evidence of its own."""
    n = lambda c: F.col(c).cast("double")
    words, chars = F.greatest(n("n_words"), F.lit(1.0)), F.greatest(n("word_chars"), F.lit(1.0))
    mean, capitals, bangs = chars / words, n("n_upper") / chars, n("n_bangs") / words
    symbols, places = n("n_symbols") / chars, n("n_symbol_runs") / words
    repeats, stops, lines = n("n_repeat_words") / words, n("n_stops") / words, n("n_dup_lines") / F.greatest(n("n_lines"), F.lit(1.0))
    some = F.col("n_words") >= 5
    vote = lambda good, bad, if_: F.when(if_ & bad, 0).when(if_ & good, 1)
    return {
        "symbol_chars": vote(symbols <= 0.02, symbols >= 0.05, some),
        "symbol_places": vote(places <= 0.05, places >= 0.12, some),
        "capitals": vote(capitals <= 0.3, capitals >= 0.4, some),
        "bangs": vote(bangs <= 0.1, bangs >= 0.3, some),
        "lines": vote(lines == 0, lines >= 0.3, F.col("n_lines") >= 3),
        "windows": vote(repeats <= 0.02, repeats > 0.2, F.col("n_words") >= 2 * WINDOW),
        "word_length": vote((mean >= 3) & (mean <= 12), (mean < 2) | (mean > 16), some),
        "sentences": vote((stops >= 0.01) & (stops <= 0.4), stops < 0.002, F.col("n_words") >= 20),
        "size": vote(F.col("n_words") >= 20, F.col("n_words") < 5, F.lit(True)),
    }


# Where the estimate starts: how common good documents are, and how often a rule's vote is good on good documents, on those
# that are bad in its way, and on those that are bad in another.
START = (0.8, 0.98, 0.3, 0.9)
SMOOTH = 10.0
Votes = tuple[int | None, ...]
Fitted = tuple[list[float], list[list[float]]]


def start(ways: list[tuple[int, ...]], n_rules: int) -> Fitted:
    """(how common each class is, good first; per class, how often each rule's vote is good)."""
    common = [START[0], *[(1 - START[0]) / len(ways)] * len(ways)]
    return common, [[START[1]] * n_rules, *[[START[2] if i in own else START[3] for i in range(n_rules)] for own in ways]]


def shares(fitted: Fitted, votes: Votes) -> list[float]:
    """The posterior of each class."""
    common, good = fitted
    logs = [math.log(p) + sum(math.log(g if v else 1 - g) for g, v in zip(row, votes, strict=True) if v is not None) for p, row in zip(common, good, strict=True)]
    most = max(logs)
    made = [math.exp(x - most) for x in logs]
    return [m / sum(made) for m in made]


def fit(patterns: list[tuple[Votes, float]], ways: list[tuple[int, ...]], n_rules: int, rounds: int = 500) -> Fitted:
    """Expectation-maximisation over (votes, how often). Counts are smoothed towards the start by SMOOTH votes. A rule may
    tell nothing of its way (be as often good there as on good documents), but it is never turned round."""
    first, now = start(ways, n_rules), start(ways, n_rules)
    total = sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        mass = [0.0] * (len(ways) + 1)
        said, voted = [[0.0] * n_rules for _ in mass], [[0.0] * n_rules for _ in mass]
        for votes, count in patterns:
            for c, share in enumerate(shares(now, votes)):
                mass[c] += count * share
                for i, v in enumerate(votes):
                    if v is not None:
                        said[c][i] += count * share * v
                        voted[c][i] += count * share
        before = now
        common = [(m + SMOOTH * f) / (total + SMOOTH) for m, f in zip(mass, first[0], strict=True)]
        good = [[(s + SMOOTH * f) / (v + SMOOTH) for s, v, f in zip(*rows, strict=True)] for rows in zip(said, voted, first[1], strict=True)]
        good = [[min(0.9999, max(0.0001, g)) for g in row] for row in good]
        for c, own in enumerate(ways):
            for i in own:
                good[c + 1][i] = min(good[c + 1][i], good[0][i])
        now = common, good
        if max(abs(x - y) for a, b in zip([before[0], *before[1]], [common, *good], strict=True) for x, y in zip(a, b, strict=True)) < 1e-7:
            break
    return now


def judge(docs: DataFrame, least: float = LEAST, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_features() with base_failed, n_votes, posterior (of being good) and kept."""
    features = stash(text_features(docs, doc_col, text_col), "rule-features")
    votes = rules()
    voted = features.select("*", *[v.alias(f"v_{k}") for k, v in votes.items()])
    names = [f"v_{k}" for k in votes]
    patterns = sorted(((tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()), key=str)
    place = {n: i for i, n in enumerate(votes)}
    common, good = fit(patterns, [tuple(place[r] for r in own) for own in WAYS.values()], len(names))
    logs = []
    for p, row in zip(common, good, strict=True):
        gain = [F.when(F.col(n) == 1, F.lit(math.log(g))).when(F.col(n) == 0, F.lit(math.log(1 - g))).otherwise(F.lit(0.0)) for n, g in zip(names, row, strict=True)]
        logs.append(sum(gain, F.lit(math.log(p))))
    of_good = 1 / sum((F.exp(x - logs[0]) for x in logs[1:]), F.lit(1.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    made = voted.withColumn("base_failed", failed).withColumn("posterior", of_good)
    n_votes = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return made.withColumn("n_votes", n_votes).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop(*names)
