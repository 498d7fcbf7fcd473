"""The recovery loop: select, verify, plan, and again with more budget or restored spans, until all emit or fall back.

Requests are (source_id, budget, maximum); candidates are those of rendered.py; `required` (source_id, span_id, first, last)
names what the text must hold. An attempt selects within the budget and looks which spans no chosen candidate covers. What is
valid is emitted. What doesn't fit gets more budget; missing spans make the candidates that overlap them mandatory; what can
do neither, and whatever fails the last attempt, falls back to the whole source. A request is one row with its candidates and
spans, grouped once; every attempt is one written table, and the next one reads only those rows that go on, without a shuffle.
Each attempt's hash takes in the one before, so the history is a chain.

Sources without candidates have an empty text, which is valid if nothing is required of them. A request appears once a source.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import domain_hash
from ..sources.shared import written
from .rendered import order_candidates, ranked_entry, settled, share_of, stays

MARGIN, SPAN_LIMIT, ATTEMPTS = 8, 8, 5
EMIT, EXPAND, RESTORE, FALLBACK = "emit", "expand_budget", "restore_spans", "full_fallback"
RESTORABLE = ("MANDATORY_EVIDENCE_OMITTED", "OBLIGATION_NOT_REPRESENTED", "RELATION_NOT_REPRESENTED")
TOO_LONG = ("BUDGET_MISMATCH", "TOKEN_BUDGET_EXCEEDED")
HARD = ("UNKNOWN_TOKENIZER", "EXTRACTION_FAILURE", "VERIFIER_EXECUTION_FAILURE", "STALE_SOURCE_MAP", "SOURCE_MAP_VALIDATION_FAILED", "INVALID_SOURCE_MAP", "HASH_MISMATCH")


def planned(codes: Column, incompressible: Column, spans: Column, budget: Column, floor: Column, maximum: Column, allowed: tuple[str, ...] = (EMIT, EXPAND, RESTORE, FALLBACK), limit: int = SPAN_LIMIT) -> Column:
    """(action, proposed budget) for the codes of the failed checks, the number of spans that they name, and the budgets."""
    among = lambda names: F.arrays_overlap(codes, F.array(*map(F.lit, names)))
    more = F.least(maximum, F.greatest(budget, floor) + MARGIN)
    step = lambda action, proposed: F.struct(F.lit(action).alias("action"), proposed.cast("long").alias("proposed"))
    none, restores = step(FALLBACK, F.lit(None)), F.lit(RESTORE in allowed)
    plan = (
        F.when((F.size(codes) == 0) & ~incompressible, step(EMIT, F.lit(None)))
        .when(incompressible | among(TOO_LONG), F.when(more > budget, step(EXPAND, more)).otherwise(none))
        .when(among(RESTORABLE) & (spans > 0) & (spans <= limit), F.when((more >= budget) & restores, step(RESTORE, more)).otherwise(none))
        .when(~among(HARD) & (spans > 0) & restores, step(RESTORE, budget)).otherwise(none)
    )
    return F.when(plan["action"].isin(*allowed), plan).otherwise(none)


def _met(low: pa.Array, high: pa.Array, first: pa.Array, last: pa.Array, contains: bool) -> pa.Array:
    """Per row which of its spans [first, last) lie in one of its ranges [low, high), or overlap one; a null meets nothing. All rows
    of a batch lie on one axis, each in a stretch of its own: of the ranges that begin early enough, one must reach far enough."""
    lists = (low, high, first, last)
    flat = [x.flatten() for x in lists]
    known = np.concatenate([x.drop_null().to_numpy() for x in flat])
    least, most = int(known.min(initial=0)), int(known.max(initial=0))
    values = lambda i, null: pc.fill_null(flat[i], null).to_numpy() - least
    rows = lambda x: np.repeat(np.arange(len(x)) * (most - least + 3), x.value_lengths().to_numpy(zero_copy_only=False))
    begin, reach = values(0, most) + rows(low), values(1, least - 1) + rows(low)
    order = np.argsort(begin, kind="stable")
    reach = np.concatenate([[-1], np.maximum.accumulate(reach[order])])
    if contains:
        met = reach[np.searchsorted(begin[order], values(2, least - 1) + rows(first), "right")] >= values(3, most + 1) + rows(first)
    else:
        met = reach[np.searchsorted(begin[order], values(3, least - 1) + rows(first), "left")] > values(2, most + 1) + rows(first)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)), pa.array(met))


def met(ranges: Column, spans: Column, contains: bool = False) -> Column:
    """An array of booleans: which of the spans (first, last) overlap one of the ranges, or lie in one."""
    found = F.arrow_udf(lambda low, high, first, last: _met(low, high, first, last, contains), "array<boolean>")
    return found(*[F.transform(x, lambda v: v[c].cast("long")) for x in (ranges, spans) for c in ("first", "last")])


def _once(rows: DataFrame, name: str, made: Column) -> DataFrame:
    """rows with this column, computed once however often it is named later on: behind a generator nothing is put in its place."""
    return rows.select("*", F.explode(F.array(made)).alias(name))


def recovered(requests: DataFrame, candidates: DataFrame, required: DataFrame, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(results, history): per source the final action, text (null after a fallback), cost and number of attempts; and every
    attempt with its codes, missing spans, action, budgets, parent and hash."""
    columns = [c for c in candidates.columns if c != "source_id"]
    own = candidates.groupBy("source_id").agg(F.collect_list(F.struct(*columns)).alias("c"))
    asked = required.groupBy("source_id").agg(F.collect_list(F.struct("span_id", "first", "last")).alias("q"))
    live = requests.select("source_id", F.col("budget").cast("long"), F.col("maximum").cast("long"), F.lit(None).cast("string").alias("parent"))
    # As sides of a merge, so that the driver holds none of them.
    live = live.join(own.hint("merge"), "source_id", "left").join(asked.hint("merge"), "source_id", "left")
    live = live.select("source_id", "budget", "maximum", "parent", *[F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c) for c, df in (("c", own), ("q", asked))])
    history = []
    for attempt in range(1, attempts + 1):
        rows = live.withColumnRenamed("c", "own").withColumn("c", F.sort_array(F.transform("own", lambda x: ranked_entry(columns, lambda c: x[c]))))
        rows = settled(rows).withColumn("cost", F.col("r.cost")).withColumn("floor", F.col("r.floor"))
        rows = rows.withColumn("held", met(F.transform(F.filter("z", stays), lambda z: z["c"]), F.col("q"), contains=True))
        ids = F.transform("q", lambda q: q["span_id"])
        rows = _once(rows, "missing", F.array_sort(F.array_except(ids, F.filter(ids, lambda _, i: F.get("held", i)))))
        codes = F.array_compact(F.array(F.when(F.size("missing") > 0, "OBLIGATION_NOT_REPRESENTED"), F.when(F.col("cost") > F.col("budget"), "TOKEN_BUDGET_EXCEEDED")))
        rows = _once(_once(rows, "codes", codes), "plan", planned(F.col("codes"), F.col("floor") > F.col("budget"), F.size("missing"), F.col("budget"), F.col("floor"), F.col("maximum")))
        action = F.col("plan.action")
        action = F.when(action != EMIT, FALLBACK).otherwise(action) if attempt == attempts else action
        # What overlaps a missing span must stay from now on.
        again = F.when(action == RESTORE, F.filter("q", lambda q: F.array_contains("missing", q["span_id"]))).otherwise(F.slice("q", 1, 0))
        rows = _once(rows, "again", again).withColumn("forced", met(F.col("again"), F.col("own")))
        forced = F.transform("own", lambda x, i: x.withField("mandatory", F.coalesce(x["mandatory"], F.lit(False)) | F.get("forced", i)))
        goes_on = action.isin(EXPAND, RESTORE)
        rows = rows.select(
            "source_id", F.lit(attempt).alias("attempt"), action.alias("action"), "codes", "missing", "budget", "maximum", F.when(goes_on, F.col("plan.proposed")).alias("proposed"), "cost", "floor", "parent",
            F.when(action == EMIT, F.col("text")).alias("text"), F.when(goes_on, forced).alias("c"), F.when(goes_on, F.col("q")).alias("q"),
        )
        record = F.to_json(F.struct("attempt", "action", "codes", "missing", "budget", "proposed", "cost", "floor", "parent"), {"ignoreNullFields": "false"})
        done = written(rows.withColumn("hash", domain_hash("spanloom.recovery", record)), "recovery-attempt")
        history.append(done)
        onward = done.filter(F.col("action").isin(EXPAND, RESTORE))
        if attempt == attempts or not onward.limit(1).count():
            break
        live = onward.select("source_id", F.col("proposed").alias("budget"), "maximum", F.col("hash").alias("parent"), "c", "q")
    every = reduce(DataFrame.unionByName, history)
    ended = every.filter(F.col("action").isin(EMIT, FALLBACK))
    results = ended.select("source_id", "action", F.when(F.col("action") == EMIT, F.coalesce("text", F.lit(""))).alias("text"), F.when(F.col("action") == EMIT, F.col("cost")).alias("cost"), F.col("attempt").alias("attempts"), "hash")
    return results, every.drop("text", "c", "q")


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders with a share of their cost as budget, some more as maximum, and spans of some of their items as required."""
    rows = order_candidates(spark, sf_dir)
    shares = share_of(rows, F.expr("30 + 10 * (source_id % 7)"))
    required = rows.filter("kind = 'json_row' and row_index % 3 = source_id % 3").select("source_id", F.col("candidate_id").alias("span_id"), (F.col("first") + 1).alias("first"), (F.col("last") - 1).alias("last"))
    return shares.withColumn("maximum", F.col("budget") + 40 * F.expr("source_id % 9")), rows, required


def recovery_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = recovered(*_requests(spark, sf_dir))
    return results.select("source_id", "action", "cost", "attempts", F.sha2("text", 256).alias("digest"), "hash")


def recovery_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, history = recovered(*_requests(spark, sf_dir))
    return history.select("source_id", "attempt", "action", F.concat_ws(",", "codes").alias("codes"), F.concat_ws(",", "missing").alias("missing"), "budget", "proposed", "cost", "floor", "parent", "hash")


# A loop: no SQL; tests hold it against a plain version.
SQL: dict[str, str] = {}
UNSTATED = ("recovery_results", "recovery_history")
