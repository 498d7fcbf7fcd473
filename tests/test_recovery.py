"""The recovery loop against a plain loop over sources."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.recovery import EMIT, EXPAND, FALLBACK, RESTORE, planned, recovered
from test_rendered import COLUMNS, plain, rank, render


def plain_recovery(candidates, required, budget, maximum, attempts):
    own, log = [dict(c) for c in candidates], []
    for attempt in range(1, attempts + 1):
        must = [c for c in own if c["mandatory"]]
        text, _, floor = plain(own, budget)
        cost = len(text.encode())
        kept = [c for c in own if c["mandatory"]]
        if len(render(must, []).encode()) <= budget:
            optional = sorted((c for c in own if not c["mandatory"]), key=rank)
            for c in optional:
                if len(render([*kept, c], []).encode()) <= budget:
                    kept.append(c)
            while len(render(kept, [c for c in own if c not in kept]).encode()) > budget and any(not c["mandatory"] for c in kept):
                kept.remove([c for c in optional if c in kept][-1])
        missing = [r for r in required if not any(c["first"] <= r[1] and r[2] <= c["last"] for c in kept)]
        more = min(maximum, max(budget, floor) + 8)
        if not missing and cost <= budget and floor <= budget:
            action, proposed = EMIT, None
        elif cost > budget or floor > budget:
            action, proposed = (EXPAND, more) if more > budget else (FALLBACK, None)
        elif len(missing) <= 8:
            action, proposed = (RESTORE, more) if more >= budget else (FALLBACK, None)
        else:
            action, proposed = RESTORE, budget
        if attempt == attempts and action != EMIT:
            action, proposed = FALLBACK, None
        log.append((attempt, action, budget, proposed, cost, floor, sorted(r[0] for r in missing)))
        if action in (EMIT, FALLBACK):
            return log, text if action == EMIT else None
        if action == RESTORE:
            for c in own:
                c["mandatory"] = c["mandatory"] or any(c["first"] < r[2] and r[1] < c["last"] for r in missing)
        budget = proposed
    raise AssertionError


def test_loop_is_that_of_a_plain_version(spark):
    rng = random.Random(12)
    sources, rows, required, requests = {}, [], [], []
    for s in range(30):
        own = [{"candidate_id": f"c{i}", "kind": "row", "text": rng.choice(["é", "line", "longer line of text"]) * rng.randint(1, 4), "mandatory": rng.random() < 0.2, "structural": False, "anomaly": rng.random() < 0.2, "protected": False, "first": i * 10, "last": i * 10 + 10, "row_index": rng.choice([None, i])} for i in range(rng.randint(1, 18))]
        asked = [(f"s{j}", a, a + rng.randint(1, 9)) for j, a in enumerate(rng.sample(range(0, len(own) * 10, 7), min(len(own), rng.choice([0, 1, 3, 12]))))]
        budget = rng.randint(1, 400)
        sources[s] = own, asked, budget, budget + rng.choice([0, 5, 100, 900])
        rows += [(s, *(c[k.split()[0]] for k in COLUMNS.split(", ")[1:])) for c in own]
        required += [(s, *r) for r in asked]
        requests.append((s, *sources[s][2:]))
    requests += [(90, 10, 10), (91, 10, 10)]
    frame = spark.createDataFrame(rows, COLUMNS)
    spans = spark.createDataFrame([*required, (91, "none", 0, 5)], "source_id long, span_id string, first long, last long")
    results, history = recovered(spark.createDataFrame(requests, "source_id long, budget long, maximum long"), frame, spans, attempts=4)
    texts, log = {r.source_id: r for r in results.collect()}, {}
    chain = {}
    for r in history.orderBy("source_id", "attempt").collect():
        log.setdefault(r.source_id, []).append((r.attempt, r.action, r.budget, r.proposed, r.cost, r.floor, sorted(r.missing)))
        assert r.parent == chain.get(r.source_id)
        chain[r.source_id] = r.hash
    for s, (own, asked, budget, maximum) in sources.items():
        want, text = plain_recovery(own, asked, budget, maximum, 4)
        assert log[s] == want and texts[s].text == text and texts[s].attempts == len(want) and texts[s].hash == chain[s]
    assert (texts[90].action, texts[90].text, texts[91].action) == (EMIT, "", FALLBACK)
    assert {a for own in log.values() for _, a, *_ in own} == {EMIT, EXPAND, RESTORE, FALLBACK}


@pytest.mark.parametrize("codes, incompressible, spans, budget, floor, maximum, want", [
    ([], False, 0, 10, 5, 10, (EMIT, None)), ([], True, 0, 10, 15, 50, (EXPAND, 23)), (["TOKEN_BUDGET_EXCEEDED"], False, 0, 10, 5, 10, (FALLBACK, None)), (["RELATION_NOT_REPRESENTED"], False, 8, 10, 5, 12, (RESTORE, 12)),
    (["RELATION_NOT_REPRESENTED"], False, 9, 10, 5, 12, (RESTORE, 10)), (["HASH_MISMATCH"], False, 9, 10, 5, 12, (FALLBACK, None)), (["OTHER"], False, 1, 10, 5, 12, (RESTORE, 10)), (["OTHER"], False, 0, 10, 5, 12, (FALLBACK, None)),
])
def test_plans(spark, codes, incompressible, spans, budget, floor, maximum, want):
    frame = spark.createDataFrame([(codes, incompressible, spans, budget, floor, maximum)], "c array<string>, i boolean, s int, b long, f long, m long")
    got = frame.select(planned(*map(F.col, "cisbfm")).alias("p")).first().p
    assert (got.action, got.proposed) == want
