"""What the tables can't show: hard lexemes, mode boundaries, nested JSON, sinks, pooled blocks."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spanloom.functions.text import CLASSES, SENTENCE, marker, match_rows, overlap_join
from spanloom.operators.lexical import typed_rows
from spanloom.operators.stats import isotonic, pooled
from spanloom.operators.structured import parsed_events
from spanloom.sources import scans, sinks


def found(spark, text, kind):
    frame = spark.createDataFrame([(1, text)], "source_id long, text string")
    return [(r.start, r.lexeme) for r in typed_rows(frame).filter(F.col("class") == kind).orderBy("start").collect()]


@pytest.mark.parametrize("text, kind, want", [
    ("on 2024-01-15 or 2024/02/03, 3 of 4", "numeric.number", [(29, "3"), (34, "4")]),
    ("v2.7.4 and 2.7 and 1.2.3-rc.1", "identifier.version", [(0, "v2.7.4"), (19, "1.2.3-rc.1")]),
    ("v2.7.4 and 2.7 and 1.2.3-rc.1", "numeric.number", [(11, "2.7")]),
    ("é12 .5 -3e4 x7 9.", "numeric.number", [(4, ".5"), (7, "-3e4")]),
    ("€ 12.50, 7 usd, $3", "numeric.currency", [(0, "€ 12.50"), (9, "7 usd"), (16, "$3")]),
    ("5%, +2.5 % more", "numeric.percentage", [(0, "5%"), (4, "+2.5 %")]),
    ("12 ms 3 Days 4kgs .5kg", "numeric.unit", [(0, "12 ms"), (6, "3 Days"), (18, ".5kg")]),
    ("at 9:05 or 23:59:59.5", "temporal.timestamp", [(3, "9:05"), (11, "23:59:59.5")]),
    ("123e4567-e89b-42d3-a456-426614174000", "identifier.uuid", [(0, "123e4567-e89b-42d3-a456-426614174000")]),
    ("cve-2024-123 REQ_7.a", "identifier.ticket", [(0, "cve-2024-123"), (13, "REQ_7.a")]),
    ("The Big House. This is Paris", "entity.named", [(0, "The Big House"), (23, "Paris")]),
])
def test_lexemes(spark, text, kind, want):
    assert found(spark, text, kind) == want


def test_markers_and_sentences(spark):
    frame = spark.createDataFrame([(1, "abc\ndef. Unless 😀 told, only  if so")], "source_id long, text string")
    rows = lambda p: [(r.start, r.end, r.lexeme) for r in match_rows(frame, ["source_id"], "text", {"x": p}).orderBy("start").collect()]
    assert rows(SENTENCE) == [(4, 8, "def."), (8, 35, " Unless 😀 told, only  if so")]
    assert rows(marker("logic.exception")) == [(9, 15, "Unless")] and [x[2] for x in rows(marker("logic.condition"))] == ["only  if"]
    assert set(CLASSES) >= {"numeric.number", "temporal.date"}


def test_overlaps_are_those_of_a_plain_version(spark):
    rng = random.Random(3)
    spans = lambda n: [(rng.randrange(3), i, a, a + rng.randint(1, 90)) for i, a in enumerate(rng.choices(range(300), k=n))]
    left, right = spans(60), spans(60)
    frame = lambda rows: spark.createDataFrame(rows, "k long, id long, start long, end long")
    for contains in (False, True):
        got = overlap_join(frame(left), frame(right), ["k"], width=16, contains=contains).select("l.id", F.col("r.id").alias("other")).collect()
        fits = (lambda x, y: x[2] <= y[2] and y[3] <= x[3]) if contains else (lambda x, y: x[2] < y[3] and y[2] < x[3])
        assert sorted(map(tuple, got)) == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and fits(x, y))


def test_last_field_wins(spark):
    line = "2024-01-01T10:00:00.5+02:00 WARN trace=a span_id=b request=r code=E1 code=E2 IOError"
    r = parsed_events(spark.createDataFrame([(1, 1, line)], "source_id long, ordinal long, line string")).first()
    assert (r.seen, r.severity, r.trace, r.code, r.exception) == ("2024-01-01T10:00:00.5+02:00", "WARN", "b", "E2", "IOError")


@pytest.mark.parametrize("size, want", [(0, (1, 1, 1)), (1, (1, 1, 1)), (10, (5, 3, 2)), (999, (499, 299, 199))])
def test_mode_budgets(spark, tmp_path, size, want):
    from spanloom.operators.ranking import mode_budgets

    spark.createDataFrame([(1, "x" * size)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["mode"]: r.budget for r in mode_budgets(spark, str(tmp_path)).collect()}
    assert (got["conservative"], got["target"], got["aggressive"]) == want


def test_isotonic_in_ranges_is_isotonic_at_once(spark):
    rng = random.Random(4)
    points = [("k", rng.random(), i, int(rng.random() < 0.5)) for i in range(500)]
    got = isotonic(spark.createDataFrame(points, "kind string, score double, id long, outcome int")).toPandas().sort_values("score")
    points.sort(key=lambda p: (p[1], p[2]))
    want = pooled(pd.DataFrame({"score": [p[1] for p in points], "total": [float(p[3]) for p in points], "n": 1}))
    assert got[["score", "total", "n"]].to_numpy().tolist() == want.to_numpy().tolist()


def test_sources_and_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(2, None, "é/"), (1, "x", "y")], "b long, a string, c string")
    sinks.write_json_lines(frame, f"{tmp_path}/out")
    lines = sorted(r.text for r in scans.whole_texts(spark, f"{tmp_path}/out").collect())
    assert "".join(lines).split("\n")[:-1] and sorted("".join(lines).strip().split("\n")) == ['{"a":"x","b":1,"c":"y"}', '{"a":null,"b":2,"c":"é/"}']
    assert sum(r.bytes for r in sinks.digests(spark, f"{tmp_path}/out").collect()) == sum(len(x.encode()) for x in lines)
    assert {r.sha256 for r in sinks.digests(spark, f"{tmp_path}/out").collect()} >= {hashlib.sha256(lines[0].encode()).hexdigest()} - {hashlib.sha256(b"").hexdigest()}
    with pytest.raises(AnalysisException):
        sinks.write_json_lines(frame, f"{tmp_path}/out")
    (tmp_path / "r.jsonl").write_text('{"id": 1}\n{"id": 1}\nnot json\n{"id": 2}\n')
    records, bad = scans.typed_records(spark, f"{tmp_path}/r.jsonl", "id long", "id")
    assert sorted(r.code for r in bad.collect()) == ["DUPLICATE_KEY", "INVALID_RECORD"] and records.count() == 3
