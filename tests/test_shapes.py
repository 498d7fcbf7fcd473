"""Shapes that the tables don't show: canonical JSON against a plain writer, types of content, claims, answers, risk, kept lines."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.canonical import canonical, number_text, stable_id
from spanloom.operators.extract import document_candidates
from spanloom.operators.stats import answer_score, structural_risk
from spanloom.operators.structured import document_segments
from spanloom.sources.scans import content_type


def plain_number(x):
    """ECMAScript's text of a double, from Python's shortest digits."""
    if x == 0:
        return "0"
    mantissa, exponent = f"{x!r}".split("e") if "e" in f"{x!r}" else (f"{x!r}", "0")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, rest = mantissa.partition(".")
    digits, point = whole + rest, len(whole) + int(exponent)
    lead = len(digits) - len(digits.lstrip("0"))
    digits, point = digits.lstrip("0").rstrip("0"), point - lead
    k = len(digits)
    if k <= point <= 21:
        return sign + digits + "0" * (point - k)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    return sign + digits[0] + ("." + digits[1:] if k > 1 else "") + f"e{point - 1:+d}"


def test_numbers(spark):
    rng = random.Random(9)
    values = [0.0, -0.0, 1.0, 0.1, 1e21, 1e20, 123456789012345680000.0, 1e-6, 1e-7, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 9007199254740993.0, 2e-3, 1e23, 4.35, -1.5e-9, *(rng.uniform(-1, 1) * 10 ** rng.randint(-30, 30) for _ in range(60))]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", number_text(F.col("v")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: plain_number(v) for i, v in enumerate(values)}
    assert [r[0] for r in spark.createDataFrame([(math.inf,), (math.nan,)], "v double").select(number_text(F.col("v"))).collect()] == [None, None]


def test_canonical_json(spark):
    kind = "b struct<z: int, a: string>, a array<boolean>, `é` map<string,double>, d bigint"
    rows = [((1, 'é"\\/\n\x01\x1f\x7f '), [True, None], {"\U00010000": 1.5, "": 2.0, "a": -3.0}, 9007199254740991), (None, None, {}, None), ((None, ""), [], {"x": math.inf}, 1), ((0, ""), [], {}, 1 << 53)]
    frame = spark.createDataFrame(rows, kind)
    whole = F.struct(*[F.col(f"`{c}`") for c in frame.columns])
    got = [r[0] for r in frame.select(canonical(whole, frame.schema)).collect()]
    assert got == ['{"a":[true,null],"b":{"a":"é\\"\\\\/\\n\\u0001\\u001f\x7f ","z":1},"d":9007199254740991,"é":{"a":-3,"\U00010000":1.5,"":2}}', '{"a":null,"b":null,"d":null,"é":{}}', None, None]
    ids = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c")], "x string, y string").select(stable_id("n", F.col("x"), F.col("y"))).collect()
    assert len({r[0] for r in ids}) == 4 and ids[0][0] == "n:" + hashlib.sha256(b'["a|b","c"]').hexdigest()[:20] and ids[2][0] == "n:" + hashlib.sha256(b'[null,"c"]').hexdigest()[:20]


@pytest.mark.parametrize("asked, kind, media, path, want", [
    ("log", "json", "", None, "log"), (None, "Messages", "application/json", "a.py", "dialogue"), (None, "tool", "application/problem+json", None, "json"), (None, "log", "application/json", None, "json"), (None, "logs", "text/plain", "a.py", "log"),
    (None, "text", "text/plain", "a.py", "python"), (None, "image", "image/png", "a.txt", "unknown"), (None, "", "text/markdown", None, "document"), (None, None, None, None, "unknown"),
])
def test_types_of_content(spark, asked, kind, media, path, want):
    frame = spark.createDataFrame([(asked, kind, media, path)], "asked string, kind string, media string, path string")
    assert frame.select(content_type(*map(F.col, frame.columns))).first()[0] == want


def test_claims_and_lines(spark):
    text = "Why?! No end\n  \nWhy?! Why?!\nNo end.\rx\nlast"
    rows = document_candidates(spark.createDataFrame([(1, text), (2, None), (3, "")], "source_id long, text string")).orderBy("place").collect()
    assert [(r.source_id, r.place, r.n, r.first_start, r.rendered) for r in rows] == [
        (1, 5000, 2, 0, "- repeated_exact count=2 text=Why?!"), (1, 5001, 1, 5, "No end"), (1, 5002, 1, 21, "Why?!"), (1, 5003, 1, 28, "No end."), (1, 5004, 1, 35, "x"), (1, 5005, 1, 38, "last"),
    ]
    lines = document_segments(spark.createDataFrame([(1, "a\r\nb\na\n\na\x0bc\na"), (2, "")], "source_id long, text string")).orderBy("at").collect()
    assert [(r.kind, r.text, r.occurrences) for r in lines] == [("document_segment", "a", 4), ("document_segment", "b", 1), ("repetition_marker", "[repeated 4 times]", 4), ("document_segment", "c", 1), ("document_segment", "a", 4)]


@pytest.mark.parametrize("kind, said, accepted, number, units, want", [
    ("number", "it is 1,203.50 or 4", [], "1203.5", None, (True, 1.0)), ("number", "3.5", [], "3", None, (False, 0.0)), ("number", "none", [], "0", None, (False, 0.0)), ("number_with_unit", "-7 MS in all", [], "-7", ["ms"], (True, 1.0)),
    ("date", "on 2024-01-02T03:04:05Z", ["2024-01-02T03:04:05"], None, None, (True, 1.0)), ("date", "soon", [""], None, None, (False, 0.0)), ("short_free_text", "the red, red car", ["a red car", "the red red car"], None, None, (True, 1.0)),
    ("short_free_text", "red car", ["the red car stops"], None, None, (False, 2 / 3)), ("ordered_list", "A; b|c", ["a,b,c"], None, None, (True, 1.0)), ("ordered_list", "b;a", ["a,b"], None, None, (False, 0.0)), ("set", "b;a;B", ["a,b"], None, None, (True, 1.0)),
    ("text", " Yes ", ["no", "yes"], None, None, (True, 1.0)), ("text", None, ["yes"], None, None, (False, 0.0)), ("short_free_text", None, ["yes"], None, None, (False, 0.0)),
])
def test_answers(spark, kind, said, accepted, number, units, want):
    frame = spark.createDataFrame([(kind, said, accepted, number, units)], "kind string, said string, accepted array<string>, number string, units array<string>")
    got = frame.select(answer_score(*map(F.col, frame.columns), F.lit(False)).alias("s")).first().s
    assert (got.correct, round(got.score, 9)) == (want[0], round(want[1], 9))


@pytest.mark.parametrize("given, want", [
    ((True, 0, 1.0, 1.0, 1.0, 0, 0, 0, 0, 0, False, False, False, False), 0.0), ((True, 2, None, 0.5, 1.0, 0, 3, 1, 2, 1, False, False, False, False), 0.1 + 0.2 + 0.075 + 0.08 + 0.06 + 0.15),
    ((True, 0, 1.0, 1.0, 1.0, 1, 1, 9, 9, 0, True, True, False, True), 0.2 + 0.1 + 0.2 + 0.15 + 0.15), ((False, 99, None, None, None, 1, 0, 0, 0, 0, True, True, True, True), 1.0),
])
def test_risk(spark, given, want):
    names = "valid boolean, failed int, hard double, relations double, mapped double, unknown int, partial int, parser int, other int, omitted int, tokenizer boolean, stale boolean, hashes boolean, gave_up boolean"
    frame = spark.createDataFrame([given], names)
    assert abs(frame.select(structural_risk(*map(F.col, frame.columns))).first()[0] - want) < 1e-12
