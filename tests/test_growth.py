"""What larger tables brought out: results at keys and dates that the small ones don't have, and plans that must not grow."""

import datetime
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.functions.canonical import number_text
from spanloom.functions.text import SIGN, match_rows
from spanloom.operators import stats, structured
from spanloom.operators.lexical import typed_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_that_name_the_very_date(spark, tmp_path):
    rows = [(26, datetime.date(1999, 1, 1), "1-URGENT"), (58, datetime.date(1999, 1, 2), "2-HIGH")]
    frame = spark.createDataFrame(rows, "o_orderkey long, o_orderdate date, o_orderpriority string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted((r.o_orderkey, r.correct, r.score) for r in stats.answer_scores(spark, str(tmp_path)).collect())
    assert got == sorted((r[0], r[2], r[3]) for r in con.sql(stats.SQL["answer_scores"]).fetchall()) == [(26, True, 1.0), (58, False, 0.0)]


def test_customers_with_odd_values(spark, tmp_path):
    balances = [-0.0, 0.0, None, math.nan, -math.inf, 1e-7, -1.5e-6, 1e21, -123456789012345680000.0, 9.678637210624652e17, 5e-324, 1e20, 0.05, -999.85]
    rows = [(i, f"Customer#{i:09d}", b, "BUILDING") for i, b in enumerate(balances)]
    rows += [(None, "n", 1.0, "x"), (-16, None, 2.5, None), (-3, "n", 2.5, "é"), (20, 'a"b\\c\n\x00\x7f\x1f', 1.0, "\b\f\r"), ((1 << 53) - 1, "n", 1.0, "x"), (1 << 53, "n", 1.0, "x"), (-(1 << 63), "n", 1.0, "x")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = {r[0]: tuple(r) for r in structured.canonical_hashes(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r for r in con.sql(structured.SQL["canonical_hashes"]).fetchall()} and len(got) == len(rows)
    for key, name, balance, segment in rows:
        if balance is not None and not math.isfinite(balance) or abs(key or 0) >= 1 << 53:
            assert got[key][1] is None and got[key][2] is None and got[key][3]
        else:
            two = None if key is None else key % 2 == 0
            want = {"Nums": [balance, None if key is None else key / 8, 1e21, 1e-7, 0], "id": key, "m": {"\U00010000": None if key is None else key % 3 == 0, "\ue000": two}, "title": name if two else None, "é": None if segment is None else segment + '\t"\\\x1f'}
            assert json.loads(got[key][1], parse_int=float) == want and "[-0," not in got[key][1]


def test_numbers_beyond_those_that_are_all_held(spark):
    values = [9.678637210624652e17, 7.2602427694655594e19, 6.701415588617876e18, 9.020030787924212e17, 3.0438910442455304e25, 2.4398331771115212e25, 2.0**53, 2.0**121, 9007199254740994.0, 1e22, 1e23, 5e36, 2.0**89, 2.0**172]
    got = spark.createDataFrame([(v, -v) for v in values], "v double, w double").select(number_text(F.col("v")), number_text(F.col("w"))).collect()
    got = [(r[0].removeprefix("-"), r[1].removeprefix("-")) for r in got]
    assert [x for x, y in got if x == y] == ["967863721062465200", "72602427694655594000", "6701415588617876000", "902003078792421200", "3.0438910442455304e+25", "2.4398331771115213e+25", "9007199254740992", "2.658455991569832e+36", "9007199254740994", "1e+22", "1e+23", "5e+36", "6.189700196426902e+26", "5.986310706507379e+51"]


def test_matches_are_made_where_the_text_lies(spark):
    frame = spark.createDataFrame([(1, f"a12 {SIGN}b3 é45"), (2, "a12 b3 é45"), (3, None), (4, ""), (5, "none")], "source_id long, text string")
    rows = match_rows(frame, ["source_id"], "text", {"n": "[0-9]+", "w": "[a-zé]"})
    assert "Exchange" not in plan(rows) and "Window" not in plan(rows) and "Exchange" not in plan(typed_rows(frame))
    got = sorted(tuple(r) for r in rows.filter("source_id < 5").collect())
    at = lambda k, s: [(k, "n", s[0], s[0] + 2, "12"), (k, "n", s[1], s[1] + 1, "3"), (k, "n", s[2], s[2] + 2, "45"), (k, "w", s[0] - 1, s[0], "a"), (k, "w", s[1] - 1, s[1], "b"), (k, "w", s[2] - 1, s[2], "é")]
    assert got == sorted(at(1, (1, 6, 9)) + at(2, (1, 5, 8)))


def test_what_begins_in_a_date_is_part_of_it(spark):
    many = " ".join(f"2024-01-{d % 28 + 1:02d} {d} v1.{d}.3" for d in range(200))
    frame = spark.createDataFrame([(1, "7 2024-01-15 8"), (2, "no date 9"), (3, many)], "source_id long, text string")
    got = typed_rows(frame).filter("class = 'numeric.number'")
    assert sorted((r.source_id, r.start, r.lexeme) for r in got.filter("source_id < 3").collect()) == [(1, 0, "7"), (1, 13, "8"), (2, 8, "9")]
    assert [r.lexeme for r in got.filter("source_id = 3").orderBy("start").collect()] == [str(d) for d in range(200)]


def test_nodes_stay_with_their_source(spark):
    from spanloom.operators.json_index import json_nodes, json_parsed

    frame = spark.createDataFrame([(1, '{"a":[{"b":1},[2,{"~/":null}]]}'), (2, "[]"), (3, "[")], "source_id long, text string")
    nodes = json_nodes(json_parsed(frame))
    assert plan(nodes).count("Exchange ") == 1 and "Join" not in plan(nodes)
    got = sorted((r.source_id, r.node, r.pointer) for r in nodes.collect())
    assert [p for s, _, p in got if s == 1] == ["", "/a", "/a/0", "/a/0/b", "/a/1", "/a/1/0", "/a/1/1", "/a/1/1/~0~1"] and [p for s, _, p in got if s == 2] == [""]


def test_choices_are_made_without_a_group_a_source(spark):
    from spanloom.operators.rendered import selected

    rows = [(s, str(i), "json_row", "x" * i, False, False, False, False, i, i + 1, i) for s in range(20) for i in range(1, 6)]
    frame = spark.createDataFrame(rows, "source_id long, candidate_id string, kind string, text string, mandatory boolean, structural boolean, anomaly boolean, protected boolean, first long, last long, row_index long")
    choices, texts = selected(frame, spark.createDataFrame([(s, 30) for s in range(20)], "source_id long, budget long"))
    assert "FlatMapGroups" not in plan(choices) and "FlatMapGroups" not in plan(texts)
    assert {r.text for r in texts.collect()} == {"\n".join("x" * i for i in range(1, 6))} and choices.filter("state = 'taken'").count() == 100


def test_plans_of_differences_and_edges(spark):
    from spanloom.operators import graph, ranking, verify
    from spanloom.sources import offsets, scans

    data = "/root/testdata/sf0.001"
    assert "Join" not in plan(verify.extraction_differences(spark, data)) and "Generate" not in plan(verify.extraction_differences(spark, data))
    assert "Generate" not in plan(graph.graph_edges(spark, data))
    assert "regexp_extract" not in scans.coordinates(spark, data)._jdf.queryExecution().analyzed().toString()
    assert offsets.foreign_documents(spark, data)._jdf.queryExecution().analyzed().toString().count("split(") == 1
    was, ranking.PAIRS = ranking.PAIRS, 1_000
    try:
        pairs = spark.read.parquet(f"{data}/documents.parquet").count() * spark.read.parquet(f"{data}/benchmark.parquet").count()
        assert f"hashpartitioning(doc_id" in plan(ranking.bm25_top_k(spark, data)) and f", {pairs // 1_000 + 1})" in plan(ranking.bm25_top_k(spark, data))
    finally:
        ranking.PAIRS = was
