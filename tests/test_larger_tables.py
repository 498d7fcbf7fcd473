"""Findings of round 4: plans that sorted, joined or gathered what larger tables have too much of."""

import pyarrow as pa

from spanloom.operators import json_index

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_json_is_read_without_sorting_tokens(spark):
    frame = spark.createDataFrame([(1, '{"a":[{"b":1}]}'), (2, "[")], "source_id long, text string")
    parsed = json_index.json_parsed(frame)
    for df in (json_index.json_failures(parsed), json_index.json_nodes(parsed)):
        assert "Sort" not in plan(df) and "Window" not in plan(df) and "Aggregate" not in plan(df)
    # Only the text itself is made with a window and a group, once.
    assert plan(json_index.json_rejected(spark, DATA)).count("Window") == plan(json_index.order_json(spark, DATA)).count("Window")


def test_slices_of_texts_are_read_alike(spark):
    texts = ["\\", None, '"\\\\"', "", "[1", '{"a\\"":[{"k":{}},{"k":[2]}]}', "x\\\"", "﻿[]", '"é"']
    want = [[], [], [""], [], [], ["", "/a\"", "/a\"/0", "/a\"/0/k", "/a\"/1", "/a\"/1/k", "/a\"/1/k/0"], [], [""], [""]]
    was = json_index.SLICE
    try:
        for json_index.SLICE in (1, 9, 1 << 22):
            for some in (texts, texts[:1], []):
                made = json_index._sliced(json_index._nodes, pa.array(some, pa.string())).to_pylist()
                assert [[n["pointer"] for n in nodes] for nodes in made] == want[: len(some)]
    finally:
        json_index.SLICE = was
    assert [n["raw"] for n in made or json_index._nodes(pa.array(texts[5:6])).to_pylist()[0] if n["raw"]] == ["{}", "[2]"]


def test_a_source_counts_its_paths_where_it_lies(spark):
    """json_structure gathered every source of every path to count them."""
    shown = plan(json_index.json_structure(spark, DATA))
    assert not any("path" in line and "source_id" in line for line in shown.splitlines() if "Exchange hashpartitioning" in line)
    rows = [(1, '{"a":[{"b":1},{"b":2}],"7":{"b":[]}}'), (2, '{"a":[{"b":3}]}'), (3, "[")]
    got = {(r.path, r.what): (r.n, r.sources) for r in json_index.path_sums(json_index.json_node_lists(json_index.json_parsed(spark.createDataFrame(rows, "source_id long, text string")))).collect()}
    assert got[("/a/[]/b", "value")] == (3, 2) and got[("/a/[]/b", "key")] == (3, 2) and got[("", "object")] == (2, 2) and got[("/[]/b", "array")] == (1, 1) and got[("/[]", "key")] == (1, 1) and len(got) == 10


def test_relations_arrays_and_anomalies_join_nothing(spark):
    """A join of relations with all nodes was broadcast, which the driver can't hold; anomalies read the texts twice."""
    for name in ("json_relations", "json_arrays", "json_anomalies"):
        shown = plan(getattr(json_index, name)(spark, DATA))
        assert "Join" not in shown and "Broadcast" not in shown and shown.count("Scan parquet") == 1, name


def test_anomalies_of_rows_with_two_forms_of_a_key(spark):
    rows = [
        (1, '[{"Status":"ok","status":"Failed"},{"Status":"error","status":"ok"},{}]'), (2, '{"r":[{"x":{"p":1,"q":2},"y":[1]},7,{"y":[1],"x":{"q":2,"p":1}}]}'), (3, '[{"x":[{"a":1},{"a":2}]},{"x":[{"a":1},{"a":3}]}]'), (4, '[{},{}]'), (5, '[{"a":null},{"a":false},{"a":0}]'),
    ]
    nodes = json_index.json_nodes(json_index.json_parsed(spark.createDataFrame(rows, "source_id long, text string")))
    got = sorted((r.source_id, r.pointer, r.peer, r.status) for r in json_index.anomalous_rows(nodes).collect())
    assert got == [(1, "/0", False, False), (1, "/1", True, True), (1, "/2", True, False)][1:] + [(3, "/0/x/1", True, False), (3, "/1", True, False), (3, "/1/x/1", True, False), (5, "/1", True, False), (5, "/2", True, False)]


def test_tables_are_made_where_the_text_lies(spark):
    """json_table wrote tokens and nodes, and joined cells, keys and rows; its selection read all of that twice."""
    from spanloom.operators import json_table

    shown = plan(json_table.json_table(spark, DATA))
    assert "Join" not in shown and "tables/json" not in shown and shown.count("Scan parquet") == 1 and shown.count("Exchange hashpartitioning") <= 2
    assert plan(json_table.json_table_selection(spark, DATA)).count("Scan parquet") == 1
    texts = ['[{"b":"x:y","a:b":null},{"a:b":1,"b":":"}]', '[{"a":1e400},{"b":-0}]', '[{"a":[ {} , { "x" : 1e400 } ]},{}]', '[{"a":1},{"a":null},{"status":"fatal"}]']
    got = sorted((r.source_id, r.kind, r.row_index or 0, r.mandatory, r.text) for r in json_table.json_candidates(spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")).collect())
    assert got == sorted([
        (0, "json_row", 0, False, '@row\tx:y\tnull\tmissing=[]'), (0, "json_row", 1, False, '@row\t:\t1\tmissing=[]'), (0, "json_schema", 0, True, '@schema=["b","a:b"]\n@types=["string","number"]\n@rows=2'),
        (1, "json_row", 0, False, '@row\t~\t~\tmissing=["b"]'), (1, "json_row", 1, False, '@row\t~\t0\tmissing=["a"]'), (1, "json_schema", 0, True, '@schema=["a","b"]\n@types=["number","number"]\n@rows=2'),
        (2, "json_compact", 0, True, '[{"a":[{},{"x":}]},{}]'),
        (3, "json_row", 0, False, '@row\t1\t~\tmissing=["status"]'), (3, "json_row", 1, False, '@row\tnull\t~\tmissing=["status"]'), (3, "json_row", 2, True, '@row\t~\tfatal\tmissing=["a"]'), (3, "json_schema", 0, True, '@schema=["a","status"]\n@types=["number","string"]\n@rows=3'),
    ])


def test_spans_are_summed_up_without_a_sort(spark):
    """typed_spans sorted every span by class, as sums of texts can't be hashed; number_spans looked for all classes, in two calls."""
    from spanloom.operators import lexical

    shown = plan(lexical.typed_spans(spark, DATA))
    assert "Sort " not in shown and "Exchange hashpartitioning" not in shown
    numbers = lexical.number_spans(spark, DATA)
    assert plan(numbers).count("ArrowEvalPython [") == 1 and plan(lexical.typed_spans(spark, DATA)).count("ArrowEvalPython [") == 1
    frame = spark.createDataFrame([(1, "On 2024-01-15 The v1.2.3 cost 7 kg"), (2, None), (3, ""), (4, "2024-01-15"), (5, "Ada 5")], "source_id long, text string")
    some = lambda *names: sorted((r.source_id, r.start, r.lexeme) for r in lexical.typed_rows(frame, list(names)).collect())
    assert some("numeric.number") == [(1, 30, "7"), (5, 4, "5")] and some("entity.named") == [(1, 0, "On"), (5, 0, "Ada")]
    every = sorted((r.source_id, r.start, r.lexeme) for r in lexical.typed_rows(frame).filter("class = 'numeric.number'").collect())
    assert every == some("numeric.number")


def test_attempts_go_on_without_a_shuffle(spark, monkeypatch):
    """Every attempt made the candidates anew, joined and grouped them, and wrote three tables."""
    from spanloom.operators import recovery

    seen, write = [], recovery.written
    monkeypatch.setattr(recovery, "written", lambda df, what: seen.append(plan(df)) or write(df, what))
    history = recovery.recovery_history(spark, DATA)
    attempts = [r.attempt for r in history.select("attempt").distinct().collect()]
    assert len(seen) == max(attempts) > 2 and "Exchange" in seen[0] and "BroadcastHashJoin" not in seen[0]
    assert not any("Exchange" in p or "Join" in p for p in seen[1:])


def test_spans_in_ranges_and_over_them(spark):
    import random

    from pyspark.sql import functions as F

    from spanloom.operators.recovery import met

    rng = random.Random(5)
    pair = lambda: rng.choice([(a := rng.randint(-5, 20), a + rng.randint(0, 6))] * 6 + [(None, 3), (2, None), (None, None)])
    rows = [(i, [pair() for _ in range(rng.randint(0, 5))], [pair() for _ in range(rng.randint(0, 6))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "i long, a array<struct<first:long,last:long>>, b array<struct<first:long,last:long>>")
    whole = lambda a, b: None not in (*a, *b)
    for r in frame.select("a", "b", met(F.col("a"), F.col("b")).alias("over"), met(F.col("a"), F.col("b"), contains=True).alias("within")).collect():
        assert r.over == [any(whole(a, b) and a[0] < b[1] and b[0] < a[1] for a in r.a) for b in r.b]
        assert r.within == [any(whole(a, b) and a[0] <= b[0] and b[1] <= a[1] for a in r.a) for b in r.b]
