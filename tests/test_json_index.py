"""The structural index against Python's parser: what is JSON, which nodes it has and where, on odd and on random texts."""

import json
import random

import pytest

from spanloom.operators.json_index import anomalous_rows, json_failures, json_nodes, json_parsed, object_arrays, object_relations, path_obligations, typed_leaves

SCHEMA = "source_id long, text string"
ODD = [
    '{"x": 1, "x": 2}', '{"x":', "", "  ", None, "[]", "{}", "3", '"a"', "[1,]", '{"a":1,}', "[1 2]", '{"a" 1}', "[NaN]", "[-Infinity]", '["\\ud800"]', '["\\ud83d\\ude00"]', '["\\\\ud800"]', "[01]",
    "[-0,1e5,1.5E-3]", "[.5]", '["a\tb"]', '["a\\x"]', "}{", "[}", "{]", '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":1}}}}}}}}}}', "1 2", '{"a":1}{', "{1:2}", '{"a":"b":"c"}', '{"a","b"}', '["open]', "[tru]",
    '{"\\u0061":1,"a":2}', "[1],", "﻿[1]", "﻿﻿1", "[﻿1]", '"a" "b"', ":", "[1,,2]", "{,}", '{"a":1 "b":2}', '{"a":}', "[:]", "x[1]", "[1]x", '{"[":"]{,:\\""}', "[[],[[]],{}]", '{"é/~":"😀"}',
]


def strict(text):
    """The value, or ValueError: no key twice, no constants, no lone surrogates."""
    def pairs(found):
        out = {}
        for k, v in found:
            if k in out:
                raise ValueError(k)
            out[k] = v
        return out

    def refused(_):
        raise ValueError("constant")

    value = json.loads(text.removeprefix("﻿"), object_pairs_hook=pairs, parse_constant=refused)
    json.dumps(value, ensure_ascii=False).encode()
    return value


def plain(value, path=""):
    yield path, value
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from plain(v, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}")


def made(rng, depth=0):
    kind = rng.choice(["object", "array", "leaf", "leaf"] if depth < 5 else ["leaf"])
    if kind == "object":
        return {rng.choice("ab/~é😀\"\\,:{") + str(i): made(rng, depth + 1) for i in range(rng.randrange(4))}
    if kind == "array":
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, -3, 1.5, 1e30, "", "a,b", "[\n]", "\\", '"', "é😀", "12%"])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    good = [json.dumps(made(rng), indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) for _ in range(60)]
    broken = []
    for t in good:
        i = rng.randrange(len(t))
        broken.append(t[:i] + rng.choice(["", ",", "]", "{", '"', "x"]) + t[i + 1 :])
    return dict(enumerate(ODD + good + broken))


def test_what_is_json_and_its_nodes(spark, texts):
    frame = spark.createDataFrame(list(texts.items()), SCHEMA)
    parsed = json_parsed(frame).cache()
    failed = {r.source_id for r in json_failures(parsed).collect()}
    nodes = {}
    for r in json_nodes(parsed).collect():
        nodes.setdefault(r.source_id, {})[r.pointer] = r
    for i, text in texts.items():
        try:
            want = dict(plain(strict(text or "")))
        except ValueError:
            assert i in failed and i not in nodes, text
            continue
        assert i not in failed, text
        got = nodes[i]
        assert set(got) == set(want), text
        for path, value in want.items():
            r = got[path]
            assert json.loads(text[r.start : r.end]) == value
            kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "integer", float: "number"}[type(value)]
            assert r.kind == kind and (r.value == value if kind == "string" else True)
            if r.key is not None:
                assert json.loads(text[r.key_start : r.key_end]) == r.key and path.rsplit("/", 1)[1] == r.key.replace("~", "~0").replace("/", "~1")
    parsed.unpersist()


def test_meaning_of_nodes(spark):
    rows = [
        (1, '{"records":[{"id":"a","value":15,"unit":"ms","owner":"api","Status":"Request failed","x":{"p":1,"q":[2]}},{"id":"b","value":20,"unit":"ms","owner":"api","status":"ok","x":{"q": [2], "p":1}},{"id":"c","limit":"5 %","unit":"ms","service":"s","trace_id":"t","timestamp":"z","x":null}],"code":3}'),
        (2, '[{"a":1},{"a":1.0},{"a":2},7]'), (3, '[{"a":"k"},{"a":"k"}]'), (4, '[{},{"a":[]}]'), (5, '{"a":[{"b":1}]}'), (6, "broken"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    nodes = json_nodes(json_parsed(frame)).cache()
    odd = {(r.source_id, r.pointer): (r.peer, r.status) for r in anomalous_rows(nodes, frame).collect()}
    assert odd == {(1, "/records/0"): (True, True), (1, "/records/1"): (True, False), (1, "/records/2"): (True, False), (2, "/2"): (True, False), (4, "/0"): (True, False)}
    found = {(r.source_id, r.relation, tuple(r.ends)) for r in object_relations(nodes).collect()}
    assert found == {
        (1, "relation.value_unit_owner", tuple(f"/records/{i}/{k}" for k in keys)) for i, keys in ((0, ("value", "unit", "owner")), (1, ("value", "unit", "owner")), (2, ("limit", "unit", "service")))
    } | {(1, "relation.event_timestamp", ("/records/2", "/records/2/timestamp")), (1, "relation.event_trace", ("/records/2", "/records/2/trace_id"))}
    assert {(r.source_id, r.pointer, r.rows) for r in object_arrays(nodes).collect()} == {(1, "/records", 3), (3, "", 2), (4, "", 2), (5, "/a", 1)}
    leaves = {(r["class"], r.pointer, r.value) for r in typed_leaves(nodes).filter("source_id = 1").collect()}
    assert {("numeric.percentage", "/records/2/limit", "5 %"), ("temporal.timestamp", "/records/2/timestamp", "z"), ("identifier.error_code", "/code", "3"), ("numeric.number", "/code", "3"), ("numeric.number", "/records/0/x/q/0", "2")} <= leaves
    paths = [(r.pointer, r.what) for r in path_obligations(nodes).filter("source_id = 5").collect()]
    assert sorted(paths) == [("", "object"), ("/a", "array"), ("/a", "key"), ("/a/0", "object"), ("/a/0/b", "key"), ("/a/0/b", "value")]
    nodes.unpersist()


def test_nothing_to_read(spark):
    for rows in ([], [(1, "no"), (2, None)]):
        frame = spark.createDataFrame(rows, SCHEMA)
        nodes = json_nodes(json_parsed(frame))
        assert not nodes.collect() and not anomalous_rows(nodes, frame).collect() and len(json_failures(json_parsed(frame)).collect()) == len(rows)
