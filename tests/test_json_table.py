"""JSON compiled to tables against a plain version, and chosen from within a budget."""

import json
import random

from pyspark.sql import functions as F

from spanloom.functions.canonical import float_text
from spanloom.operators.json_table import FAILED, json_candidates
from spanloom.operators.rendered import selected

SCHEMA = "source_id long, text string"


def plain(text):
    value = json.loads(text.removeprefix("﻿"))
    short = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    types = {}
    table = isinstance(value, list) and len(value) >= 2 and all(isinstance(r, dict) for r in value)
    for row in value if table else ():
        for k, v in row.items():
            types.setdefault(k, set()).add(type(v))
            table = table and not isinstance(v, (dict, list))
    if not table or any(len(t - {type(None)}) > 1 for t in types.values()):
        return [("json_compact", None, True, short(value))]
    names = {bool: "boolean", int: "number", float: "number", str: "string"}
    kinds = [names[next(iter(t - {type(None)}))] if t - {type(None)} else "null" for t in types.values()]
    out = [("json_schema", None, True, f"@schema={short(list(types))}\n@types={short(kinds)}\n@rows={len(value)}")]
    for i, row in enumerate(value):
        cells = [(short(row[k])[1:-1] if isinstance(row[k], str) else short(row[k])) if k in row else "~" for k in types]
        must = isinstance(row.get("status"), str) and row["status"].lower() in FAILED
        out.append(("json_row", i, must, "@row\t" + "\t".join(cells) + "\tmissing=" + short([k for k in types if k not in row])))
    return out


def test_tables(spark):
    rng = random.Random(3)
    leaf = lambda: rng.choice([1, -0.0, 2.5, 1e16, 1e22, 123456.75, 1e-5, True, None, "é\t\"/", "", "FATAL", "x"])
    same = {"a": lambda: rng.choice([1, -7, None]), "b": lambda: rng.choice([0.5, 1e300, 3.0]), "status": lambda: rng.choice(["Error", "ok", None]), "é\n": lambda: rng.choice([True, False]), "n": lambda: None}
    row = lambda: {k: same[k]() for k in rng.sample(list(same), rng.randint(0, 5))}
    texts = ["[]", "{}", '[{"a":1}]', "[{},{}]", '[{"a":1},{"a":1.0}]', '[{"a":1},{"a":[]}]', '[{"a":1},2]', ' {"b" : [1.50, -0, 1E2], "a":"\\u0041\\/"}', '﻿[{"z":null},{"y":null,"z":"q"}]', "3.10"]
    texts += [json.dumps([row() for _ in range(rng.randint(2, 6))], indent=rng.choice([None, 2])) for _ in range(25)] + [json.dumps([{"k": leaf(), "m": leaf()} for _ in range(3)]) for _ in range(10)]
    frame = spark.createDataFrame([*enumerate(texts), (900, "[1"), (901, None)], SCHEMA)
    made = json_candidates(frame)
    got = {}
    for r in made.collect():
        got.setdefault(r.source_id, []).append((r.kind, r.row_index, r.mandatory, r.text))
        if r.kind == "json_row":
            assert json.loads(texts[r.source_id][r["first"] : r["last"]]) == json.loads(texts[r.source_id].removeprefix("﻿"))[r.row_index]
    for i, text in enumerate(texts):
        assert sorted(got[i], key=str) == sorted(plain(text), key=str), text
    assert set(got) == set(range(len(texts)))
    wide = "[" + ",".join(f'{{"id":{i},"t":"{"x" * 30}"}}' for i in range(9)) + "]"
    _, chosen = selected(json_candidates(spark.createDataFrame([(1, wide)], SCHEMA)), spark.createDataFrame([(1, 250)], "source_id long, budget long"))
    r = chosen.first()
    assert r.fits and r.cost <= 250 and r.marker == "@omitted_rows=3-8" and r.text.startswith('@schema=["id","t"]') and r.text.endswith(r.marker)


def test_floats(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, 1e15, 9999999999999998.0, 1e16, 1e17, 1e-4, 1e-5, 123.456, 5e-324, -2.5e-10, *(rng.uniform(-1, 1) * 10 ** rng.randint(-20, 25) for _ in range(40))]
    got = spark.createDataFrame(list(enumerate(values)), "i long, v double").select("i", float_text(F.col("v")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: repr(v) for i, v in enumerate(values)}
