"""Every stage of the pipeline on its own input, and the run, on a table with nulls, copies, junk and clashing columns."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from spanloom.llm import kneser_ney, mixing
from spanloom.llm.queries import tokenizer_path

WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    base = make(80)
    texts = [*(make(rng.randint(5, 120)) for _ in range(50)), base, base, base + " end", base.replace(" ", "\n", 3), "qqxz ZZQ7 xqzj 9wq " * 12, None, "", " \n", make(20) + " password: hunter22222 " + make(9)]
    rows = [(i, t, ["en", None][i % 9 == 8], ["a", "b", "b", None][i % 4], len(t or ""), i, i) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, n_chars long, text_key long, row long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(54, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{sf_dir}/step-{i}-{name}")
        out.append(spark.read.parquet(f"{sf_dir}/step-{i}-{name}"))
    return [(df.columns, df.collect()) for df in out]


def test_columns_stay(steps):
    assert all(columns == steps[0][0] for columns, _ in steps[:5])


def test_quality(spark, sf_dir, steps):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = {(r.doc_id, r.text_key) for r in kneser_ney.judge(docs, labels).collect() if r.kept}
    assert sorted(r.doc_id for r in steps[1][1]) == sorted(r.doc_id for r in steps[0][1] if r.doc_id in {k[0] for k in kept})
    ids = {r.doc_id for r in steps[1][1]}
    assert not ids & {54, 55, 56, 57} and len(ids) >= 50


def test_near_duplicates(steps):
    sets = {}
    for r in steps[1][1]:
        w = WORD.findall(r.text.lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    up = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    assert sorted(r.doc_id for r in steps[2][1]) == sorted(set(up.values()))


def test_secrets_go(steps):
    before, after = ({r.doc_id: r for r in rows} for _, rows in steps[2:4])
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i].text != after[i].text}
    assert changed == {i for i in before if "password" in before[i].text} and all("hunter" not in after[i].text and after[i].n_chars == len(after[i].text) for i in changed)


def test_mix(steps):
    sizes, taken = collections.Counter(), collections.Counter()
    for r in steps[3][1]:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in steps[4][1]:
        taken[r.source] += len(WORD.findall(r.text))
    want = mixing.targets(list(sizes.items()))
    assert all(abs(taken[s] - w) <= 0.1 * w + 20 for s, w in want.items())
    texts = {r.doc_id: WORD.findall(r.text) for r in steps[3][1]}
    assert all(" ".join(WORD.findall(r.text)) in " ".join(texts[r.doc_id]) for r in steps[4][1])


def test_pack(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in steps[5][1]) == collections.Counter((r.doc_id, ids(r.text)) for r in steps[4][1])


def test_run(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got) == key(steps[5][1])
