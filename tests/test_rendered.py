"""Selection by the cost of the rendering against a version that renders every time."""

import random

import pytest

from spanloom.operators.rendered import OMITTED, Ranges, ranked, selected

COLUMNS = "source_id long, candidate_id string, kind string, text string, mandatory boolean, structural boolean, anomaly boolean, protected boolean, first long, last long, row_index long"


def shown(numbers):
    out, numbers = [], sorted(set(numbers))
    while numbers:
        n = 1
        while n < len(numbers) and numbers[n] == numbers[0] + n:
            n += 1
        out.append(str(numbers[0]) if n == 1 else f"{numbers[0]}-{numbers[n - 1]}")
        numbers = numbers[n:]
    return ",".join(out)


def rank(c):
    return 0 if c["mandatory"] else 1 if c["structural"] else 2, not c["anomaly"], not c["protected"], c["first"], c["last"], c["kind"], c["candidate_id"]


def render(chosen, omitted):
    rows = [c for c in omitted if c["row_index"] is not None]
    lines = [(c["first"], c["last"], c["kind"], c["text"]) for c in chosen]
    if rows:
        lines.append((*min((c["first"], c["last"]) for c in rows), "", OMITTED + shown([c["row_index"] for c in rows])))
    return "\n".join(x[3] for x in sorted(lines))


def plain(candidates, budget):
    must = [c for c in candidates if c["mandatory"]]
    size = lambda text: len(text.encode())
    if size(render(must, [])) > budget:
        return render(must, []), False, size(render(must, []))
    chosen = list(must)
    optional = sorted((c for c in candidates if not c["mandatory"]), key=rank)
    for c in optional:
        if size(render([*chosen, c], [])) <= budget:
            chosen.append(c)
    while True:
        omitted = [c for c in candidates if c not in chosen]
        text = render(chosen, omitted)
        rows = [c for c in omitted if c["row_index"] is not None]
        floor = size(render(must, rows))
        left = [c for c in optional if c in chosen]
        if size(text) <= budget or not left:
            return text, size(text) <= budget, floor
        chosen.remove(left[-1])


@pytest.mark.parametrize("seed", [1, 2])
def test_choice_is_that_of_a_plain_version(spark, seed):
    rng = random.Random(seed)
    sources, rows = {}, []
    for s in range(40):
        own = [{"candidate_id": f"c{i}", "kind": rng.choice(["a", "b"]), "text": rng.choice(["", "é", "line", "longer line of text", "😀😀"]) * rng.randint(1, 3), "mandatory": rng.random() < 0.15, "structural": rng.random() < 0.2, "anomaly": rng.random() < 0.2, "protected": rng.random() < 0.3, "first": i * 10 + rng.randrange(3), "last": i * 10 + 9, "row_index": rng.choice([None, i, i + 90])} for i in range(rng.randint(1, 25))]
        sources[s] = own, rng.randint(1, 300)
        rows += [(s, *(c[k.split()[0]] for k in COLUMNS.split(", ")[1:])) for c in own]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    choices, texts = selected(frame, spark.createDataFrame([(s, b) for s, (_, b) in sources.items()], "source_id long, budget long"))
    got = {r.source_id: r for r in texts.collect()}
    for s, (own, budget) in sources.items():
        text, fits, floor = plain(own, budget)
        assert (got[s].text, got[s].fits, got[s].floor, got[s].cost) == (text, fits, floor, len(text.encode())), (s, budget)
    ranks = [(r.source_id, r.rank, r.candidate_id) for r in choices.collect()]
    assert sorted(ranks) == sorted((s, i + 1, c["candidate_id"]) for s, (own, _) in sources.items() for i, c in enumerate(sorted(own, key=rank)))


def test_ranges_grow():
    rng = random.Random(5)
    for _ in range(50):
        numbers, made = [rng.randrange(130) for _ in range(rng.randint(1, 60))], Ranges()
        for i, x in enumerate(numbers):
            made.add(x)
            assert str(made) == shown(numbers[: i + 1]) and made.size == len(str(made))


def test_no_candidates(spark):
    none = spark.createDataFrame([], COLUMNS)
    choices, texts = selected(none, spark.createDataFrame([(1, 5)], "source_id long, budget long"))
    assert not choices.collect() and not texts.collect() and not ranked(none).collect()
