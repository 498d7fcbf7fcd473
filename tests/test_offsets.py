"""Ranges of normalised texts against a map of every character."""

import random

from spanloom.sources.offsets import edit_map, normalized_sources, translated


def entries(text):
    """(original start, end, normalised start, end) of every character."""
    out, i, n = [], 0, 0
    if text.startswith("﻿"):
        out, i = [(0, 1, 0, 0)], 1
    while i < len(text):
        w = 2 if text[i : i + 2] == "\r\n" else 1
        out.append((i, i + w, n, n + 1))
        i, n = i + w, n + 1
    return out, n


def plain(text, start, end, to):
    every, n = entries(text)
    every = every if to == "normal" else [(c, d, a, b) for a, b, c, d in every]
    size, other = (len(text), n) if to == "normal" else (n, len(text))
    if not 0 <= start <= end <= size:
        return "OUT_OF_BOUNDS"
    met = [e for e in every if e[1] > start and e[0] < end]
    if met:
        return min(e[2] for e in met), max(e[3] for e in met)
    point = min((e[2] for e in every if e[0] >= start), default=other)
    return point, point


def test_ranges_both_ways(spark):
    rng = random.Random(8)
    texts = ["", "﻿", "﻿\r\n", "\r", "\n\r", "a\r\nbb\nc\r\nd", "﻿A\r\nB\rC\n", *("".join(rng.choice(["a", "é", "😀", "\r", "\n", "\r\n", "﻿"]) for _ in range(rng.randint(1, 12))) for _ in range(25))]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "source_id long, text string")
    edits = edit_map(frame).cache()
    ranges = [(i, 100 * a + b + 200, a, b) for i, t in enumerate(texts) for a in range(-1, len(t) + 2) for b in range(a - 1, len(t) + 2)] + [(99, 0, 0, 0), (98, 0, 0, 0)]
    for to in ("normal", "original"):
        got = {(r.source_id, r.start, r.end): r.code or (r.to_start, r.to_end) for r in translated(spark.createDataFrame(ranges, "source_id long, range_id long, start long, end long"), edits, to).collect()}
        assert got.pop((99, 0, 0)) == (0, 0) and got.pop((98, 0, 0)) == "UNKNOWN_SOURCE"
        for (i, a, b), found in got.items():
            assert found == plain(texts[i], a, b, to), (texts[i], a, b, to)
    log = [(r.rule, r.original_start, r.original_end, r.normal_start, r.normal_end) for r in edits.filter("source_id = 6 and rule is not null").orderBy("i").collect()]
    assert log == [("remove_utf8_bom", 0, 1, 0, 0), ("normalize_line_ending", 2, 4, 1, 2), ("normalize_line_ending", 5, 6, 3, 4)]
    hashed = {r.source_id: r for r in normalized_sources(frame).collect()}
    assert hashed[6].normal == "A\nB\nC\n" and hashed[6].original_hash != hashed[6].normal_hash
    edits.unpersist()
