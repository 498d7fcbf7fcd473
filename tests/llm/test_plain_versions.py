"""Fingerprints, language filters, the language model and first-fit packing against plain versions; nulls and name clashes."""

import collections
import math
import random

import numpy as np

from spanloom.llm import html_extract, kneser_ney, langid, mixing, ngram_join, order_minhash, packing, secrets, surrogates, weak_rules
from spanloom.llm.queries import tokenizer_path
from spanloom.llm.wordhash import mix


def one(x):
    return int(mix(np.array([x % 2**64], np.uint64))[0])


def plain_fingerprint(text):
    """Numbered k-mers one at a time, in lists per cell."""
    step, out = 0x9E3779B97F4A7C15, [0] * order_minhash.PARTS
    k = min(order_minhash.K, len(text))
    seen, cells = collections.Counter(), collections.defaultdict(list)
    for at in range(len(text) - k + 1 if text else 0):
        total = k
        for c in text[at : at + k]:
            total = (total * step + ord(c)) % 2**64
        kmer = one(total) >> 24
        numbered = one((kmer << 24) + seen[kmer]) >> 24
        seen[kmer] += 1
        cells[numbered >> 34].append((numbered, at))
    for cell, own in cells.items():
        made, chosen = 0, sorted(sorted(own)[: order_minhash.LEAST], key=lambda x: x[1])
        for j in range(order_minhash.LEAST):
            made = one(made * step + (chosen[j][0] if j < len(chosen) else 0) + 1)
        out[cell] = made >> 32 | 1
    return out


def test_fingerprints():
    rng = random.Random(5)
    texts = ["", "a", "short", "x" * 300, "Élan ß Ω 文字 😀 " * 9, *("".join(rng.choice("abc ") for _ in range(rng.randint(1, 900))) for _ in range(25))]
    for t in texts:
        assert order_minhash.fingerprint(t).tolist() == plain_fingerprint(t)


def test_language_prediction(spark):
    rng = random.Random(2)
    parts = {"aa": "ba lo mi ka", "bb": "lo mi str ch", "cc": "ka un str ü"}
    rows = [(i, " ".join("".join(rng.choice(parts[lang].split()) for _ in range(2)) for _ in range(rng.randint(1, 12))), lang) for i, lang in enumerate(rng.choices(list(parts), k=90))]
    learn, rest = rows[:60], rows[60:]

    def grams(text):
        out = []
        for w in text.lower().split():
            m = f"^{w}$"
            out += [m[i : i + n] for n in (2, 3, 4) for i in range(len(m) - n + 1)] + ["=" + w]
        return out

    counts = {lang: collections.Counter(g for _, t, own in learn if own == lang for g in grams(t)) for lang in parts}
    shares = {lang: {g: n / c.total() for g, n in c.items() if n / c.total() >= 1 / langid.RARE} for lang, c in counts.items()}
    most = {g: max(s.get(g, 0) for s in shares.values()) for s in shares.values() for g in s}
    held = {lang: {g for g, x in s.items() if x * langid.OTHERS >= most[g]} for lang, s in shares.items()}
    filters = langid.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(rest, "doc_id long, text string, lang string").select("doc_id", "text"), filters).collect()}
    for i, t, _ in rest:
        hits = {lang: sum(g in own for g in grams(t)) for lang, own in held.items()}
        assert got[i] == min(hits, key=lambda lang: (-hits[lang], lang))


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over the letters of words, by its definition, with dictionaries."""

    def __init__(self, words, order):
        self.order, self.a = order, {n: collections.Counter() for n in range(1, order + 1)}
        for w, n in words.items():
            m = f"^{w}$"
            for i in range(1, len(m)):
                g = m[max(0, i - order + 1) : i + 1]
                self.a[len(g)][g] += n
        for n in range(order - 1, 0, -1):
            for g in self.a[n + 1]:
                self.a[n][g[1:]] += 1
        self.d = {}
        for n, grams in self.a.items():
            c = collections.Counter(grams.values())
            y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0
            self.d[n] = [max(0.1 * i, min(i - 0.1, i - (i + 1) * y * c[i + 1] / c[i])) if c[i] and c[1] else 0.5 * i for i in (1, 2, 3)]

    def take(self, g):
        return min(self.d[len(g)][min(self.a[len(g)][g], 3) - 1], self.a[len(g)][g] - 0.05)

    def gamma(self, h):
        own = [g for g in self.a[len(h) + 1] if g[:-1] == h]
        return sum(map(self.take, own)) / sum(self.a[len(h) + 1][g] for g in own) if own else 1.0

    def p(self, g):
        """Of the last letter of g after the others."""
        if not g:
            return 1e-7
        h, n = g[:-1], len(g)
        total = sum(c for x, c in self.a[n].items() if x[:-1] == h)
        own = (self.a[n][g] - self.take(g)) / total if g in self.a[n] else 0.0
        return own + self.gamma(h) * self.p(g[1:])

    def word(self, w):
        m = f"^{w}$"
        return sum(math.log(self.p(m[max(0, i - self.order + 1) : i + 1])) for i in range(1, len(m)))


def test_kneser_ney_probabilities(spark):
    texts = {"aa": "the then there these this that tin ten thin the the then a an and hand", "bb": "der die das dem den des dir der der die und hund"}
    frame = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(texts.items())], "doc_id long, lang string, text string")
    model = kneser_ney.train(frame, order=3)
    asked = [("aa", "the and"), ("aa", "thand xq"), ("bb", "der hund"), ("bb", "the zzz"), ("aa", "hund " * 5), ("aa", "")]
    docs = spark.createDataFrame([(i, i, lang, t) for i, (lang, t) in enumerate(asked)], "doc_id long, text_key long, lang string, text string")
    plain = {lang: PlainKneserNey(collections.Counter(t.split()), 3) for lang, t in texts.items()}
    for most in (kneser_ney.MOST, 0):
        got = {r.doc_id: r for r in kneser_ney.document_scores(docs, model, 3, most).collect()}
        for i, (lang, t) in enumerate(asked):
            want = sum(plain[lang].word(w) for w in t.split())
            assert got[i].logp is None if not t else abs(got[i].logp - want) < 1e-6 and got[i].letters == sum(len(w) + 1 for w in t.split())


def test_first_fit_decreasing():
    """The tree gives each piece the first bin with room, as a walk over all bins would."""
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 200))]
        bins, offsets = packing.first_fit_decreasing(np.array(lengths), 100)
        room: list[int] = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            room += [100] if at == len(room) else []
            assert (bins[i], offsets[i]) == (at, 100 - room[at])
            room[at] -= lengths[i]


def test_a_text_of_ten_thousand_pieces(spark):
    frame = spark.createDataFrame([(1, "word " * 160_000), (2, "other")], "doc_id long, text string")
    got = packing.pack(frame, tokenizer_path(), room=16, group=64, with_ids=False).toPandas()
    long = got[got.doc_id == 1].sort_values("start")
    assert len(long) == 10_001 and (long.start == np.arange(0, 160_016, 16)).all() and long.length.sum() == 160_001
    assert got.groupby("sequence_id").length.sum().max() <= 16


def test_null_ids_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten, call +1 (017) 555-7713 password=abcdef12"
    frame = spark.createDataFrame([(None, text), (None, None), (1, text), (1, text), (2, "")], "doc_id long, text string")
    docs = frame.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    every = ids(docs)
    for made in (packing.pack(docs, tokenizer_path()), ngram_join.near_duplicate_components(docs), secrets.scan_secrets(docs), kneser_ney.judge(docs, labels), weak_rules.judge(docs), mixing.taken_words(docs), surrogates.replace_personal_data(docs)):
        assert ids(made) == every
    assert ids(order_minhash.compare_with_next(docs)) == every
    assert {r.component_id for r in ngram_join.near_duplicate_components(docs).collect() if r.n_shingles} == {1}
    assert ids(ngram_join.one_of_each(docs)) == sorted([None, None, 1, 2], key=str)


def test_clashing_columns(spark):
    names = ["text_key", "row", "_key", "_nth", "_cut", "_new", "_runs", "_size", "_source", "_s", "_w", "_bits", "maybe", "first", "cls", "n", "h", "block", "_mix", "trusted", "kind"]
    text = "one two three four five six seven eight nine ten. token = abcdef123456 "
    rows = [(i, text + f"more {i} words here {i * 7}", "en", ["a", "b"][i % 2], 5, *[i] * len(names)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    for made in (kneser_ney.kept_documents(docs, labels), ngram_join.one_of_each(docs), secrets.redact_secrets(docs), mixing.mixed_documents(docs)):
        assert made.columns == docs.columns
        assert all(r["text_key"] == r["doc_id"] == r["row"] == r["_mix"] for r in made.collect())
    assert all("abcdef" not in r.text for r in secrets.redact_secrets(docs).collect())
    pages = spark.createDataFrame([(1, "u", None, 3), (1, "u", "<p>a", 3), (None, None, "<p>a", 3)], "page_id long, url string, html string, text long")
    assert sorted(r.text for r in html_extract.extract_pages(pages).collect()) == ["", "a", "a"]
