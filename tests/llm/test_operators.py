"""Each operator against a plain version, on rows with nulls, empty and long texts, copies and clashing column names."""

import collections
import hashlib
import random
import re
import string
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import html_extract, kneser_ney, langid, mixing, ngram_join, order_minhash, packing, secrets, surrogates, weak_rules
from spanloom.llm.queries import tokenizer_path

LETTERS = string.ascii_lowercase
WORD = re.compile("[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    base = make(120)
    near = [" ".join(w if rng.random() > p else "edit" for w in base.split()) for p in [0.004] * 40 + [0.03] * 20]
    passage = make(60)
    shared = [make(30) + " " + passage + " " + make(rng.randint(5, 300)) for _ in range(40)]
    plain = [make(rng.randint(1, 200)) for _ in range(40)]
    odd = [None, "", " \n\t ", "a", "a b c d", "x" * 5000, make(3000), "Élan ß Ω 文字 😀 token: abcdef123", "a\n\na\na b"]
    return [*near, *shared, *plain, *odd, base, base, base.upper()]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, t, ["en", "de", None][i % 3], ["s1", "s1", "s2", None][i % 4], len(t or ""), i, "x") for i, t in enumerate(texts())]
    made.append(made[3])  # a repeated row
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cls long, block string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return docs.filter("doc_id < 0")


def test_ngram_join(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = ngram_join.near_duplicate_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets[i]), find(i)) for i, *_ in rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(i for i in sets if find(i) == i)
    assert ngram_join.near_duplicate_components(empty).count() == 0


def test_secrets(docs, rows, empty):
    finders = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6), ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24)]

    def base(t):
        found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, n) in enumerate(finders) for m in p.finditer(t or "") if len(m[2] if kind == "assign" else m[0]) >= n]
        return hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()

    got = secrets.scan_secrets(docs).collect()
    assert sorted((r.doc_id, r.base_sha256) for r in got) == sorted((i, base(t)) for i, t, *_ in rows)
    assert secrets.redact_secrets(docs).columns == docs.columns and secrets.redact_secrets(docs).count() == len(rows)
    assert secrets.scan_secrets(empty).count() == 0


def test_weak_parts_need_a_partner(spark):
    key = "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9v"
    frame = spark.createDataFrame([(1, f"just {key} here"), (2, f"user=bob {key}"), (3, f"user=bob {'far ' * 200}{key}"), (4, "user=bob alone")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.scan_secrets(frame).collect()} == {1: "", 2: "login:0:8,mixed:9:37", 3: "", 4: ""}


def test_weak_rules(docs, rows, empty):
    def plain(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))

    got = weak_rules.judge(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((i, *plain(t)) for i, t, *_ in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert weak_rules.judge(empty).count() == 0


def test_weak_rules_fit():
    """The estimate over vote patterns is that over single documents, finds planted accuracies, and turns majorities."""
    rng = random.Random(7)
    ways, n = [(0, 1), (2, 3, 4)], 5
    common, good = [0.8, 0.12, 0.08], [[0.98, 0.97, 0.99, 0.9, 0.97], [0.1, 0.15, 0.95, 0.9, 0.97], [0.95, 0.96, 0.1, 0.3, 0.2]]
    docs_ = []
    for _ in range(60_000):
        c = rng.choices(range(3), common)[0]
        docs_.append(tuple((int(rng.random() < good[c][i]) if rng.random() < 0.9 else None) for i in range(n)))
    fitted = weak_rules.fit(list(collections.Counter(docs_).items()), ways, n)
    assert np.allclose(fitted[0], common, atol=0.03) and np.allclose(fitted[1], good, atol=0.1)
    # Plain expectation-maximisation, a document at a time, with arrays.
    first = [np.array(x) for x in weak_rules.start(ways, n)]
    v = np.array([[np.nan if x is None else x for x in d] for d in docs_[:500]])
    p, q = first
    for _ in range(30):
        logs = np.log(p) + np.stack([np.nansum(np.log(np.where(v == 1, row, 1 - row)) * ~np.isnan(v), axis=1) for row in q], axis=1)
        r = np.exp(logs - logs.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        said, voted = r.T @ np.nan_to_num(v), r.T @ (~np.isnan(v)).astype(float)
        p, q = (r.sum(axis=0) + 10 * first[0]) / (len(v) + 10), np.clip((said + 10 * first[1]) / (voted + 10), 0.0001, 0.9999)
        for c, own in enumerate(ways):
            q[c + 1, own] = np.minimum(q[c + 1, own], q[0, own])
    short = weak_rules.fit(list(collections.Counter(docs_[:500]).items()), ways, n, rounds=30)
    assert np.allclose(short[0], p) and np.allclose(short[1], q)
    # Two bad votes of a way outweigh three good ones; one bad vote of a rule that blames good documents often doesn't count.
    assert weak_rules.shares(fitted, (0, 0, 1, 1, 1))[0] < 0.5 < weak_rules.shares(fitted, (1, 1, 1, 0, 1))[0]


def test_mixing(docs, rows, empty):
    got = mixing.taken_words(docs, block=16).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    assert all(r.taken <= 3 * r["size"] for r in got)
    by = {r.doc_id: r for r in got}
    taken, want = collections.Counter(), {}
    for i, _, _, s, *_ in rows:
        want[s] = by[i].target
    for r in got:
        taken[rows[r.doc_id][3]] += r.taken
    assert all(abs(taken[s] - w) <= 0.02 * w + 32 for s, w in want.items())
    words = collections.Counter()
    for r in mixing.mixed_documents(docs, block=16).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    total = collections.Counter()
    for r in got:
        total[r.doc_id] += r.taken
    assert words == collections.Counter({k: v for k, v in total.items() if v})
    assert mixing.taken_words(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.targets([("a", 100), ("b", 10), (None, 10)]) == {"b": 30.0, None: 30.0, "a": 60.0}


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    got = packing.pack(docs, tokenizer_path(), group=50).collect()
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32 and bytes(r.ids) == piece.tobytes() and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, *_ in rows)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_order_minhash(docs, rows, empty):
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in order_minhash.compare_with_next(docs).collect()}
    distinct = list(dict.fromkeys((r[0], r[1] or "") for r in order))
    for k, (i, t) in enumerate(distinct):
        after = distinct[(k + 1) % len(distinct)][1]
        if i != 3:  # the repeated row follows itself
            assert got[i].edited_sha256 == hashlib.sha256(order_minhash.edited(t, after).encode()).hexdigest() and got[i].n_chars == len(t)
    assert order_minhash.likeness(order_minhash.fingerprint("same text here"), order_minhash.fingerprint("same text here")) == 1
    assert order_minhash.compare_with_next(empty).count() == 0


def test_order_matters():
    a, b = "one side of the text, long enough to count. ", "another side of it, also with words of its own. "
    f = order_minhash.fingerprint
    assert order_minhash.likeness(f(a + b), f(a + b)) == 1 > order_minhash.likeness(f(a + b), f(b + a))


def test_language_filters(spark, empty):
    rng = random.Random(1)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    made = [(i, make(["ba", "lo", "mi"] if i % 2 else ["str", "ch", "un"]), "aa" if i % 2 else "bb") for i in range(60)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    filters = langid.train(frame.filter("doc_id < 40"))
    got = langid.predict(frame.filter("doc_id >= 40"), filters).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") and 0 < r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "½ ² Ⅷ ①")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.predict(odd, filters).collect()} == {"und"}
    assert langid.train(empty).langs == []


def test_grams_are_those_of_a_plain_version():
    words = ["a", "ab", "abab", "über", "文字", "x" * 3000, "abc", "ab"]
    hashes, owners = langid.grams_of(words)
    got = [collections.Counter(hashes[owners == i].tolist()) for i in range(len(words))]
    plain = [collections.Counter([*(f"^{w}$"[i : i + n] for n in (2, 3, 4) for i in range(len(w) + 3 - n)), f"={w}"]) for w in words]
    assert [sorted(c.values()) for c in got] == [sorted(c.values()) for c in plain]
    for i in range(len(words)):
        for k in range(len(words)):
            assert (got[i] & got[k]).total() == (plain[i] & plain[k]).total()
    assert len(langid.grams_of([])[0]) == 0


def test_kneser_ney(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 100, 2)], "doc_id long, quality int, toxic int")
    near, far = kneser_ney.judge(docs, labels).collect(), kneser_ney.judge(docs, labels, most=0).collect()
    key = lambda r: (r.doc_id, round(float(np.log(r.perplexity)), 6) if r.perplexity else None, r.kept)
    assert sorted(map(key, near), key=str) == sorted(map(key, far), key=str) and len(near) == docs.count()
    assert kneser_ney.kept_documents(docs, labels).columns == docs.columns
    assert kneser_ney.judge(empty, labels).count() == 0


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head &amp; more</h1><p>Some text,<br>with   commas, here.<p>And <b>more.</b><div class='comments'><p>Me, too.</p></div></article><footer>f</footer>"
    assert html_extract.main_text(page) == "Head & more\nSome text, with commas, here.\nAnd more."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"


PARA = "<p>" + "Some long paragraph of text, with commas, and more words than a menu has, so it counts. " * 3 + "</p>"


@pytest.mark.parametrize("name", ["page has-sidebar", "layout-with-nav", "post no-comments", "entry-content post-message", "post-header-wrap", "container share-enabled"])
def test_html_wrappers_with_bad_names(name):
    page = f"<html><body><div class='{name}'>{PARA * 5}<div class='comments'><p>I say, this, and that.</p></div></div></body></html>"
    assert html_extract.main_text(page).count("\n") == 4 and "I say" not in html_extract.main_text(page)


def test_html_headings_articles_and_depth():
    page = f"<body><header><h1>Site</h1></header><article><div class='post-header'><h1>Title</h1><p>by me</p></div>{PARA}</article></body>"
    assert html_extract.main_text(page).startswith("Title\nSome long")
    for n in (1, 2, 3, 4):
        page = "<body><div>" + f"<article>{PARA}</article>" * n + "<article><p>teaser</p></article></div></body>"
        assert html_extract.main_text(page).count("Some long") == 3 * n and "teaser" not in html_extract.main_text(page)
    began = time.process_time()
    assert html_extract.main_text("<b>x" * 20_000 + "<div>" + "<i>" * 20_000 + "deep").endswith("deep") and time.process_time() - began < 5


def test_html_scores_are_those_of_a_plain_scorer():
    """On generated trees: points by recursion over nested lists instead of ranges of nodes."""
    rng = random.Random(8)

    def grow(depth):
        return [grow(depth + 1) if depth < 4 and rng.random() < 0.5 else "word, " * rng.randint(0, 40) + "end" for _ in range(rng.randint(1, 4))]

    def worth(t):
        return 1 + t.count(",") + min(len(t) / 100, 3) if len(t) >= 25 else 0.2

    def points(node, level=0):
        own = sum(worth(x) for x in node if isinstance(x, str)) * (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12)[level]
        return own + sum(points(x, level + 1) for x in node if not isinstance(x, str) and level < 4)

    def write(node):
        return "<div>" + "".join(f"<p>{x}</p>" if isinstance(x, str) else write(x) for x in node) + "</div>"

    def all_of(node):
        return [points(node), *(p for x in node if not isinstance(x, str) for p in all_of(x))]

    for _ in range(50):
        made = grow(0)
        tree = html_extract.Tree(write(made))
        got = [p for p, tag in zip(html_extract.node_points(tree), tree.tag, strict=True) if tag == "div"]
        assert np.allclose(got, all_of(made))


def test_surrogates(spark, docs, rows, empty):
    made = [(1, "write a.b@x.org or A.B@X.ORG, call +1 (017) 555-7713, card 4111111111111111, at 10.1.2.3"), (2, "a.b@x.org again, not c.d@x.org"), (3, None), (4, "Mr John Smith met Mrs Smith")]
    got = {r.doc_id: r for r in surrogates.replace_personal_data(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[3].text is None and got[1].n_entities == 5 and got[4].n_entities == 3
    for secret in ("a.b@x.org", "555-7713", "4111111111111111", "10.1.2.3", "c.d@x.org"):
        assert all(secret not in (r.text or "").lower() for r in got.values())
    first = got[2].text.split()[0]
    assert got[1].text.count(first) + got[1].text.lower().count(first) >= 2 and first != got[2].text.split()[-1]
    assert got[4].text.split()[2] == got[4].text.split()[-1]
    assert surrogates.replace_personal_data(docs).count() == len(rows) and surrogates.replace_personal_data(empty).count() == 0


def test_surrogates_that_collide(spark):
    """Short formats and lists that run out: surrogates grow, all differ once rendered, and none is a real entity."""
    made = [("ssn", f"{i:03d}") for i in range(300)]
    made += [("email", f"{a}@{b}.{c}") for a in LETTERS for b in LETTERS for c in ("com", "org", "net", "de", "fr", "es", "it", "nl")][:5000]
    made += [("phone", f"+49{i:07d}") for i in range(20_000)]
    made += [("given-f-latin", f"name{i}") for i in range(100_000)]
    rows = spark.createDataFrame(made, "kind string, form string").repartition(8)
    got = surrogates.entity_table(rows).collect()
    assert len(got) == len(made)
    shown = {(r.kind, surrogates.render(r.form.title() if "-" in r.kind else f"+49 {r.form[3:6]} {r.form[6:]}" if r.kind == "phone" else r.form, r.kind, r.made).casefold()) for r in got}
    assert len(shown) == len(made) and not {(r.kind, r.made) for r in got} & set(made)
    assert all(r.made.startswith("+49") for r in got if r.kind == "phone")
    assert len(surrogates.surrogate(b"k", "ssn", "003", surrogates.ROUNDS)) == 3 + surrogates.LAST


def test_names_found_in_labelled_sentences():
    """What is found of persons, and what is wrongly taken for one, on sentences labelled by hand."""
    labelled = [("My name is Priya Patel, hello.", 2), ("Dear Wei Zhang,", 2), ("Author: Kwame Mensah", 2), ("Mr Obi called.", 1), ("Julia Roth wrote to Frau Meier.", 3), ("Ольга Петрова пришла.", 2),
                ("Signed by Ingrid Olsen. Later Olsen left.", 3), ("Herr Peter Schmidt", 2), ("Amara Okafor came by.", 2), ("Contact: José Ruiz Soler", 3),
                ("The House of Commons met.", 0), ("Dear customer, hello", 0), ("New York is large.", 0), ("On 2024-01-15 1234 5678 came", 0), ("a total of 123.456.789 items", 0), ("Anna alone", 0), ("15.03.2024 123 4567", 0)]
    persons = [len([x for x in surrogates.find(t) if x[2].startswith(("given", "family"))]) for t, _ in labelled]
    right, wanted = sum(min(p, n) for p, (_, n) in zip(persons, labelled, strict=True)), sum(n for _, n in labelled)
    assert right / wanted >= 0.9 and all(p <= n for p, (_, n) in zip(persons, labelled, strict=True))
    assert not [x for t, n in labelled if not n for x in surrogates.find(t)]


def test_finding_is_linear():
    text = " ".join(f"a{i}@b.com" for i in range(20_000))
    began = time.process_time()
    assert len(surrogates.find(text)) == 20_000 and time.process_time() - began < 5


def test_word_ids_equal_those_of_whole_texts():
    words = packing.Encoder(tokenizer_path())
    texts = ["", "It's, 'S. JOHN'LL!? A.B., ½. x١, ΣΑΣ. İ! J̌, é, É! don't'd, क़, a\tb\u00a0C, ...", "<|x, Word", "word, Word. WORD!\nword;;"]
    rng = random.Random(2)
    pool = "aaaäßéİKΩक़x١½²''.,!?;:-_%$ \n\t ǅﬁ文字가각́é😀<|\r\x0b\x85\u3000≮̸sStTéÉ09"
    texts += [None, *("".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(5000))]
    for text, ids in zip((t or "" for t in texts), words.encode(pa.array(texts)).to_pylist(), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_templates_that_link_with_nothing_cost_little(spark, monkeypatch):
    """Pages that share 60 % of their text: what is verified and shipped stays near their number."""
    rng = random.Random(9)
    template = " ".join(f"t{i}" for i in range(60))
    pages = [(i, template + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(40))) for i in range(3000)]
    shipped = []
    verified, places = ngram_join.verified, ngram_join._places
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: (shipped.append(pairs.count()), verified(pairs, *rest))[1])
    monkeypatch.setattr(ngram_join, "_places", lambda *given: (lambda p: (shipped.append(p.count()), p)[1])(places(*given)))
    got = ngram_join.near_duplicate_components(spark.createDataFrame(pages, "doc_id long, text string").repartition(4))
    assert got.filter("doc_id <> component_id").count() == 0 and got.count() == 3000
    assert len(shipped) == 2 and sum(shipped) < 3000


def test_groups_of_many_members(spark, monkeypatch):
    """Different sets with identical prefix and size, in groups too large to be paired out, lose no link."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts_ = []
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 1, 2, 3])):
            words[at] = f"x{rng.randrange(10**6)}"
        texts_.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "EXPAND", 2)
    # One group for all sets of a size: expansion and verification alone must tell them apart.
    monkeypatch.setattr(ngram_join, "_group_of", lambda prefix, n: n)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for t in texts_]
    up = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    got = ngram_join.near_duplicate_components(frame).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(up))
