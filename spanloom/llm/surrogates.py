"""Personal data replaced by keyed surrogates.

Detected: e-mail addresses, telephone numbers, card numbers, IPv4 and IPv6 addresses, social security numbers, IBANs and
names: after a form of address, a known given name with a surname, or capitalised words where a name is announced ("my name
is", "Author:", "Dear"). What a text calls a name once is one wherever it stands in that text. Names that nothing announces
and whose given name isn't listed stay; tests/llm states the recall on labelled sentences.

Every distinct entity of all documents gets one surrogate, made from a keyed hash of its type and canonical form, so all its
mentions agree in whatever format they are written (coreference). A surrogate keeps the type: letters stay letters of their
script, digits stay digits, a card number keeps whether its check digit is right, a telephone number its country code, an
address its separators, a given name its gender and script.

Collision checks keep entities apart: of entities with the same surrogate only the first keeps it, and none may be the
canonical form of a real entity; the others draw again, until all differ. With every attempt after the first a surrogate
grows, so a short format or a short list of names never runs out; one that still collides after ROUNDS gets 24 more
characters of its hash. These checks are joins over the table of distinct entities, whichever size it has. Documents without
any candidate are never shuffled.

Null text stays null. Equal texts get equal results, repeated rows stay repeated, a null doc_id is kept as it is, and other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stash

KEY = b"set a secret key of your own"
ROUNDS = 12
LAST = 24

# Given names by script and gender, and forms of address by gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Carla Clara Elena Emma Greta Hanna Ines Julia Karin Laura Lena Lucia Maria Marie Marta Nina Paula Sarah Sofia Sophie Teresa Vera".split(),
    ("latin", "m"): "Adam Albert Bruno Carlos Daniel David Erik Felix Georg Hugo Jacob James Javier John Jonas Julien Karl Louis Luis Martin Michael Paul Peter Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Татьяна Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Михаил Олег Павел Юрий".split(),
}
CUES = ["My name is", "my name is", "Name is", "name is", "Name:", "Author:", "Contact:", "Signed:", "Signed by", "signed by", "Dear", "Regards,", "Sincerely,", "Autor:", "Auteur :", "Liebe", "Lieber", "Cher", "Chère", "Querido", "Querida"]
# Country codes of one and of two digits; all others have three.
CODES = {1: ("1", "7"), 2: ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")}
ADDRESS = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "", "Prof": "", "господин": "m", "госпожа": "f"}

_GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
_NAME = r"[^\W\d_a-zà-öø-ÿа-я]+(?:['’-]?[^\W\d_]+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FINDERS = [
    ("email", re.compile(r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")),
    ("ipv6", re.compile(r"(?<![\w:])(?=[0-9a-fA-F:]*::[0-9a-fA-F]|(?:[0-9a-fA-F]{1,4}:){7})(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{1,4}(?![\w:])")),
    ("ip", re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)")),
    ("card", re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,4}){1,4}|\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|(?<![\w.,:/-])(?!\d{3}\.\d{3}\.\d{3}(?!\d))(?!(?:19|20)\d\d-)\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?![.-]?\d))(?!\w)")),
]
_PERSON = re.compile(rf"(?<!\w)(?:(?P<address>{'|'.join(ADDRESS)})\.? (?P<called>{_NAME}(?: {_NAME}){{0,2}})|(?P<given>{'|'.join(_GENDER)}) (?P<family>{_NAME})|(?:{'|'.join(map(re.escape, CUES))}) (?P<told>{_NAME}(?: {_NAME}){{1,2}}))(?!\w)")
# A row that has none of these has no entity: looked for before any row leaves the JVM. All begin with a letter of the first
# class, so most places are passed with one look.
_NAMED = [*ADDRESS, *_GENDER, *CUES]
_FIRST = "".join(sorted({name[0] for name in _NAMED}))
HINT = rf"(?=[@:\d{_FIRST}])(?:@|\d{{3}}|\d\.\d|\d[ -]\d|(?<=[0-9a-fA-F]):[0-9a-fA-F:]|(?U)\b(?:{'|'.join(_NAMED)})(?:\b|(?<=[:,])))"


def _script(word: str) -> str:
    return "cyrillic" if any("CYRILLIC" in unicodedata.name(c, "") for c in word[:3]) else "latin"


class _Spans:
    """Spans that don't overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.held: list[tuple[int, int, str, str]] = []

    def add(self, start: int, end: int, kind: str, form: str) -> bool:
        """Takes the span if it is free."""
        at = bisect.bisect_left(self.starts, start)
        if at and self.held[at - 1][1] > start or at < len(self.held) and self.held[at][0] < end:
            return False
        self.starts.insert(at, start)
        self.held.insert(at, (start, end, kind, form))
        return True


def country_code(digits: str) -> str:
    return next((digits[:n] for n, codes in CODES.items() if digits[:n] in codes), digits[:3])


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form), not overlapping, in order; earlier finders win."""
    spans = _Spans()
    for kind, finder in FINDERS:
        if kind == "email" and "@" not in text or kind == "ipv6" and ":" not in text:
            continue
        for m in finder.finditer(text):
            form = m[0].lower() if kind in ("email", "ipv6") else m[0] if kind == "ip" else re.sub(r"[^0-9A-Z]", "", m[0])
            spans.add(*m.span(), kind, "+" + form if kind == "phone" and m[0][0] == "+" else form)
    told: dict[str, tuple[str, str]] = {}
    for m in _PERSON.finditer(text):
        group = "called" if m["called"] else "told" if m["told"] else "given"
        gender = ADDRESS[m["address"]] if m["address"] else "" if m["told"] else _GENDER[m["given"]][1]
        words = list(re.finditer(r"[^ ]+", text[m.start(group) : m.end()]))
        for i, w in enumerate(words):
            known = _GENDER.get(w[0])
            first = known is not None or i < len(words) - 1
            kind = f"given-{known[1] if known else gender or 'm'}-{_script(w[0])}" if first else f"family-{_script(w[0])}"
            form = w[0].casefold()
            if spans.add(m.start(group) + w.start(), m.start(group) + w.end(), kind, form):
                told.setdefault(w[0], (kind, form))
    if told:
        for m in re.finditer(rf"(?<!\w){_NAME}(?!\w)", text):
            if m[0] in told:
                spans.add(*m.span(), *told[m[0]])
    return spans.held


class _Stream:
    """Numbers from a keyed hash of what the surrogate is for."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.n = hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), 0

    def below(self, n: int) -> int:
        self.n += 1
        return int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()[:8], "big") % n


def _like(c: str, s: _Stream) -> str:
    """A character of the same class, case and script."""
    if c.isdigit():
        return str(s.below(10))
    if not c.isalpha():
        return c
    letters = "абвгдежзиклмнопрстуфхцчшэюя" if "CYRILLIC" in unicodedata.name(c, "") else "abcdefghijklmnopqrstuvwxyz"
    made = letters[s.below(len(letters))]
    return made.upper() if c.isupper() else made


def _luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The canonical form of the surrogate; never empty. Attempts after the first make it longer."""
    s = _Stream(key, kind, form, attempt)
    more = LAST if attempt >= ROUNDS else max(0, attempt - 1)
    digits = lambda n: "".join(str(s.below(10)) for _ in range(n))
    if kind == "email":
        local, _, domain = form.partition("@")
        grown = "".join("abcdefghijklmnopqrstuvwxyz"[s.below(26)] for _ in range(more))
        return "".join(_like(c, s) for c in local) + grown + "@" + "".join(_like(c, s) for c in domain.rpartition(".")[0]) + ".example"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4 + more))
    if kind == "card":
        made = digits(len(form) + more)
        right = (int(made[-1]) - _luhn(made)) % 10
        return made[:-1] + str(right if _luhn(form) == 0 else (right + 1 + s.below(9)) % 10)
    if kind == "iban":
        return form[:2] + "".join(_like(c, s) for c in form[2:]) + digits(more)
    if kind == "ipv6":
        return "".join("0123456789abcdef"[s.below(16)] if c != ":" else c for c in form) + "".join(f":{s.below(65536):x}" for _ in range(more))
    if kind.startswith("given"):
        _, gender, script = kind.split("-")
        return "-".join(GIVEN[script, gender][s.below(len(GIVEN[script, gender]))] for _ in range(1 + attempt if attempt < ROUNDS else LAST)).casefold()
    if kind.startswith("family"):
        parts = ("ва ле ми но ра со ти ку де ги пло бре".split() if kind.endswith("cyrillic") else "bar len mir nos rad sol tin kov del gar plo bre wen hal dor fis".split())
        ends = ("ов ин ский ко".split() if kind.endswith("cyrillic") else "er man son ley ard ez".split())
        return "".join(parts[s.below(len(parts))] for _ in range(2 + more)) + ends[s.below(len(ends))]
    kept = len(country_code(form[1:])) + 1 if form.startswith("+") else 0
    return form[:kept] + "".join(_like(c, s) for c in form[kept:]) + digits(more)


def render(mention: str, kind: str, form: str) -> str:
    """The surrogate in the format of this mention; what it is longer stands at the end. Different forms give different texts."""
    if kind in ("email", "ipv6"):
        return form.upper() if mention.isupper() else form
    if kind == "ip":
        return form
    if kind.startswith(("given", "family")):
        return form.upper() if mention.isupper() and len(mention) > 1 else "-".join(p[:1].upper() + p[1:] for p in form.split("-"))
    rest = iter(form.removeprefix("+"))
    return "".join(next(rest) if c.isdigit() or c.isalpha() and c.isupper() else c for c in mention) + "".join(rest)


def entity_table(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, form, made) for the distinct entities in `found` (kind, form)."""
    @F.pandas_udf("string")
    def draw(kind: pd.Series, form: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, f, a) for k, f, a in zip(kind, form, attempt, strict=True)], dtype=object)

    # Names of whichever sort must differ from all names.
    space = F.when(F.col("kind").rlike("^(given|family)"), F.lit("name")).otherwise(F.col("kind"))
    real = stash(found.select("kind", "form").distinct(), "entities")
    taken = real.select(space.alias("space"), F.col("form").alias("made"), F.lit(True).alias("taken")).distinct()
    now = stash(real.withColumn("attempt", F.lit(0)).withColumn("made", draw("kind", "form", "attempt")), "surrogates")
    for _ in range(ROUNDS):
        # One e-mail may not become another's surrogate; of a shared surrogate, the earliest attempt and least form keeps it.
        now = now.withColumn("space", space)
        first = now.groupBy("space", "made").agg(F.min(F.struct("attempt", "form", "kind")).alias("owner"))
        checked = now.join(first, ["space", "made"]).join(taken, ["space", "made"], "left")
        again = F.col("taken").isNotNull() | (F.col("owner.form") != F.col("form")) | (F.col("owner.kind") != F.col("kind"))
        checked = stash(checked.select("kind", "form", "attempt", "made", again.alias("again")), "surrogates")
        if not checked.filter("again").limit(1).count():
            return checked.select("kind", "form", "made")
        redo = checked.filter("again").withColumn("attempt", F.col("attempt") + 1).withColumn("made", draw("kind", "form", "attempt"))
        now = stash(checked.filter("not again").drop("again").unionByName(redo.drop("again")), "surrogates")
    return now.select("kind", "form", "made")


def replace_personal_data(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, text, n_entities, entities): texts with surrogates; entities lists kind:start:end in the old text."""
    given = docs.select("doc_id", "text")
    hit = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    hits = given.filter(hit).withColumn("text_key", F.xxhash64("text"))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, entities = Counter(), {}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                copies[k] += 1
                if k not in entities:
                    entities[k] = {(kind, form) for _, _, kind, form in find(t)}
            rows = [(k, kind, form, copies[k]) for k, own in entities.items() for kind, form in own]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["text_key", "kind", "form", "copies"])

    seen = hits.select("text_key", "text").mapInArrow(detect, "text_key long, kind string, form string, copies long")
    found = stash(seen.groupBy("text_key", "kind", "form").agg(F.sum("copies").alias("copies")), "found")
    table = entity_table(found, key).select(F.struct("kind", "form").alias("entity"), "made")
    # An address may stand in a third of all texts, and a third of all rows may be copies of one text.
    placed = join_hot(found.select("text_key", F.struct("kind", "form").alias("entity")), table, "entity", "inner")
    own = stash(placed.groupBy("text_key").agg(F.collect_list(F.struct("entity.kind", "entity.form", "made")).alias("table")), "entities-of-texts")
    rows_of = found.groupBy("text_key").agg(F.max("copies").alias("_n"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts, counts, lists = [], [], []
                for text, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    made = {(r["kind"], r["form"]): r["made"] for r in rows or ()}
                    out, last, spans = [], 0, find(text)
                    for a, b, kind, form in spans:
                        out += [text[last:a], render(text[a:b], kind, made[kind, form])]
                        last = b
                    texts.append("".join([*out, text[last:]]))
                    counts.append(len(spans))
                    lists.append(",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(lists, pa.string())], ["doc_id", "text", "n_entities", "entities"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    changed = join_hot(hits, own, "text_key", counts=rows_of).select("doc_id", "text", "table").mapInArrow(apply, f"doc_id {kind}, text string, n_entities long, entities string")
    plain = given.filter(~hit).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entities"))
    return changed.unionByName(plain)
