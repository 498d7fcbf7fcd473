"""Secret scan with multipart credential linking. DataFrame functions only.

Strong patterns (the base kinds) are always reported. Weak ones are reported only when a part of another role, within
the same scope, complements them: a long mixed token means little alone, and a lot 80 characters after a login.

Roles: an identifier says who, a secret proves it, an endpoint says where. A weak secret needs an identifier or an
endpoint in scope; a weak identifier or endpoint needs a secret. Two parts are in one scope when their starts lie at
most `scope` code points apart. The interval join deals parts to cells of that width: a part meets its own and the two
neighbouring cells, each reduced to its first and last part per role, so a text with many parts makes no pairs.
A weak secret that overlaps a base span is that span and is dropped.

Null text counts as empty and has no span. Equal rows get equal results. A null doc_id is kept as it is. Other columns are
passed on by redact_secrets() whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_rows, stash

SCOPE = 400


@dataclass(frozen=True)
class Part:
    """A pattern: matches are leftmost and do not overlap within a kind. Group `value` must have `least` characters and
    match `also`. No match lacks `hint`, which is looked for first."""

    kind: str
    role: str
    pattern: str
    hint: str
    value: int = 0
    least: int = 0
    weak: bool = False
    also: str = ""


_WORD = r"(?i:password|passwd|secret|token|api_?key)"
_LOGIN = r"(?i:user(?:name|_?id)?|login|client_?id|account|key_?id)"
PARTS = [
    Part("assign", "secret", rf"""({_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _WORD, 2, 6),
    Part("access", "identifier", r"AKIA[A-Z0-9]{16,}", "AKIA"),
    Part("hex", "secret", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
    Part("login", "identifier", rf"""({_LOGIN})["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]+)""", _LOGIN + r"""["']?\x20*[:=]""", 2, 3, True),
    Part("mixed", "secret", r"[A-Za-z0-9+/_-]{24,}={0,2}", r"[A-Za-z0-9+/_-]{24}", weak=True, also=r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"),
    Part("endpoint", "endpoint", r"""(?:https?|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)(?::[a-z]+)?://[^\x20\x09-\x0D"'<>|]+""", "://", weak=True),
]
BASE = 3
_KEY = ["doc_id", "text_key"]


def _found(text: Column, part: Part) -> Column:
    """An array of (gap before, length, fits) for the matches of a kind, in order of text; one more element for the tail."""
    whole = F.regexp_extract_all(text, F.lit(f"({part.pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({part.pattern})"), F.lit(part.value + 1))
    rows = F.arrays_zip(F.split(text, part.pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def one(r: Column) -> Column:
        fits = F.length(r["value"]) >= part.least
        fits = fits & r["value"].rlike(part.also) if part.also else fits
        return F.struct(F.length(r["gap"]).alias("gap"), F.coalesce(F.length(r["whole"]), F.lit(0)).alias("size"), F.coalesce(fits, F.lit(False)).alias("fits"))

    return F.when(text.rlike(part.hint), F.transform(rows, one))


def secret_parts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, kind, rank, role, weak, start, end) of every part, reported or not; equal rows count once."""
    given = docs.select(F.col(doc_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hint = "|".join(p.hint for p in PARTS)
    listed = given.filter(F.col("text").rlike(hint)).select("doc_id", F.xxhash64("text").alias("text_key"), *[_found(F.col("text"), p).alias(p.kind) for p in PARTS])
    listed = listed.filter(" or ".join(f"exists({p.kind}, m -> m.fits)" for p in PARTS)).dropDuplicates(_KEY)
    kinds = F.array(*[F.struct(F.lit(p.kind).alias("kind"), F.lit(i).alias("rank"), F.lit(p.role).alias("role"), F.lit(p.weak).alias("weak"), F.col(p.kind).alias("found")) for i, p in enumerate(PARTS)])
    rows = listed.select(*_KEY, F.explode(F.filter(kinds, lambda k: F.size(k["found"]) > 1)).alias("k")).select(*_KEY, "k.kind", "k.rank", "k.role", "k.weak", F.posexplode("k.found").alias("i", "m"))
    upto = Window.partitionBy(*_KEY, "rank").orderBy("i")
    start = F.sum(F.col("m.gap") + F.col("m.size")).over(upto) - F.col("m.size")
    return rows.withColumn("start", start).filter("m.fits").select(*_KEY, "kind", "rank", "role", "weak", "start", (F.col("start") + F.col("m.size")).alias("end"))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The reported parts, with `linked`: whether a part that complements it lies in its scope."""
    along = Window.partitionBy(*_KEY).orderBy("start", "weak", "rank")
    strong = F.when(~F.col("weak"), F.col("end"))
    covered = F.max(strong).over(along.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    ahead = F.min(F.when(~F.col("weak"), F.col("start"))).over(along.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    own = parts.withColumn("covered", F.coalesce(covered, F.lit(False)) | F.coalesce(ahead, F.lit(False))).filter("not (weak and role = 'secret' and covered)").drop("covered")
    own = own.withColumn("cell", F.expr(f"start div {scope}"))
    cells = own.groupBy(*_KEY, "cell", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = own.withColumn("at", F.explode(F.expr("array(cell - 1, cell, cell + 1)"))).alias("p")
    c = cells.alias("c")
    meet = F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.text_key") == F.col("c.text_key")) & (F.col("p.at") == F.col("c.cell"))
    meet = meet & F.when(F.col("p.role") == "secret", F.col("c.role") != "secret").otherwise(F.col("c.role") == "secret")
    meet = meet & F.expr(f"c.first <= p.start + {scope} and c.last >= p.start - {scope}")
    partners = near.join(c, meet, "left_semi").select("doc_id", "text_key", "rank", "start").distinct()
    o, q = own.alias("o"), partners.alias("q")
    same = F.col("o.doc_id").eqNullSafe(F.col("q.doc_id")) & F.expr("o.text_key = q.text_key and o.rank = q.rank and o.start = q.start")
    return o.join(q, same, "left").select("o.*", F.col("q.start").isNotNull().alias("linked")).filter("not weak or linked").drop("cell")


def scan_secrets(docs: DataFrame, scope: int = SCOPE, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the digest of its base spans, all spans, how many are linked or weak."""
    spans = link_parts(stash(secret_parts(docs, doc_col, text_col), "secret-parts"), scope)
    shown = F.concat_ws(":", "kind", "start", "end")
    made = spans.groupBy(*_KEY).agg(
        *[F.count(F.when(F.col("kind") == p.kind, 1)).alias(f"n_{p.kind}") for p in PARTS],
        F.count(F.when(F.col("linked"), 1)).alias("n_linked"),
        F.array_sort(F.collect_list(F.struct("start", "rank", shown.alias("shown")))).alias("list"),
    )
    joined = lambda some: F.concat_ws(",", F.transform(some, lambda s: s["shown"]))
    made = made.withColumn("base", joined(F.filter("list", lambda s: s["rank"] < BASE))).withColumn("spans", joined(F.col("list"))).drop("list")
    keys = docs.select(F.col(doc_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")).alias("d")
    m = made.alias("m")
    both = keys.join(m, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.text_key") == F.col("m.text_key")), "left")
    counts = [F.coalesce(f"m.n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("assign", "access", "hex", "login", "mixed", "endpoint", "linked")]
    return both.select("d.doc_id", *counts, F.sha2(F.coalesce("m.base", F.lit("")), 256).alias("base_sha256"), F.coalesce("m.spans", F.lit("")).alias("spans"))


def redact_secrets(docs: DataFrame, scope: int = SCOPE, mark: str = "[secret]") -> DataFrame:
    """The documents with every reported secret part (strong ones, and weak ones that are linked) replaced by `mark`;
    other columns stay, n_chars follows the text. Identifiers and endpoints that are linked go too."""
    spans = link_parts(stash(secret_parts(docs), "secret-parts"), scope).select("doc_id", "text_key", "start", "end")
    cut = spans.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cut"))
    d = as_rows(docs).select("row", F.col("row.text").alias("text"), F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))).alias("_key")).alias("d")
    c = cut.withColumnRenamed("doc_id", "_doc").alias("c")
    both = d.join(c, F.col("d.row.doc_id").eqNullSafe(F.col("c._doc")) & (F.col("d._key") == F.col("c.text_key")), "left")
    # Text from the end of the spans so far to the start of the next; overlapping spans merge as the end only grows.
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        text = F.col("text")
        inside = s["start"] < acc["at"]
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece, F.lit(mark)))).alias("out"))

    whole = F.aggregate(F.col("_cut"), empty, step, lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    clean = both.withColumn("_new", F.when(F.col("_cut").isNotNull(), whole).otherwise(F.col("text")))
    names = {n: F.col("row")[n] for n in docs.columns} | {"text": F.col("_new")}
    if "n_chars" in names:
        names["n_chars"] = F.when(F.col("_cut").isNotNull(), F.length("_new").cast("long")).otherwise(names["n_chars"])
    return clean.select(*[c.alias(n) for n, c in names.items()])
