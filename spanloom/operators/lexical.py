"""Typed spans of texts: tokens by class, markers, conditions and what follows from them, roles, and what covers what."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CLASSES, HELD, HOLDERS, MARKERS, ROLE, SENTENCE, STOP_WORDS, marker, match_arrays, match_rows, overlap_join, running
from ..sources.tables import INCIDENT_SQL, dialogue_texts, incident_notes, read
from .structured import SAID_SQL, dialogue_turns


def _placed(lists: pa.Array, held: list[int], holders: list[int]) -> pa.Array:
    """The running sums of each pattern's lengths, without those of matches of the patterns `held` that begin in one of `holders`:
    all texts of a batch on one axis, each in a stretch of its own. A text's lengths are one list a pattern, gaps and matches in turn."""
    inner, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    ends = running(lists).flatten()
    starts = ends.flatten().to_numpy(zero_copy_only=False) - inner.flatten().to_numpy(zero_copy_only=False)
    sizes = inner.value_lengths().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    pattern = np.repeat(np.concatenate([np.arange(n) for n in counts] or [np.zeros(0, int)]), sizes)
    stops = ends.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.repeat(np.arange(len(lists)), counts), sizes) * (1 + stops.max(initial=0))
    match = (np.arange(starts.size) - np.repeat(bounds[:-1], sizes)) % 2 == 1
    of = lambda which: np.flatnonzero(match & np.isin(pattern, which))
    among, at = of(holders), of(held)
    among = among[np.argsort((starts + row)[among], kind="stable")]
    reach = np.concatenate([[-1], np.maximum.accumulate((stops + row)[among])])
    gone = np.zeros(starts.size, bool)
    gone[at] = reach[np.searchsorted((starts + row)[among], (starts + row)[at], "right")] > (starts + row)[at]
    cuts = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    return pa.ListArray.from_arrays(cuts(counts), pa.ListArray.from_arrays(cuts(sizes), pa.array(stops, mask=gone)))


def typed_lists(texts: DataFrame, classes: list[str]) -> DataFrame:
    """(source_id, found): per text that isn't null and class in order an array of its spans (class, start, end, lexeme). Numbers
    and hexadecimal identities that start in a date or version are part of it, and single capitalised stop words are no names."""
    tried = [k for k in CLASSES if k in classes or k in HOLDERS and set(HELD) & set(classes)]
    index = lambda names: [i for i, k in enumerate(tried) if k in names]
    places = F.arrow_udf(lambda lists: _placed(lists, index(HELD), index(HOLDERS)), "array<array<bigint>>")
    free = lambda m: ~m["lexeme"].isin(*STOP_WORDS)
    rows = match_arrays(texts, ["source_id"], "text", {k: CLASSES[k] for k in tried}, places)
    wanted = [F.filter(f, free) if k == "entity.named" else f for k in classes for f in [F.get("found", F.lit(tried.index(k)))]]
    return rows.select("source_id", F.array(*wanted).alias("found"))


def typed_rows(texts: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """All typed spans of texts (source_id, text), or those of some classes, one a row."""
    return typed_lists(texts, classes or list(CLASSES)).select("source_id", F.explode(F.flatten("found")).alias("m")).select("source_id", "m.*")


def typed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans per class: how many, their places summed up, the smallest and the largest lexeme. Of each text only these go on, in
    a column each: grouped by class, spans would be sorted on disk, as there are texts among the sums."""
    rows = typed_lists(incident_notes(spark, sf_dir), list(CLASSES))
    summed = lambda f, c: F.aggregate(f, F.lit(0).cast("long"), lambda s, m: s + m[c])
    lexemes = lambda f: F.transform(f, lambda m: m["lexeme"])
    columns, made = [], []
    for i, name in enumerate(CLASSES):
        f = F.get("found", F.lit(i))
        columns += [F.size(f).alias(f"n{i}"), summed(f, "start").alias(f"s{i}"), summed(f, "end").alias(f"e{i}"), F.array_min(lexemes(f)).alias(f"l{i}"), F.array_max(lexemes(f)).alias(f"h{i}")]
        sums = [F.sum(f"n{i}").alias("n"), F.sum(f"s{i}").alias("starts"), F.sum(f"e{i}").alias("ends"), F.min(f"l{i}").alias("low"), F.max(f"h{i}").alias("high")]
        made.append(F.struct(F.lit(name).alias("class"), *sums))
    return rows.select(*columns).agg(F.array(*made).alias("c")).select(F.explode("c").alias("c")).select("c.*").filter("n > 0")


def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number that stands for itself, with its place."""
    return typed_rows(incident_notes(spark, sf_dir), ["numeric.number"]).select("source_id", "start", "lexeme")


def marker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of logic, policy, correction and commitment by class and lexeme."""
    rows = match_rows(incident_notes(spark, sf_dir), ["source_id"], "text", {k: marker(k) for k in MARKERS})
    return rows.groupBy("class", F.lower("lexeme").alias("lexeme")).agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


def consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions with what follows from them in their sentence: behind the first comma, else behind the marker."""
    rows = match_rows(incident_notes(spark, sf_dir), ["source_id"], "text", {"sentence": SENTENCE})
    first = F.regexp_extract("lexeme", f"({marker('logic.condition')})", 1)
    rest = F.expr("substring(lexeme, locate(condition, lexeme) + length(condition))")
    rows = rows.withColumn("condition", first).filter("condition <> ''").withColumn("rest", rest).filter(F.col("rest").rlike(r"(?i),|\bthen\b"))
    after = F.when(F.col("rest").contains(","), F.expr("substring(rest, locate(',', rest) + 1)")).otherwise(F.col("rest"))
    return rows.select("source_id", "condition", F.trim(after).alias("consequence"))


def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that commit to something or correct something, whole."""
    rows = match_rows(incident_notes(spark, sf_dir), ["source_id"], "text", {"sentence": SENTENCE})
    kind = F.array_compact(F.array(*[F.when(F.col("lexeme").rlike(marker(k)), F.lit(k)) for k in ("dialogue.commitment", "temporal.correction")]))
    return rows.select("source_id", F.explode(kind).alias("class"), F.trim("lexeme").alias("sentence"))


def role_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role labels at beginnings of lines, with the instruction that follows those of systems and developers."""
    texts = dialogue_texts(spark, sf_dir)
    rows = match_rows(texts, ["source_id"], "text", {"role.boundary": ROLE}).join(texts, "source_id")
    role = F.lower(F.regexp_replace("lexeme", r"\s*:$", ""))
    line = F.trim(F.regexp_extract(F.expr("substring(text, cast(end as int) + 1)"), r"^([^\n]*)", 1))
    return rows.select("source_id", "start", role.alias("role"), F.when(role.isin("system", "developer"), line).alias("instruction"))


def spans_of_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which typed spans lie in which sentence of a document (an interval join), counted per class."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    sentences = match_rows(docs, ["source_id"], "text", {"sentence": SENTENCE})
    words = match_rows(docs, ["source_id"], "text", {"number": r"[0-9]+", "capital": r"[A-Z][a-z]+"})
    met = overlap_join(sentences.select("source_id", "start", "end"), words, ["source_id"], contains=True)
    return met.groupBy("r.class").agg(F.count("*").alias("n"), F.countDistinct("l.source_id", "l.start").alias("sentences"))


def dialogue_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that correct the turn before them, with message ids made from place, role and digest."""
    turns = dialogue_turns(spark, sf_dir)
    turns = turns.withColumn("message_id", F.concat_ws(":", F.lit("msg"), "turn", "role", F.substring(F.sha2("text", 256), 1, 16)))
    before = F.lag("message_id").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("superseded", before).filter("superseded is not null").filter(F.col("text").rlike(marker("temporal.correction"))).select("conv_id", "message_id", "superseded")


_N = "with n as (select o_orderkey as k, o_orderdate, o_custkey, o_orderstatus, " + INCIDENT_SQL + " as t from orders), p as (select *, strpos(t, ' at ') + 3 as at_, strpos(t, ' version ') + 8 as ver, strpos(t, ' cost ') + 5 as cost, strpos(t, ' and ') + 4 as cur, strpos(t, ' share ') + 6 as share, strpos(t, ' load ') + 5 as load, strpos(t, ' for Depot') + 4 as dep, strpos(t, ' as REQ') + 3 as req, strpos(t, ' sum ') + 4 as hash from n)"
_CLASSES = _N + """, s as (
    select k, 'temporal.date' as class, 3 as start, strftime(o_orderdate, '%Y-%m-%d') as lexeme from p
    union all select k, 'temporal.timestamp', at_, k % 24 || ':' || lpad(cast(k % 60 as varchar), 2, '0') from p
    union all select k, 'identifier.version', ver, 'v2.' || k % 9 || '.' || k % 7 from p
    union all select k, 'numeric.number', at_, cast(k % 24 as varchar) from p
    union all select k, 'numeric.number', at_ + length(cast(k % 24 as varchar)) + 1, lpad(cast(k % 60 as varchar), 2, '0') from p
    union all select k, 'numeric.number', cost + 1, cast(k % 500 as varchar) from p
    union all select k, 'numeric.number', cur, k % 900 || '.5' from p
    union all select k, 'numeric.number', share, cast(k % 100 as varchar) from p
    union all select k, 'numeric.number', load, cast(k % 40 + 1 as varchar) from p
    union all select k, 'numeric.number', req + 4, cast(k as varchar) from p
    union all select k, 'numeric.currency', cost, '$' || k % 500 from p
    union all select k, 'numeric.currency', cur, k % 900 || '.5 EUR' from p
    union all select k, 'numeric.percentage', share, k % 100 || '%' from p
    union all select k, 'numeric.unit', load, k % 40 + 1 || case k % 3 when 0 then ' kg' when 1 then ' ms' else ' GB' end from p
    union all select k, 'identifier.ticket', req, 'REQ-' || k from p
    union all select k, 'identifier.hex', hash, md5(cast(k as varchar)) from p
    union all select k, 'entity.named', 0, 'On' from p
    union all select k, 'entity.named', dep, 'Depot' || o_custkey from p
    union all select k, 'entity.named', hash + 34, case o_orderstatus when 'O' then 'You' when 'F' then 'You' else 'Nobody' end from p
    union all select k, 'entity.named', strpos(t, 'If it') - 1, 'If' from p where k % 5 = 0
    union all select k, 'entity.named', strpos(t, 'We will') - 1, 'We' from p where k % 7 = 0
    union all select k, 'entity.named', strpos(t, 'Actually') - 1, 'Actually' from p where k % 7 = 0)"""
SQL = {
    "typed_spans": _CLASSES + " select class, count(*) as n, cast(sum(start) as bigint) as starts, cast(sum(start + length(lexeme)) as bigint) as ends, min(lexeme) as low, max(lexeme) as high from s group by 1",
    "number_spans": _CLASSES + " select k as source_id, cast(start as bigint) as start, lexeme from s where class = 'numeric.number'",
    "marker_spans": """with m as (select o_orderkey as k, 'policy.permission' as class, 'may' as lexeme from orders where o_orderstatus = 'O'
        union all select o_orderkey, 'policy.prohibition', 'must not' from orders where o_orderstatus = 'F' union all select o_orderkey, 'logic.negation', 'not' from orders where o_orderstatus = 'F'
        union all select o_orderkey, 'dialogue.commitment', 'must' from orders where o_orderstatus = 'F' union all select o_orderkey, 'policy.permission', 'can' from orders where o_orderstatus not in ('O', 'F')
        union all select o_orderkey, 'logic.exception', 'unless' from orders where o_orderkey % 2 = 0 union all select o_orderkey, 'logic.quantifier', 'all' from orders where o_orderkey % 2 = 0
        union all select o_orderkey, 'dialogue.commitment', 'agreed' from orders where o_orderkey % 2 = 0 union all select o_orderkey, 'logic.condition', 'if' from orders where o_orderkey % 5 = 0
        union all select o_orderkey, 'logic.quantifier', 'at least' from orders where o_orderkey % 5 = 0 union all select o_orderkey, 'dialogue.commitment', 'will' from orders where o_orderkey % 7 = 0
        union all select o_orderkey, 'temporal.correction', 'actually' from orders where o_orderkey % 7 = 0)
        select class, lexeme, count(*) as n, count(distinct k) as sources from m group by 1, 2""",
    "consequences": "select o_orderkey as source_id, 'If' as condition, 'call at least once.' as consequence from orders where o_orderkey % 5 = 0",
    "obligations": """with s as (select o_orderkey as k, o_orderkey % 2 = 0 as e, case o_orderstatus when 'O' then 'You may enter' when 'F' then 'You must not enter' else 'Nobody can enter' end as r, o_orderstatus = 'F' as must from orders)
        select k as source_id, 'dialogue.commitment' as class, r || case when e then ' unless all agreed.' else '.' end as sentence from s where must or e
        union all select k, 'dialogue.commitment', 'We will pay.' from s where k % 7 = 0 union all select k, 'temporal.correction', 'Actually the sum changed.' from s where k % 7 = 0""",
    "role_boundaries": """select conv_id as source_id, cast(coalesce(sum(length(role) + length(text) + 3) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as start, role,
        case when role in ('system', 'developer') then trim(replace(text, chr(10), ' '), ' ') end as instruction from conversations""",
    "spans_of_sentences": """with m as (select doc_id, regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]|$)') as s from documents), x as (select doc_id, unnest(range(len(s))) as i, unnest(s) as lex from m),
        w as (select doc_id, i, 'number' as class, unnest(regexp_extract_all(lex, '[0-9]+')) as w from x union all select doc_id, i, 'capital', unnest(regexp_extract_all(lex, '[A-Z][a-z]+')) from x)
        select class, count(*) as n, count(distinct (doc_id, i)) as sentences from w group by 1""",
    "dialogue_corrections": """with c as (select conv_id, turn, role, text || """ + SAID_SQL + """ as text from conversations), t as (select *, 'msg:' || turn || ':' || role || ':' || substr(sha256(text), 1, 16) as message_id from c), l as (select *, lag(message_id) over (partition by conv_id order by turn) as superseded from t)
        select conv_id, message_id, superseded from l where superseded is not null and list_has_any(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), ['actually', 'instead', 'correction', 'corrected', 'supersedes', 'update', 'updated'])""",
}
