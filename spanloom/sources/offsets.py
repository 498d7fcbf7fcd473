"""Normalised texts and their coordinates: a byte order mark goes, every line end becomes one line feed, and ranges of either
text are translated to the other.

Only the edits are kept, with how much was removed up to each; a place is translated by the last edit that begins at or
before it (an as-of join: edits and places in one window per source). A range takes in every character that it touches, so one
that begins or ends inside \\r\\n has all of it on the other side. `texts` is (source_id, text), one row a source; null is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import domain_hash, matches, normalized
from .tables import read

EDIT = r"\A\x{FEFF}|\r\n?"


def edit_map(texts: DataFrame) -> DataFrame:
    """(source_id, i, rule, exactness, original_start, original_end, normal_start, normal_end, removed): the edits in order, with
    the number of characters removed up to the end of each; the last row, without a rule, stands at the ends of both texts."""
    rows = texts.select("source_id", F.posexplode(matches(F.coalesce("text", F.lit("")), EDIT)).alias("i", "m")).select("source_id", "i", "m.gap", "m.lexeme")
    along = Window.partitionBy("source_id").orderBy("i")
    size = F.coalesce(F.length("lexeme"), F.lit(0))
    rule = F.when(F.col("lexeme").startswith("﻿"), "remove_utf8_bom").when(F.col("lexeme").isNotNull(), "normalize_line_ending")
    rows = rows.withColumn("rule", rule).withColumn("original_end", F.sum(F.length("gap") + size).over(along))
    lost = F.when(F.col("rule") == "remove_utf8_bom", 1).when(F.col("rule").isNotNull(), size - 1).otherwise(0)
    rows = rows.withColumn("removed", F.sum(lost).over(along)).withColumn("normal_end", F.col("original_end") - F.col("removed"))
    exactness = F.when(F.col("rule") == "remove_utf8_bom", "none_deleted").when(F.col("rule").isNotNull(), "character_equivalent")
    start = F.col("normal_end") - F.when(F.col("rule") == "normalize_line_ending", 1).otherwise(0)
    return rows.select("source_id", "i", "rule", exactness.alias("exactness"), (F.col("original_end") - size).alias("original_start"), "original_end", start.alias("normal_start"), "normal_end", "removed")


def translated(ranges: DataFrame, edits: DataFrame, to: str) -> DataFrame:
    """Rows of `ranges` (source_id, range_id, start, end) with to_start and to_end in the other text, or a code: OUT_OF_BOUNDS,
    or UNKNOWN_SOURCE. `to` is normal or original. An empty range stays empty, but inside \\r\\n it becomes the line feed."""
    here, there = ("original", "normal") if to == "normal" else ("normal", "original")
    wide = F.col("end") > F.col("start")
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("at")), F.struct(F.lit(1).alias("side"), F.when(wide, F.col("end") - 1).otherwise(F.col("end")).alias("at")))
    places = ranges.select("source_id", "range_id", "start", "end", F.explode(ends).alias("p")).select("source_id", "range_id", "start", "end", F.col("p.side"), F.col("p.at"), F.lit(1).alias("late"), F.lit(None).cast("int").alias("i"))
    edit = F.struct(F.col(f"{here}_start").alias("s"), F.col(f"{here}_end").alias("e"), F.col(f"{there}_start").alias("ts"), F.col(f"{there}_end").alias("te"), "removed").alias("edit")
    marks = edits.select("source_id", F.col(f"{here}_start").alias("at"), F.lit(0).alias("late"), "i", edit, F.when(F.col("rule").isNull(), F.col(f"{here}_end")).alias("size"))
    both = places.unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("source_id").orderBy("at", "late", "i").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("e", F.last("edit", ignorenulls=True).over(upto)).withColumn("size", F.max("size").over(Window.partitionBy("source_id"))).filter("late = 1")
    at, sign = F.col("at"), (-1 if to == "normal" else 1)
    inside = F.coalesce(at < F.col("e.e"), F.lit(False))
    moved = at + F.lit(sign) * F.coalesce("e.removed", F.lit(0))
    point = F.when(inside, F.col("e.ts")).otherwise(moved)
    # Before a byte order mark there is nothing, so the first place of the normalised text is the first of the original.
    point = F.when(~wide & (at == 0), 0).otherwise(point) if to == "original" else point
    within = inside & (F.col("e.s") < at)
    stop = F.when(wide, F.when(inside, F.col("e.te")).otherwise(moved + 1)).otherwise(F.when(within, F.col("e.te")).otherwise(point))
    met = found.groupBy("source_id", "range_id", "start", "end").agg(F.max(F.when(F.col("side") == 0, point)).alias("to_start"), F.max(F.when(F.col("side") == 1, stop)).alias("to_end"), F.max("size").alias("size"))
    sound = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("size"))
    code = F.when(F.col("size").isNull(), "UNKNOWN_SOURCE").when(~sound, "OUT_OF_BOUNDS")
    return met.select("source_id", "range_id", "start", "end", F.when(code.isNull(), F.col("to_start")).alias("to_start"), F.when(code.isNull(), F.col("to_end")).alias("to_end"), code.alias("code"))


def normalized_sources(texts: DataFrame) -> DataFrame:
    """(source_id, normal, original_hash, normal_hash): the text after its edits, and both texts' hashes, each under its domain."""
    text = F.coalesce("text", F.lit(""))
    return texts.select("source_id", normalized(text).alias("normal"), domain_hash("spanloom.source", text).alias("original_hash"), domain_hash("spanloom.normalized", normalized(text)).alias("normal_hash"))


def foreign_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, text): documents as other systems write them: some with a byte order mark, and line ends of all three kinds
    in one text."""
    # The lines are bound once: a function of the text inside would cut it again for every line.
    ended = F.expr("""flatten(transform(array(split(text, '\\n')), s -> transform(s, (x, i) -> concat(x, case when i = size(s) - 1 then '' when (doc_id + i) % 3 = 0 then '\\n' when (doc_id + i) % 3 = 1 then '\\r\\n' else '\\r' end))))""")
    mark = F.expr("if(doc_id % 2 = 1, cast(x'EFBBBF' as string), '')")
    return read(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("source_id"), F.concat(mark, F.array_join(ended, "")).alias("text"))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edit of normalisation with its place in both texts."""
    return edit_map(foreign_documents(spark, sf_dir)).filter("rule is not null").drop("i", "removed")


def _ranges(sizes: DataFrame, size: str) -> DataFrame:
    """Sevenths of texts, two wide, from one before the beginning to one behind the end, and empty ones, numbered."""
    made = F.expr(f"flatten(transform(sequence(0, 7), j -> array(struct(2 * j as range_id, cast({size} * (j - 1) div 7 as bigint) as start, cast({size} * (j + 1) div 7 as bigint) as end), struct(2 * j + 1 as range_id, cast({size} * j div 7 as bigint) as start, cast({size} * j div 7 as bigint) as end))))")
    return sizes.select("source_id", F.explode(made).alias("r")).select("source_id", "r.*")


def ranges_to_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = foreign_documents(spark, sf_dir)
    return translated(_ranges(texts.select("source_id", F.length("text").alias("n")), "n"), edit_map(texts), "normal")


def ranges_to_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = edit_map(foreign_documents(spark, sf_dir))
    return translated(_ranges(edits.filter("rule is null").select("source_id", F.col("normal_end").alias("n")), "n"), edits, "original")


_L = """with l as (select doc_id as k, x[1] as t, x[2] as i, x[3] as m from (select doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))), list_transform(string_split(text, chr(10)), lambda y: len(string_split(text, chr(10)))))) as x from documents where text is not null)),
    s as (select *, case when i = m - 1 then '' when (k + i) % 3 = 0 then chr(10) when (k + i) % 3 = 1 then chr(13) || chr(10) else chr(13) end as e, coalesce(sum(length(t)) over w, 0) as ts from l window w as (partition by k order by i rows between unbounded preceding and 1 preceding)),
    p as (select *, k % 2 + ts + coalesce(sum(length(e)) over w, 0) as o, ts + i as n from s window w as (partition by k order by i rows between unbounded preceding and 1 preceding))"""
# Every character with its entry in both texts, as the definition has it.
_C = _L + """, d as (select k, case when k % 2 = 1 then chr(65279) else '' end || string_agg(t || e, '' order by i) as txt from s group by 1),
    c as (select k, p, ch, lag(ch) over w as b, lead(ch) over w as a from (select k, unnest(range(length(txt))) as p, unnest(string_split(txt, '')) as ch from d) window w as (partition by k order by p)),
    g as (select *, ch = chr(13) and a = chr(10) is true as fst, ch = chr(10) and b = chr(13) is true as snd, p = 0 and ch = chr(65279) as bom from c),
    h as (select k, p, fst, snd, bom, p - coalesce(sum(case when bom or fst then 1 else 0 end) over (partition by k order by p rows between unbounded preceding and 1 preceding), 0) as ns from g),
    x as (select k, p, snd, bom, ns, ns + case when bom then 0 else 1 end as ne, case when snd then p - 1 else p end as os, case when fst then p + 2 else p + 1 end as oe from h),
    z as (select d.k, length(txt) as lo, length(txt) - coalesce(sum(case when bom or fst then 1 end), 0) as ln from d left join h using (k) group by 1, 2)"""
_R = ", r as (select k, lo, ln, y[1] as range_id, y[2] as s, y[3] as e from (select k, lo, ln, unnest(list_concat(list_transform(range(8), lambda j: [2 * j, trunc({n} * (j - 1) / 7)::bigint, trunc({n} * (j + 1) / 7)::bigint]), list_transform(range(8), lambda j: [2 * j + 1, trunc({n} * j / 7)::bigint, trunc({n} * j / 7)::bigint]))) as y from z))"
SQL = {
    "edit_log": _L + """ select k as source_id, 'remove_utf8_bom' as rule, 'none_deleted' as exactness, 0 as original_start, 1 as original_end, 0 as normal_start, 0 as normal_end from (select distinct k from l) where k % 2 = 1
        union all select k, 'normalize_line_ending', 'character_equivalent', cast(o + length(t) as bigint), cast(o + length(t) + length(e) as bigint), cast(n + length(t) as bigint), cast(n + length(t) + 1 as bigint) from p where e in (chr(13), chr(13) || chr(10))""",
    "ranges_to_normal": _C + _R.format(n="lo") + """, q as (select r.*, min(ns) as a, max(ne) as b from r left join x on x.k = r.k and x.p >= s and x.p < e and s >= 0 and e <= lo group by all),
        v as (select q.k, range_id, s, e, case when s < 0 or e > lo then null when s < e then a else coalesce(x.ns, ln) end as ts, case when s < 0 or e > lo then null when s < e then b else coalesce(x.ns, ln) + case when x.snd then 1 else 0 end end as te, case when s < 0 or e > lo then 'OUT_OF_BOUNDS' end as code from q left join x on x.k = q.k and x.p = q.s)
        select k as source_id, cast(range_id as integer) as range_id, s as start, e as "end", cast(ts as bigint) as to_start, cast(te as bigint) as to_end, code from v""",
    "ranges_to_original": _C + _R.format(n="ln") + """, q as (select r.*, min(os) as a, max(oe) as b from r left join x on x.k = r.k and not x.bom and x.ns >= s and x.ns < e and s >= 0 and e <= ln group by all),
        f as (select k, ns, min(os) as os from x group by 1, 2),
        v as (select q.k, range_id, s, e, case when s < 0 or e > ln then null when s < e then a else coalesce(f.os, lo) end as ts, case when s < 0 or e > ln then null when s < e then b else coalesce(f.os, lo) end as te, case when s < 0 or e > ln then 'OUT_OF_BOUNDS' end as code from q left join f on f.k = q.k and f.ns = q.s)
        select k as source_id, cast(range_id as integer) as range_id, s as start, e as "end", cast(ts as bigint) as to_start, cast(te as bigint) as to_end, code from v""",
}
