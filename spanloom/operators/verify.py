"""Verification as tables of violations: chains of hashes, claims against findings, sets, mappings, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import domain_hash, overlap_join, ratio
from ..sources.tables import SPAN_ID, line_spans, read


def _link(parent: Column, turn: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(parent, F.lit("")), turn.cast("string"), digest), 256)


def chained(attempts: DataFrame) -> DataFrame:
    """(run, sequence, parent, hash) of attempts (run, sequence, digest): each record hashes the one before. A run has but a
    few attempts, so a fold over its array builds the chain."""
    runs = attempts.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("sequence", "digest"))).alias("items"))
    made = F.array().cast("array<struct<sequence:bigint,parent:string,hash:string>>")

    def step(acc: Column, x: Column) -> Column:
        parent = F.try_element_at(acc, F.lit(-1))["hash"]
        return F.concat(acc, F.array(F.struct(x["sequence"].alias("sequence"), parent.alias("parent"), _link(parent, x["sequence"], x["digest"]).alias("hash"))))

    return runs.select("run", F.inline(F.aggregate("items", made, step)))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("sequence"), F.sha2("text", 256).alias("digest"))


def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained(_attempts(spark, sf_dir))


def chain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose sequence has gaps, whose parents don't match or whose hashes aren't those of their content. Some runs are
    tampered with first: every fifth has its second digest altered, every seventh loses its second record."""
    attempts = _attempts(spark, sf_dir)
    stored = chained(attempts).filter("not (run % 7 = 0 and sequence = 1)")
    digest = F.when((F.col("run") % 5 == 0) & (F.col("sequence") == 1), F.reverse("digest")).otherwise(F.col("digest"))
    rows = stored.join(attempts.withColumn("digest", digest), ["run", "sequence"])
    along = Window.partitionBy("run").orderBy("sequence")
    rows = rows.withColumn("before", F.lag("hash").over(along)).withColumn("place", F.row_number().over(along) - 1)
    checks = {"SEQUENCE_GAP": F.col("sequence") != F.col("place"), "PARENT_MISMATCH": ~F.col("before").eqNullSafe(F.col("parent")), "HASH_MISMATCH": F.col("hash") != _link(F.col("parent"), F.col("sequence"), F.col("digest"))}
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return rows.select("run", F.explode(codes).alias("code")).groupBy("run", "code").agg(F.count("*").alias("n"))


def coverage_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed and found counts per class, from both sides: missing, unknown and differing claims."""
    claimed = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("class")).agg(F.count("*").alias("claimed")).filter("class % 6 <> 0")
    found = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("class")).agg(F.count("*").alias("found"))
    rows = claimed.join(found, "class", "full")
    code = F.when(F.col("claimed").isNull(), "CLAIM_MISSING").when(F.col("found").isNull(), "CLAIM_UNKNOWN").when(F.col("claimed") != F.col("found"), "CLAIM_DIFFERS")
    return rows.select("class", "claimed", "found", code.alias("code")).filter("code is not null")


def extraction_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either of two extractions has more of than the other, counting repeats."""
    items = read(spark, sf_dir, "lineitem")
    more = items.groupBy("l_orderkey", "l_returnflag").agg((F.count_if(F.col("l_quantity") > 20) - F.count_if(F.col("l_discount") > 0.03)).alias("more")).filter("more <> 0")
    # A source is one row of its flag, and more on one side only.
    return more.groupBy(F.when(F.col("more") > 0, "first").otherwise("second").alias("side"), "l_returnflag").agg(F.sum(F.abs("more")).alias("n"), F.count("l_orderkey").alias("sources"))


def omission_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omitted and deleted ids must be the same set: each id of only one side, with that side."""
    items = read(spark, sf_dir, "lineitem")
    side = lambda flag, name: items.filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("id")).distinct().withColumn(name, F.lit(True))
    rows = side("R", "omitted").join(side("A", "deleted"), "id", "full").filter("omitted is null or deleted is null")
    return rows.select("id", F.when(F.col("omitted").isNull(), "NOT_OMITTED").otherwise("NOT_DELETED").alias("code"))


# Codes in the order in which they decide. Fixed values.
_ACTIONS = [("expand_budget", ("TOKEN_BUDGET_EXCEEDED",)), ("restore_spans", ("OBLIGATION_NOT_REPRESENTED",)), ("full_fallback", ("HASH_MISMATCH", "STALE_SOURCE_MAP"))]
_CODE_OF = {"error": "HASH_MISMATCH", "purchase": "TOKEN_BUDGET_EXCEEDED", "signup": "OBLIGATION_NOT_REPRESENTED"}


def recommended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: discovery (unknown over partial over known), status, and the action that its failures ask for."""
    events = read(spark, sf_dir, "events").withColumn("run", F.expr("event_id div 3"))
    code = F.lit(None).cast("string")
    for kind, c in _CODE_OF.items():
        code = F.when((F.col("event_type") == kind) & (F.col("event_id") % 2 == 0), c).otherwise(code)
    rank = F.when(F.col("value") < 5, 2).when(F.col("value") < 40, 1).otherwise(0)
    runs = events.withColumn("code", code).withColumn("rank", rank).groupBy("run").agg(F.collect_set("code").alias("codes"), F.max("rank").alias("rank"))
    discovery = F.element_at(F.array(*map(F.lit, ("known", "partial", "unknown"))), F.col("rank") + 1)
    action = F.when((F.size("codes") > 0) | (F.col("rank") == 2), "full_fallback").otherwise("emit")
    for name, codes in reversed(_ACTIONS):
        action = F.when(F.arrays_overlap("codes", F.array(*map(F.lit, codes))), name).otherwise(action)
    status = F.when(F.array_contains("codes", "HASH_MISMATCH"), "failed").when(F.size("codes") > 0, "invalid").when(F.col("rank") == 2, "unverifiable").otherwise("valid")
    return runs.groupBy(discovery.alias("discovery"), status.alias("status"), action.alias("action")).agg(F.count("*").alias("runs"), F.min("run").alias("first_run"))


def merged_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of one id merge: an ordered union of what they map, and how many bytes of theirs are exact."""
    items = read(spark, sf_dir, "lineitem")
    rows = items.groupBy(F.col("l_partkey").alias("id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("ids"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")).otherwise(0)).alias("exact"))
    return rows.select("id", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), ratio(F.col("exact"), F.col("bytes")).alias("coverage"))


def restored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each span asked for (class R), the first mapping (class A) that overlaps it; null where nothing maps it."""
    rows = line_spans(spark, sf_dir)
    asked = rows.filter("class = 'R'")
    met = overlap_join(rows.filter("class = 'A'"), asked, ["source_id"], width=32)
    first = met.groupBy("r.source_id", "r.span_id").agg(F.min(F.struct("l.start", "l.end", "l.span_id")).alias("m"))
    return asked.select("source_id", "span_id").join(first, ["source_id", "span_id"], "left").select("source_id", "span_id", F.col("m.span_id").alias("mapping"), F.col("m.start").alias("start"))


def next_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next attempt's options: a budget that failed grows to what is needed and 8 more, up to the whole."""
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey as run", "cast(floor(o_totalprice) as bigint) as size", "cast(o_orderkey % 3000 as bigint) as needed")
    budget = F.greatest(F.lit(1), F.expr("size * 3000 div 10000"))
    grown = F.least("size", F.greatest(budget, F.col("needed") + 8))
    return orders.select("run", budget.alias("budget"), F.when(F.col("needed") > budget, grown).otherwise(budget).alias("next_budget"), domain_hash("spanloom.request", F.concat_ws("|", "run", "needed")).alias("request_hash"))


_S = f"with s as (select l_orderkey as source_id, {SPAN_ID} as span_id, date_diff('day', timestamp '1990-01-01', l_shipdate) as a, date_diff('day', timestamp '1990-01-01', l_shipdate) + cast(l_quantity as integer) as b, l_returnflag as class from lineitem)"
_CHAIN = """with recursive c as (select conv_id as run, turn as sequence, sha256(text) as digest, row_number() over (partition by conv_id order by turn) as nth from conversations),
    h as (select run, sequence, nth, cast(null as varchar) as parent, sha256('|' || sequence || '|' || digest) as hash from c where nth = 1 union all select c.run, c.sequence, c.nth, h.hash, sha256(h.hash || '|' || c.sequence || '|' || c.digest) from h join c on c.run = h.run and c.nth = h.nth + 1)"""
SQL = {
    "hash_chain": _CHAIN + " select run, sequence, parent, hash from h",
    "chain_violations": """with t as (select conv_id as run, turn, row_number() over (partition by conv_id order by turn) - 1 as nth from conversations), k as (select run, max(turn) as last from t group by 1)
        select run, 'HASH_MISMATCH' as code, 1 as n from k where run % 5 = 0 and run % 7 <> 0 and last >= 1 union all select run, 'SEQUENCE_GAP', last - 1 from k where run % 7 = 0 and last >= 2 union all select run, 'PARENT_MISMATCH', 1 from k where run % 7 = 0 and last >= 2""",
    "coverage_claims": """with c as (select cast(c_nationkey as bigint) as class, count(*) as claimed from customer where c_nationkey % 6 <> 0 group by 1), f as (select cast(s_nationkey as bigint) as class, count(*) as found from supplier group by 1)
        select class, claimed, found, case when claimed is null then 'CLAIM_MISSING' when found is null then 'CLAIM_UNKNOWN' else 'CLAIM_DIFFERS' end as code from c full join f using (class) where claimed is distinct from found""",
    "extraction_differences": """with a as (select l_orderkey, l_returnflag from lineitem where l_quantity > 20), b as (select l_orderkey, l_returnflag from lineitem where l_discount > 0.03),
        d as (select 'first' as side, * from (select * from a except all select * from b) union all select 'second', * from (select * from b except all select * from a)) select side, l_returnflag, count(*) as n, count(distinct l_orderkey) as sources from d group by 1, 2""",
    "omission_sets": """select l_partkey as id, case when bool_or(l_returnflag = 'R') then 'NOT_DELETED' else 'NOT_OMITTED' end as code from lineitem where l_returnflag in ('R', 'A') group by 1 having count(distinct l_returnflag) = 1""",
    "recommended_actions": """with e as (select event_id // 3 as run, event_id, case when event_id % 2 = 0 then case event_type when 'error' then 'HASH_MISMATCH' when 'purchase' then 'TOKEN_BUDGET_EXCEEDED' when 'signup' then 'OBLIGATION_NOT_REPRESENTED' end end as code, case when value < 5 then 2 when value < 40 then 1 else 0 end as r from events),
        g as (select run, max(r) as r, count(code) as n, bool_or(coalesce(code = 'HASH_MISMATCH', false)) as h, bool_or(coalesce(code = 'TOKEN_BUDGET_EXCEEDED', false)) as b, bool_or(coalesce(code = 'OBLIGATION_NOT_REPRESENTED', false)) as o from e group by 1)
        select case r when 2 then 'unknown' when 1 then 'partial' else 'known' end as discovery, case when h then 'failed' when n > 0 then 'invalid' when r = 2 then 'unverifiable' else 'valid' end as status,
        case when b then 'expand_budget' when o then 'restore_spans' when h or r = 2 then 'full_fallback' else 'emit' end as action, count(*) as runs, min(run) as first_run from g group by 1, 2, 3""",
    "merged_mappings": """with g as (select l_partkey as id, list_sort(list_distinct(list(l_suppkey))) as ids, cast(sum(l_quantity) as bigint) as b, cast(sum(case when l_returnflag = 'N' then l_quantity else 0 end) as bigint) as e from lineitem group by 1), d as (select *, e * 1000000 // b as q, e * 1000000 % b as r from g)
        select id, array_to_string(ids, ',') as ids, cast(q + case when 2 * r > b or 2 * r = b and q % 2 = 1 then 1 else 0 end as double) / 1000000 as coverage from d""",
    "restored_spans": _S + """, m as (select r.source_id, r.span_id, x.span_id as mapping, x.a as start, row_number() over (partition by r.source_id, r.span_id order by x.a, x.b, x.span_id) as nth from s r left join s x on x.source_id = r.source_id and x.class = 'A' and x.a < r.b and r.a < x.b where r.class = 'R')
        select source_id, span_id, mapping, cast(start as integer) as start from m where nth = 1""",
    "next_requests": """with o as (select o_orderkey as run, cast(floor(o_totalprice) as bigint) as size, o_orderkey % 3000 as needed from orders), b as (select *, greatest(1, size * 3000 // 10000) as budget from o)
        select run, budget, case when needed > budget then least(size, greatest(budget, needed + 8)) else budget end as next_budget, 'sha256:' || sha256('spanloom.request' || chr(0) || run || '|' || needed) as request_hash from b""",
}
