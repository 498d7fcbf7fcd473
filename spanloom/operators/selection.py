"""Choosing under a budget: match features, utility, waterfalls, greedy choice, ranges, coverage of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import overlap_join, ratio, terms
from ..sources.tables import SPAN_ID, line_spans, read

RESERVE = 8


def _turn_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation with the terms that they share with its last turn of the user, the question."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.max("turn").alias("asked"))
    set_of = lambda c: F.array_distinct(terms(F.col(c)))
    rows = turns.join(asked, "conv_id").filter("turn <> asked").withColumn("shared", F.array_intersect(set_of("question"), set_of("text")))
    having = lambda pattern: F.size(F.filter("shared", lambda t: t.rlike(pattern))).cast("long")
    return rows.withColumn("identifiers", having("[-/:]")).withColumn("numbers", having("[0-9]")).withColumn("paths", having("[._]")).withColumn("overlap", F.size("shared").cast("long"))


def utility(relevance: Column, **other: Column) -> Column:
    """Integer utility; the weights are fixed values."""
    weights = {"hard": 10_000, "bridge": 80, "structure": 60, "anomaly": 60, "unique": 40, "recent": 20, "severe": 40, "redundant": -30, "cost": -10, "ambiguous": -80}
    total = 100 * relevance
    for name, value in other.items():
        total = total + weights[name] * value
    return total.cast("long")


def match_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match features of every turn, and its utility for the question."""
    rows = _turn_matches(spark, sf_dir)
    made = utility(8.0 * F.col("overlap"), unique=F.lit(1), cost=F.octet_length("text") / F.lit(4.0))
    return rows.select("conv_id", "turn", "identifiers", "numbers", "paths", "overlap", made.alias("utility"))


def budget_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's budget in its order: envelope and mandatory text with a reserve, question, anomalies, structure, rest."""
    sizes = read(spark, sf_dir, "documents").selectExpr("doc_id", "cast(octet_length(text) as bigint) as n", "cast(doc_id % 40 as bigint) as envelope", "cast(octet_length(text) div 5 as bigint) as mandatory", "cast(doc_id % 300 as bigint) as asked", "cast(doc_id % 90 as bigint) as odd", "cast(doc_id % 500 as bigint) as form")
    left = lambda c: F.greatest(F.lit(0), c)
    rows = sizes.withColumn("budget", F.greatest(F.lit(1), F.expr("n * 3000 div 10000"))).withColumn("rest", left(F.col("budget") - F.col("envelope") - F.col("mandatory") - RESERVE))
    for name, wanted in (("query", "asked"), ("anomaly", "odd"), ("structure", "form")):
        rows = rows.withColumn(name, F.least("rest", wanted)).withColumn("rest", F.col("rest") - F.col(name))
    return rows.select("doc_id", "budget", "query", "anomaly", "structure", F.col("rest").alias("optional"), (F.col("mandatory") + F.col("envelope") + RESERVE > F.col("budget")).alias("incompressible"))


def greedy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: turns by falling overlap, each taken if the text still fits in half of the whole, else skipped.

    A fold over one conversation's turns; a running sum would stop at the first that doesn't fit.
    """
    rows = _turn_matches(spark, sf_dir).withColumn("cost", F.octet_length("text").cast("long") + 1)
    groups = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("key"), "turn", "cost"))).alias("items"), F.expr("sum(cost) div 2").alias("budget"))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    fits = lambda a, x: a["used"] + x["cost"] <= F.col("budget")
    step = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["taken"], F.array(x["turn"])).alias("taken"))).otherwise(a)
    made = groups.withColumn("s", F.aggregate("items", state, step))
    return made.select("conv_id", "budget", "s.used", F.concat_ws(",", F.transform(F.array_sort("s.taken"), lambda t: t.cast("string"))).alias("taken"))


def index_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, the numbers of its returned items as ranges: 1-3,5."""
    rows = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").distinct()
    island = F.col("l_linenumber") - F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    runs = rows.withColumn("island", island).groupBy("l_orderkey", "island").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = runs.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("a", shown.alias("shown")))).alias("runs"))
    return listed.select("l_orderkey", F.concat_ws(",", F.transform("runs", lambda r: r["shown"])).alias("ranges"))


def first_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return read(spark, sf_dir, "documents").select("source", "doc_id", nth.alias("nth")).filter("nth <= 2")


def covered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of class N that overlap a span of class R of their source: an interval join, counted per span."""
    rows = line_spans(spark, sf_dir)
    met = overlap_join(rows.filter("class = 'R'"), rows.filter("class = 'N'"), ["source_id"], width=32)
    return met.groupBy("r.source_id", "r.span_id").agg(F.count("*").alias("covering"))


def contained_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources all of whose spans of class N lie within spans of class R, or of class A."""
    rows = line_spans(spark, sf_dir)
    own = rows.filter("class = 'N'")
    met = overlap_join(rows.filter("class <> 'N'"), own, ["source_id"], width=32, contains=True).select("r.source_id", "r.span_id").distinct()
    marked = own.join(met.withColumn("inside", F.lit(True)), ["source_id", "span_id"], "left")
    return marked.groupBy("source_id").agg(F.bool_and(F.coalesce("inside", F.lit(False))).alias("eliminated"), F.count("*").alias("n"))


def omitted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of class N that no span of another class touches: an anti-join on intervals, per source."""
    rows = line_spans(spark, sf_dir)
    own = rows.filter("class = 'N'")
    met = overlap_join(rows.filter("class <> 'N'"), own, ["source_id"], width=32).select("r.source_id", "r.span_id").distinct()
    return own.join(met, ["source_id", "span_id"], "left_anti").groupBy("source_id").agg(F.count("*").alias("omitted"), F.sum("cost").alias("cost"))


def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: how long the union of its spans is, how many stretches it has, and whether it leaves no gap."""
    along = Window.partitionBy("source_id").orderBy("start", "end", "span_id")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = line_spans(spark, sf_dir).withColumn("reached", before)
    gain = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reached", F.col("start"))))
    opens = F.col("reached").isNull() | (F.col("start") > F.col("reached"))
    return rows.groupBy("source_id").agg(F.sum(gain).alias("length"), F.count(F.when(opens, 1)).alias("stretches"), (F.count(F.when(opens, 1)) == 1).alias("gapless"))


def fixed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found and represented items per class of a fixed list, so that classes without any appear too."""
    listed = spark.createDataFrame([(c,) for c in ("A", "N", "R", "lost")], "class string")
    rows = line_spans(spark, sf_dir).groupBy("class").agg(F.count("*").alias("discovered"), F.count_if(F.col("cost") > 10).alias("represented"))
    full = listed.join(rows, "class", "left").select("class", F.coalesce("discovered", F.lit(0)).alias("discovered"), F.coalesce("represented", F.lit(0)).alias("represented"))
    return full.select("*", ratio(F.col("represented"), F.col("discovered")).alias("ratio"), F.when(F.col("discovered") == 0, "not_applicable").otherwise("measured").alias("status"))


_S = f"with s as (select l_orderkey as source_id, {SPAN_ID.replace('concat(', 'concat(')} as span_id, date_diff('day', timestamp '1990-01-01', l_shipdate) as a, date_diff('day', timestamp '1990-01-01', l_shipdate) + cast(l_quantity as integer) as b, l_returnflag as class, cast(l_quantity as integer) as cost from lineitem)"
_T = """with a as (select conv_id, max(turn) as asked, arg_max(text, turn) as question from conversations where role = 'user' group by 1),
    m as (select conv_id, turn, text, list_intersect(list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}_./:@%+-]+')), list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_./:@%+-]+'))) as shared from conversations join a using (conv_id) where turn <> asked)"""
SQL = {
    "match_utility": _T + """ select conv_id, turn, len(list_filter(shared, lambda t: regexp_matches(t, '[-/:]'))) as identifiers, len(list_filter(shared, lambda t: regexp_matches(t, '[0-9]'))) as numbers, len(list_filter(shared, lambda t: regexp_matches(t, '[._]'))) as paths,
        len(shared) as overlap, cast(trunc(800.0 * len(shared) + 40 - 10 * (strlen(text) / 4.0)) as bigint) as utility from m""",
    "budget_waterfall": """with d as (select doc_id, strlen(text) as n, doc_id % 40 as e, strlen(text) // 5 as m, doc_id % 300 as q, doc_id % 90 as o, doc_id % 500 as f from documents),
        b as (select *, greatest(1, n * 3000 // 10000) as budget from d), r as (select *, greatest(0, budget - e - m - 8) as r0 from b), x as (select *, least(r0, q) as q1 from r), y as (select *, least(r0 - q1, o) as o1 from x), z as (select *, least(r0 - q1 - o1, f) as f1 from y)
        select doc_id, budget, q1 as query, o1 as anomaly, f1 as structure, r0 - q1 - o1 - f1 as optional, m + e + 8 > budget as incompressible from z""",
    "greedy_choice": _T.replace("with a as", "with recursive a as", 1) + """, i as (select conv_id, turn, strlen(text) + 1 as cost, row_number() over (partition by conv_id order by len(shared) desc, turn) as nth, cast(sum(strlen(text) + 1) over (partition by conv_id) as bigint) // 2 as budget from m),
        g as (select conv_id, budget, cast(0 as bigint) as nth, cast(0 as bigint) as used, cast([] as bigint[]) as taken from i where nth = 1
          union all select g.conv_id, g.budget, i.nth, case when g.used + i.cost <= g.budget then g.used + i.cost else g.used end, case when g.used + i.cost <= g.budget then list_append(g.taken, i.turn) else g.taken end from g join i on i.conv_id = g.conv_id and i.nth = g.nth + 1)
        select conv_id, budget, arg_max(used, nth) as used, array_to_string(list_sort(arg_max(taken, nth)), ',') as taken from g group by 1, 2""",
    "index_ranges": """with d as (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'R'), i as (select *, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as g from d),
        r as (select l_orderkey, min(l_linenumber) as a, max(l_linenumber) as b from i group by l_orderkey, g) select l_orderkey, string_agg(case when a = b then cast(a as varchar) else a || '-' || b end, ',' order by a) as ranges from r group by 1""",
    "first_per_kind": "select source, doc_id, cast(nth as integer) as nth from (select source, doc_id, row_number() over (partition by source order by doc_id) as nth from documents) where nth <= 2",
    "covered_spans": _S + " select n.source_id, n.span_id, count(*) as covering from s n join s r on r.source_id = n.source_id and r.class = 'R' and n.class = 'N' and r.a < n.b and n.a < r.b group by 1, 2",
    "contained_spans": _S + " select source_id, bool_and(inside) as eliminated, count(*) as n from (select n.source_id, exists (select 1 from s r where r.source_id = n.source_id and r.class <> 'N' and r.a <= n.a and n.b <= r.b) as inside from s n where n.class = 'N') group by 1",
    "omitted_spans": _S + " select source_id, count(*) as omitted, cast(sum(cost) as bigint) as cost from s n where n.class = 'N' and not exists (select 1 from s r where r.source_id = n.source_id and r.class <> 'N' and r.a < n.b and n.a < r.b) group by 1",
    "span_union": _S + """, d as (select distinct source_id, unnest(range(a, b)) as day from s), e as (select source_id, count(*) as length from d group by 1), g as (select source_id, day, lag(day) over (partition by source_id order by day) as before from d),
        t as (select source_id, count(*) filter (before is null or before < day - 1) as stretches from g group by 1) select source_id, length, stretches, stretches = 1 as gapless from e join t using (source_id)""",
    "fixed_coverage": _S + """, c(class) as (values ('A'), ('N'), ('R'), ('lost')), g as (select c.class, count(s.class) as discovered, count(*) filter (cost > 10) as represented from c left join s on s.class = c.class group by 1)
        select class, discovered, represented, case when discovered > 0 then cast(printf('%.6f', represented / discovered) as double) end as ratio, case when discovered = 0 then 'not_applicable' else 'measured' end as status from g""",
}
