"""Logs and JSON records: templates, runs, transitions, causes; paths, deviations and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import log_lines, read


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda k: F.nullif(F.regexp_extract("line", rf"\b{k}=(\S+)", 1), F.lit("")).cast("long")
    lines = log_lines(spark, sf_dir)
    return lines.select(field("event_id").alias("event_id"), field("trace_id").alias("trace"), field("caused_by").alias("cause"), F.regexp_extract("line", r"\b(INFO|WARN|ERROR|CRITICAL|FATAL)\b", 1).alias("severity"), F.substring("line", 1, 19).alias("at"), "line")


def log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with times and identifiers masked: how many of each, with the first and last time."""
    masked = F.regexp_replace(F.regexp_replace("line", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "<time>"), r"\b(trace_id|event_id|caused_by)=\S+", "$1=<id>")
    return _parsed(spark, sf_dir).groupBy(masked.alias("template")).agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive events of one trace with the same severity: gaps and islands."""
    along = Window.partitionBy("trace").orderBy("event_id")
    rows = _parsed(spark, sf_dir).withColumn("new", (F.lag("severity").over(along).isNull() | (F.lag("severity").over(along) != F.col("severity"))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(along))
    return rows.groupBy("trace", "run", "severity").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")).filter("n > 2")


def severity_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = Window.partitionBy("trace").orderBy("event_id")
    rows = _parsed(spark, sf_dir).withColumn("before", F.lag("severity").over(along)).filter("before <> severity")
    return rows.groupBy("before", "severity").agg(F.count("*").alias("n"), F.countDistinct("trace").alias("traces"))


def causal_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with the event that they name as their cause, if it was declared before them (a backward as-of join)."""
    rows = _parsed(spark, sf_dir)
    e, d = rows.alias("e"), rows.select(F.col("event_id").alias("declared"), F.col("severity").alias("cause_severity")).alias("d")
    linked = e.join(d, (F.col("e.cause") == F.col("d.declared")) & (F.col("d.declared") <= F.col("e.event_id")))
    return linked.select("e.event_id", "e.cause", "cause_severity")


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of the JSON column: its pointer, type and range."""
    props = read(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string, string>")).alias("key", "value"))
    kind = F.when(F.col("value").rlike(r"^-?\d+$"), "integer").when(F.col("value").rlike(r"^-?\d+[.]\d+$"), "number").otherwise("string")
    pointer = F.concat(F.lit("/"), F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    return props.groupBy(pointer.alias("pointer"), kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"), F.min(F.expr("try_cast(value as bigint)")).alias("low"), F.max(F.expr("try_cast(value as bigint)")).alias("high"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each order's JSON array that repeat but for their number: how many, and where."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))).alias("row"))
    grouped = items.groupBy("l_orderkey", "row").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string"))).alias("rows"))
    return grouped.filter("n > 1").select("l_orderkey", F.get_json_object("row", "$.flag").alias("flag"), F.get_json_object("row", "$.status").alias("status"), "n", "rows")


def peer_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of items of one order whose flags differ: those with the flag of the last one."""
    own = Window.partitionBy("l_orderkey")
    whole = own.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = read(spark, sf_dir, "lineitem").withColumn("last_flag", F.last("l_returnflag").over(whole)).withColumn("low", F.min("l_returnflag").over(own)).withColumn("high", F.max("l_returnflag").over(own))
    rows = rows.filter("low <> high and l_returnflag = last_flag")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("last_flag").alias("flag"))


_LOG = """with e as (select event_id, user_id as trace, case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' else 'INFO' end as severity, event_type,
    case when event_type = 'error' and event_id > 0 then event_id - 1 end as cause, strftime(ts, '%Y-%m-%dT%H:%M:%S') as seen from events)"""
SQL = {
    "log_templates": _LOG + """ select '<time> ' || severity || ' trace_id=<id> event_id=<id>' || case when cause is not null then ' caused_by=<id>' else '' end || ' ' || event_type || ' done' as template,
        count(*) as n, min(seen) as first_at, max(seen) as last_at from e group by 1""",
    "log_runs": _LOG + """, n as (select *, case when lag(severity) over w is distinct from severity then 1 else 0 end as new from e window w as (partition by trace order by event_id)),
        r as (select *, sum(new) over (partition by trace order by event_id) as run from n)
        select trace, cast(run as bigint) as run, severity, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from r group by 1, 2, 3 having count(*) > 2""",
    "severity_transitions": _LOG + """ select before, severity, count(*) as n, count(distinct trace) as traces from (select *, lag(severity) over (partition by trace order by event_id) as before from e) where before <> severity group by 1, 2""",
    "causal_predecessors": _LOG + """ select e.event_id, e.cause, d.severity as cause_severity from e join e d on d.event_id = e.cause and d.event_id <= e.event_id""",
    "json_paths": """select '/k' as pointer, 'integer' as kind, count(*) as n, count(distinct props->>'$.k') as distinct_values, min(cast(props->>'$.k' as bigint)) as low, max(cast(props->>'$.k' as bigint)) as high from events where props->>'$.k' is not null""",
    "json_rows": """select l_orderkey, l_returnflag as flag, l_linestatus as status, count(*) as n, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber) as rows from lineitem group by 1, 2, 3 having count(*) > 1""",
    "peer_deviation": """select l_orderkey, count(*) as n, max(last_flag) as flag from (select *, last_value(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and unbounded following) as last_flag,
        min(l_returnflag) over (partition by l_orderkey) as low, max(l_returnflag) over (partition by l_orderkey) as high from lineitem) where low <> high and l_returnflag = last_flag group by 1""",
}
