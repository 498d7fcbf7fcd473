"""Tables, and texts rendered from their columns, so that the columns tell what extraction must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores, such as a file of one row group, dealt to all of them; larger ones as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, cust_id, text): a note per order, with a date, a ticket, a rule and, for some, a correction."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as source_id", "o_custkey as cust_id",
        """concat('Placed on ', date_format(o_orderdate, 'yyyy-MM-dd'), ' under REQ-', o_orderkey, '. ',
           case o_orderstatus when 'O' then 'Staff may change it' when 'F' then 'Staff must not change it' else 'Staff may not change it' end,
           case when o_orderpriority in ('1-URGENT', '2-HIGH') then ' unless the customer calls' else '' end, '. ',
           'Owner ', o_custkey, '.', case when o_orderkey % 7 = 0 then ' Correction: the owner is someone else.' else '' end) as text""",
    )


def part_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, text): a labelled quantity per part."""
    return read(spark, sf_dir, "part").selectExpr("p_partkey as source_id", "concat('Limit ', p_name, case when p_partkey % 2 = 0 then ': ' else ' ' end, p_size, case p_partkey % 4 when 0 then ' kg' when 1 then 'ms' when 2 then ' GB' else ' hours' end, ' for ', p_brand, '.') as text")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, trace, line): a log line per event; the severity follows the type."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id as trace",
        """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), ' ', case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' else 'INFO' end,
           ' trace_id=', user_id, ' event_id=', event_id, case when event_type = 'error' and event_id > 0 then concat(' caused_by=', event_id - 1) else '' end,
           ' ', event_type, ' done') as line""",
    )


def incident_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, text): a note per order that holds every class of token at places that its key decides, then rules."""
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as source_id", INCIDENT + " as text")


# The same expression in Spark and in DuckDB, but for the functions of the date; {date} stands for those.
_INCIDENT = """concat('On ', {date}, ' at ', o_orderkey % 24, ':', lpad(cast(o_orderkey % 60 as {text}), 2, '0'), ' version v2.', o_orderkey % 9, '.', o_orderkey % 7,
    ' cost $', o_orderkey % 500, ' and ', o_orderkey % 900, '.5 EUR share ', o_orderkey % 100, '% load ', o_orderkey % 40 + 1, case o_orderkey % 3 when 0 then ' kg' when 1 then ' ms' else ' GB' end,
    ' for Depot', o_custkey, ' as REQ-', o_orderkey, ' sum ', md5(cast(o_orderkey as {text})), '. ',
    case o_orderstatus when 'O' then 'You may enter' when 'F' then 'You must not enter' else 'Nobody can enter' end, case when o_orderkey % 2 = 0 then ' unless all agreed. ' else '. ' end,
    case when o_orderkey % 5 = 0 then 'If it fails, call at least once. ' else '' end, case when o_orderkey % 7 = 0 then 'We will pay. Actually the sum changed.' else '' end)"""
INCIDENT = _INCIDENT.format(date="date_format(o_orderdate, 'yyyy-MM-dd')", text="string")
INCIDENT_SQL = _INCIDENT.format(date="strftime(o_orderdate, '%Y-%m-%d')", text="varchar")


# An order's items as objects of JSON: some lack a key, some have more, numbers have two forms.
_VALUE = "case when nth % 3 <> 0 then concat(cast(cast(l_quantity as {whole}) as {text}), case when nth % 2 = 0 then '.5' else '' end) end"
_ITEM = """concat('{{"id":', nth, case when nth % 3 <> 0 then concat(', "value": ', {value}) else '' end, ',"unit":"pieces","owner":"', l_suppkey, '","status":"', case when l_returnflag = 'R' then 'request failed' else 'ok' end, '"',
    case when nth % 4 = 0 then {rest} else '' end, '}}')"""
_HEAD = """concat(case when l_orderkey % 5 = 0 then {bom} else '' end, '{{"a/b":{{"~n":', l_orderkey, '}},"records":[')"""
_REST = """',"share":" 12% ","tags":[true,null,{"k/~":[1.50]}],"trace_id":"tSLASHu00e9"'"""
_NTH = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
ORDER_ITEMS_SQL = (
    "with l as (select *, " + _NTH + " as nth from lineitem), i as (select l_orderkey as k, nth, " + _ITEM.format(value=_VALUE.format(whole="integer", text="varchar"), rest=_REST.replace("SLASH", "\\")) + " as item, "
    + _VALUE.format(whole="integer", text="varchar") + " as value, l_returnflag = 'R' as failed, cast(l_suppkey as varchar) as owner, " + _HEAD.format(bom="chr(65279)") + " as head, case when l_orderkey % 5 = 0 then chr(65279) else '' end as bom from l)"
)


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, nth, l_returnflag, item): the items of orders, numbered, as objects of JSON."""
    item = _ITEM.format(value=_VALUE.format(whole="int", text="string"), rest=_REST.replace("SLASH", "\\\\"))
    return read(spark, sf_dir, "lineitem").selectExpr("*", _NTH + " as nth").selectExpr("l_orderkey", "nth", "l_returnflag", item + " as item")


def order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, text): an order as JSON, with an array of all its items; some texts begin with a byte order mark, some are
    broken: a key twice, an open bracket, a number with a leading zero."""
    items = order_items(spark, sf_dir)
    listed = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("nth", "item"))).alias("items"))
    tail = "case when l_orderkey % 11 = 0 then '],\"records\":0}' when l_orderkey % 13 = 0 then ']' when l_orderkey % 17 = 0 then '],\"x\":01}' else ']}' end"
    text = F.concat(F.expr(_HEAD.format(bom="cast(x'EFBBBF' as string)")), F.concat_ws(",", F.transform("items", lambda i: i["item"])), F.expr(tail))
    return listed.select(F.col("l_orderkey").alias("source_id"), text.alias("text"))


def dialogue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, text): each conversation as lines `role: text`, in which line feeds of a turn become blanks."""
    turns = read(spark, sf_dir, "conversations").selectExpr("conv_id as source_id", "turn", "concat(role, ': ', replace(text, chr(10), ' ')) as line")
    return turns.groupBy("source_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda t: t["line"])).alias("text"))


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, span_id, start, end, class, cost): a stretch of days per item of an order."""
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as source_id", SPAN_ID + " as span_id", "datediff(l_shipdate, date'1990-01-01') as start", "datediff(l_shipdate, date'1990-01-01') + cast(l_quantity as int) as end", "l_returnflag as class", "cast(l_quantity as int) as cost")


SPAN_ID = "concat(l_linenumber, '.', l_partkey, '.', l_suppkey, '.', cast(floor(l_extendedprice * 100) as bigint))"
