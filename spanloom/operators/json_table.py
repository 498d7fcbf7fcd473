"""JSON compiled: arrays of flat, uniform objects as a header and a line per object, anything else without its blanks.

The type of a key is an aggregate over its values: nothing below null, null below every scalar type, and two types or a nested
value make the array no table. Keys stand in the order in which they are first seen. Built on the nodes of json_index.py, so
every candidate has the place of its object in the source. Candidates have the columns that rendered.py chooses from. They are
made of a text's list of nodes where it lies: a flat object's fields are the nodes that follow it, so nothing is joined or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical, float_text, quoted
from ..sources.tables import read
from .json_index import json_node_lists, json_parsed
from .rendered import selected

# A record with one of these as its status must stay. Fixed values.
FAILED = ("error", "failed", "failure", "critical", "fatal")
TEXTS = T.ArrayType(T.StringType())


def scalar_text(kind: Column, value: Column) -> Column:
    """A scalar as it is written again; strings with quotes."""
    whole = F.when(value == "-0", "0").otherwise(value)
    return F.when(kind == "string", quoted(value)).when(kind == "integer", whole).when(kind == "number", float_text(value.cast("double"))).otherwise(value)


def compact(nodes: Column) -> Column:
    """The text of these nodes without blanks, strings and numbers in their shortest form."""
    def pieces(n: Column) -> Column:
        boxed = n["kind"].isin("object", "array")
        own = F.when(n["kind"] == "object", "{").when(n["kind"] == "array", "[").otherwise(F.coalesce(scalar_text(n["kind"], n["value"]), F.lit("")))
        begin = F.concat(F.when(n["first"], "").otherwise(","), F.when(n["key"].isNotNull(), F.concat(quoted(n["key"]), F.lit(":"))).otherwise(""), own)
        end = F.struct((n["end"] - 1).alias("at"), F.when(n["kind"] == "object", "}").otherwise("]").alias("piece"))
        return F.array_compact(F.array(F.struct(n["start"].alias("at"), begin.alias("piece")), F.when(boxed, end)))

    return F.array_join(F.transform(F.sort_array(F.flatten(F.transform(nodes, pieces))), lambda x: x["piece"]), "")


def _cell(n: Column) -> Column:
    """A field of a row as it stands in the table: a string without its quotes."""
    shown = quoted(n["value"])
    return F.when(n["kind"] == "string", F.substring(shown, F.lit(2), F.length(shown) - 2)).otherwise(scalar_text(n["kind"], n["value"]))


def json_candidates(texts: DataFrame) -> DataFrame:
    """Candidates of every valid JSON text: a header and a record per object of a table, else one compact text. A table is an
    array of two objects or more that are flat and uniform."""
    rows = json_node_lists(json_parsed(texts)).filter(F.size("n") > 0).withColumn("root", F.get("n", F.lit(0)))
    rows = rows.withColumn("cells", F.when((F.col("root.kind") == "array") & (F.col("root.size") >= 2) & (F.col("root.objects") == F.col("root.size")), F.filter("n", lambda n: n["holder"] == F.col("root.node"))))
    # Types of a key: none but null, one, or it is no table. A type's name has no colon.
    kinds = F.array_distinct(F.transform(F.filter("cells", lambda n: n["kind"] != "null"), lambda n: F.concat(n["kind"], F.lit(":"), n["key"])))
    rows = rows.withColumn("keys", F.array_distinct(F.transform("cells", lambda n: n["key"]))).withColumn("kinds", kinds)
    rows = rows.withColumn("typed", F.transform("kinds", lambda k: F.substring(k, F.locate(":", k) + 1, F.length(k))))
    flat = ~F.exists("cells", lambda n: n["kind"].isin("object", "array")) & (F.size(F.array_distinct("typed")) == F.size("typed"))
    rows = rows.withColumn("table", F.coalesce(F.col("cells").isNotNull() & flat, F.lit(False)))
    part = lambda kind, row, first, last, nodes: F.struct(F.lit(kind).alias("kind"), row.cast("long").alias("row_index"), first.cast("long").alias("first"), last.cast("long").alias("last"), nodes.alias("nodes"))
    none, root = F.lit(None), F.col("root")
    records = F.transform("n", lambda n, i: F.when(n["parent"] == root["node"], part("json_row", n["place"], n["start"], n["end"], F.slice("n", i + 2, n["size"]))))
    header = part("json_schema", none, F.lit(0), root["end"], F.slice("n", F.lit(1), F.lit(0)))
    parts = F.when(F.col("table"), F.concat(F.array(header), F.array_compact(records))).otherwise(F.array(part("json_compact", none, root["start"], root["end"], F.col("n"))))
    rows = rows.select("source_id", "keys", "kinds", "typed", F.col("root.size").alias("rows"), F.explode(parts).alias("p")).select("source_id", "keys", "kinds", "typed", "rows", "p.*")

    listed = lambda c: canonical(c, TEXTS)
    kind = lambda k: F.substring_index(F.get("kinds", F.array_position("typed", k).cast("int") - 1), ":", 1)
    types = F.transform("keys", lambda k: F.coalesce(F.when(kind(k) == "integer", "number").otherwise(kind(k)), F.lit("null")))
    schema = F.concat(F.lit("@schema="), listed(F.col("keys")), F.lit("\n@types="), listed(types), F.lit("\n@rows="), F.col("rows"))
    names, shown = F.transform("nodes", lambda n: n["key"]), F.transform("nodes", _cell)
    rows = rows.withColumn("names", F.when(F.col("kind") == "json_row", names)).withColumn("shown", F.when(F.col("kind") == "json_row", shown))
    missing = F.filter("keys", lambda k: ~F.array_contains("names", k))
    line = F.concat_ws("\t", F.lit("@row"), F.array_join(F.transform("keys", lambda k: F.coalesce(F.get("shown", F.array_position("names", k).cast("int") - 1), F.lit("~"))), "\t"), F.concat(F.lit("missing="), listed(missing)))
    failed = F.exists("nodes", lambda n: (n["key"] == "status") & (n["kind"] == "string") & F.lower(n["value"]).isin(*FAILED))
    record = F.col("kind") == "json_row"
    text = F.when(record, line).when(F.col("kind") == "json_schema", schema).otherwise(compact(F.col("nodes")))
    return rows.select(
        "source_id", F.concat_ws(":", "kind", F.col("row_index").cast("string")).alias("candidate_id"), "kind", text.alias("text"), F.when(record, F.coalesce(failed, F.lit(False))).otherwise(True).alias("mandatory"),
        (F.col("kind") == "json_schema").alias("structural"), F.lit(False).alias("anomaly"), F.lit(False).alias("protected"), "first", "last", "row_index",
    )


def item_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, text): an order's items as an array; keys in two orders, some missing or null; for some orders of two types."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("*", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as nth").selectExpr("l_orderkey as k", "nth", "cast(cast(l_quantity as int) as string) as q", "l_returnflag as f")
    number = "case when k % 5 = 0 and nth = 2 then concat('\"', q, '\"') when k % 2 = 0 then q else concat(q, '.50') end"
    flag = r"""concat('"', f, '\\t\\"\\u00e9"')"""
    note = "case when nth % 3 = 0 then ',\\n\"note\": null' else '' end"
    item = f"case when nth % 2 = 1 then concat('{{\"id\":', nth, ',\"qty\": ', {number}, ',\"flag\":', {flag}, {note}, '}}') else concat('{{\"flag\" : ', {flag}, ', \"id\":', nth, ',\"ok\":true,\"qty\":', {number}, {note}, ',\"status\":\"', if(f = 'R', 'Failed', 'fine'), '\"}}') end"
    made = rows.selectExpr("k", "nth", f"{item} as item").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("nth", "item"))).alias("items"))
    return made.select(F.col("k").alias("source_id"), F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit("]")).alias("text"))


def json_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of orders' items as JSON, by digest."""
    rows = json_candidates(item_arrays(spark, sf_dir))
    return rows.select("source_id", "kind", "row_index", "mandatory", F.sha2("text", 256).alias("digest"))


def json_table_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rendered within two thirds of their cost, with the records left out named; tests hold this against a plain version."""
    rows = json_candidates(item_arrays(spark, sf_dir))
    return selected(rows, F.lit(66))[1].select("source_id", "cost", "floor", "fits", "marker", F.sha2("text", 256).alias("digest"))


UNSTATED = ("json_table_selection",)
SQL = {
    "json_table": """with r as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as nth, count(*) over (partition by l_orderkey) as m, cast(cast(l_quantity as integer) as varchar) as q, l_returnflag as f from lineitem),
        s as (select *, m >= 2 and (k % 5 <> 0) as tab, case when k % 2 = 0 then q else q || '.5' end as num, f || '\\t\\"é' as flag, case when f = 'R' then 'Failed' else 'fine' end as st, nth % 2 = 0 as ok, nth % 3 = 0 as note from r),
        j as (select *, case when not ok then '{"id":' || nth || ',"qty":' || num || ',"flag":"' || flag || '"' || case when note then ',"note":null' else '' end || '}' else '{"flag":"' || flag || '","id":' || nth || ',"ok":true,"qty":' || case when k % 5 = 0 and nth = 2 then '"' || q || '"' else num end || case when note then ',"note":null' else '' end || ',"status":"' || st || '"}' end as item from s),
        t as (select k, 'json_schema' as kind, null::bigint as row_index, true as mandatory, '@schema=["id","qty","flag","ok","status"' || case when m > 2 then ',"note"' else '' end || ']' || chr(10) || '@types=["number","number","string","boolean","string"' || case when m > 2 then ',"null"' else '' end || ']' || chr(10) || '@rows=' || m as text from s where tab and nth = 1
        union all select k, 'json_row', nth - 1, ok and st = 'Failed', '@row' || chr(9) || nth || chr(9) || num || chr(9) || flag || chr(9) || case when ok then 'true' || chr(9) || st else '~' || chr(9) || '~' end || case when m > 2 then chr(9) || case when note then 'null' else '~' end else '' end || chr(9) || 'missing=' || to_json(list_filter([case when not ok then 'ok' end, case when not ok then 'status' end, case when m > 2 and not note then 'note' end], lambda x: x is not null)) from s where tab
        union all select k, 'json_compact', null, true, '[' || string_agg(item, ',' order by nth) || ']' from j where not tab group by k) select k as source_id, kind, row_index, mandatory, sha256(text) as digest from t""",
}
