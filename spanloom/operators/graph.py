"""Facts, relations and their graph: hash-consing, endpoints, edges, one-hop closure, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import stable_id
from ..sources.tables import line_spans, read


def fact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with equal value, owner, unit, scope and polarity become one node: the first of them, with all evidence."""
    items = read(spark, sf_dir, "lineitem")
    keys = {"class": F.lit("numeric.unit"), "value": F.col("l_quantity").cast("int"), "owner": F.col("l_suppkey"), "unit": F.lit("pieces"), "scope": F.col("l_linestatus"), "polarity": F.col("l_returnflag")}
    rows = items.select(*[c.alias(k) for k, c in keys.items()], "l_orderkey")
    nodes = rows.groupBy(*keys).agg(F.count("*").alias("evidence"), F.min("l_orderkey").alias("source_order"))
    return nodes.select(stable_id("fact", *[F.col(k) for k in keys]).alias("node_id"), "value", "owner", "scope", "polarity", "evidence", "source_order")


def span_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the same set of parts merge: a node per set of spans."""
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_returnflag", "l_linestatus"))).alias("spans"))
    shown = F.concat_ws(",", F.transform("spans", lambda s: F.concat(s["l_returnflag"], s["l_linestatus"])))
    return sets.groupBy(shown.alias("spans")).agg(F.count("*").alias("merged"), F.min("l_orderkey").alias("first_source"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relation_id, type, endpoints): orders relate their customer and the parts of their items, once each."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("part:"), "l_partkey").alias("node"))
    owners = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("customer:"), "o_custkey").alias("node"))
    ends = items.unionByName(owners).groupBy("o_orderkey").agg(F.array_sort(F.collect_set("node")).alias("endpoints"))
    made = ends.filter(F.size("endpoints") >= 2).withColumn("joined", F.concat_ws(",", "endpoints"))
    return made.groupBy("joined").agg(F.first("endpoints").alias("endpoints"), F.count("*").alias("merged")).withColumn("relation_id", stable_id("relation", F.col("joined")))


def relation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with at least two endpoints, equal ones merged."""
    return _relations(spark, sf_dir).select("relation_id", F.size("endpoints").cast("long").alias("endpoints"), "merged")


def node_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node is an endpoint of: how many relations, and the first by id."""
    ends = _relations(spark, sf_dir).select("relation_id", F.explode("endpoints").alias("node"))
    return ends.groupBy("node").agg(F.countDistinct("relation_id").alias("relations"), F.min("relation_id").alias("first_relation"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by kind: consecutive spans of a source, endpoints of relations, evidence; repeated edges count once."""
    spans = line_spans(spark, sf_dir)
    following = F.lead("span_id").over(Window.partitionBy("source_id").orderBy("start", "end", "span_id"))
    # What begins an edge of spans or evidence belongs to one source and an endpoint is listed once, so edges are counted where
    # their source or relation lies; only the counts are brought together.
    order = spans.select("source_id", "span_id", following.alias("next")).filter("next is not null").distinct().groupBy("source_id", "span_id").agg(F.count("*").alias("edges")).select(F.lit("source_order").alias("kind"), "edges", F.lit(True).alias("begins"))
    ends = _relations(spark, sf_dir).select(F.lit("relation_endpoint").alias("kind"), F.size("endpoints").cast("long").alias("edges"), F.lit(True).alias("begins"))
    evidence = spans.select("source_id", "class").distinct().groupBy("source_id").agg(F.count("*").alias("edges")).select(F.lit("evidence").alias("kind"), "edges", F.col("source_id").isNotNull().alias("begins"))
    return order.unionByName(ends).unionByName(evidence).groupBy("kind").agg(F.sum("edges").alias("edges"), F.count_if("begins").alias("starts"))


def protected_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard nodes, the mandatory relations, and the endpoints of these (one hop): why each is protected."""
    orders = read(spark, sf_dir, "orders")
    hard = orders.filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("order:"), "o_orderkey").alias("node"), F.lit("hard").alias("reason"))
    mandatory = orders.filter("o_totalprice > 150000")
    relations = mandatory.select(F.concat(F.lit("order:"), "o_orderkey").alias("node"), F.lit("relation").alias("reason"))
    endpoints = mandatory.select(F.concat(F.lit("customer:"), "o_custkey").alias("node"), F.lit("endpoint").alias("reason"))
    rows = hard.unionByName(relations).unionByName(endpoints).distinct()
    return rows.groupBy("node").agg(F.concat_ws(",", F.array_sort(F.collect_set("reason"))).alias("reasons")).groupBy("reasons").agg(F.count("*").alias("nodes"), F.min("node").alias("first_node"))


def relation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that don't exist, and ids that occur twice, as violations."""
    items, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").filter("p_size > 5")
    missing = items.join(parts, items.l_partkey == parts.p_partkey, "left_anti").groupBy(F.col("l_partkey").cast("string").alias("id")).agg(F.count("*").alias("n")).withColumn("code", F.lit("MISSING_ENDPOINT"))
    twice = items.groupBy(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("code", F.lit("DUPLICATE_ID"))
    return missing.unionByName(twice).select("code", "id", "n")


def fact_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as one line each, by templates of their class, in source order per customer."""
    orders = read(spark, sf_dir, "orders")
    line = F.concat(F.lit("order "), "o_orderkey", F.when(F.col("o_orderstatus") == "F", " closed").when(F.col("o_orderstatus") == "O", " open").otherwise(" pending"), F.lit(" owner "), "o_custkey")
    rows = orders.select("o_custkey", F.struct("o_orderkey", line.alias("line")).alias("l"))
    listed = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    text = F.concat_ws("\n", F.transform("lines", lambda x: x["line"]))
    return listed.select("o_custkey", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("tokens"))


_R = """with e as (select distinct l_orderkey as k, 'part:' || l_partkey as node from lineitem union select o_orderkey, 'customer:' || o_custkey from orders), g as (select k, string_agg(node, ',' order by node) as joined, count(*) as n from e group by 1 having count(*) >= 2),
    r as (select joined, any_value(n) as n, count(*) as merged, 'relation:' || substr(sha256('["' || joined || '"]'), 1, 20) as relation_id from g group by 1)"""
SQL = {
    "fact_nodes": """select 'fact:' || substr(sha256('["' || concat_ws('","', 'numeric.unit', value, owner, 'pieces', scope, polarity) || '"]'), 1, 20) as node_id, * from (select cast(l_quantity as integer) as value, l_suppkey as owner, l_linestatus as scope, l_returnflag as polarity, count(*) as evidence, min(l_orderkey) as source_order from lineitem group by 1, 2, 3, 4)""",
    "span_nodes": "with s as (select l_orderkey, string_agg(distinct l_returnflag || l_linestatus, ',' order by l_returnflag || l_linestatus) as spans from lineitem group by 1) select spans, count(*) as merged, min(l_orderkey) as first_source from s group by 1",
    "relation_nodes": _R + " select relation_id, n as endpoints, merged from r",
    "node_relations": _R + ", x as (select relation_id, unnest(string_split(joined, ',')) as node from r) select node, count(distinct relation_id) as relations, min(relation_id) as first_relation from x group by 1",
    "graph_edges": _R + """, s as (select l_orderkey as source_id, concat(l_linenumber, '.', l_partkey, '.', l_suppkey, '.', cast(floor(l_extendedprice * 100) as bigint)) as span_id, date_diff('day', timestamp '1990-01-01', l_shipdate) as a, l_quantity as q, l_returnflag as class from lineitem),
        o as (select source_id, span_id, lead(span_id) over (partition by source_id order by a, a + cast(q as integer), span_id) as nxt from s), d as (select distinct 'source_order' as kind, source_id || '/' || span_id as a, source_id || '/' || nxt as b from o where nxt is not null
        union select 'relation_endpoint', relation_id, unnest(string_split(joined, ',')) from r union select 'evidence', 'source:' || source_id, class from s) select kind, count(*) as edges, count(distinct a) as starts from d group by 1""",
    "protected_closure": """with p as (select 'order:' || o_orderkey as node, 'hard' as reason from orders where o_orderpriority = '1-URGENT' union select 'order:' || o_orderkey, 'relation' from orders where o_totalprice > 150000 union select 'customer:' || o_custkey, 'endpoint' from orders where o_totalprice > 150000),
        g as (select node, string_agg(reason, ',' order by reason) as reasons from p group by 1) select reasons, count(*) as nodes, min(node) as first_node from g group by 1""",
    "relation_integrity": """select 'MISSING_ENDPOINT' as code, cast(l_partkey as varchar) as id, count(*) as n from lineitem where l_partkey not in (select p_partkey from part where p_size > 5) group by 2
        union all select 'DUPLICATE_ID', l_orderkey || ':' || l_linenumber, count(*) from lineitem group by 2 having count(*) > 1""",
    "fact_rendering": """with l as (select o_custkey, string_agg('order ' || o_orderkey || case o_orderstatus when 'F' then ' closed' when 'O' then ' open' else ' pending' end || ' owner ' || o_custkey, chr(10) order by o_orderkey) as t from orders group by 1) select o_custkey, sha256(t) as digest, strlen(t) as tokens from l""",
}
