"""Sources and what becomes of their coordinates: decoding, paths, routing, normalisation maps, typed scans, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file below a path as one row."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def typed_records(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of a JSON-lines file: lines that don't parse, and keys that occur twice."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).select(parsed.alias("r")).select("r.*")
    bad = rows.filter("_bad is not null").select(F.lit("INVALID_RECORD").alias("code"), F.col("_bad").alias("value"))
    twice = rows.filter("_bad is null").groupBy(key).count().filter("count > 1").select(F.lit("DUPLICATE_KEY").alias("code"), F.col(key).cast("string").alias("value"))
    return rows.filter("_bad is null").drop("_bad"), bad.unionByName(twice)


def decoded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 of customers' names, each fifth one broken: the text, or a failure row."""
    sent = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("!"), F.base64(F.encode("c_name", "UTF-8")))).otherwise(F.base64(F.encode("c_name", "UTF-8"))).alias("b64"))
    raw = F.when(F.col("b64").rlike(r"^[A-Za-z0-9+/]*={0,2}$"), F.try_to_binary("b64", F.lit("base64")))
    text = F.try_validate_utf8(raw.cast("string"))
    return sent.select("c_custkey", text.alias("text"), F.when(text.isNull(), "INVALID_BASE64").alias("code"))


def portable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are relative, with / only and without empty, . and .. parts."""
    made = F.expr("case c_custkey % 6 when 0 then '/' when 1 then 'a//' when 2 then 'a/../' when 3 then './' when 4 then r'a\\b' else 'a/b/' end || c_custkey")
    parts = F.split("path", "/")
    portable = ~F.exists(parts, lambda p: p.isin("", ".", "..")) & ~F.col("path").contains("\\")
    return read(spark, sf_dir, "customer").select("c_custkey", made.alias("path")).select("c_custkey", portable.alias("portable"))


# Names of kinds and media that tell the type of content. Fixed values, tried in this order.
KINDS = {"dialogue": ("dialogue", "conversation", "messages"), "python": ("python", "code"), "json": ("json", "structured"), "log": ("log", "logs"), "document": ("text", "document", "markdown", "plain")}
MEDIA = {"python": ("text/x-python", "application/x-python"), "document": ("text/plain", "text/markdown")}


def content_type(asked: Column, kind: Column, media: Column, path: Column) -> Column:
    """What is asked for; else what the source's kind or its media type tell, then the suffix .py; else unknown."""
    kind, media = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(media, F.lit("")))
    of = lambda name: kind.isin(*KINDS[name])
    told = F.when(of("dialogue"), "dialogue").when(of("python") | media.isin(*MEDIA["python"]), "python").when(of("json") | media.contains("json"), "json").when(of("log") | media.contains("log"), "log")
    return F.coalesce(asked, told.when(path.endswith(".py"), "python").when(of("document") | media.isin(*MEDIA["document"]), "document").otherwise("unknown"))


def routed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sources of all kinds of kind, media type and path."""
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.expr(by) % len(names) + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("if(o_orderkey % 17 = 0, 'log', null)").alias("asked"), pick(ROUTED_KINDS, "o_orderkey").alias("kind"), pick(ROUTED_MEDIA, "o_orderkey div 3").alias("media_type"), F.expr("case o_custkey % 3 when 0 then concat(o_custkey, '.py') when 1 then 'a.txt' end").alias("path"))
    return rows.select("o_orderkey", content_type(F.col("asked"), F.col("kind"), F.col("media_type"), F.col("path")).alias("content_type"))


ROUTED_KINDS = ("Dialogue", "messages", "code", "structured", "LOGS", "markdown", "image", "conversation", "plain", "video", "text")
ROUTED_MEDIA = ("application/x-python", "application/vnd.api+JSON", "text/x-log", "text/plain", "Text/Markdown", "image/png", "application/json-log")


def _foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as other systems write them: a byte order mark for odd ids, carriage returns before or for line feeds."""
    text = F.expr("concat(if(doc_id % 2 = 1, cast(x'EFBBBF' as string), ''), replace(text, chr(10), case doc_id % 3 when 0 then chr(10) when 1 then concat(chr(13), chr(10)) else chr(13) end))")
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, column and byte of three places in each document; line ends are \\r\\n, \\r and \\n."""
    rows = _foreign(spark, sf_dir).withColumn("place", F.explode(F.array(F.lit(0), F.expr("length(text) div 3"), F.expr("length(text)"))))
    left = F.expr("left(text, place)")
    # What follows the last line end, found once: a pattern for it would be tried at every place of the line.
    tail = F.substring_index(F.translate(left, "\r", "\n"), "\n", -1)
    return rows.select("doc_id", "place", (1 + F.regexp_count(left, F.lit(r"\r\n|\r|\n"))).cast("long").alias("line"), F.length(tail).cast("long").alias("column"), F.octet_length(left).cast("long").alias("byte")).distinct()


def filtered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of wanted ids: those that exist, in the table's order, and as violations the unknown and the repeated ones."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0")
    wanted = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    ids = customers.select(F.col("c_custkey").alias("id"))
    unknown = wanted.join(ids, "id", "left_anti").select("id", F.lit("UNKNOWN_ID").alias("code"))
    twice = wanted.filter("n > 1").select("id", F.lit("DUPLICATE_ID").alias("code"))
    return ids.join(wanted, "id", "left_semi").select("id", F.lit("OK").alias("code")).unionByName(unknown).unionByName(twice)


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests looked up by their hash among recorded ones, and the first check that the record fails."""
    asked = read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_custkey", F.col("o_orderkey") % 10), 256).alias("hash"), F.col("o_orderstatus").alias("method"), "o_orderpriority")
    held = read(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").groupBy(F.sha2(F.concat_ws("|", "o_custkey", F.col("o_orderkey") % 10), 256).alias("hash")).agg(F.min_by(F.struct(F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("model")), "o_orderkey").alias("held"))
    code = F.when(F.col("held").isNull(), "NOT_RECORDED").when(F.col("held.model") != F.col("o_orderpriority"), "MODEL_MISMATCH").when(F.col("held.method") != F.col("method"), "METHOD_MISMATCH").otherwise("OK")
    return asked.join(held, "hash", "left").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


SQL = {
    "decoded_sources": "select c_custkey, case when c_custkey % 5 <> 0 then c_name end as text, case when c_custkey % 5 = 0 then 'INVALID_BASE64' end as code from customer",
    "portable_paths": "select c_custkey, c_custkey % 6 = 5 as portable from customer",
    "routed_sources": """with r as (select o_orderkey, case when o_orderkey % 17 = 0 then 'log' end as asked, lower(KINDS[1 + o_orderkey % 11]) as kind, lower(MEDIA[1 + o_orderkey // 3 % 7]) as media, case o_custkey % 3 when 0 then o_custkey || '.py' when 1 then 'a.txt' end as path from orders)
        select o_orderkey, case when asked is not null then asked when kind in ('dialogue', 'conversation', 'messages') then 'dialogue' when kind in ('python', 'code') or media in ('text/x-python', 'application/x-python') then 'python' when kind in ('json', 'structured') or media like '%json%' then 'json'
        when kind in ('log', 'logs') or media like '%log%' then 'log' when path like '%.py' then 'python' when kind in ('text', 'document', 'markdown', 'plain') or media in ('text/plain', 'text/markdown') then 'document' else 'unknown' end as content_type from r""".replace("KINDS", str(list(ROUTED_KINDS))).replace("MEDIA", str(list(ROUTED_MEDIA))),
    "coordinates": """with f as (select doc_id, case when doc_id % 2 = 1 then chr(65279) else '' end || replace(text, chr(10), case doc_id % 3 when 0 then chr(10) when 1 then chr(13) || chr(10) else chr(13) end) as t from documents), p as (select distinct doc_id, t, unnest([0, length(t) // 3, length(t)]) as place from f),
        q as (select doc_id, place, t[1:place] as l from p), r as (select *, string_split(replace(replace(l, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as ls from q) select doc_id, cast(place as integer) as place, len(ls) as line, length(ls[-1]) as "column", strlen(l) as byte from r""",
    "filtered_ids": """with w as (select o_custkey as id, count(*) as n from orders group by 1), c as (select c_custkey as id from customer where c_custkey % 4 <> 0) select id, 'OK' as code from c where id in (select id from w) union all select id, 'UNKNOWN_ID' from w where id not in (select id from c) union all select id, 'DUPLICATE_ID' from w where n > 1""",
    "replayed": """with h as (select o_custkey || '|' || o_orderkey % 10 as k, arg_min(o_orderstatus, o_orderkey) as method, arg_min(o_orderpriority, o_orderkey) as model from orders where o_orderkey % 3 <> 0 group by 1)
        select case when h.k is null then 'NOT_RECORDED' when model <> o_orderpriority then 'MODEL_MISMATCH' when method <> o_orderstatus then 'METHOD_MISMATCH' else 'OK' end as code, count(*) as n from orders left join h on h.k = o_custkey || '|' || o_orderkey % 10 group by 1""",
}
