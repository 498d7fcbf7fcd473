"""Logs and documents compiled: schemas with rows, fields, templates, runs, repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical, stable_id
from ..functions.text import domain_hash
from ..sources.tables import read

# Keys of log fields. Fixed values.
ID_FIELDS = "request_id|request|trace_id|trace|span_id|correlation_id|error_code|code|event_id|caused_by|previous_event|service"
# A turn with one of these, wherever in a word, is kept.
KEPT_WORDS = ("correction", "actually", "instead", "must", "prohibited", "commit")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as canonical JSON under a hash of their domain, and their short ids."""
    odd = F.col("c_custkey") % 2 == 0
    record = F.struct(
        F.col("c_custkey").alias("id"), F.when(odd, F.col("c_name")).alias("title"), F.concat("c_mktsegment", F.lit('\t"\\\x1f')).alias("é"), F.array(F.col("c_acctbal").cast("double"), F.col("c_custkey") / 8, F.lit(1e21), F.lit(1e-7), F.lit(-0.0)).alias("Nums"),
        F.create_map(F.lit("\ue000"), odd, F.lit("\U00010000"), F.col("c_custkey") % 3 == 0).alias("m"),
    )
    rows = read(spark, sf_dir, "customer").select("c_custkey", record.alias("record"))
    kind = rows.schema["record"].dataType
    made = rows.select("c_custkey", canonical(F.col("record"), kind).alias("json"), stable_id("c", F.col("c_custkey"), F.col("record.title")).alias("id"))
    return made.select("c_custkey", "json", domain_hash("spanloom.record", F.col("json")).alias("hash"), "id")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, ordinal, line): log lines of each user; some name a key twice or an exception, some have no severity."""
    return read(spark, sf_dir, "events").selectExpr(
        "user_id as source_id", "event_id as ordinal",
        """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z ', case when event_id % 9 = 0 then '' when event_type = 'error' then 'ERROR ' when event_type = 'purchase' then 'WARN ' else 'INFO ' end, 'service=web trace=t', event_id % 5,
           case when event_id % 4 = 0 then concat(' trace_id=u', event_id % 3, ' service=api') else '' end, ' event_id=', event_id, case when event_type = 'error' then concat(' code=E', event_id % 7, ' TimeoutError raised') else ' done' end) as line""",
    )


def parsed_events(lines: DataFrame) -> DataFrame:
    """Fields of log lines: the last of a key wins, traces and requests by several keys; first time, first severity."""
    pairs = lambda group: F.regexp_extract_all("line", F.lit(rf"\b({ID_FIELDS})=([A-Za-z0-9_.:/-]+)"), F.lit(group))
    rows = lines.withColumn("p", F.arrays_zip(pairs(1).alias("key"), pairs(2).alias("value")))
    last = lambda keys: F.get(F.reverse(F.filter("p", lambda p: p["key"].isin(*keys))), F.lit(0))["value"]
    named = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))
    return rows.select(
        "source_id", "ordinal", "line", named(r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)").alias("seen"),
        named(r"\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|FATAL)\b").alias("severity"), last(["trace_id", "trace", "span_id", "correlation_id"]).alias("trace"),
        last(["service"]).alias("service"), last(["error_code", "code"]).alias("code"), last(["event_id"]).alias("event_id"), named(r"\b([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception))\b").alias("exception"),
    )


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_events(event_lines(spark, sf_dir))
    return rows.groupBy("service", "trace", "code", "exception").agg(F.count("*").alias("n"), F.min("seen").alias("first_seen"), F.count("severity").alias("severities"))


def trace_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of severity from the previous event of the same source and trace that has one; no trace is a trace too."""
    rows = parsed_events(event_lines(spark, sf_dir)).filter("severity is not null")
    before = F.lag("severity").over(Window.partitionBy("source_id", "trace").orderBy("ordinal"))
    return rows.withColumn("before", before).filter("before <> severity").groupBy("trace", "before", "severity").agg(F.count("*").alias("n"))


def _masked(line: Column) -> Column:
    times = F.regexp_replace(line, r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<timestamp>")
    return F.regexp_replace(times, r"\b(trace|trace_id|request|request_id|event_id)=\S+", "$1=<id>")


def template_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a source with the same template and the same need to be kept: runs of over two that needn't be
    keep their first and last event and mark those between."""
    rows = event_lines(spark, sf_dir).withColumn("template", _masked(F.col("line"))).withColumn("kept", F.col("line").rlike(r"\b(WARN|ERROR)\b"))
    along = Window.partitionBy("source_id").orderBy("ordinal")
    new = F.lag("template").over(along).isNull() | (F.lag("template").over(along) != F.col("template")) | (F.lag("kept").over(along) != F.col("kept"))
    runs = rows.withColumn("run", F.sum(new.cast("int")).over(along)).groupBy("source_id", "run", "kept").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    return runs.select("source_id", "first", "last", "n", F.when(~F.col("kept") & (F.col("n") > 2), F.col("n") - 2).otherwise(0).alias("marked"))


def log_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that name a failure are kept as they are; the rest are grouped by template, wherever they stand."""
    rows = event_lines(spark, sf_dir).withColumn("template", F.regexp_replace(_masked(F.col("line")), r"\b(?:trace|trace_id|request|request_id|event_id)=<id>", "trace=<id>"))
    kept = F.upper("line").rlike("ERROR|WARN|CRITICAL|FATAL")
    return rows.groupBy(kept.alias("verbatim"), F.when(~kept, F.col("template")).alias("template")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def document_segments(texts: DataFrame) -> DataFrame:
    """(source_id, at, kind, text, occurrences): the lines of texts (source_id, text) without their ends and without empty ones;
    of equal lines the first and the last stay, and those between become one marker at the second's place, which names how
    often the line stands there in all."""
    lines = texts.select("source_id", F.posexplode(F.split("text", LINE_BREAK)).alias("at", "line")).filter("line <> ''")
    same = Window.partitionBy("source_id", "line")
    rows = lines.withColumn("n", F.count("*").over(same)).withColumn("nth", F.row_number().over(same.orderBy("at")))
    marker = (F.col("nth") == 2) & (F.col("n") > 2)
    kept = rows.filter(marker | F.col("nth").isin(1) | (F.col("nth") == F.col("n")))
    return kept.select("source_id", "at", F.when(marker, "repetition_marker").otherwise("document_segment").alias("kind"), F.when(marker, F.concat(F.lit("[repeated "), "n", F.lit(" times]"))).otherwise(F.col("line")).alias("text"), F.col("n").alias("occurrences"))


def compiled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated lines marked, rendered again in order."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    made = document_segments(docs).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("lines"), F.max("occurrences").alias("most"), F.count_if(F.col("kind") == "repetition_marker").alias("markers"))
    return made.select(F.col("source_id").alias("doc_id"), "most", "markers", F.sha2(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), 256).alias("digest"))


def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text): turns of conversations, some of which correct, promise or forbid something."""
    said = F.expr("case (conv_id + turn) % 9 when 0 then ' Actually, make it seven.' when 1 then ' We are COMMITTED to it.' when 2 then ' PLEASE UPDATE it.' when 3 then ' mustard' when 4 then ' Never on Monday' else '' end")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("text", said).alias("text"))


def required_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that must survive: those of systems and developers, the latest of the user, and those with a marker, also within a word."""
    turns = dialogue_turns(spark, sf_dir)
    latest = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    why = F.array_compact(F.array(F.when(F.col("role").isin("system", "developer"), F.lit("role")), F.when((F.col("role") == "user") & (F.col("turn") == latest), F.lit("latest")), F.when(F.lower("text").rlike("|".join(KEPT_WORDS)), F.lit("marker"))))
    return turns.select("conv_id", "turn", F.concat_ws(",", why).alias("reasons")).filter("reasons <> ''")


SAID_SQL = "case (conv_id + turn) % 9 when 0 then ' Actually, make it seven.' when 1 then ' We are COMMITTED to it.' when 2 then ' PLEASE UPDATE it.' when 3 then ' mustard' when 4 then ' Never on Monday' else '' end"
_E = """with e as (select user_id as source_id, event_id as ordinal, event_type, ts, event_id % 9 = 0 as bare, case when event_id % 4 = 0 then 'u' || event_id % 3 else 't' || event_id % 5 end as trace, case when event_id % 4 = 0 then 'api' else 'web' end as service,
    case when event_type = 'error' then 'E' || event_id % 7 end as code, case when event_id % 9 = 0 then null when event_type = 'error' then 'ERROR' when event_type = 'purchase' then 'WARN' else 'INFO' end as severity, event_id % 4 = 0 as two from events),
    t as (select *, coalesce(severity || ' ', '') || two || coalesce(code, '') as template from e)"""


def _quoted(x: str) -> str:
    """SQL of a string in quotes, with control characters escaped; null as such."""
    made = f"""replace(replace({x}, '\\', '\\\\'), '"', '\\"')"""
    for code in range(32):
        made = f"""replace({made}, chr({code}), '{dict(zip((8, 9, 10, 12, 13), ("\\b", "\\t", "\\n", "\\f", "\\r"))).get(code, f"\\u{code:04x}")}')"""
    return f"""coalesce('"' || {made} || '"', 'null')"""


def _number(x: str) -> str:
    """SQL of a double as ECMAScript writes it, from its digits and the place of the point; null as such, -0 is 0, and what isn't finite makes all null."""
    d, n = f"{x}_digits", f"{x}_point"
    return f"""case when {x} is null then 'null' when not isfinite({x}) then null when {x} = 0 then '0' else case when {x} < 0 then '-' else '' end || case when {n} between length({d}) and 21 then rpad({d}, cast({n} as integer), '0')
        when {n} between 1 and 21 then substr({d}, 1, {n}) || '.' || substr({d}, {n} + 1) when {n} between -5 and 0 then '0.' || repeat('0', -{n}) || {d}
        else substr({d}, 1, 1) || case when length({d}) > 1 then '.' || substr({d}, 2) else '' end || case when {n} > 0 then 'e+' else 'e-' end || abs({n} - 1) end end"""


def _parted(x: str) -> str:
    """SQL of the digits of a printed double, and the place of the point among them."""
    first, lead = f"split_part(cast(abs({x}) as varchar), 'e', 1)", f"ltrim(replace(split_part(cast(abs({x}) as varchar), 'e', 1), '.', ''), '0')"
    return f"rtrim({lead}, '0') as {x}_digits, length({lead}) - length(split_part({first}, '.', 2)) + coalesce(try_cast(split_part(cast(abs({x}) as varchar), 'e', 2) as integer), 0) as {x}_point"


_C = f"""with c as (select *, cast(c_acctbal as double) as x, c_custkey / 8 as y from customer), d as (select *, {_parted("x")}, {_parted("y")}, case when c_custkey % 2 = 0 then {_quoted("c_name")} else 'null' end as title from c)"""
SQL = {
    "canonical_hashes": _C + f""" select c_custkey, json, 'sha256:' || sha256('spanloom.record' || chr(0) || json) as hash, 'c:' || substr(sha256(parts), 1, 20) as id from (
        select c_custkey, case when c_custkey is null or abs(cast(c_custkey as hugeint)) <= 9007199254740991 then '{{"Nums":[' || {_number("x")} || ',' || {_number("y")} || ',1e+21,1e-7,0],"id":' || coalesce(cast(c_custkey as varchar), 'null')
            || ',"m":{{"' || chr(65536) || '":' || coalesce(cast(c_custkey % 3 = 0 as varchar), 'null') || ',"' || chr(57344) || '":' || coalesce(cast(c_custkey % 2 = 0 as varchar), 'null') || '}},"title":' || title || ',"é":' || {_quoted("c_mktsegment || chr(9) || '" + '"' + chr(92) + "' || chr(31)")} || '}}' end as json,
            '[' || coalesce('"' || c_custkey || '"', 'null') || ',' || title || ']' as parts from d)""",
    "event_fields": _E + " select service, trace, code, case when code is not null then 'TimeoutError' end as exception, count(*) as n, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) as first_seen, count(severity) as severities from e group by 1, 2, 3, 4",
    "trace_transitions": _E + ", l as (select *, lag(severity) over (partition by source_id, trace order by ordinal) as before from e where severity is not null) select trace, before, severity, count(*) as n from l where before <> severity group by 1, 2, 3",
    "template_runs": _E + """, n as (select *, coalesce(severity in ('ERROR', 'WARN'), false) as kept, case when lag(template) over w is distinct from template then 1 else 0 end as new from t window w as (partition by source_id order by ordinal)), r as (select *, sum(new) over (partition by source_id order by ordinal) as run from n)
        select source_id, min(ordinal) as first, max(ordinal) as last, count(*) as n, case when not any_value(kept) and count(*) > 2 then count(*) - 2 else 0 end as marked from r group by source_id, run""",
    "log_candidates": _E + """ select verbatim, template, count(*) as n, min(ordinal) as first, max(ordinal) as last from (select ordinal, severity in ('ERROR', 'WARN') is true or code is not null as verbatim,
        case when not (severity in ('ERROR', 'WARN') is true or code is not null) then '<timestamp> ' || coalesce(severity || ' ', '') || 'service=web trace=<id>' || case when two then ' trace=<id> service=api' else '' end || ' trace=<id> done' end as template from e) group by 1, 2""",
    "compiled_documents": """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as at_ from documents), c as (select *, count(*) over (partition by doc_id, line) as n, row_number() over (partition by doc_id, line order by at_) as nth from l where line <> ''),
        s as (select *, nth = 2 and n > 2 as mark, case when nth = 2 and n > 2 then '[repeated ' || n || ' times]' when nth = 1 or nth = n then line end as shown from c) select doc_id, max(n) as most, count(*) filter (mark) as markers, sha256(string_agg(shown, chr(10) order by at_)) as digest from s where shown is not null group by 1""",
    "required_turns": """with t as (select *, max(case when role = 'user' then turn end) over (partition by conv_id) as latest, """+SAID_SQL+""" as said from conversations), m as (select *, lower(text || said) as low from t)
        select conv_id, turn, concat_ws(',', case when role in ('system', 'developer') then 'role' end, case when role = 'user' and turn = latest then 'latest' end,
        case when contains(low, 'correction') or contains(low, 'actually') or contains(low, 'instead') or contains(low, 'must') or contains(low, 'prohibited') or contains(low, 'commit') then 'marker' end) as reasons from m where reasons <> ''""",
}
