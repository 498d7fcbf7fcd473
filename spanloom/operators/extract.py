"""Sources and lexical extraction: identities, coordinates, typed spans and the relations between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CLAIM, CLASSES, MARKERS, SENTENCE, domain_hash, marker, match_rows, normalized
from ..sources.tables import order_notes, part_notes, read


def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    return docs.select("doc_id", F.concat(F.lit("src:"), "doc_id", F.lit(":"), F.substring(digest, 1, 16)).alias("source_id"), F.sha2(F.encode(normalized(F.col("text")), "UTF-8"), 256).alias("normalized_sha256"), domain_hash("spanloom.source", F.col("text")).alias("content_hash"))


def route_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    kind = F.when(F.lower("url").endswith(".py"), "python").when(F.lower("url").endswith(".json"), "json").when(F.col("html").startswith("<!DOCTYPE"), "markup").otherwise("document")
    return pages.groupBy(kind.alias("content_type")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("n_bytes"))


def line_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per non-empty line its number, start (code points and bytes) and length."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda f: F.coalesce(F.sum(f("text") + 1).over(before), F.lit(0)).cast("long")
    made = lines.select("doc_id", "line", start(F.length).alias("char_start"), start(F.octet_length).alias("byte_start"), F.length("text").cast("long").alias("n_chars"))
    return made.filter("n_chars > 0")


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: sentences of every document with exact offsets, counted and summed up per document."""
    docs = read(spark, sf_dir, "documents")
    made = match_rows(docs, ["doc_id"], "text", {"sentence": SENTENCE}).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("s"), F.sum("end").alias("e"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return docs.select("doc_id").join(made, "doc_id", "left").select("doc_id", zero("n", "n_sentences"), zero("s", "sum_start"), zero("e", "sum_end"))


def claims(texts: DataFrame) -> DataFrame:
    """(source_id, start, sentence): claims of texts (source_id, text): up to the end of a line or with all the signs that end
    a sentence, in which a carriage return counts as a line feed; blank ones are left out."""
    rows = match_rows(texts, ["source_id"], "text", {"claim": CLAIM})
    return rows.select("source_id", "start", F.regexp_replace("lexeme", "\r", "\n").alias("sentence")).filter(F.col("sentence").rlike(r"(?U)[^\s\x1c-\x1f]"))


def document_candidates(texts: DataFrame) -> DataFrame:
    """(source_id, place, kind, n, first_start, rendered): one candidate for equal claims, in the order of their first places; a
    repeated one is rendered as an aggregate with its count."""
    trimmed = F.regexp_replace("sentence", r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    groups = claims(texts).groupBy("source_id", "sentence").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("first_start")) + 4999
    many = F.col("n") > 1
    rendered = F.when(many, F.concat(F.lit("- repeated_exact count="), F.col("n"), F.lit(" text="), trimmed)).otherwise(trimmed)
    return groups.select("source_id", place.alias("place"), F.when(many, "document_aggregate").otherwise("document_sentence").alias("kind"), "n", "first_start", rendered.alias("rendered"))


def duplicate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a document has more than once: how often, and where first."""
    rows = claims(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))
    return rows.groupBy(F.col("source_id").alias("doc_id"), "sentence").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start")).filter("n > 1")


def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_candidates(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))
    return rows.select(F.col("source_id").alias("doc_id"), "place", "kind", "n", "first_start", F.sha2("rendered", 256).alias("digest"))


def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept at their first and last place; those between become one marker."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter("text <> ''")
    return lines.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line")).filter("n > 2").withColumn("n_marked", F.col("n") - 2)


def capitalised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}+)"), F.lit(1))).alias("entity"))
    return words.groupBy("entity").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mentions per class of marker: negation, quantifier, condition, exception and the policies."""
    kinds = [k for k in MARKERS if k.startswith(("logic", "policy"))]
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_']+")).alias("word"))
    single = F.array(*[F.struct(F.lit(k).alias("kind"), F.array(*map(F.lit, SINGLE[k])).alias("words")) for k in kinds])
    rows = words.filter(F.col("word").isin(sorted({w for k in kinds for w in SINGLE[k]}))).select("doc_id", F.explode(F.filter(single, lambda k: F.array_contains(k["words"], F.col("word")))).alias("k"))
    return rows.groupBy("k.kind").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))


# Markers of one plain word, by class.
SINGLE = {k: [w for w in words if w.replace("'", "").isalpha()] for k, words in MARKERS.items()}


def extract_dates_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_rows(order_notes(spark, sf_dir), ["source_id"], "text", {"date": CLASSES["temporal.date"], "ticket": CLASSES["identifier.ticket"]})
    pick = lambda kind, c: F.max(F.when(F.col("class") == kind, F.col(c)))
    return found.groupBy("source_id").agg(pick("date", "lexeme").alias("date"), pick("date", "start").cast("long").alias("date_start"), pick("ticket", "lexeme").alias("ticket"), pick("ticket", "end").cast("long").alias("ticket_end"))


def value_unit_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantity, its unit and the label before it on the line."""
    notes = part_notes(spark, sf_dir)
    rows = match_rows(notes, ["source_id"], "text", {"unit": CLASSES["numeric.unit"]}).join(notes, "source_id")
    value, unit = F.regexp_extract("lexeme", r"^([+-]?[0-9.]+)", 1), F.lower(F.regexp_extract("lexeme", r"([A-Za-z%]+)$", 1))
    # The label before it on its line, else what it is for within 80 characters.
    label = F.regexp_extract(F.regexp_extract(F.expr("left(text, start)"), r"([^\n]*)$", 1), r"([A-Za-z_][\w .-]{0,50})\s*[:=]\s*$", 1)
    target = F.regexp_extract(F.expr("substring(text, cast(end as int) + 1, 80)"), r"(?i)\bfor\s+([A-Za-z_][\w.-]*)", 1)
    return rows.select("source_id", value.cast("double").alias("value"), unit.alias("unit"), F.coalesce(F.nullif(label, F.lit("")), F.nullif(target, F.lit(""))).alias("owner"))


def rule_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with their polarity; what is said before and after an exception word of the same sentence."""
    rows = match_rows(order_notes(spark, sf_dir), ["source_id"], "text", {"sentence": SENTENCE}).filter(F.col("lexeme").rlike(r"(?U)\b(?:may|must)\b"))
    polarity = F.when(F.col("lexeme").rlike(marker("policy.prohibition")) | F.col("lexeme").rlike(marker("logic.negation")), "prohibition").otherwise("permission")
    rows = rows.withColumn("polarity", polarity).withColumn("exception", F.regexp_extract("lexeme", marker("logic.exception") + r" (.*)[.]$", 1))
    return rows.groupBy("polarity", "exception").agg(F.count("*").alias("n"), F.min("source_id").alias("first_source"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence that corrects, with the sentence before it, which it supersedes."""
    rows = match_rows(order_notes(spark, sf_dir), ["source_id"], "text", {"sentence": SENTENCE})
    before = F.lag("lexeme").over(Window.partitionBy("source_id").orderBy("start"))
    return rows.withColumn("superseded", F.trim(before)).filter(F.col("lexeme").rlike(marker("temporal.correction"))).select("source_id", "superseded", F.trim("lexeme").alias("current"))


def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that must survive: those of the system, and each conversation's latest of the user."""
    turns = read(spark, sf_dir, "conversations")
    latest = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    marked = turns.withColumn("latest_user", F.coalesce(F.col("turn") == latest, F.lit(False)) & (F.col("role") == "user"))
    return marked.filter("role in ('system', 'developer') or latest_user").select("conv_id", "turn", "role", "latest_user", F.length("text").cast("long").alias("n_chars"))


WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"
CLAIMS_SQL = """with m as (select doc_id, regexp_extract_all(text, '[^.!?\\n]+[.!?]*') as s, regexp_split_to_array(text, '[^.!?\\n]+[.!?]*') as g from documents),
    x as (select doc_id, unnest(range(1, len(s) + 1)) as i, unnest(s) as lex, unnest(g[1:len(s)]) as gap from m),
    y as (select doc_id, lex, sum(length(gap) + length(lex)) over (partition by doc_id order by i) - length(lex) as st from x)"""
SQL = {
    "source_identity": """select doc_id, 'src:' || doc_id || ':' || substr(sha256(text), 1, 16) as source_id,
        sha256(regexp_replace(regexp_replace(text, '^' || chr(65279), ''), '\\r\\n?', chr(10), 'g')) as normalized_sha256,
        'sha256:' || sha256('spanloom.source' || chr(0) || text) as content_hash from documents""",
    "route_content_type": """select case when lower(url) like '%.py' then 'python' when lower(url) like '%.json' then 'json' when html like '<!DOCTYPE%' then 'markup' else 'document' end as content_type,
        count(*) as n, cast(sum(strlen(html)) as bigint) as n_bytes from pages group by 1""",
    "line_coordinates": """with l as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as line from documents)
        select * from (select doc_id, cast(line as integer) as line, cast(coalesce(sum(length(t) + 1) over w, 0) as bigint) as char_start,
        cast(coalesce(sum(strlen(t) + 1) over w, 0) as bigint) as byte_start, length(t) as n_chars from l
        window w as (partition by doc_id order by line rows between unbounded preceding and 1 preceding)) where n_chars > 0""",
    "sentence_spans": """with m as (select doc_id, regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]|$)') as s, regexp_split_to_array(text, '[^.!?\\n]+(?:[.!?]|$)') as g from documents),
        x as (select doc_id, unnest(range(1, len(s) + 1)) as i, unnest(s) as lex, unnest(g[1:len(s)]) as gap from m),
        y as (select doc_id, sum(length(gap) + length(lex)) over (partition by doc_id order by i) as e, length(lex) as n from x)
        select d.doc_id, count(e) as n_sentences, cast(coalesce(sum(e - n), 0) as bigint) as sum_start, cast(coalesce(sum(e), 0) as bigint) as sum_end from documents d left join y using (doc_id) group by 1""",
    "duplicate_sentences": CLAIMS_SQL + " select doc_id, replace(lex, chr(13), chr(10)) as sentence, count(*) as n, cast(min(st) as bigint) as first_start from y where trim(lex, W) <> '' group by 1, 2 having count(*) > 1".replace("W", WHITE_SQL),
    "claim_candidates": CLAIMS_SQL + """, g as (select doc_id, replace(lex, chr(13), chr(10)) as s, count(*) as n, cast(min(st) as bigint) as first_start from y where trim(lex, W) <> '' group by 1, 2)
        select doc_id, cast(4999 + row_number() over (partition by doc_id order by first_start) as integer) as place, case when n > 1 then 'document_aggregate' else 'document_sentence' end as kind, n, first_start,
        sha256(case when n > 1 then '- repeated_exact count=' || n || ' text=' else '' end || trim(s, W)) as digest from g""".replace("W", WHITE_SQL),
    "duplicate_lines": """with l as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as line from documents)
        select doc_id, text, count(*) as n, cast(min(line) as integer) as first_line, cast(max(line) as integer) as last_line, count(*) - 2 as n_marked from l where text <> '' group by 1, 2 having count(*) > 2""",
    "capitalised_words": """with w as (select doc_id, unnest(regexp_extract_all(text, '\\p{Lu}\\p{Ll}+')) as entity from documents)
        select entity, count(*) as mentions, count(distinct doc_id) as documents from w group by 1""",
    "markers": """with w as (select doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_'']+')) as word from documents),
        m(kind, list) as (values ('logic.negation', ['not', 'no', 'never', 'without', 'cannot', 'can''t', 'didn''t', 'doesn''t', 'isn''t', 'won''t', 'shouldn''t', 'mustn''t']),
            ('logic.quantifier', ['all', 'any', 'some', 'none', 'only', 'each', 'every', 'exactly']), ('policy.permission', ['may', 'can', 'allowed', 'permitted', 'shall']),
            ('policy.prohibition', ['don''t', 'prohibited', 'forbidden', 'cannot', 'can''t']), ('logic.condition', ['if', 'when']), ('logic.exception', ['unless', 'except', 'excluding']))
        select kind, count(*) as mentions, count(distinct doc_id) as documents from w join m on list_contains(list, word) group by 1""",
    "extract_dates_tickets": """select o_orderkey as source_id, strftime(o_orderdate, '%Y-%m-%d') as date, cast(10 as bigint) as date_start, 'REQ-' || o_orderkey as ticket, cast(31 + length(cast(o_orderkey as varchar)) as bigint) as ticket_end from orders""",
    "value_unit_owner": """select p_partkey as source_id, cast(p_size as double) as value, case p_partkey % 4 when 0 then 'kg' when 1 then 'ms' when 2 then 'gb' else 'hours' end as unit,
        case when p_partkey % 2 = 0 then 'Limit ' || p_name else regexp_replace(p_brand, '#.*', '') end as owner from part""",
    "rule_exceptions": """select case when o_orderstatus = 'O' then 'permission' else 'prohibition' end as polarity,
        case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'the customer calls' else '' end as exception, count(*) as n, min(o_orderkey) as first_source from orders group by 1, 2""",
    "corrections": """select o_orderkey as source_id, 'Owner ' || o_custkey || '.' as superseded, 'Correction: the owner is someone else.' as current from orders where o_orderkey % 7 = 0""",
    "dialogue_turns": """select conv_id, turn, role, latest_user, length(text) as n_chars from (select *, coalesce(role = 'user' and turn = max(case when role = 'user' then turn end) over (partition by conv_id), false) as latest_user from conversations)
        where role in ('system', 'developer') or latest_user""",
}
