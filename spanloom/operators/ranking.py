"""Ranking, budgets, coverage and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms, wilson
from ..sources.tables import read

K1, B, TOP = 1.2, 0.75, 10
ASKED = 100_000
# Of so many pairs of a question and a document a task adds up the scores.
PAIRS = 1_000_000


def bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark text, by BM25 over the corpus.

    Of a document's terms only those that a question has are counted; a document's terms combine where its text lies. Questions
    of up to ASKED terms in all are sent to the documents, so that no common term gathers its documents in one task; counts then
    lie by document, where scores add up, and only the best of each task are sent on.
    """
    docs, asked = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    query = asked.select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    few = query.limit(ASKED + 1).count() <= ASKED
    near = F.broadcast if few else (lambda df: df)
    words = docs.select("doc_id", terms(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    size = words.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    rows = words.select("doc_id", "len", F.explode("t").alias("term")).join(near(query.select("term").distinct()), "term", "left_semi")
    tf = rows.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = query.join(df, "term").crossJoin(F.broadcast(size)).select("item_id", "term", (F.col("times") * idf).alias("worth"), "mean")
    weight = F.col("worth") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    parts = docs.count() * asked.count() // PAIRS + 1
    scored = tf.repartition(parts, "doc_id").join(near(worth), "term")
    ranked = scored.groupBy("item_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.filter(F.col("rank") <= TOP)


def mode_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each mode allows a document."""
    modes = spark.createDataFrame([("conservative", 5000), ("target", 3000), ("aggressive", 2000)], "mode string, points int")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return docs.crossJoin(F.broadcast(modes)).select("doc_id", "mode", F.greatest(F.lit(1).cast("long"), F.expr("n_bytes * cast(points as bigint) div 10000")).alias("budget"))


def output_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn lands when a conversation is rendered with one line feed between turns."""
    along = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(F.length("text") + 1).over(along)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", (end - F.length("text") - 1).alias("start"), (end - 1).alias("end"), F.lead("turn").over(along).alias("next_turn"))


def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents per source, with a row for every source even if none is labelled."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("discovered"), F.count("quality").alias("represented"))
    return rows.withColumn("ratio", F.round(F.col("represented") / F.col("discovered"), 6))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by source, by language and both at once, with Wilson bounds."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    source, lang = F.col("source"), F.col("lang")
    sums = rows.groupingSets([[source], [lang], [source, lang]], source, lang).agg(F.grouping_id("source", "lang").alias("level"), F.count("*").alias("n"), F.sum("quality").alias("good"))
    low, high = wilson(F.col("good"), F.col("n"))
    return sums.select("source", "lang", F.col("level").cast("int").alias("level"), "n", "good", F.round(F.abs(low), 6).alias("low"), F.round(high, 6).alias("high"))


def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both labels per language as a two by two table, and the share of good ones that are also not toxic."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    is_ = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    made = rows.groupBy("lang").agg(is_(1, 0).alias("both"), is_(1, 1).alias("only_quality"), is_(0, 0).alias("only_clean"), is_(0, 1).alias("neither"))
    return made.withColumn("retention", F.round(F.col("both") / (F.col("both") + F.col("only_quality")), 6))


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated median and nearest-rank 90 % of the events' values, by type."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.expr("percentile_disc(0.9) within group (order by value)").alias("p90"), F.count("*").alias("n"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A risk for each labelled document, from how many symbols it has, with what really is the case."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    share = F.regexp_count("text", F.lit("[#*$%&|!]")) / F.greatest(F.length("text"), F.lit(1))
    return docs.select("doc_id", F.least(F.lit(1.0), 4 * share).alias("risk"), (1 - F.col("quality")).alias("bad"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and expected calibration error over ten bins."""
    rows = _predictions(spark, sf_dir).withColumn("bin", F.least(F.lit(9), F.floor(F.col("risk") * 10)))
    bins = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("risk").alias("said"), F.avg("bad").alias("was"), F.sum((F.col("risk") - F.col("bad")) ** 2).alias("loss"))
    return bins.agg(F.sum("n").alias("n"), F.round(F.sum("loss") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.col("n") * F.abs(F.col("said") - F.col("was"))) / F.sum("n"), 6).alias("ece"))


def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a threshold lets through, and how many of those are good."""
    steps = spark.range(1, 10).select((F.col("id") / 10).alias("threshold"))
    rows = _predictions(spark, sf_dir).crossJoin(F.broadcast(steps))
    passes = F.col("risk") <= F.col("threshold")
    return rows.groupBy("threshold").agg(F.round(F.avg(passes.cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(passes, 1 - F.col("bad"))), 6).alias("success"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train or validation by the first byte of a digest."""
    byte = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2), 16, 10).cast("int")
    rows = read(spark, sf_dir, "documents").select(F.when(byte % 5 == 0, "validation").otherwise("train").alias("split"), "doc_id")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


_P = """with p as (select doc_id, least(1.0, 4.0 * len(regexp_extract_all(text, '[#*$%&|!]')) / greatest(length(text), 1)) as risk, 1 - quality as bad from documents join labels using (doc_id))"""
SQL = {
    "bm25_top_k": """with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_./:@%+-]+') as t from documents), z as (select count(*) as docs, avg(len(t)) as mean from w),
        q as (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_./:@%+-]+')) as term from benchmark) group by 1, 2),
        tf as (select doc_id, n, term, count(*) as tf from (select doc_id, len(t) as n, unnest(t) as term from w) where term in (select term from q) group by 1, 2, 3),
        df as (select term, count(*) as df from tf group by 1),
        s as (select item_id, doc_id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score from tf join df using (term) join q using (term), z group by 1, 2)
        select item_id, doc_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 10""",
    "mode_budgets": """select doc_id, mode, greatest(1, strlen(text) * points // 10000) as budget from documents, (values ('conservative', 5000), ('target', 3000), ('aggressive', 2000)) m(mode, points)""",
    "output_offsets": """select conv_id, turn, cast(e - length(text) - 1 as bigint) as start, cast(e - 1 as bigint) as "end", next_turn from (select *, sum(length(text) + 1) over w as e, lead(turn) over w as next_turn from conversations window w as (partition by conv_id order by turn))""",
    "class_coverage": """select source, count(*) as discovered, count(quality) as represented, round(count(quality) / count(*), 6) as ratio from documents left join labels using (doc_id) group by 1""",
    "score_summary": """with s as (select source, lang, cast(grouping_id(source, lang) as integer) as level, count(*) as n, cast(sum(quality) as bigint) as good from documents join labels using (doc_id) group by grouping sets ((source), (lang), (source, lang))),
        c as (select *, good / n as p, 1.959963984540054 as z from s)
        select source, lang, level, n, good, round(abs((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) as low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) as high from c""",
    "paired_outcomes": """select lang, count(*) filter (quality = 1 and toxic = 0) as both, count(*) filter (quality = 1 and toxic = 1) as only_quality, count(*) filter (quality = 0 and toxic = 0) as only_clean, count(*) filter (quality = 0 and toxic = 1) as neither,
        round(count(*) filter (quality = 1 and toxic = 0) / count(*) filter (quality = 1), 6) as retention from documents join labels using (doc_id) group by 1""",
    "latency_quantiles": """select event_type, round(median(value), 6) as median, quantile_disc(value, 0.9) as p90, count(*) as n from events group by 1""",
    "calibration": _P + """, b as (select least(9, floor(risk * 10)) as bin, count(*) as n, avg(risk) as said, avg(bad) as was, sum((risk - bad) * (risk - bad)) as loss from p group by 1)
        select cast(sum(n) as bigint) as n, round(sum(loss) / sum(n), 6) as brier, round(sum(n * abs(said - was)) / sum(n), 6) as ece from b""",
    "risk_coverage": _P + """ select t / 10 as threshold, round(avg(case when risk <= t / 10 then 1 else 0 end), 6) as coverage, round(avg(case when risk <= t / 10 then 1 - bad end), 6) as success from p, range(1, 10) r(t) group by 1""",
    "hash_split": """select case when cast(concat('0x', substr(sha256(cast(doc_id as varchar)), 1, 2)) as integer) % 5 = 0 then 'validation' else 'train' end as split, count(*) as n, cast(sum(doc_id) as bigint) as ids from documents group by 1""",
}
