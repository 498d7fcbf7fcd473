"""Statistics of runs: reductions, retention, gates, risk, isotonic calibration, answers and their scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ratio, wilson
from ..sources.tables import read
from .structured import SAID_SQL, dialogue_turns

CELLS = 64


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, kind, before, after, failed): what a method leaves of each document; every 11th run failed."""
    return read(spark, sf_dir, "documents").selectExpr("doc_id as item", "source as kind", "cast(octet_length(text) + 1 as bigint) as before", "(cast(octet_length(text) + 1 as bigint) * (20 + doc_id % 50)) div 100 as after", "doc_id % 11 = 0 as failed")


def reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: the reduction of sums, the mean of reductions over all items and over those that didn't fail."""
    own = 1 - F.col("after") / F.col("before")
    rows = _runs(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.round(1 - F.sum("after") / F.sum("before"), 6).alias("of_sums"), F.round(F.avg(own), 6).alias("mean_all"), F.round(F.avg(F.when(~F.col("failed"), own)), 6).alias("mean_emitted"))
    return rows


def paired_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the items that are right with full text, how many still are; and the four outcomes of both, with Wilson bounds."""
    labels = read(spark, sf_dir, "labels")
    rows = labels.join(_runs(spark, sf_dir), labels.doc_id == F.col("item"))
    full, less = F.col("quality") == 1, (F.col("toxic") == 0) & ~F.col("failed")
    made = rows.groupBy("kind").agg(F.count_if(full & less).alias("both"), F.count_if(full & ~less).alias("full_only"), F.count_if(~full & less).alias("less_only"), F.count_if(~full & ~less).alias("neither"))
    low, high = wilson(F.col("both"), F.col("both") + F.col("full_only"))
    return made.select("*", ratio(F.col("both"), F.col("both") + F.col("full_only")).alias("retention"), F.round(F.abs(low), 6).alias("low"), F.round(high, 6).alias("high"))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gates the runs pass: every expected item is there, none failed, mean, least and number of kinds above the mark."""
    runs, docs = _runs(spark, sf_dir), read(spark, sf_dir, "documents")
    there = docs.select(F.col("doc_id").alias("item")).join(runs.filter("item % 97 <> 0").select("item", F.lit(True).alias("there")), "item", "left")
    complete = there.agg((F.count_if(F.col("there").isNull()) == 0).alias("complete"))
    kinds = runs.groupBy("kind").agg((1 - F.sum("after") / F.sum("before")).alias("r"), F.bool_and(~F.col("failed")).alias("valid"))
    total = kinds.agg(F.bool_and("valid").alias("all_valid"), (F.avg("r") >= 0.5).alias("mean_reached"), (F.count_if(F.col("r") >= 0.5) >= 4).alias("enough_kinds"), (F.min("r") >= 0.3).alias("least_reached"))
    return complete.crossJoin(total)


def structural_risk(
    valid: Column, failed: Column, hard: Column, relations: Column, mapped: Column, unknown: Column, partial: Column, parser_warnings: Column, other_warnings: Column, omitted: Column, tokenizer: Column, stale: Column, hashes: Column, gave_up: Column,
) -> Column:
    """Risk of a result between 0 and 1: what failed, what isn't covered (no coverage counts as none) and what isn't known."""
    lacking = lambda c: 1.0 - F.coalesce(c, F.lit(0.0))
    flag = lambda c, weight: F.when(c, weight).otherwise(0.0)
    score = flag(~valid, 0.35) + F.least(F.lit(0.30), failed * 0.05) + 0.20 * lacking(hard) + 0.15 * lacking(relations) + 0.15 * lacking(mapped)
    score = score + F.when(unknown > 0, 0.20).when(partial > 0, 0.08).otherwise(0.0) + F.least(F.lit(0.10), (parser_warnings + other_warnings) * 0.02) + F.least(F.lit(0.15), omitted * 0.15)
    return F.least(F.lit(1.0), score + flag(tokenizer, 0.20) + flag(stale, 0.15) + flag(hashes, 0.15) + flag(gave_up, 0.15))


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk per user, whose events of each type and value stand for what was found, verified, warned of and failed."""
    e, c = F.col("event_type"), F.count_if
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), c(e == "error").alias("failed"), c(e == "purchase").alias("verified"), c(e == "signup").alias("warnings"), c((e == "view") | (e == "click")).alias("seen"), c((e == "click") & (F.col("value") < 50)).alias("mapped"),
        c(F.col("value") < 2).alias("unknown"), c(F.col("value") < 10).alias("partial"), c(F.col("value") > 190).alias("omitted"), F.max("event_id").alias("last"),
    )
    of = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 6))
    last = lambda m: F.col("last") % m == 0
    risk = structural_risk(F.col("failed") == 0, F.col("failed"), of("verified", "n"), of("mapped", "seen"), of("seen", "n"), F.col("unknown"), F.col("partial"), F.col("warnings"), F.col("omitted"), F.col("omitted"), last(11), last(7), last(13), last(5))
    return rows.select("user_id", "failed", F.round(risk, 6).alias("risk"))


def step_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value takes the first point that isn't below it, else the last one: a forward as-of join on few points."""
    e = read(spark, sf_dir, "events")
    points = e.groupBy("event_type").agg(F.array_sort(F.array(*[F.expr(f"percentile_disc({q}) within group (order by value)") for q in (0.25, 0.5, 0.75)])).alias("points"))
    rows = e.join(F.broadcast(points), "event_type").withColumn("hit", F.filter("points", lambda p: F.col("value") <= p))
    return rows.groupBy("event_type", F.coalesce(F.get("hit", F.lit(0)), F.element_at("points", -1)).alias("point")).agg(F.count("*").alias("n"))


def pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks (score, total, n) in order, pooled until their means rise strictly; a block's score is its last one."""
    out: list[list[float]] = []
    for score, total, n in zip(blocks["score"], blocks["total"], blocks["n"], strict=True):
        out.append([score, total, n])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            last = out.pop()
            out[-1] = [last[0], out[-1][1] + last[1], out[-1][2] + last[2]]
    return pd.DataFrame(out, columns=["score", "total", "n"])


def isotonic(points: DataFrame) -> DataFrame:
    """(kind, score, total, n): isotonic regression of points (kind, score, id, outcome), in order of score and id.

    Pooling blocks of pooled blocks gives the blocks of all points: each range of scores pools its own first, in a task of its
    own, and what is left, a few blocks a range, is pooled once more per kind.
    """
    cell = F.least(F.lit(CELLS - 1), F.floor(F.col("score") * CELLS)).cast("int")

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "id"])
        made = pooled(pd.DataFrame({"score": frame["score"], "total": frame["outcome"].astype(float), "n": 1}))
        return made.assign(kind=frame["kind"].iloc[0], cell=frame["cell"].iloc[0])

    def second(frame: pd.DataFrame) -> pd.DataFrame:
        return pooled(frame.sort_values(["cell", "place"])).assign(kind=frame["kind"].iloc[0])

    def placed(frame: pd.DataFrame) -> pd.DataFrame:
        return first(frame).reset_index(names="place")

    ranges = points.withColumn("cell", cell).groupBy("kind", "cell").applyInPandas(placed, "place long, score double, total double, n long, kind string, cell int")
    return ranges.groupBy("kind").applyInPandas(second, "score double, total double, n long, kind string")


def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed badness of labelled documents by the share of their characters that aren't small letters, made monotonic."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    other = F.round(1 - F.regexp_count("text", F.lit("[a-z]")) / F.greatest(F.length("text"), F.lit(1)), 4)
    made = isotonic(docs.select(F.col("lang").alias("kind"), other.alias("score"), F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("outcome")))
    return made.groupBy("kind", F.round(F.col("total") / F.col("n"), 6).alias("probability")).agg(F.sum("n").alias("n"), F.max("score").alias("score"))


WORD = r"(?U)[\w'-]+"
NUMBER = r"[-+]?\d+(?:\.\d+)?"


def answer_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def bag_f1(said: Column, expected: Column) -> Column:
    """F1 of two texts' bags of words; if one has none, 1 for equal texts and 0 for others. For short texts: each word is
    counted in both."""
    left, right = answer_tokens(said), answer_tokens(expected)
    count = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    shared = F.aggregate(F.array_distinct(left), F.lit(0), lambda total, w: total + F.least(count(left, w), count(right, w)))
    size = F.size(left) + F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), (F.trim(said) == F.trim(expected)).cast("double")).otherwise(2 * shared / size)


def first_number(text: Column) -> Column:
    """The first number of a text, without its commas, as a decimal."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(",")), f"({NUMBER})", 1), F.lit("")).try_cast("decimal(38,12)")


def answer_score(kind: Column, said: Column, accepted: Column, number: Column, units: Column, cased: Column) -> Column:
    """(correct, score) of an answer by its type: the first number, one with all its units, the first date, free text by F1 of
    0.8 or more, lists and sets parted by , ; or |, and else any accepted text. No answer is wrong."""
    same = lambda c: F.when(cased, F.trim(c)).otherwise(F.lower(F.trim(c)))
    parts = lambda c: F.transform(F.filter(F.split(c, "[,;|]"), lambda p: F.trim(p) != ""), lambda p: F.lower(F.trim(p)))
    first = F.get(accepted, F.lit(0))
    right_number = F.coalesce(first_number(said) == number.cast("decimal(38,12)"), F.lit(False))
    date = F.regexp_extract(said, r"(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?)", 1)
    f1 = F.coalesce(F.array_max(F.transform(accepted, lambda a: bag_f1(said, a))), F.lit(0.0))
    correct = (
        F.when(said.isNull(), False).when(kind == "number", right_number).when(kind == "number_with_unit", right_number & F.forall(F.coalesce(units, F.array()), lambda u: F.contains(F.lower(said), F.lower(u))))
        .when(kind == "date", (date != "") & F.array_contains(accepted, date)).when(kind == "short_free_text", f1 >= 0.8).when(kind == "ordered_list", parts(said) == parts(first))
        .when(kind == "set", F.array_sort(F.array_distinct(parts(said))) == F.array_sort(F.array_distinct(parts(first)))).otherwise(F.exists(accepted, lambda a: same(a) == same(said)))
    )
    correct = F.coalesce(correct, F.lit(False))
    return F.struct(correct.alias("correct"), F.when(said.isNotNull() & (kind == "short_free_text"), f1).otherwise(correct.cast("double")).alias("score"))


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the bags of words of each turn and the one after it; of two without words, or one, by whether they are equal."""
    turns = dialogue_turns(spark, sf_dir).withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 8 < 2, F.expr("if(conv_id % 2 = 0, '...', if(turn % 2 = 0, ' ?', '!'))")).otherwise(F.col("text")))
    words = turns.select("conv_id", "turn", F.explode(answer_tokens(F.col("text"))).alias("w"))
    bags = words.groupBy("conv_id", "turn", "w").agg(F.count("*").alias("n"))
    sizes = bags.groupBy("conv_id", "turn").agg(F.sum("n").alias("size"))
    after = bags.select("conv_id", (F.col("turn") - 1).alias("turn"), "w", F.col("n").alias("m"))
    shared = bags.join(after, ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("shared"))
    own = turns.select("conv_id", "turn", F.trim("text").alias("text")).join(sizes, ["conv_id", "turn"], "left")
    pairs = own.join(own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("size").alias("other"), F.col("text").alias("next")), ["conv_id", "turn"]).join(shared, ["conv_id", "turn"], "left")
    f1 = F.when(F.col("size").isNull() | F.col("other").isNull(), (F.col("text") == F.col("next")).cast("double")).otherwise(F.round(2 * F.coalesce("shared", F.lit(0)) / (F.col("size") + F.col("other")), 6))
    return pairs.select("conv_id", "turn", f1.alias("f1"))


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of seven types to orders, some wrong by a digit, a unit, an order or a letter; some missing."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 8 as t", "o_orderkey div 8 % 4 as v", "o_orderkey + 1234 as n", "date_format(o_orderdate, 'yyyy-MM-dd') as d", "o_orderpriority as p")
    rows = rows.withColumn("kind", F.element_at(F.array(*map(F.lit, ANSWER_KINDS)), (F.col("t") + 1).cast("int"))).withColumn("said", F.expr(SAID)).withColumn("accepted", F.expr(ACCEPTED))
    made = answer_score(F.col("kind"), F.col("said"), F.col("accepted"), F.expr("concat(n, '.5')"), F.expr("array('KG', 'net')"), F.col("t") == 7)
    return rows.select("o_orderkey", "kind", made.alias("s")).select("o_orderkey", "kind", "s.correct", F.round("s.score", 6).alias("score"))


ANSWER_KINDS = ("number", "number_with_unit", "date", "short_free_text", "ordered_list", "set", "text", "exact_text")
SAID = """case t when 0 then case v when 0 then concat('about ', format_number(n, 0), '.50 in all') when 1 then concat(n, '.5') when 2 then concat(n, '') else 'none' end
    when 1 then concat(n, case v when 0 then '.5 kg NET' when 1 then '.5 kg' when 2 then '.5 g net' else ' kg net' end) when 2 then case v when 0 then concat('on ', d, '.') when 1 then concat(d, 'T10:00:00') when 2 then concat(substring(d, 3), '!') else concat('1999-01-01 not ', d) end
    when 3 then case v when 0 then 'The quick brown fox jumps!' when 1 then 'quick brown fox' when 2 then '...' else 'a slow fox' end when 4 then case v when 0 then ' A; b |C,' when 1 then 'b, a, c' when 2 then 'a,b' else 'a,b,c,c' end
    when 5 then case v when 0 then 'c|B;a;a' when 1 then 'a,b' when 2 then '' else 'A,B,C,D' end else case v when 0 then concat(' ', p, ' ') when 1 then upper(concat(p, 'x')) when 2 then lower(p) else null end end"""
ACCEPTED = "case t when 2 then array(d, concat(d, 'T10:00:00')) when 3 then array('the quick brown fox jumps', '. . .') when 4 then array('a,b,c') when 5 then array('a;b;c') else array('zero', p) end"


def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost at a price per million tokens; unknown where either is."""
    e = read(spark, sf_dir, "events")
    price = F.when(F.col("event_type") == "error", None).otherwise(F.lit(2.5))
    cost = F.floor("value") * price / 1_000_000
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count(cost).alias("known"), F.round(F.sum(cost), 6).alias("cost"))


def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each sequence of three events of a user occurs (value counts over a window)."""
    along = Window.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, sf_dir, "events").select(F.concat_ws(">", "event_type", F.lead("event_type", 1).over(along), F.lead("event_type", 2).over(along)).alias("path"), F.lead("event_type", 2).over(along).alias("third"))
    return rows.filter("third is not null").groupBy("path").agg(F.count("*").alias("n"))


_RUN = "with r as (select doc_id as item, source as kind, strlen(text) + 1 as b, (strlen(text) + 1) * (20 + doc_id % 50) // 100 as a, doc_id % 11 = 0 as failed from documents)"
SQL = {
    "reductions": _RUN + " select kind, count(*) as n, round(1 - sum(a) / sum(b), 6) as of_sums, round(avg(1 - a / b), 6) as mean_all, round(avg(case when not failed then 1 - a / b end), 6) as mean_emitted from r group by 1",
    "paired_retention": _RUN + """, j as (select kind, quality = 1 as f, toxic = 0 and not failed as l from labels join r on item = doc_id), g as (select kind, count(*) filter (f and l) as both, count(*) filter (f and not l) as full_only, count(*) filter (not f and l) as less_only, count(*) filter (not f and not l) as neither from j group by 1),
        w as (select *, "both" / ("both" + full_only) as p, "both" + full_only as n, 1.959963984540054 as z from g) select kind, "both", full_only, less_only, neither, case when n > 0 then cast(printf('%.6f', p) as double) end as retention,
        case when n > 0 then round(abs((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) else 0 end as low, case when n > 0 then round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) else 0 end as high from w""",
    "gates": _RUN + ", k as (select kind, 1 - sum(a) / sum(b) as r, bool_and(not failed) as v from r group by 1) select (select count(*) from documents where doc_id % 97 = 0) = 0 as complete, bool_and(v) as all_valid, avg(r) >= 0.5 as mean_reached, count(*) filter (r >= 0.5) >= 4 as enough_kinds, min(r) >= 0.3 as least_reached from k",
    "risk_scores": """with g as (select user_id, count(*) as n, count(*) filter (event_type = 'error') as failed, count(*) filter (event_type = 'purchase') as verified, count(*) filter (event_type = 'signup') as warnings, count(*) filter (event_type in ('view', 'click')) as seen,
        count(*) filter (event_type = 'click' and value < 50) as mapped, count(*) filter (value < 2) as unknown, count(*) filter (value < 10) as partial, count(*) filter (value > 190) as omitted, max(event_id) as last from events group by 1),
        s as (select *, case when failed > 0 then 0.35::double else 0 end + least(0.30::double, failed * 0.05::double) + 0.20::double * (1 - coalesce(round(verified / n, 6), 0)) + 0.15::double * (1 - case when seen > 0 then round(mapped / seen, 6) else 0 end) + 0.15::double * (1 - round(seen / n, 6))
        + case when unknown > 0 then 0.20::double when partial > 0 then 0.08::double else 0 end + least(0.10::double, (warnings + omitted) * 0.02::double) + least(0.15::double, omitted * 0.15::double) + case when last % 11 = 0 then 0.20::double else 0 end + case when last % 7 = 0 then 0.15::double else 0 end
        + case when last % 13 = 0 then 0.15::double else 0 end + case when last % 5 = 0 then 0.15::double else 0 end as score from g) select user_id, failed, round(least(1.0::double, score), 6) as risk from s""",
    "step_predictions": """with p as (select event_type, unnest(quantile_disc(value, [0.25, 0.5, 0.75])) as point from events group by 1), m as (select event_type, max(point) as last from p group by 1)
        select e.event_type, coalesce((select min(point) from p where p.event_type = e.event_type and e.value <= point), last) as point, count(*) as n from events e join m on m.event_type = e.event_type group by 1, 2""",
    "isotonic_fit": """with d as (select lang as kind, round(1 - len(regexp_extract_all(text, '[a-z]')) / greatest(length(text), 1), 4) as score, doc_id, 1 - quality as y from documents join labels using (doc_id)),
        o as (select *, row_number() over (partition by kind order by score, doc_id) as i, sum(y) over (partition by kind order by score, doc_id) as s from d), z as (select kind, i, s from o union all select distinct kind, 0, 0 from o),
        a as (select j.kind, j.i + 1 as j, k.i as k, (k.s - j.s) / (k.i - j.i) as m from z j join z k on j.kind = k.kind and j.i < k.i), lo as (select kind, j, k, min(m) over (partition by kind, j order by k rows between current row and unbounded following) as m from a),
        f as (select kind, k as i, max(m) as p from (select kind, j, k, m from lo) where j <= k group by 1, 2)
        select f.kind, round(p, 6) as probability, count(*) as n, max(score) as score from f join o on o.kind = f.kind and o.i = f.i group by 1, 2""",
    "token_f1": """with c as (select conv_id, turn, case when (conv_id + turn) % 8 < 2 then case when conv_id % 2 = 0 then '...' when turn % 2 = 0 then ' ?' else '!' end else text || """ + SAID_SQL + """ end as text from conversations), w as (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_''-]+')) as w from c), b as (select conv_id, turn, w, count(*) as n from w group by 1, 2, 3), z as (select conv_id, turn, sum(n) as size from b group by 1, 2),
        s as (select b.conv_id, b.turn, sum(least(b.n, c.n)) as shared from b join b c on c.conv_id = b.conv_id and c.turn = b.turn + 1 and c.w = b.w group by 1, 2)
        select c.conv_id, c.turn, case when z.size is null or y.size is null then cast(trim(c.text) = trim(d.text) as integer)::double else round(2 * coalesce(shared, 0) / (z.size + y.size), 6) end as f1 from c join c d on d.conv_id = c.conv_id and d.turn = c.turn + 1
        left join z on z.conv_id = c.conv_id and z.turn = c.turn left join z y on y.conv_id = c.conv_id and y.turn = c.turn + 1 left join s on s.conv_id = c.conv_id and s.turn = c.turn""",
    "answer_scores": """with o as (select o_orderkey, o_orderkey % 8 as t, o_orderkey // 8 % 4 as v, strftime(o_orderdate, '%Y-%m-%d') as d from orders) select o_orderkey, ['number', 'number_with_unit', 'date', 'short_free_text', 'ordered_list', 'set', 'text', 'exact_text'][t + 1] as kind,
        case t when 0 then v <= 1 when 1 then v = 0 when 2 then v <= 1 or v = 3 and d = '1999-01-01' when 3 then v = 0 when 4 then v <= 0 when 5 then v = 0 when 6 then v = 0 or v = 2 else v = 0 end as correct,
        case when t = 3 then case v when 0 then 1.0 when 1 then 0.75 when 3 then 0.25 else 0.0 end else cast(correct as integer) end::double as score from o""",
    "token_costs": "select event_type, count(*) as n, case when event_type = 'error' then 0 else count(*) end as known, case when event_type <> 'error' then round(sum(floor(value) * cast(2.5 as double) / 1000000), 6) end as cost from events group by 1",
    "first_failures": "with l as (select event_type as a, lead(event_type) over w as b, lead(event_type, 2) over w as c from events window w as (partition by user_id order by event_id)) select a || '>' || b || '>' || c as path, count(*) as n from l where c is not null group by 1",
}
