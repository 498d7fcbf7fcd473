"""The queries of this subpackage: each operator over its whole table, with the parameters that a corpus would get."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, html_extract, kneser_ney, langid, mixing, ngram_join, order_minhash, packing, secrets, substring_dedup, surrogates, weak_rules, whitening
from .common import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_next(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op6_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    filters = langid.train(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), filters)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kneser_ney.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "threshold", "kept")


def op8_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "n_votes")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's setting spanloom.surrogates.key; without one, results are for show only."""
    key = spark.conf.get("spanloom.surrogates.key", None)
    return surrogates.replace_personal_data(read(spark, sf_dir, "documents"), key.encode() if key else surrogates.KEY)


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_html_extract, op2_packing, op3_order_minhash, op4_ngram_join, op5_secret_scan, op6_language_filters, op7_kneser_ney, op8_weak_rules, op9_mixing, op10_surrogates, op11_ball_tree, op12_whitening, op13_substring_dedup)
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": OP4_SQL, "op11_ball_tree": OP11_SQL, "op13_substring_dedup": OP13_SQL}


OP4_SQL = """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents
), s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
                               when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w)
), n as (select doc_id, count(*) as n from s group by 1),
links as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by 1, 2, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(a, b) as (
  select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from documents d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by 1) c using (doc_id)
"""

OP11_SQL = """
with d as (
  select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
), tf as (select r, doc_id, term, count(*) as tf from d group by all),
size as (select r, sum(tf)::bigint as n from tf group by 1),
total as (select count(*) as big_n, sum(n)::bigint as big_l from size),
weight as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term, big_n),
q as (
  select distinct item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), scored as (
  select q.item_id, q.text, tf.r, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::bigint as score
  from q join tf using (term) join weight using (term) join size using (r), total group by all
), placed as (
  select item_id, doc_id, score, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from placed where rank <= 50
"""

OP13_SQL = """
with d as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), win as (
  select r, doc_id, i, array_to_string(ws[i : i + 49], ' ') as s from (select r, doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d)
), hit as (
  select r, i from (select r, i, doc_id, min(doc_id) over (partition by s) as lowest from win) where doc_id > lowest
), gone as (select distinct r, i + j as place from hit, range(50) t(j)),
kept as (
  select r, string_agg(word, ' ' order by place) as text, count(*) as n
  from (select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as place from d) w where not exists (select 1 from gone g where g.r = w.r and g.place = w.place) group by 1
)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (r)
"""
