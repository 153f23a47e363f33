"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.llm import (
    bpe, classifier, exact, licenses, near, packing, phrases, rules, scoring, search, suffixes, tokens, trie,
)
from vitalspark.llm.common import documents
from vitalspark.session import work_dir


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    tokens.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.token_digests(spark, path)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(documents(spark, sf_dir))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_texts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode_texts(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return bpe.decode_ids(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/block of 50 ids/id``."""
    docs = documents(spark, sf_dir)
    block = F.format_string("%06d", F.floor(F.col("doc_id") / 50).cast("long"))
    files = docs.select(F.concat_ws("/", "source", "lang", block, F.col("doc_id").cast("string")).alias("path"), "text")
    return licenses.scan(files).withColumn(
        "doc_id", F.element_at(F.split("path", "/"), -1).cast("long"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = trie.read_spec(public_tokenizers.path("byte_bpe_50k.json"))
    return trie.decode_ids(trie.encode_texts(documents(spark, sf_dir), spec), spec).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_pack": op1_pack,
    "op2_tokens": op2_tokens,
    "op3_suffix": op3_suffix,
    "op4_rules": op4_rules,
    "op5_exact": op5_exact,
    "op6_near": op6_near,
    "op7_lm": op7_lm,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_licenses": op10_licenses,
    "op11_phrases": op11_phrases,
    "op12_trie": op12_trie,
    "op13_search": op13_search,
}

ORACLE_SQL = {
    "op5_exact": r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body
  from documents),
g as (select body, min(doc_id) as keep_id, count(*) as group_size from t group by body)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept,
       sha256(t.body) as text_sha256
from t join g using (body)
""",
    "op11_phrases": r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, ws, unnest(generate_series(1, len(ws))) as i from w),
f as materialized (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as a
  from g, (values (1), (2), (3)) as v(k) where i + k - 1 <= len(ws) group by all),
total as (select lang, sum(a) as n from f where k = 1 group by 1),
c as (select * from f where k > 1 and a >= 10),
cuts as (select c.*, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') as head,
  array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') as rest
  from c, (values (1), (2)) as v(cut) where cut < k),
s as (select cuts.*, x.a as l, y.a as r, 1000000::hugeint * cuts.a * cuts.a // (x.a::hugeint * y.a) as score
  from cuts join (select row(lang, phrase) as key, a from f) x on x.key = row(lang, head)
  join (select row(lang, phrase) as key, a from f) y on y.key = row(lang, rest)),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (select lang, inside, max(a) as a from (
  select lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
    array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as inside from c where k = 3) group by 1, 2),
kept as (select best.* from best left join longer o on o.lang = best.lang and o.inside = best.phrase
  where o.a is null or 100 * o.a < 50 * best.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n,
  score::bigint as score
from ranked join total using (lang) where rank <= 2000
""",
    "op13_search": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
c as (select count(*) filter (len(words) > 0)::bigint as n_docs, sum(len(words))::bigint as n_terms from d),
tf as (select doc_id, len(words)::bigint as n, term, count(*)::bigint as tf from (
  select doc_id, words, unnest(words) as term from d) group by all),
q as (select item_id, term, count(*)::bigint as times from (
  select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
w as (select term, floor(1000 * ln((2 * max(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, c where term in (select term from q) group by term),
s as (select q.item_id, tf.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + ((25 * tf.n * n_docs) // n_terms)))))::bigint as score
  from tf join w using (term) join q using (term), c group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20
""",
}
