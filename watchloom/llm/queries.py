"""The registered queries of this subpackage and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import decontaminate, embeddings, mixing, mixlm, nearjoin, periodic, resample, secrets, sharding, substrings, tokens, toxicity, warc
from watchloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_texts(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_table(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_table(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_table(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.lm_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_near_vectors, op2_substring_dedup, op3_toxicity, op4_feistel_shards, op5_jaccard_join, op6_mix_sources, op7_secret_scan, op8_token_files, op9_warc, op10_decontaminate,
    op11_periodic_runs, op12_resample, op13_lm_scores,
)}
# Base 32 of a SHA-1: five bits at a time from two hexadecimal digits.
ORACLE_SQL: dict[str, str] = {
    "op9_warc": """with d as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
b as (select page_id, cast(payload_bytes as bigint) as payload_bytes, hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + cast(((cast('0x' || substr(hex, (5 * i) // 4 + 1, 2) as int) >> (3 - (5 * i) % 4)) & 31) as int), 1)), '') as payload_digest from d),
l as (select hex, max(page_id) as last from d group by hex)
select page_id, payload_bytes, payload_digest, case when page_id = last or last is null then 'response' else 'revisit' end as record_type,
  case when page_id = last or last is null then null else last end as refers_to from b join l using (hex)""",
    # The CRC table is derived from its polynomial, 3988292384 in reversed bit order; a feature's CRC takes one table step a byte.
    "op12_resample": """with recursive steps(b, c, k) as (select b, b, 0 from range(256) t(b) union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crcs as materialized (select list(c order by b) as crc from steps where k = 8),
texts as (select row_number() over () as row_no, doc_id, text, true as raw from documents union all select null, null, text, false from benchmark),
words as materialized (select row_no, doc_id, raw, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from texts),
grams as materialized (select row_no, raw, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from words),
each_gram as (select g, hex(encode(g)) as h from (select distinct g from grams)),
coded as materialized (select g, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
  lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % 10000 as bucket from each_gram, crcs),
seen as (select bucket, count(*) filter (raw) as s, count(*) filter (not raw) as t from grams join coded using (g) group by bucket),
totals as (select coalesce(sum(s), 0)::bigint as s_all, coalesce(sum(t), 0)::bigint as t_all from seen),
gain as (select bucket, cast(floor(1000 * ln(cast((t + 1) * (s_all + 10000) as double) / ((s + 1) * (t_all + 10000)))) as bigint) as gain from seen, totals),
means as (select row_no, count(*) as n_features, cast(floor(sum(gain) / count(*)) as bigint) as weight from grams join coded using (g) join gain using (bucket) where raw group by row_no),
scored as (select row_no, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
  from words left join means using (row_no) where raw),
placed as (select row_no, row_number() over (order by score desc, doc_id nulls last) as place, count(*) over () as n from scored where n_words >= 20)
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when place <= 25 * n // 100 then place end as rank from scored left join placed using (row_no)""",
}
