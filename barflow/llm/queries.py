"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, language_id, line_dedup, quality_classifier, quality_rules, secret_scan, sharding, simhash, suffix_dedup
from . import token_alignment, url_filter, whitening
from .common import table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "edge_source")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask"
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.planted(docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.strip_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, packed=True, decoded="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.strip_boilerplate(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, basis = whitening.whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(v)) for v in basis.explained]) if basis else F.array(F.lit(0.0))
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(basis.n if basis else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(basis.identity_error if basis else 0.0).alias("identity_error"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(language_id.sample(docs)))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = token_alignment.align(table(spark, sf_dir, "documents"), left, right, digest=True)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_secret_scan": op5_secret_scan,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_language_id": op12_language_id,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT k, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS t(i)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT k, sum(least(5, coalesce(i - prev, 5))) AS n FROM
  (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS prev FROM r) GROUP BY k),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclamations
  FROM d JOIN w USING (k) LEFT JOIN rep USING (k)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
  + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN n_symbols > n_words * 0.25::DOUBLE THEN 4 ELSE 0 END
  + CASE WHEN n_dup_lines > n_lines * 0.5::DOUBLE THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
  + CASE WHEN n_upper > word_chars * 0.4::DOUBLE THEN 32 ELSE 0 END
  + CASE WHEN n_exclamations > n_words * 0.5::DOUBLE THEN 64 ELSE 0 END)::BIGINT AS fail_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_mask & 3) <> 0 AS base_failed, fail_mask = 0 AS kept, fail_mask FROM f
""",
    "op10_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS site FROM documents),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
e AS (SELECT k, i, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t,
  len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 3 AS ok FROM l),
bad AS (SELECT t FROM e JOIN d USING (k) WHERE ok GROUP BY t HAVING count(DISTINCT site) >= 5),
kept AS (SELECT k, count(*) FILTER (ok AND t IN (SELECT t FROM bad)) AS n,
  string_agg(line, chr(10) ORDER BY i) FILTER (NOT (ok AND t IN (SELECT t FROM bad))) AS text FROM e GROUP BY k)
SELECT doc_id, n::BIGINT AS n_lines_removed, md5(coalesce(kept.text, '')) AS text_md5 FROM kept JOIN d USING (k)
""",
}
