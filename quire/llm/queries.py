"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import block_products, decontaminate, embed_tiles, fill_middle, line_crf, mixing, packing, quality_fm, simhash, surrogates, templates, url_model, warc
from quire.llm.common import table


#: An open key, for results that can be compared; real corpora need one of their own, in surrogates.KEY_SETTING.
OPEN_KEY = "an open key for tests"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_pii(docs, spark.conf.get(surrogates.KEY_SETTING, OPEN_KEY), count="n_entities")


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(table(spark, sf_dir, "pages"))


def op7_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_tiles.embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_model.judge(table(spark, sf_dir, "pages"))


def op10_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return block_products.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Base 32 from a SHA-1 in DuckDB: 32 groups of five bits of its 160.
OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)),
           'string_agg', '')), 'string_agg', '') AS payload_digest,
         max(page_id) OVER (PARTITION BY hex) AS keeper
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_source_mixing, op3_pii_surrogates, op4_warc_transactions, op5_simhash_groups, op6_template_text, op7_embedding_groups, op8_line_labels, op9_url_verdicts, op10_quality_scores, op11_hard_negatives, op12_fill_middle, op13_contamination)}
ORACLE_SQL = {"op2_source_mixing": mixing.MIX_SQL, "op4_warc_transactions": OP4_SQL, "op11_hard_negatives": block_products.MINE_SQL, "op12_fill_middle": fill_middle.DIGEST_SQL, "op13_contamination": decontaminate.DIGEST_SQL}
