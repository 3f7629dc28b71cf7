"""Registered queries of the subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    decontaminate,
    exact_dedup,
    importance,
    jaccard_join,
    language_id,
    lattice_lm,
    packing,
    repeated_spans,
    target_resampling,
    token_counts,
    token_output,
    warc_fixity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def word_bpe() -> str:
    """Place of the public word-level BPE vocabulary."""
    return vocabulary("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_fixity.warc_records(table(spark, sf_dir, "pages"))
    replica = warc_fixity.damaged_copy(records)
    return warc_fixity.fixity_audit(warc_fixity.leaf_hashes(records), warc_fixity.leaf_hashes(replica))


def op3_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_round_trip(table(spark, sf_dir, "documents"), word_bpe(), end_id=2)


def op6_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(table(spark, sf_dir, "documents"))


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    found = language_id.identify_language(docs, docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe(), capacity=2048, end_id=0)


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("slots", F.concat_ws(",", F.array_sort("slots")))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.target_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_warc_fixity,
        op3_lattice_likelihood,
        op4_jaccard_components,
        op5_token_output,
        op6_prefix_doubling_dedup,
        op7_string_kernel_language,
        op8_bin_slack_packing,
        op9_importance_resampling,
        op10_decontaminate,
        op11_token_counts,
        op12_tokenizer_alignment,
        op13_target_resampling,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op2_warc_fixity": r"""
        WITH made AS (
            SELECT page_id // 512 AS file, page_id AS record_id,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
                   || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
                   || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
            FROM pages),
        placed AS (
            SELECT *, coalesce(sum(strlen(payload)) OVER (
                       PARTITION BY file ORDER BY record_id, payload ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
            FROM made),
        marked AS (SELECT *, md5(file || '/' || "offset" || '/' || record_id) AS digest FROM placed)
        SELECT file, "offset", record_id, CASE WHEN digest LIKE 'ab%' THEN 'missing' ELSE 'altered' END AS kind,
               sha256(payload) AS left_sha256,
               CASE WHEN digest NOT LIKE 'ab%' THEN sha256(left(payload, length(payload) - 5)) END AS right_sha256
        FROM marked WHERE digest LIKE 'ab%' OR digest LIKE '7%'
    """,
}
