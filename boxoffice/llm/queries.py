"""The registered queries of this folder: each operator over the whole table it is meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boxoffice.llm.decontamination import contaminated
from boxoffice.llm.exact_dedup import exact_dedup
from boxoffice.llm.jaccard_join import jaccard_components
from boxoffice.llm.language_id import identify_languages
from boxoffice.llm.license_scan import scan_licenses, scan_sql
from boxoffice.llm.mixing import mix
from boxoffice.llm.ngram_trie import language_model_scores
from boxoffice.llm.periodic_runs import run_digests
from boxoffice.llm.quality_rules import quality_rules
from boxoffice.llm.token_counts import token_counts
from boxoffice.llm.token_files import read_token_files, token_folder, write_token_files
from boxoffice.llm.warc import read_warc, warc_folder, write_warc
from boxoffice.llm.whitening import whitened_components

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
WARC_SPLIT_BYTES = 4 << 20

#: The digest is of the UTF-8 bytes.
OP3_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages
), w AS (
    SELECT payload, max(page_id) AS whole FROM p WHERE n >= 1000 GROUP BY payload
), r AS (
    SELECT p.*, CASE WHEN n >= 1000 AND page_id <> whole THEN whole END AS refers_to FROM p LEFT JOIN w USING (payload)
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
    CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to::BIGINT AS refers_to FROM r
"""

#: Only A-Z are folded; the digest is of the UTF-8 bytes.
OP12_SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(_table(spark, sf_dir, "pages"), warc_folder(spark))
    records = read_warc(manifest, WARC_SPLIT_BYTES, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, public_tokenizers.path(TOKENIZER), END_ID, token_folder(spark))
    return read_token_files(manifest)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(_table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_model": op2_language_model,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_files": op8_token_files,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
    "op11_whitening": op11_whitening,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op10_license_scan": scan_sql(),
    "op12_exact_dedup": OP12_SQL,
}
