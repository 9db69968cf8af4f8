"""The ``opN_<name>`` queries: each operator over its whole table. ORACLE holds DuckDB SQL where SQL can state the result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import byte_bpe, collocations, edit_fingerprint, html_text, language, minhash, mixing, pieces, pii, quality, suffix_dedup, variants, warc
from seamline.session import table

#: Path of the SentencePiece model file, in a store that Spark reads; it isn't part of the repository.
MODEL = os.environ.get("PIECE_MODEL", "file:///opt/tokenizers/piece_bpe_32k.model")
#: Path of the byte-level BPE ranks, likewise.
RANKS = os.environ.get("BPE_RANKS", "file:///opt/tokenizers/byte_bpe_50k.tiktoken")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2_rows(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.read_model(spark, MODEL))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe.read_ranks(spark, RANKS))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_mixing, op3_html_text, op4_language, op5_near_duplicates, op6_pieces, op7_quality, op8_suffix_dedup, op9_warc, op10_pii, op11_variants, op12_byte_bpe, op13_collocations)}
ORACLE: dict[str, str] = {
    "op2_mixing": mixing.oracle(),
    "op9_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
      o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
      SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN original <> page_id THEN original END AS refers_to
      FROM p LEFT JOIN o USING (payload_digest)""",
    "op13_collocations": collocations.oracle(),
}
