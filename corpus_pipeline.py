"""From raw documents to training pieces, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads it
back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import minhash, mixing, pieces, pii, quality
from seamline.llm.queries import MODEL
from seamline.session import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    return quality.quality(docs.select(COLUMNS), table(spark, sf_dir, "labels"), carry=True).where("kept").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of near-duplicates the document of the least doc_id stays, once if its rows repeat."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    rest = docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return rest
    one = rest.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return rest.join(again, "doc_id", "left_anti").select(COLUMNS).unionByName(one.select(COLUMNS))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: each span becomes its kind in brackets; n_chars follows the text."""
    clean = pii.redacted(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a row for every epoch that takes a document; the one in which a budget ends stays whole."""
    return mixing.mix(docs.select(COLUMNS), mixing.corpus_domain(), mixing.corpus_weights()).select(COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text by SentencePiece encoding, checked by decoding them."""
    return pieces.round_trip(docs, pieces.read_model(spark, MODEL), carry=True)


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]
#: The language-model ratio, the confirmed links and the piece merges can't be put in SQL; see tests/llm for a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
