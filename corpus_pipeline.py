"""From raw documents to encoded training text: toxicity, near-dedup, mixing, SentencePiece."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import minhash, mixing, sentencepiece_codec, toxicity
from galeframe.llm.common import shared_dir

SEED = 20


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the model is fitted on the labelled ones."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id."""
    return minhash.drop_near_duplicates(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed(docs, seed=SEED)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids: the SentencePiece ids of each whole text."""
    return sentencepiece_codec.encode(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", "ids", F.size("ids").alias("n_ids"))


STAGES = [
    ("toxicity", without_toxic),
    ("minhash", without_near_duplicates),
    ("mixing", to_target_weights),
    ("sentencepiece", encoded),
]
ORACLE_SQL = None  # a fitted classifier, signatures and byte pairs are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/galeframe/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
