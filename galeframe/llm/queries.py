"""One query for each operator, with production parameters, over its whole table; and the SQL for them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import bpe_automaton, chat_format, license_scan, mixing, sentencepiece_codec, sharding, spelling, token_counts, topk_search, toxicity, whitening
from galeframe.llm.common import shared_dir, stored
from galeframe.llm.embedding_dedup import near_duplicate_vectors
from galeframe.llm.minhash import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["license"]))), ",")
    most = F.array_max(F.transform("findings", lambda x: x["coverage"]))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_findings"), names.alias("licenses"), F.round(F.coalesce(most, F.lit(0.0)), 6).alias("best_coverage"), "findings")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(more)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(stored(rows), shards=8, seed=20).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", F.size("passages").alias("n_passages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(mixing.sized(_table(spark, sf_dir, "documents")))
    mix = mixing.allotment(sizes, seed=20)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents with provisional counts, revise all to exact ones, replay the revision, delete those without text, read the totals."""
    docs = _table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/galeframe/rollups/{uuid.uuid4().hex}")
    version = "byte_bpe_50k-1"
    first = token_counts.estimated(docs, version)
    rollup.commit("insert", added=first)
    exact = token_counts.counted(docs, version)
    rollup.commit("revise", added=exact, removed=first)
    rollup.commit("revise", added=exact, removed=first)
    rollup.commit("delete", removed=token_counts.estimated(docs.where("text IS NULL OR text = ''"), version))  # no text, no tokens, in either count
    return rollup.totals()


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), min_length=5, min_count=3, times=2)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.coordinates(vectors, whitening.fit(vectors, scale=64, shift=1_000_000, components=16))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_embedding_dedup, op2_license_scan, op3_chat_format, op4_minhash, op5_sharding, op6_topk, op7_toxicity, op8_sentencepiece, op9_mixing, op10_token_counts, op11_bpe, op12_spelling, op13_whitening)
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id)::BIGINT AS n_links,
  c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id)""",
    "op6_topk": """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
