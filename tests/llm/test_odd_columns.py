"""Case variants, dots and columns that hold maps, through every operator that passes columns on, and the pipeline."""

import pytest
from pyspark.sql import functions as F

from galeframe.llm import bpe_automaton, minhash, mixing, sentencepiece_codec, sharding, toxicity

TEXTS = [(1, "one two three four five six"), (2, "one two three four five six"), (3, "zork"), (4, None), (5, ""), (6, "x"), (6, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit(7) for c in ("IDs", "Decoded", "a.b", "Read", "MADE", "Shard", "sLot", "c1", "x y", "`")})
    tags = F.create_map(F.lit("b"), F.col("doc_id"), F.lit("a"), F.lit(None).cast("long"))
    return df.withColumns({"tags": F.when(F.col("doc_id") != 3, tags), "deep": F.array(F.struct(F.create_map(F.lit(1), F.array(tags)).alias("in.side"), F.lit(1).alias("n")))})


def shown(df, names):
    return sorted(str([r[n] for n in names]) for r in df.collect())


def test_encoders_replace_case_variants(odd):
    for codec in (sentencepiece_codec, bpe_automaton):
        out = codec.decode(codec.encode(odd))
        kept = [c for c in odd.columns if c not in ("IDs", "Decoded")]
        assert out.columns == [*kept, "ids", "decoded"]
        assert shown(out, kept) == shown(odd, kept) and all(r.decoded == (r.text or "") for r in out.collect())


def test_toxicity_keeps_columns(odd):
    out = toxicity.drop_toxic(odd, toxicity.ToxicityModel())
    assert out.columns == odd.columns and shown(out, odd.columns) == shown(odd, odd.columns)


def test_shards_take_maps(odd, spark):
    out = sharding.shard_rows(odd, 3, seed=1)
    kept = [c for c in odd.columns if c not in ("Shard", "sLot")]
    assert out.columns == [*kept, "shard", "slot"] and shown(out, kept) == shown(odd, kept)
    assert sorted((r.shard, r.slot) for r in out.collect()) == sorted((k % 3, k // 3) for k in range(len(TEXTS)))
    assert sharding.shard_rows(odd.limit(0), 3).count() == 0


def test_stages_keep_columns(odd):
    assert minhash.drop_near_duplicates(odd).columns == odd.columns
    assert mixing.mixed(odd, seed=1).columns == odd.columns


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (3, 1, 1), (None, 0, 1), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.drop("`", "x y")  # names that Parquet cannot hold
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.columns == ["doc_id", "source", "lang", "ids", "n_ids"] and docs.count() > 0
