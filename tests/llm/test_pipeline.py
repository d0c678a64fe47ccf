"""The corpus pipeline, stage by stage, and the registered queries."""

import corpus_pipeline
from galeframe.llm import mixing
from galeframe.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.01").write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name in ("toxicity", "minhash"):
            assert docs.exceptAll(before).isEmpty() and 0.7 * before.count() < docs.count() < before.count()
        if name == "mixing":
            total = mixing.sized(before).agg({"size": "sum"}).first()[0]
            assert abs(mixing.sized(docs).agg({"size": "sum"}).first()[0] - total) <= 20
    assert docs.where("n_ids = 0").isEmpty() and docs.count() == before.count()


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
