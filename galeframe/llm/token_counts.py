"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are never edited in place: a batch of signed
changes (insert +, delete -, revision: - the old count and + the new) is summed to one row a group
and written as the batch's own folder, and totals are the sum over all committed batches' rows. A
batch counts once its mark, written after its folder, is there; a batch without a mark is written
over, a batch with one is left as it is, so replays and lost executors change nothing.

Edge cases: null texts count 0 tokens; null sources and languages are groups of their own; a group
whose rows all went shows no more; empty batches leave an empty folder. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from galeframe.llm.chat_format import encoder
from galeframe.llm.common import text_slices

KEYS = ["source", "lang", "tokenizer_version"]
_DELTAS = "source string, lang string, tokenizer_version string, docs long, tokens long, batch string"


def _count(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            for part in text_slices(batch, "text"):
                n = [len(encode(t.as_py() or "")) for t in part.column("text")]
                kept = [part.column(i) for i, c in enumerate(part.schema.names) if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names=[*(c for c in part.schema.names if c != "text"), "tokens"])

    return run


def counted(docs: DataFrame, version: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokens, tokenizer_version of the whole texts, by the byte-level BPE at tokenizer."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return rows.mapInArrow(_count(tokenizer), "doc_id long, source string, lang string, tokens long").withColumn("tokenizer_version", F.lit(version))


def estimated(docs: DataFrame, version: str) -> DataFrame:
    """The same columns with a provisional count, the text's bytes over four, rounded up, which needs no tokenizer."""
    guess = F.coalesce(F.ceil(F.octet_length("text") / F.lit(4)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", guess.alias("tokens"), F.lit(version).alias("tokenizer_version"))


class Rollup:
    """Totals kept under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-." for c in batch):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.path}/deltas/batch={batch}"

    def _marks(self) -> DataFrame:
        try:
            return self.spark.read.schema("batch string").parquet(f"{self.path}/marks")
        except AnalysisException:
            return self.spark.createDataFrame([], "batch string")

    def committed(self, batch: str) -> bool:
        """Whether the batch has its mark."""
        return not self._marks().where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> bool:
        """Commit rows that come and rows that go (both as counted()); False if the batch was committed before.

        A revision is a removed row with the old count and an added one with the new.
        """
        folder = self._folder(batch)
        if self.committed(batch):
            return False
        signed = [df.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col("tokens")).alias("tokens")) for df, sign in ((added, 1), (removed, -1)) if df is not None]
        if not signed:
            raise ValueError("a batch has rows to add or to remove")
        both = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
        sums = both.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(folder)
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/marks")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens; groups without documents left are gone."""
        try:
            rows = self.spark.read.schema(_DELTAS).parquet(f"{self.path}/deltas")
        except AnalysisException:
            rows = self.spark.createDataFrame([], _DELTAS)
        rows = rows.join(self._marks().distinct(), "batch", "left_semi")
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")
