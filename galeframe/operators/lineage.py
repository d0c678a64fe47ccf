"""Cutting the lineage of tables that several later steps read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir, or one in the warehouse where that is unset, which is then made the session's checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    folder = spark.sparkContext.getCheckpointDir().rstrip("/")
    return folder if "://" in folder else folder.replace("file:", "", 1)


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts and merges. Spark takes rows behind an explode for as few as before it, so that it would send millions of them through the driver to every task."""
    return df.hint("merge")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint in the shared folder. Its files go with it only where spark.cleaner.referenceTracking.cleanCheckpoints is set, else with the folder.

    The shuffle files behind it are not needed once it is written, and are removed then: else they stay until
    the driver's garbage is collected, so that those of all steps of a long query lie on the disk together.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # a DataFrame of its own, since one knows from when it is made what becomes of its shuffle files
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
