"""Places over a whole table, and cycles of a table's period."""

from datetime import datetime

from pyspark.sql import functions as F

from galeframe.operators import schedule, sequences


def test_places(spark):
    df = spark.range(5000, numPartitions=7).select(F.when(F.col("id") % 10 > 0, F.pmod(F.hash("id"), F.lit(50))).alias("k"), "id")
    got = sequences.placed(df, ["k", "id"]).collect()
    want = sorted(got, key=lambda r: (r.k is not None, r.k or 0, r.id))
    assert [r.place for r in want] == list(range(1, 5001)) and set(got[0].asDict()) == {"k", "id", "place"}
    same = spark.createDataFrame([(1,)] * 5, "k int")
    assert sorted(r.n for r in sequences.placed(same, ["k"], "n").collect()) == [1, 2, 3, 4, 5]
    assert sequences.placed(same.limit(0), ["k"]).count() == 0


def test_cycles_of_a_table(spark):
    t = spark.createDataFrame([(datetime(2024, 2, 28, 23, 59),), (None,), (datetime(2024, 3, 1, 0, 0),)], "ts timestamp_ntz")
    got = [r.init_time for r in schedule.cycles_of(t, "ts").orderBy("init_time").collect()]
    assert len(got) == 12 and got[0] == datetime(2024, 2, 28) and got[-1] == datetime(2024, 3, 1, 18)
    assert schedule.cycles_of(t.where("ts IS NULL"), "ts").count() == 0
