import pytest
from pyspark.sql import functions as F

from postquarry import session as S


def test_hot_keys_are_split(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 3).alias("n"), F.when(F.col("id") < 400, "hot").when(F.col("id") < 990, F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    entries = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("k2", 4), (None, 5), ("absent", 6)], "key string, v int")
    for how in ("inner", "left"):
        want = sorted(map(repr, rows.join(entries, ["key"], how).select("key", "n", "v").collect()))
        assert sorted(map(repr, S.look_up(rows, entries, ["key"], how).select("key", "n", "v").collect())) == want
        with monkeypatch.context() as m:
            m.setattr(S, "is_small", lambda df: False)
            for hot in (100, 5000):
                assert sorted(map(repr, S.look_up(rows, entries, ["key"], how, hot).select("key", "n", "v").collect())) == want


def test_size_is_proven(spark):
    assert S.is_small(spark.range(10)) and not S.is_small(spark.range(1000), 1000)
    assert not S.is_small(spark.createDataFrame([("x" * 5000, ["a" * 5000])], "t string, a array<string>"), 10_000) and S.is_small(spark.range(0))


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://h:7077"})  # noqa: N815

    with pytest.raises(ValueError):
        S.shared_folder(Cluster)
    Cluster.sparkContext.master = "local[2]"
    assert S.shared_folder(Cluster)
