"""A table in one file keeps all cores busy."""

from specimen_spark.plans import fixtures


def test_large_tables_are_spread(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    few = fixtures.sequences(spark, folder)
    monkeypatch.setattr(fixtures, "SPREAD", 10)
    many = fixtures.sequences(spark, folder)
    assert few.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism <= many.rdd.getNumPartitions()
    assert sorted(map(tuple, few.select("ord", "title", "seq").collect())) == sorted(map(tuple, many.select("ord", "title", "seq").collect()))
