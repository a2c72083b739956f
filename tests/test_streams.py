"""Streams drive the same operators batch by batch."""

from pyspark.sql import functions as F

from specimen_spark.streaming.identify import append_grid_stream, identify_stream

SCHEMA = "ord long, title string, seq string, species string, genus string"


def test_identify_stream(spark, tmp_path):
    reference = spark.createDataFrame([(1, "a", "ACGT" * 10, "A b", "A"), (2, "c", "TTTT" * 10, "C d", "C")], SCHEMA)
    spark.createDataFrame([(10, "q", "ACGT" * 9 + "ACGA", "A b", "A"), (11, "r", "TTTT" * 10, "A b", "A")], SCHEMA).write.parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = identify_stream(stream, reference, lambda df, n: got.update({r["q"]: (r["verdict"], r["close_verdict"]) for r in df.collect()}), 0.03, 20)
    query.processAllAvailable()
    query.stop()
    assert got == {10: ("correct", "correct"), 11: ("incorrect", "incorrect")}


def test_append_grid_stream(spark, tmp_path):
    start = spark.createDataFrame([("l", "t", 0, "ACGT", 4, False)], "locus string, taxon string, ord long, seq string, actual_length int, cancelled boolean")
    start.write.parquet(str(tmp_path / "grid/version=-1"))
    spark.createDataFrame([("u", 1, "AAAA")], "taxon string, ord long, seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("taxon string, ord long, seq string").parquet(str(tmp_path / "in"))
    query = append_grid_stream(stream, str(tmp_path / "grid"), "l")
    query.processAllAvailable()
    query.stop()
    assert {r["taxon"] for r in spark.read.parquet(str(tmp_path / "grid/version=0")).select(F.col("taxon")).collect()} == {"t", "u"}
