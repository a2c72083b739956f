"""A user's own format as a data source."""

import pytest

from specimen_spark.sources import formats


class Pairs(formats.SequenceFormat):
    """Titles and residues on lines by turns."""

    name, ending = "pairs_of_lines", ".two"

    def read(self, lines):
        for title in lines:
            yield title, next(lines)

    def lines(self, rows):
        for title, seq in rows:
            if title == "bad":
                raise ValueError("bad row")
            yield from (title, seq)


class Readable(Pairs):
    name = "only_read"
    lines = formats.SequenceFormat.lines


def files(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith((".", "_SUCCESS")))


def test_own_format(spark, tmp_path):
    formats.register(spark, Pairs())
    path = tmp_path / "out"
    rows = [(f"t{i}", "ACGT" * i) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "title string, seq string").repartition(5)
    df.write.format("pairs_of_lines").mode("append").save(str(path))
    assert len(files(path)) == 5 and (path / "_SUCCESS").exists()
    got = spark.read.format("pairs_of_lines").load(str(path))
    assert got.columns == ["file", "ord", "title", "seq"] and got.rdd.getNumPartitions() == 5
    assert sorted((r["title"], r["seq"]) for r in got.collect()) == sorted(rows)
    df.limit(3).write.format("pairs_of_lines").mode("append").save(str(path))
    assert spark.read.format("pairs_of_lines").load(str(path)).count() == 32
    df.limit(2).write.format("pairs_of_lines").mode("overwrite").save(str(path))
    assert spark.read.format("pairs_of_lines").load(f"file://{path}").count() == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    formats.register(spark, Pairs())
    path = tmp_path / "out"
    spark.createDataFrame([("a", "AC")], "title string, seq string").write.format("pairs_of_lines").mode("append").save(str(path))
    before = files(path)
    bad = spark.createDataFrame([(f"t{i}", "A") for i in range(20)] + [("bad", "A")], "title string, seq string").repartition(4)
    with pytest.raises(Exception, match="bad row"):
        bad.write.format("pairs_of_lines").mode("append").save(str(path))
    assert files(path) == before and spark.read.format("pairs_of_lines").load(str(path)).count() == 1


def test_what_can_t_be_done(spark, tmp_path):
    formats.register(spark, Readable())
    with pytest.raises(Exception, match="can't be written"):
        spark.createDataFrame([("a", "AC")], "title string, seq string").write.format("only_read").mode("append").save(str(tmp_path / "x"))
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        spark.read.format("only_read").load(str(tmp_path / "nowhere")).count()
