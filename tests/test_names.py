"""Names made unique in list order, and grids filled from files."""

import random

import pytest
from pyspark.sql import functions as F

from specimen_spark.operators import names
from specimen_spark.sources import readers, writers


def greedy(bases, most=0, forced=()):
    taken, out = set(), []
    for i, base in enumerate(bases):
        base = base[:most] if most else base
        name, n = base, 1
        while name in taken and i not in forced:
            n += 1
            name = f"{base[: most - len(str(n)) - 1] if most else base}_{n}"
        taken.add(name)
        out.append(name)
    return out


def named(spark, bases, most=0, forced=()):
    df = spark.createDataFrame([(i, b, i in forced) for i, b in enumerate(bases)], "ord long, title string, f boolean").repartition(3)
    return [r["name"] for r in names.first_free_names(df, F.col("title"), "ord", most, F.col("f")).orderBy("at").collect()]


def test_a_number_may_be_taken_by_another_name(spark):
    assert named(spark, ["x", "x", "x_2"]) == ["x", "x_2", "x_2_2"]
    assert named(spark, ["x_2", "x", "x", "x"]) == ["x_2", "x", "x_3", "x_4"]
    assert named(spark, ["a", "a", "a"], forced={0, 1}) == ["a", "a", "a_2"]
    long = "n" * 40
    assert named(spark, [long] * 12, 32) == greedy([long] * 12, 32) and all(len(x) == 32 for x in named(spark, [long] * 12, 32))
    rows = writers.unique_names(spark.createDataFrame([(0, "x"), (1, "x"), (2, "x_2")], "ord long, title string"), F.col("title"))
    assert sorted((r["ord"], r["name"]) for r in rows.collect()) == [(0, "x"), (1, "x_2"), (2, "x_2_2")]


@pytest.mark.parametrize("most", [0, 10, 12, 20])
def test_names_equal_one_after_the_other(spark, most):
    rng = random.Random(most)
    bases = [rng.choice(["alpha", "beta beta", "x", "long long name that goes on", "", "a_1"]) + rng.choice(["", "", "", "_2", "_3", "_2_2", "_", "_12"]) for _ in range(300)]
    got = named(spark, bases, most)
    assert got == greedy(bases, most) and len(set(got)) == 300 and (not most or max(map(len, got)) <= most)


def test_one_name_of_many_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("ord"), F.lit("same").alias("title"))
    got = writers.unique_names(df, F.col("title"), 8)
    assert got.where("name <> if(ord = 0, 'same', concat(substring('same', 1, 8 - length(cast(ord + 1 as string)) - 1), '_', ord + 1))").count() == 0


FILES = [
    ("a.fas", ">t one\nAC--GT\n>t one\nACGTGT\n>short\nACG\n>gap\n--GT--\n>none\n------\n"),
    ("a.nex", "#NEXUS\nBEGIN DATA;\nFORMAT MISSING=- GAP=.;\nMATRIX\nt1 AC.G-T\n;\nEND;\n"),
    ("a_2.fas", ">t\nAC\n"),
    ("z.seq", "#sequences\n\n>x\n^g.colname a\n^g.seqname gap\n^g.cancelled\nACGTAC\n\n>y\n^g.colname own\n^g.seqname y\nACGT\n\n>w\n^g.colname own\n^g.seqname w\nACGTT\n"),
]


def test_files_fill_a_grid(spark):
    rows = readers.parse_any(spark.createDataFrame(FILES, "file string, text string"))
    grid, lost = readers.filled(rows)
    cells = {(r["locus"], r["taxon"]): (r["seq"], r["actual_length"], r["cancelled"]) for r in grid.collect()}
    assert cells == {
        ("a", "t one"): ("ACGTGT", 6, False), ("a", "gap"): ("ACGTAC", 6, True), ("a_2", "t1"): ("AC-G?T", 5, False), ("a_2_2", "t"): ("AC", 2, False), ("own", "y"): ("ACGT", 4, False),
    }
    assert {(r["locus"], r["taxon"], r["file"], r["ord"], r["reason"]) for r in lost.collect()} == {
        ("a", "t one", "a.fas", 0, "shorter or earlier"), ("a", "short", "a.fas", 2, "too short"), ("a", "gap", "a.fas", 3, "shorter or earlier"), ("own", "w", "z.seq", 2, "too long"),
    }


def test_a_file_takes_no_name_that_rows_before_named(spark):
    rows = spark.createDataFrame([("a.seq", "x", "b"), ("a.seq", "y", None), ("b.fas", "z", None), ("b.nex", "z", None)], "file string, title string, locus_override string")
    assert {r["file"]: r["locus"] for r in readers.unique_loci(rows).collect()} == {"a.seq": "a", "b.fas": "b_2", "b.nex": "b_3"}
