"""Interval joins: bins of several widths in place of all pairs of a key.

An interval belongs to the level of its length, a power of two, and lies in at most two bins of that
width.  The shorter of two overlapping intervals looks the longer up at the longer one's level, where it too
lies in at most two bins.  So rows are written a few times for each level there is, whatever lies on
one chromosome, and intervals of a bin mostly overlap: the work follows the result.  A bin of very many
rows is met in pieces, so that no task holds it whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import store


def _levelled(df: DataFrame, name: str, on: list[str], first: str, last: str) -> DataFrame:
    """The keys, ends and level of each interval, and its row as a struct; empty intervals overlap nothing."""
    rows = df.where(F.col(first) <= F.col(last)).select(*on, F.col(first).cast("long").alias("_f"), F.col(last).cast("long").alias("_t"), F.struct(*df.columns).alias(name))
    size = F.col("_t") - F.col("_f")
    return rows.withColumn("_l", F.when(size > 0, F.length(F.bin(size))).otherwise(0))


def _bins(rows: DataFrame, level: str) -> DataFrame:
    return rows.withColumn("_bin", F.explode(F.expr(f"sequence(shiftright(_f, {level}), shiftright(_t, {level}))")))


#: Rows of one side of a bin that meet in one piece, about; of more each block of one side meets each of the other.
MEET = 4096


def _dealt(kept: DataFrame, asked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Adds _p and _q to both sides, by which each row of a key of the one meets each of the other once, in pieces."""
    kept, asked = (store(df.withColumn("_u", F.monotonically_increasing_id())) for df in (kept, asked))
    count = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias(n))
    sizes = store(count(kept, "_np").join(count(asked, "_nq"), keys).where("_np > 1 or _nq > 1"))

    def side(df: DataFrame, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64("_u"), F.coalesce(own[1], F.lit(1))).cast("int")
        every = F.sequence(F.lit(0), F.coalesce(other[1], F.lit(1)) - 1)
        return df.join(sizes, keys, "left").withColumn(own[0], block).withColumn(other[0], F.explode(every)).drop("_np", "_nq", "_u")

    return side(kept, ("_p", "_np"), ("_q", "_nq")), side(asked, ("_q", "_nq"), ("_p", "_np"))


def _found(long: DataFrame, short: DataFrame, on: list[str], top: int, or_equal: bool) -> DataFrame:
    """Overlapping pairs of which the interval in `long` is of a higher level, or of an equal one."""
    kept = _bins(long.withColumn("_m", F.col("_l")), "_m")
    asked = _bins(short.select("*", F.explode(F.sequence(F.col("_l") if or_equal else F.col("_l") + 1, F.greatest(F.col("_l") + 1, F.lit(top)))).alias("_m")), "_m")
    kept, asked = _dealt(kept, asked, [*on, "_m", "_bin"])
    x, y = kept.alias("x"), asked.alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*on, "_m", "_bin", "_p", "_q"]]
    begin, end = F.greatest("x._f", "y._f"), F.least("x._t", "y._t")
    # a pair that meets in two bins counts where its overlap begins
    return x.join(y, [*same, begin <= end, F.expr("shiftright(greatest(x._f, y._f), x._m)") == F.col("x._bin")]).withColumn("_first", begin).withColumn("_last", end)


def overlap_join(x: DataFrame, y: DataFrame, on: list[str], x_ends: tuple[str, str] = ("from", "to"), y_ends: tuple[str, str] = ("from", "to")) -> DataFrame:
    """(x, y, first, last): rows of both, as structs, whose keys `on` are equal and whose intervals share positions first to last.

    Ends are inclusive.  Null keys and ends meet nothing; each pair of rows comes once.
    """
    a, b = _levelled(x, "x_row", on, *x_ends), _levelled(y, "y_row", on, *y_ends)
    top = max(d.agg(F.coalesce(F.max("_l"), F.lit(0))).first()[0] for d in (a, b))
    columns = ["x_row", "y_row", "_first", "_last"]
    both = _found(a, b, on, top, True).select(*columns).unionByName(_found(b, a, on, top, False).select(*columns))
    return both.select(F.col("x_row").alias("x"), F.col("y_row").alias("y"), F.col("_first").alias("first"), F.col("_last").alias("last"))


def overlaps(df: DataFrame, on: list[str], key: str, ends: tuple[str, str] = ("from", "to")) -> DataFrame:
    """As overlap_join of a table with itself: each pair once, x the one with the smaller `key`; rows of equal keys don't meet."""
    rows = _levelled(df, "row", on, *ends)
    top = rows.agg(F.coalesce(F.max("_l"), F.lit(0))).first()[0]
    met = _found(rows, rows, on, top, True).where(F.col(f"x.row.{key}") != F.col(f"y.row.{key}"))
    met = met.where((F.col("x._l") > F.col("y._l")) | (F.col(f"x.row.{key}") < F.col(f"y.row.{key}")))
    swapped = F.col(f"x.row.{key}") > F.col(f"y.row.{key}")
    one, two = F.when(swapped, F.col("y.row")).otherwise(F.col("x.row")), F.when(swapped, F.col("x.row")).otherwise(F.col("y.row"))
    return met.select(one.alias("x"), two.alias("y"), F.col("_first").alias("first"), F.col("_last").alias("last"))
