"""Names made unique in list order: a name that is taken gets the first free of _2, _3, ..."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import numbered, store

#: Digits that a number has at most where names are cut.
DIGITS = 6


def _root(base: Column, most: int) -> Column:
    """What a name shares with every numbered form of it: names that can meet have one root."""
    head = F.substring(base, 1, max(most - DIGITS - 2, 0)) if most else base
    return F.regexp_replace(head, r"(_\d*)+$", "")


def _first_free(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, taken, reached = None, set(), {}
        for batch in batches:
            names = []
            for r, base, forced in zip(batch["root"], batch["base"], batch["forced"], strict=True):
                if r != root:
                    root, taken, reached = r, set(), {}
                name, n = base, reached.get(base, 1)
                while name in taken and not forced:
                    n += 1
                    name = f"{base[: most - len(str(n)) - 1] if most else base}_{n}"
                reached[base] = n
                taken.add(name)
                names.append(name)
            yield pd.DataFrame({"at": batch["at"], "name": names})

    return run


def first_free_names(rows: DataFrame, base: Column, at: str, most: int = 0, forced: Column | None = None) -> DataFrame:
    """(at, name): for each row, in order of `at`, its base name or else the first of base_2, base_3, ... that no
    row before it has.  With `most`, base names are cut to so many characters, and further to hold the number.

    forced: rows that keep their base name in any case, and take it from those behind.

    Names can only meet within a family: those that differ in numbers at their ends, or behind where
    they are cut.  Rows alone in their family need nothing.  A family of one name, which may hold
    any share of the rows, is numbered by range.  In other families what is free depends on all rows before, so
    such a family streams through one task in order.
    """
    cut = F.substring(base, 1, most) if most else base
    keys = rows.select(F.col(at).alias("at"), cut.alias("base"), (F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))).alias("forced"))
    keys = store(keys.withColumn("root", _root(F.col("base"), most)))
    # a cut name that ends in a number can meet its own numbered form
    odd = F.col("base").rlike(r"_\d+$") if most else F.lit(False)
    families = keys.groupBy("root").agg(F.count(F.lit(1)).alias("n"), (F.max("forced") | (F.min("base") != F.max("base")) | F.max(odd)).alias("mixed")).where("n > 1")
    met = keys.join(families, "root", "left")
    alone = met.where("n is null").select("at", F.col("base").alias("name"))

    same = numbered(met.where("not mixed").select("at", "base"), [F.col("base"), F.col("at")])
    first = same.groupBy("base").agg(F.min("place").alias("first"))
    number = F.col("place") - F.col("first") + 1
    digits = F.length(number.cast("string"))
    if most:
        number = F.when(digits <= DIGITS, number).otherwise(F.raise_error(F.lit(f"more than {DIGITS} digits are needed to number names of one beginning")))
    head = F.substring(F.col("base"), F.lit(1), F.lit(most) - digits - 1) if most else F.col("base")
    named = same.join(first, "base").select("at", F.when(number == 1, F.col("base")).otherwise(F.concat(head, F.lit("_"), number.cast("string"))).alias("name"))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = met.where("mixed").select("root", "at", F.expr("not forced").alias("last"), "base", "forced")
    ordered = mixed.repartition(n, "root").sortWithinPartitions("root", "at", "last")
    kind = dict(keys.dtypes)["at"]
    return alone.unionByName(named).unionByName(ordered.select("root", "at", "base", "forced").mapInPandas(_first_free(most), f"at {kind}, name string"))
