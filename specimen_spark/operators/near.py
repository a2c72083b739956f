"""Exact similarity joins by segments: all pairs within a distance, without comparing all pairs.

Two sequences with at most t mismatches over L columns, cut into m segments, agree in at least m - t of
them.  Each sequence therefore goes into an inverted index under the letters of its segments, or of
pairs of its segments, and only sequences that meet under a key are compared.

Missing characters and ambiguity codes agree with several letters: such a segment is written under
each of its readings.  A sequence leaves out its d segments with the most readings, at most; two
sequences then still have m - t - 2d agreeing segments that both of them wrote.  Sequences whose other segments
have too many readings, as very short ones beside long ones, are a side list that is compared with
all by tiles.  Nothing is lost; candidates are measured on their planes.

Where sequences are so much alike that many pairs meet under a key, or few altogether, storing candidates
costs more than looking at all pairs: then these are compared inside tiles, and only what is near leaves them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import BITS, MASK, with_planes, words_of
from . import ranking, tiles
from .pairs import COLUMN_WORDS, SCALE, _compare, _Planes, blocks_for, measured, mirrored, most_mismatches
from .storage import store

#: Readings that a segment is written under at most; with more its sequence is on the side list.
READINGS = 64
#: Keys of a sequence, not counting readings, at most.
KEYS = 64
#: Sequences under one key that are compared in one piece at most.
MEET = 1024
#: All pairs are compared in tiles where there are no more than so many,
FEW = 1 << 27
#: or where a larger share of them than this would meet in the index, as so many rows show.
SHARE = 0.01
SHOWN = 4096


def layout(mismatches: int, columns: int) -> tuple[int, int, int] | None:
    """(segments, segments of a key, segments that a sequence may leave out) of the most selective index there is, or None."""
    found = {}
    for of_key in (1, 2, 3):
        for width in range(4, 21):
            segments = columns // width
            spare = segments - mismatches - of_key
            if spare < 0:
                continue
            out = spare // 2
            keys = math.comb(segments - out, of_key)
            if keys <= KEYS or of_key == 1:
                found.setdefault((min(out, 2), min(width * of_key, 24), -keys), (segments, of_key, out))
    return found[max(found)] if found else None


def _readings(ch: Column) -> Column:
    """What a character agrees with: bases of a code, a gap, or all for a missing one."""
    table = [F.lit("-"), F.array(F.lit("-"))]
    for code, mask in MASK.items():
        table += [F.lit(code), F.array(*[F.lit(b) for b in BITS if mask & BITS[b]])]
    return F.coalesce(F.element_at(F.create_map(*table), ch), F.array(*map(F.lit, "ACTG-")))


def _written(seq: Column, columns: int, segments: int, out: int) -> Column:
    """The segments a sequence writes: k, number of readings, and what each position may be read as."""
    options = F.transform(F.split(F.rpad(seq, columns, "?"), ""), _readings)
    cuts = [k * columns // segments for k in range(segments + 1)]
    one = lambda k: F.slice(options, cuts[k] + 1, cuts[k + 1] - cuts[k])
    count = lambda part: F.aggregate(part, F.lit(1.0), lambda n, x: n * F.size(x))
    every = F.array(*[F.struct(count(one(k)).alias("n"), F.lit(k).alias("k"), one(k).alias("part")) for k in range(segments)])
    return F.slice(F.array_sort(every), 1, segments - out)


def _texts(part: Column) -> Column:
    return F.aggregate(part, F.array(F.lit("")), lambda made, x: F.flatten(F.transform(made, lambda p: F.transform(x, lambda c: F.concat(p, c)))))


def _keys(own: Column, of_key: int) -> Column:
    """Hashes of the readings of each combination of so many segments."""

    def read(chosen: list[Column], texts: list[Column]) -> Column:
        if len(texts) == of_key:
            return F.xxhash64(*[s["k"] for s in chosen], *texts)
        made = F.transform(chosen[len(texts)]["t"], lambda x: read(chosen, [*texts, x]))
        return made if len(texts) == of_key - 1 else F.flatten(made)

    def choose(chosen: list[Column]) -> Column:
        if len(chosen) == of_key:
            return read(chosen, [])
        behind = F.filter(own, lambda u: u["k"] > chosen[-1]["k"]) if chosen else own
        return F.flatten(F.transform(behind, lambda u: choose([*chosen, u])))

    return choose([])


def _by_side_list(rows: DataFrame, side: DataFrame) -> DataFrame:
    """(grp, a, b): each sequence of the side list with every other of its group, by tiles."""
    blocks = blocks_for(rows)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    few = side.select("grp", "id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("tile"))
    met = few.alias("x").join(rows.select("grp", "id", block.cast("int").alias("tile")).alias("y"), ["grp", "tile"]).where(F.col("x.id") != F.col("y.id"))
    return met.select("grp", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _indexed(rows: DataFrame, columns: int, segments: int, out: int) -> DataFrame:
    own = rows.select("grp", "id", _written(F.col("seq"), columns, segments, out).alias("own"))
    return own.withColumn("side", F.element_at("own", -1)["n"] > READINGS)


def _keyed(own: DataFrame, of_key: int) -> DataFrame:
    texts = F.transform("own", lambda s: F.struct(s["k"].alias("k"), _texts(s["part"]).alias("t")))
    return own.where("not side").select("grp", "id", texts.alias("own")).select("grp", "id", F.explode(_keys(F.col("own"), of_key)).alias("key"))


def by_tiles(rows: DataFrame, threshold: float, columns: int) -> bool:
    """Whether to compare all pairs of rows (grp, id, seq) in tiles and not to look for candidates; both find the same pairs."""
    found = layout(most_mismatches(threshold, columns), columns)
    pairs_of = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    every, n = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(pairs_of, F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if found is None or every <= FEW:
        return True
    segments, of_key, out = found
    # a look at some rows, which decides the way and not the result
    shown = rows.where(F.pmod(F.xxhash64("grp", "id"), F.lit(max(n // SHOWN, 1))) == 0)
    shown = store(_indexed(shown, columns, segments, out))
    met = _keyed(shown, of_key).groupBy("grp", "key").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(pairs_of, F.lit(0.0))).first()[0]
    sizes = shown.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("side").cast("long")).alias("s"))
    here, aside = sizes.agg(F.coalesce(pairs_of, F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("s")), F.lit(0))).first()
    return met + aside > SHARE * here


def candidates(rows: DataFrame, threshold: float, columns: int) -> DataFrame:
    """(grp, a, b), a < b, each once: all pairs of rows (grp, id, seq) that can be within the threshold."""
    found = layout(most_mismatches(threshold, columns), columns)
    if found is None:  # so many mismatches that no segment need agree
        return _by_side_list(rows, rows).distinct()
    segments, of_key, out = found
    own = store(_indexed(rows, columns, segments, out))
    keyed = store(_keyed(own, of_key))
    # a key of very many sequences is dealt out over pairs of its blocks
    sizes = keyed.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / MEET).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiled = keyed.join(sizes.select("grp", "key", "blocks"), ["grp", "key"]).select("grp", "key", "id", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    tiled = tiled.select("grp", "key", "id", "block", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"))
    x, y = tiled.alias("x"), tiled.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("grp", "key", "lo", "hi")]
    on += [F.col("x.id") < F.col("y.id"), (F.col("x.block") != F.col("y.block")) | (F.col("x.lo") == F.col("x.hi"))]
    met = x.join(y, on).select("x.grp", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return met.unionByName(_by_side_list(rows, own.where("side"))).distinct()


def _measured_in_numpy(pairs: DataFrame, words: int, min_overlap: int) -> DataFrame:
    """grp, a, b, overlap and dist of pairs with both sequences."""
    schema = ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes if c in ("grp", "a", "b")) + ", overlap int, dist double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                own = batch.iloc[at : at + 512]
                overlap, dist = _compare(_Planes(own["seq_a"].tolist(), words), _Planes(own["seq_b"].tolist(), words), "uncorrected")
                yield own[["grp", "a", "b"]].assign(overlap=overlap.astype(np.int32), dist=np.where(overlap >= max(min_overlap, 1), dist, np.nan))

    return pairs.mapInPandas(run, schema).withColumn("dist", F.when(~F.isnan("dist"), F.col("dist"))).withColumn("bucket", F.floor(F.col("dist") * SCALE))


def _with_enough(rows: DataFrame, min_overlap: int) -> tuple[DataFrame, int]:
    """Rows that can have a pair, and the columns of the longest."""
    rows = rows.where("seq is not null").where(F.length(F.regexp_replace("seq", "[?_]", "")) >= max(min_overlap, 1))
    return rows, rows.agg(F.coalesce(F.max(F.length("seq")), F.lit(1))).first()[0]


def _by_index(rows: DataFrame, threshold: float, min_overlap: int, columns: int) -> DataFrame:
    pairs, words = candidates(rows, threshold, columns), words_of(columns)
    if words > COLUMN_WORDS:
        side = lambda s: rows.select("grp", F.col("id").alias(s), F.col("seq").alias(f"seq_{s}"))
        out = _measured_in_numpy(pairs.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"]), words, min_overlap)
    else:
        planes = store(with_planes(rows, words).drop("seq"))
        x = pairs.alias("p").join(planes.alias("x"), (F.col("p.grp") == F.col("x.grp")) & (F.col("p.a") == F.col("x.id")))
        both = x.join(planes.alias("y"), (F.col("p.grp") == F.col("y.grp")) & (F.col("p.b") == F.col("y.id")))
        out = measured(both, words, "uncorrected", min_overlap, ["p.grp as grp", "p.a as a", "p.b as b"])
    return out.where(F.col("bucket") <= round(threshold * SCALE))


def near(rows: DataFrame, threshold: float, min_overlap: int = 300) -> DataFrame:
    """(grp, a, b, overlap, dist, bucket), a < b: the pairs of rows (grp, id, seq) of one group within the threshold.

    Distances are uncorrected and count in five decimals.  Null sequences have no pairs; equal ones are
    pairs like others.  Needs ids that are unique within a group.
    """
    rows, columns = _with_enough(store(rows.select("grp", "id", "seq")), min_overlap)
    if by_tiles(rows, threshold, columns):
        return tiles.close_pairs(rows.withColumnRenamed("id", "ord"), threshold, min_overlap, ["grp"])
    return _by_index(rows, threshold, min_overlap, columns)


def _ungrouped(df: DataFrame) -> DataFrame:
    return df.select(F.lit("").alias("grp"), F.col("ord").alias("id"), "seq")


def distance_band(df: DataFrame, lo: float, hi: float, min_overlap: int = 300) -> DataFrame:
    """(a, b, overlap, dist, bucket), a < b by `ord`: the pairs with lo <= dist <= hi, of which what is farther is never made."""
    found = near(_ungrouped(df.where("ord is not null")), math.ceil(hi * SCALE) / SCALE, min_overlap)
    return found.where(F.col("dist").between(lo, hi)).drop("grp")


def near_pairs(df: DataFrame, threshold: float, min_overlap: int = 300) -> DataFrame:
    """As pairs.pair_distances, but only the pairs within the threshold; needs ord, title, seq, species and genus."""
    df = store(df.select("ord", "title", "seq", "species", "genus"))
    rows, columns = _with_enough(_ungrouped(df), min_overlap)
    if by_tiles(rows, threshold, columns):
        return tiles.close_pairs(df, threshold, min_overlap, named=("species", "genus"), twins="title")
    found = _by_index(rows, threshold, min_overlap, columns).drop("grp")
    side = lambda s: df.select(F.col("ord").alias(s), F.col("species").alias(f"species_{s}"), F.col("genus").alias(f"genus_{s}"), F.col("title").alias(f"title_{s}"))
    named = found.join(side("a"), "a").join(side("b"), "b")
    return named.select("a", "b", "species_a", "species_b", "genus_a", "genus_b", F.col("title_a").eqNullSafe(F.col("title_b")).alias("twins"), "overlap", "dist", "bucket")


def near_best_match(df: DataFrame, threshold: float, min_overlap: int = 300) -> DataFrame:
    """As ranking.best_match, of rows that have a neighbour within the threshold."""
    df = store(df.select("ord", "title", "seq", "species", "genus"))
    rows, columns = _with_enough(_ungrouped(df), min_overlap)
    if by_tiles(rows, threshold, columns):
        found = ranking.best_match_of(df, threshold, min_overlap, round(threshold * SCALE))
    else:
        found = ranking.best_match(df, mirrored(near_pairs(df, threshold, min_overlap)), threshold)
    return found.where("best_bucket is not null")


def near_links(df: DataFrame, threshold: float, min_overlap: int = 300) -> DataFrame:
    """(a, b, bucket): links that connect what pairs within the threshold connect.

    Equal sequences hang on the first of them, so that a large group of copies has as many links as rows.
    """
    df = store(df.select("ord", "seq"))
    first = store(df.groupBy("seq").agg(F.min("ord").alias("ord")))
    copies = df.join(first.select("seq", F.col("ord").alias("first")), "seq").where("ord <> first")
    real = F.length(F.regexp_replace("seq", "[?_]", ""))
    hung = copies.where(real >= max(min_overlap, 1)).select(F.col("first").alias("a"), F.col("ord").alias("b"), F.lit(0).cast("long").alias("bucket"))
    rows, columns = _with_enough(_ungrouped(first), min_overlap)
    if by_tiles(rows, threshold, columns):  # of each tile a spanning forest
        return hung.unionByName(tiles.links(first, threshold, max(min_overlap, 1)))
    return hung.unionByName(_by_index(rows, threshold, min_overlap, columns).select("a", "b", "bucket"))


def near_cells(grid: DataFrame, threshold: float, min_overlap: int = 0) -> DataFrame:
    """(locus, taxon, other, overlap, dist): live cells of one locus within the threshold, both directions."""
    rows = grid.where("not cancelled").select(F.col("locus").alias("grp"), F.col("taxon").alias("id"), "seq")
    rows, columns = _with_enough(store(rows), min_overlap)
    if by_tiles(rows, threshold, columns):
        return tiles.close_both_ways(rows.withColumnRenamed("id", "ord"), threshold, min_overlap, ["grp"]).withColumnsRenamed({"grp": "locus", "id": "taxon"})
    found = _by_index(rows, threshold, min_overlap, columns)
    side = lambda a, b: F.struct(F.col("grp").alias("locus"), F.col(a).alias("taxon"), F.col(b).alias("other"), "overlap", "dist")
    return found.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
