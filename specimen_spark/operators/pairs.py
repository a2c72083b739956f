"""Pairwise overlaps and distances of aligned sequences.

Sequences become bit planes; overlaps and matches are bit counts of their combinations, so a pair
costs a few integer operations inside generated code.  All pairs are dealt out over tiles: rows
fall into blocks by a hash of their number, a tile is a pair of blocks, and rows meet by an
equi-join on the tile.  The number of blocks follows the number of rows, so tiles stay small.

Of long sequences the columns would be too many for generated code; there a tile's rows are grouped
and its bit planes compared in numpy, to the same results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import MASK, PLANES, with_planes, words_needed, words_of
from .storage import cumulated, store

SCALE = 100_000  # distances are equal when they agree in five decimals
#: Sequences of more words than this are compared tile by tile in numpy.
COLUMN_WORDS = 8
#: A block has about so many rows at most.
BLOCK_ROWS = 2048


def most_mismatches(threshold: float, columns: int) -> int:
    """Mismatches that a pair with so many columns at most can have within the threshold, which counts in five decimals."""
    return int((round(threshold * SCALE) + 1) * columns / SCALE + 1e-9)


def _and(x: Column, y: Column) -> Column:
    return x.bitwiseAND(y)


def _or(*xs: Column) -> Column:
    return reduce(lambda x, y: x.bitwiseOR(y), xs)


class _Word:
    """One word of both sequences of a pair."""

    def __init__(self, w: int):
        self.x = {p: F.col(f"x.{p}{w}") for p in PLANES}
        self.y = {p: F.col(f"y.{p}{w}") for p in PLANES}
        base = lambda s: _or(s["a"], s["c"], s["t"], s["g"])
        self.bx, self.by = base(self.x), base(self.y)
        self.ux, self.uy = _or(self.x["p"], self.x["y"]), _or(self.y["p"], self.y["y"])
        x, y = self.x, self.y
        self.gaps = _or(_and(x["i"], _or(self.by, y["i"])), _and(y["i"], self.bx))
        self.same = _or(*[_and(x[k], y[k]) for k in "actg"], _and(x["i"], y["i"]))
        self.crossed = _or(_and(x["p"], y["y"]), _and(x["y"], y["p"]))
        differ = _or(*[x[k].bitwiseXOR(y[k]) for k in "actg"])
        self.transitions = _and(_or(_and(x["p"], y["p"]), _and(x["y"], y["y"])), differ)


def _total(words: list[_Word], part: Callable[[_Word], list[Column]]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(c) for w in words for c in part(w)])


def _uncorrected(words: list[_Word]) -> tuple[Column, Column]:
    overlap = _total(words, lambda w: [_or(_and(w.bx, w.by), w.gaps)])
    return overlap, 1.0 - F.try_divide(_total(words, lambda w: [w.same]).cast("double"), overlap)


def _two_parameter(words: list[_Word]) -> tuple[Column, Column]:
    overlap = _total(words, lambda w: [_and(w.bx, w.by)])
    n = _total(words, lambda w: [_and(w.ux, w.uy)]).cast("double")
    p = F.try_divide(_total(words, lambda w: [w.transitions]).cast("double"), n)
    q = F.try_divide(_total(words, lambda w: [w.crossed]).cast("double"), n)
    return overlap, F.when((1 - 2 * p - q > 0) & (1 - 2 * q > 0), F.greatest(F.lit(0.0), -0.5 * F.ln(1 - 2 * p - q) - 0.25 * F.ln(1 - 2 * q)))


def _transversions(words: list[_Word]) -> tuple[Column, Column]:
    overlap = _total(words, lambda w: [_and(w.ux, w.uy), w.gaps])
    return overlap, F.try_divide(_total(words, lambda w: [w.crossed]).cast("double"), overlap)


#: name -> (words) -> (overlap, distance); users may add their own.
METHODS: dict[str, Callable[[list[_Word]], tuple[Column, Column]]] = {"uncorrected": _uncorrected, "k2p": _two_parameter, "transversions": _transversions}


def measured(pairs: DataFrame, words: int, method: str, min_overlap: int, keep: list[str]) -> DataFrame:
    """Joined sides x and y, measured: the kept columns, overlap, dist (null if invalid) and bucket."""
    overlap, dist = METHODS[method]([_Word(w) for w in range(words)])
    out = pairs.select(*[F.col(k) if " " not in k else F.expr(k) for k in keep], overlap.cast("int").alias("overlap"), dist.alias("_d"))
    dist = F.when((F.col("overlap") >= min_overlap) & (F.col("overlap") > 0), F.col("_d"))
    return out.withColumn("dist", dist).drop("_d").withColumn("bucket", F.floor(F.col("dist") * SCALE))


def blocks_of(count: int, rows: DataFrame) -> int:
    """Blocks of at most about BLOCK_ROWS rows, and enough for a few tiles on each core."""
    return max(math.ceil(count / BLOCK_ROWS), math.ceil(math.sqrt(4 * rows.sparkSession.sparkContext.defaultParallelism)))


def blocks_for(rows: DataFrame) -> int:
    return blocks_of(rows.count(), rows)


def tiled(rows: DataFrame, keys: list[str], id_: str, count: int, blocks: int | None = None, most: int | None = None, size: int | None = None) -> DataFrame:
    """Adds block, lo and hi: a row of each tile that a row belongs to, for pairs of rows of equal keys.

    Within keys the number of blocks is that of the key's own rows, so that a row of a small group is
    written once, and one of a group that holds most rows as often as in a table without keys.
    most: blocks that all rows together would have; size: rows of a block.
    """
    every, size = blocks or most or blocks_of(count, rows), size or BLOCK_ROWS
    if keys and not blocks:
        own = F.ceil(F.greatest(F.count(F.lit(1)) / size, F.count(F.lit(1)) * F.lit(every) / max(count, 1))).cast("int")
        rows = rows.join(rows.groupBy(*keys).agg(own.alias("_blocks")), keys)
    else:
        rows = rows.withColumn("_blocks", F.lit(every))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(id_), F.col("_blocks")).cast("int"))
    out = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o"))
    return out.select("*", F.least("block", "_o").alias("lo"), F.greatest("block", "_o").alias("hi")).drop("_o", "_blocks")


#: Methods by which a pair is as far apart as the pair turned round.
SYMMETRIC = ("uncorrected", "k2p", "transversions")


def sides(tiles: DataFrame, id_: str, method: str) -> tuple[DataFrame, DataFrame, Column]:
    """The two sides of the tiles' pairs, as x and y, and the condition by which each pair of rows comes once.

    A tile's lower block meets its upper one, in either order of ids; by a method of a user's own the smaller id is x.
    """
    tiles = tiles.where(F.col(id_).isNotNull())
    if method not in SYMMETRIC:
        return tiles.alias("x"), tiles.alias("y"), (F.col(f"x.{id_}") < F.col(f"y.{id_}")) & ((F.col("x.block") != F.col("y.block")) | (F.col("x.lo") == F.col("x.hi")))
    return tiles.where("block = lo").alias("x"), tiles.where("block = hi").alias("y"), (F.col("x.lo") < F.col("x.hi")) | (F.col(f"x.{id_}") < F.col(f"y.{id_}"))


class _Planes:
    """Bit planes of many sequences: arrays [sequence, word]."""

    def __init__(self, seqs: list[str], words: int):
        flat = np.full((len(seqs), 64 * words), ord("_"), np.uint8)
        for i, s in enumerate(seqs):
            raw = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
            flat[i, : len(raw)] = raw
        self._pack(flat)

    @classmethod
    def packed(cls, flat: np.ndarray) -> "_Planes":
        """The same of sequences that are rows of characters, a multiple of 64 of them."""
        out = object.__new__(cls)
        out._pack(flat)
        return out

    def _pack(self, flat: np.ndarray) -> None:
        masks = np.zeros(256, np.uint8)
        for ch, m in MASK.items():
            masks[ord(ch)] = m
        m, of = masks[flat], lambda letters: np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(letters.encode(), np.uint8))[flat]
        packed = lambda bits: np.packbits(bits, axis=1).view(np.uint64)
        self.a, self.c, self.t, self.g = (packed(m & b > 0) for b in (1, 2, 4, 8))
        self.i, self.p, self.y = packed(of("-")), packed(of("AGR")), packed(of("CTY"))
        self.base, self.known = self.a | self.c | self.t | self.g, self.p | self.y

    def row(self, k: int) -> "_Planes":
        out = object.__new__(_Planes)
        out.__dict__ = {name: x[k] for name, x in self.__dict__.items()}
        return out


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def _compare(x: _Planes, y: _Planes, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Overlap and distance of one sequence and many, as METHODS has them."""
    gaps = x.i & (y.base | y.i) | y.i & x.base
    crossed = _count(x.p & y.y | x.y & y.p)
    with np.errstate(divide="ignore", invalid="ignore"):
        if method == "uncorrected":
            overlap = _count(x.base & y.base | gaps)
            same = _count(x.a & y.a | x.c & y.c | x.t & y.t | x.g & y.g | x.i & y.i)
            return overlap, 1.0 - same / overlap
        if method == "transversions":
            overlap = _count(x.known & y.known) + _count(gaps)
            return overlap, crossed / overlap
        differ = (x.a ^ y.a) | (x.c ^ y.c) | (x.t ^ y.t) | (x.g ^ y.g)
        n = _count(x.known & y.known)
        p, q = _count((x.p & y.p | x.y & y.y) & differ) / n, crossed / n
        dist = np.maximum(0.0, -0.5 * np.log(1 - 2 * p - q) - 0.25 * np.log(1 - 2 * q))
        return _count(x.base & y.base), np.where((1 - 2 * p - q > 0) & (1 - 2 * q > 0), dist, np.nan)


def in_numpy(words: int, method: str) -> bool:
    """Whether sequences of so many words are compared tile by tile: long ones, by a method of this module."""
    return words > COLUMN_WORDS and method in ("uncorrected", "k2p", "transversions")


#: Pairs that a task hands on at once, about.
SLICE = 1 << 17


def _met(x: _Planes, y: _Planes, n: int, starts: list[int], method: str, min_overlap: int, kept: Callable[[int, slice], np.ndarray] | None = None, valid_only: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """Row k of x against the rows of y from starts[k] on: (k, row, overlap, dist), dist being nan where it isn't valid; a slice of them at a time."""
    out, held = [], 0
    for k, start in enumerate(starts):
        overlap, dist = _compare(x.row(k), y.row(slice(start, n)), method)
        valid = (overlap >= min_overlap) & (overlap > 0) & ~np.isnan(dist)
        keep = valid if valid_only else np.ones(n - start, bool)
        if kept is not None:
            keep = keep & kept(k, slice(start, n))
        at = np.flatnonzero(keep)
        if len(at):
            out.append((np.full(len(at), k), start + at, overlap[at], np.where(valid, dist, np.nan)[at]))
            held += len(at)
        if held >= SLICE:
            yield tuple(np.concatenate(c) for c in zip(*out, strict=True))
            out, held = [], 0
    if out:
        yield tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _starts(rows: pd.DataFrame) -> list[int]:
    """Of a tile's rows in order of their blocks: where the partners of each row of the lower block begin."""
    low = int((rows["block"] == rows["lo"]).sum())
    itself = low and rows["lo"].iloc[0] == rows["hi"].iloc[0]
    return [k + 1 if itself else low for k in range(low)]


def measured_numpy(dist: np.ndarray, overlap: np.ndarray) -> dict[str, object]:
    return {"overlap": overlap, "dist": dist, "bucket": pd.Series(np.floor(dist * SCALE)).astype("Int64")}


MEASURED = "overlap int, dist double, bucket long"


def _tile_pairs(tiles: DataFrame, keys: list[str], words: int, method: str, min_overlap: int, scope: str, valid_only: bool) -> DataFrame:
    """The pairs of each tile, measured in numpy."""
    names = ["species", "genus"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["block", "ord"], ignore_index=True)
        planes, ord_, epithet = _Planes(rows["seq"].tolist(), words), rows["ord"].to_numpy(), rows["species_epithet"].to_numpy(dtype=object)
        other = (lambda k, at: (epithet[at] != epithet[k]) & pd.notna(epithet[at]) & pd.notna(epithet[k])) if scope == "inter_congeneric" else None
        named = {n: rows[n].to_numpy(dtype=object) for n in names}
        title = rows["title"].fillna("").to_numpy(dtype=object)
        for x, y, overlap, dist in _met(planes, planes, len(rows), _starts(rows), method, min_overlap, other, valid_only):
            turned = ord_[x] > ord_[y]
            x, y = np.where(turned, y, x), np.where(turned, x, y)
            made = {"a": ord_[x], "b": ord_[y]} | {f"{n}_{s}": pd.Series(named[n][at], dtype=object) for n in names for s, at in (("a", x), ("b", y))}
            yield pd.DataFrame(made | {"twins": (title[x] == title[y]).astype(bool)} | measured_numpy(dist, overlap))[[c.split()[0] for c in schema.split(", ")]]

    schema = "a long, b long, species_a string, species_b string, genus_a string, genus_b string, twins boolean, " + MEASURED
    return tiles.groupBy("lo", "hi", *keys).applyInPandas(compare, schema)


def tiles_met(tiles: DataFrame, key: str, name: str, words: int, method: str, min_overlap: int) -> DataFrame:
    """(key, a, b, overlap, dist, bucket): the valid pairs of each tile's rows (key, name, seq), of names a < b."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows[rows[name].notna() & rows["seq"].notna()].sort_values(["block", name], ignore_index=True)
        names, planes = rows[name].to_numpy(dtype=object), _Planes(rows["seq"].tolist(), words)
        for x, y, overlap, dist in _met(planes, planes, len(rows), _starts(rows), method, min_overlap, lambda k, at: names[at] != names[k]):
            x, y = np.where(names[x] > names[y], y, x), np.where(names[x] > names[y], x, y)
            own = pd.Series(rows[key].iloc[0], index=range(len(x)), dtype=object)
            yield pd.DataFrame({key: own, "a": pd.Series(names[x], dtype=object), "b": pd.Series(names[y], dtype=object)} | measured_numpy(dist, overlap))

    return tiles.groupBy("lo", "hi", key).applyInPandas(compare, f"{key} string, a string, b string, {MEASURED}")


def side_by_side(rows: DataFrame, words: int, method: str, min_overlap: int) -> DataFrame:
    """Measures seq against other_seq of each row; both leave. A batch of rows at a time, so nothing is shuffled."""
    kept = [f for f in rows.schema.fields if f.name not in ("seq", "other_seq")]
    at_once = max(1, (1 << 22) // (64 * words))

    def compare(batches):
        for batch in batches:
            for start in range(0, len(batch), at_once):
                part = batch.iloc[start : start + at_once].reset_index(drop=True)
                x, y = (_Planes(part[c].fillna("").tolist(), words) for c in ("seq", "other_seq"))
                overlap, dist = _compare(x, y, method)
                valid = (overlap >= min_overlap) & (overlap > 0) & ~np.isnan(dist)
                yield pd.DataFrame({f.name: part[f.name] for f in kept} | measured_numpy(np.where(valid, dist, np.nan), overlap))

    return rows.mapInPandas(compare, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), MEASURED]))


def pair_distances(df: DataFrame, method: str = "uncorrected", min_overlap: int = 300, scope: str = "all", blocks: int | None = None, valid_only: bool = True) -> DataFrame:
    """(a, b, species_a, species_b, genus_a, genus_b, twins, overlap, dist, bucket) of pairs a < b by `ord`.

    twins: both have the same title.

    scope: all; intra (one species); inter_congeneric (one genus, two epithets).  Within a species
    or genus the same tiles split large groups.  Needs ord, title, seq, species, genus, species_epithet.
    """
    keys = {"all": [], "intra": ["species"], "inter_congeneric": ["genus"]}[scope]
    rows = store(df.select("ord", "title", "seq", "species", "genus", "species_epithet"))  # counted and dealt out, but made once
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    if valid_only and min_overlap > 0:  # an overlap can't exceed the shorter sequence
        rows = rows.where(F.length(F.regexp_replace("seq", "[?_]", "")) >= min_overlap)
    count, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("seq")), F.lit(0))).first()
    words = words_of(longest)
    by_tile = in_numpy(words, method)
    if not by_tile:
        rows = with_planes(rows, words).drop("seq")
    tiles = tiled(rows, keys, "ord", count, blocks)
    if by_tile:
        return _tile_pairs(tiles, keys, words, method, min_overlap, scope, valid_only)
    x, y, met = sides(tiles, "ord", method)
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ["lo", "hi", *keys]] + [met]
    if scope == "inter_congeneric":
        on.append(F.col("x.species_epithet") != F.col("y.species_epithet"))
    joined = x.join(y, reduce(lambda a, b: a & b, on))
    first = lambda c, s: f"if(x.ord < y.ord, x.{c}, y.{c}) as {c}_a" if s == "a" else f"if(x.ord < y.ord, y.{c}, x.{c}) as {c}_b"
    kept = ["least(x.ord, y.ord) as a", "greatest(x.ord, y.ord) as b", *[first(c, s) for c in ("species", "genus") for s in "ab"]]
    out = measured(joined, words, method, min_overlap, [*kept, "x.title <=> y.title as twins"])
    return out.where("dist is not null") if valid_only else out


def saturated(measured_pairs: DataFrame, min_overlap: int) -> DataFrame:
    """Of pairs with valid_only=False, those that overlap enough but are too far apart to have a distance."""
    return measured_pairs.where((F.col("overlap") >= min_overlap) & (F.col("overlap") > 0) & F.col("dist").isNull())


def mirrored(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, as query q and match m, in one pass over the pairs."""
    side = lambda q, m: F.struct(F.col(q).alias("q"), F.col(m).alias("m"), *[F.col(f"{n}_{s}").alias(f"{n}_{t}") for n in ("species", "genus") for s, t in ((q, "q"), (m, "m"))], "overlap", "dist", "bucket")
    return pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")


def filter_distance(pairs: DataFrame, lo: float, hi: float) -> DataFrame:
    return pairs.where(F.col("dist").between(lo, hi))


def overlap_report(df: DataFrame, blocks: int | None = None) -> DataFrame:
    """Pairs of one species with the base pairs they share, no threshold."""
    return pair_distances(df, min_overlap=0, scope="intra", blocks=blocks, valid_only=False).select("a", "b", F.col("species_a").alias("species"), "overlap")


def _met_tiles(q: DataFrame, m: DataFrame, words: int, method: str, min_overlap: int) -> DataFrame:
    """The pairs of a tile's queries and references, measured in numpy; both sides have tq and tm."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        x, y = (rows[rows["asked"] == side].reset_index(drop=True) for side in (True, False))
        a, b = x["ord"].to_numpy(), y["ord"].to_numpy()
        seqs = [df["seq"].fillna("").tolist() for df in (x, y)]
        for i, k, overlap, dist in _met(_Planes(seqs[0], words), _Planes(seqs[1], words), len(y), [0] * len(x), method, min_overlap, lambda r, at: b[at] != a[r]):
            made = {"q": a[i], "m": b[k]} | {f"{n}_{s}": pd.Series(df[n].to_numpy(dtype=object)[at], dtype=object) for n in ("species", "genus") for s, df, at in (("q", x, i), ("m", y, k))}
            yield pd.DataFrame(made | measured_numpy(dist, overlap))

    side = lambda df, asked: df.select("tq", "tm", "ord", "seq", "species", "genus", F.lit(asked).alias("asked"))
    return side(q, True).unionByName(side(m, False)).groupBy("tq", "tm").applyInPandas(compare, f"q long, m long, species_q string, species_m string, genus_q string, genus_m string, {MEASURED}")


def _with_mismatches(out: DataFrame) -> DataFrame:
    return out.withColumn("mismatches", F.round(F.col("dist") * F.col("overlap")).cast("int"))


def query_distances(queries: DataFrame, reference: DataFrame, method: str = "uncorrected", min_overlap: int = 300) -> DataFrame:
    """Every query against every reference sequence: (q, m, overlap, dist, bucket, mismatches).

    Each query goes to every part of the reference, by tiles of a block of queries and one of references.
    """
    words = max(words_needed(queries), words_needed(reference))
    q, m = (df.select("ord", "seq", "species", "genus") for df in (queries, reference))
    by_tile = in_numpy(words, method)
    if not by_tile:
        q, m = with_planes(q, words).drop("seq"), with_planes(m, words).drop("seq")
    nq, nm = math.ceil(queries.count() / BLOCK_ROWS) or 1, blocks_for(reference)
    block = lambda n: F.pmod(F.xxhash64("ord"), F.lit(n)).cast("int")
    q = q.withColumn("tq", block(nq)).withColumn("tm", F.explode(F.sequence(F.lit(0), F.lit(nm - 1))))
    m = m.withColumn("tm", block(nm)).withColumn("tq", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    if by_tile:
        return _with_mismatches(_met_tiles(q, m, words, method, min_overlap))
    joined = q.alias("x").join(m.alias("y"), (F.col("x.tq") == F.col("y.tq")) & (F.col("x.tm") == F.col("y.tm")) & (F.col("x.ord") != F.col("y.ord")))
    out = measured(joined, words, method, min_overlap, ["x.ord as q", "y.ord as m", "x.species as species_q", "y.species as species_m", "x.genus as genus_q", "y.genus as genus_m"])
    return _with_mismatches(out.where("dist is not null"))


def times(pairs: DataFrame) -> Column:
    """How often a pair counts in a distribution: sequences of one species and one title count twice."""
    return F.when((F.col("species_a") == F.col("species_b")) & F.col("twins"), 2).otherwise(1)


def place_in_distributions(distances: DataFrame, intra: DataFrame, inter: DataFrame) -> DataFrame:
    """Adds to distances (dist) the share of pairs within species that are farther apart, and of pairs
    between species that are closer, in percent.

    Only counts of distinct distances, one row for each, meet the distances.
    """
    counted = lambda pairs: pairs.groupBy("dist").agg(F.sum(times(pairs)).alias("n"))
    return place_in_counts(distances, counted(intra), counted(inter))


def place_in_counts(distances: DataFrame, within: DataFrame, between: DataFrame) -> DataFrame:
    """place_in_distributions from counts of distances (dist, n)."""
    wanted = distances.select("dist").where("dist is not null").distinct().select("dist", F.lit(0).alias("n"))

    def share(counted: DataFrame, name: str, below: bool) -> DataFrame:
        counts = store(counted.select("dist", "n").unionByName(wanted).groupBy("dist").agg(F.sum("n").alias("n")))
        total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
        return cumulated(counts, below).crossJoin(total).select("dist", F.round(F.try_divide(F.lit(100.0) * F.col("before"), F.col("total")), 6).alias(name))

    return distances.join(share(within, "intra_farther", False), "dist", "left").join(share(between, "inter_closer", True), "dist", "left")
