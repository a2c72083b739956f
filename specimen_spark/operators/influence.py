"""Leave-one-out influence on the correlation of loci, with every taxon as the reference.

Distances of all taxa to all references at all loci are n² a locus, and are needed twice: for the sums of
each reference, and for what these are without a cell.  A block of references meets all taxa twice, in
order of their names and a chunk at a time.  Of a reference its sums and its best cells are kept, so memory is
that of a chunk, and neither distances nor terms of pairs of loci are stored or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import words_of
from .pairs import _Planes
from .storage import store
from .tiles import TILE_ROWS

#: Taxa that a reference meets at once.
CHUNK = 1 << 15
#: Positions of the taxa of a chunk or block together, at most, about.
POSITIONS = 1 << 24
#: Numbers that the sums of a block of references are, at most, about.
SUMS = 1 << 22
#: Overlaps and hits of so many kinds have their distances in a table.
TABLE = 1 << 16
#: Method -> planes whose common bits are the overlap (sums of unions), and those whose common bits are hits.
_SIDES = {
    "uncorrected": ([[("real", "real")]], [(c, c) for c in "actgi"]),
    "transversions": ([[("known", "known")], [("i", "real"), ("base", "i")]], [("p", "y"), ("y", "p")]),
}
METHODS = tuple(_SIDES)


class _Cells:
    """Of many taxa the bit planes of each locus: arrays [word, taxon] of numbers no wider than the locus."""

    def __init__(self, rows: list[str], widths: list[int]):
        flat = np.frombuffer("".join(rows).encode("latin-1", "replace"), np.uint8).reshape(len(rows), sum(widths))
        self.loci, begin = [], 0
        for width in widths:
            kind = next(k for size, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (math.inf, np.uint64)) if width <= size)
            part = np.full((len(rows), 64 * words_of(width)), ord("_"), np.uint8)
            part[:, :width] = flat[:, begin : begin + width]
            planes = _Planes.packed(part)
            planes.real = planes.base | planes.i
            self.loci.append({name: np.ascontiguousarray(bits.T.astype(kind)) for name, bits in planes.__dict__.items()})
            begin += width


def _common(x: dict[str, np.ndarray], k: int, y: dict[str, np.ndarray], sides: list[tuple[str, str]], total: np.ndarray) -> None:
    """Adds the positions at which taxon k of x and those of y have any two of the planes in common."""
    for w in range(len(x["a"])):
        bits = None
        for a, b in sides:
            if own := x[a][w, k]:
                part = y[b][w] & own
                bits = part if bits is None else np.bitwise_or(bits, part, out=bits)
        if bits is not None:
            np.add(total, np.bitwise_count(bits), out=total)


class _Distances:
    """Distances at a locus by overlap and hits; nan where there are too few positions."""

    def __init__(self, width: int, method: str, min_overlap: int):
        self.sides, self.method, self.least, self.base = _SIDES[method], method, max(min_overlap, 1), width + 1
        size = (2 * width + 1) * self.base  # a position can count as known and as a gap by transversions
        self.table = self._dist(np.arange(size)) if size <= TABLE else None

    def _dist(self, code: np.ndarray) -> np.ndarray:
        overlap, hits = np.divmod(code, self.base)
        share = hits / np.maximum(overlap, 1)
        return np.where(overlap >= self.least, 1.0 - share if self.method == "uncorrected" else share, np.nan)

    def of(self, x: dict[str, np.ndarray], k: int, y: dict[str, np.ndarray]) -> np.ndarray:
        """Codes of taxon k of x and those of y."""
        n = y["a"].shape[1]
        overlap, hits = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for sides in self.sides[0]:
            _common(x, k, y, sides, overlap)
        _common(x, k, y, self.sides[1], hits)
        overlap *= self.base
        return np.add(overlap, hits, out=overlap)

    def dist(self, code: np.ndarray) -> np.ndarray:
        return self._dist(code) if self.table is None else self.table[code]


def _r(n, sx, sy, sxx, syy, sxy):
    """Pearson r of sums; 0 without variance."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((vx > 1e-12) & (vy > 1e-12), (n * sxy - sx * sy) / (np.sqrt(vx) * np.sqrt(vy)), 0.0)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) * 1e7 + 0.5) / 1e7, x)


def _chunks(batches: Iterator[pd.DataFrame], widths: list[int]) -> Iterator[tuple[int, np.ndarray, _Cells]]:
    """(turn, taxa, their cells), the taxa of a turn a chunk at a time."""
    held, size, turn, most = [], 0, None, max(1, min(CHUNK, POSITIONS // sum(widths)))

    def made():
        rows = pd.concat(held, ignore_index=True)
        return turn, rows["taxon"].to_numpy(dtype=object), _Cells(rows["cells"].tolist(), widths)

    for batch in batches:
        for now, part in batch.groupby("turn", sort=True):
            if held and (now != turn or size + len(part) > most and turn):
                yield made()
                held, size = [], 0
            turn = now
            held.append(part)
            size += len(part)
    if held:
        yield made()


class _Block:
    """The references of a block, their sums, and the best cells of each so far."""

    def __init__(self, names: np.ndarray, cells: _Cells, loci: list[str], measures: list[_Distances], k: int, top: int):
        self.names, self.cells, self.loci, self.measures, self.top = names, cells, loci, measures, top
        count = len(loci)
        self.sums = np.zeros((len(names), 4, count, count))  # n, sx, sxx, sxy
        self.k, self.pairs, self.r = k, k * (k + 1) / 2, None
        self.best = [[(np.empty(0), np.empty(0, object))] * count for _ in names]

    def _met(self, taxa: np.ndarray, cells: _Cells) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
        """Each reference, and by locus codes and distances of the taxa; its own are not valid."""
        itself = pd.Index(taxa).get_indexer(self.names)
        for ref, at in enumerate(itself.tolist()):
            codes = [m.of(x, ref, y) for m, x, y in zip(self.measures, self.cells.loci, cells.loci, strict=True)]
            if at >= 0:
                for code in codes:
                    code[at] = 0  # no overlap
            yield ref, codes, [m.dist(code) for m, code in zip(self.measures, codes, strict=True)]

    def add(self, taxa: np.ndarray, cells: _Cells) -> None:
        for ref, _, dists in self._met(taxa, cells):
            x = np.stack(dists)
            valid = ~np.isnan(x)
            x[~valid] = 0.0
            valid = valid.astype(float)
            own = self.sums[ref]
            own[0] += valid @ valid.T
            own[1] += x @ valid.T
            own[2] += (x * x) @ valid.T
            own[3] += x @ x.T

    def _pair(self, ref: int, i: int, j: int) -> tuple[float, ...]:
        n, sx, sxx, sxy = self.sums[ref]
        return n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]

    def _change(self, ref: int, i: int, j: int, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        """By how much r of two loci changes without a cell's distances; 0 where one isn't valid."""
        n, sx, sy, sxx, syy, sxy = self._pair(ref, i, j)
        less = _r(n - 1, sx - dx, sy - dy, sxx - dx * dx, syy - dy * dy, sxy - dx * dy)
        return np.where(np.isnan(dx) | np.isnan(dy), 0.0, less - self.r[ref, i, j])

    def look(self, taxa: np.ndarray, cells: _Cells) -> None:
        """Keeps the best cells; taxa come in order, so that of equal ones the first stay."""
        count = len(self.loci)
        upper = np.triu_indices(count, 1)
        if self.r is None:
            n, sx, sxx, sxy = self.sums.transpose(1, 0, 2, 3)
            self.r = _r(n, sx, sx.transpose(0, 2, 1), sxx, sxx.transpose(0, 2, 1), sxy)
        for ref, codes, dists in self._met(taxa, cells):
            if not self.sums[ref, 0][upper].any():
                continue
            kinds = []  # of each locus the number of each taxon's distance, and the distances
            for m, code in zip(self.measures, codes, strict=True):
                if m.table is None:
                    kinds.append(None)
                    continue
                there = np.zeros(len(m.table), bool)
                there[code] = True
                seen = np.flatnonzero(there)
                number = np.zeros(len(m.table), np.int32)
                number[seen] = np.arange(len(seen))
                kinds.append((number[code], m.table[seen]))
            delta = np.zeros((count, len(taxa)))
            for i, j in zip(*upper, strict=True):
                if kinds[i] and kinds[j] and len(kinds[i][1]) * len(kinds[j][1]) < len(taxa):
                    (a, dx), (b, dy) = kinds[i], kinds[j]
                    change = self._change(ref, i, j, dx[:, None], dy[None, :]).ravel()[a * np.int32(len(dy)) + b]
                else:
                    change = self._change(ref, i, j, dists[i], dists[j])
                delta[i] += change
                delta[j] += change
            every = self.r[ref][upper].sum() + self.k
            now = _rounded(np.array([every / self.pairs]))[0]
            for locus in range(count):
                self._offer(ref, locus, (every + delta[locus]) / self.pairs, now, taxa)

    def _offer(self, ref: int, locus: int, value: np.ndarray, now: float, taxa: np.ndarray) -> None:
        held, names = self.best[ref][locus]
        full = len(held) == self.top
        at = np.flatnonzero(value > held[-1]) if full else np.arange(len(value))
        value = _rounded(value[at])
        keep = (value != now) & (value > held[-1]) if full else value != now
        at, value = at[keep], value[keep]
        if len(value) > self.top:
            keep = value >= np.partition(value, len(value) - self.top)[len(value) - self.top]
            at, value = at[keep], value[keep]
        if len(value):
            value, names = np.concatenate([held, value]), np.concatenate([names, taxa[at]])
            order = np.argsort(-value, kind="stable")[: self.top]
            self.best[ref][locus] = value[order], names[order]

    def found(self) -> Iterator[pd.DataFrame]:
        made, size = [], 0
        for ref, name in enumerate(self.names):
            for locus, (value, taxa) in zip(self.loci, self.best[ref], strict=True):
                if len(value):
                    made.append(pd.DataFrame({"taxon": taxa, "average_r": value, "place": np.arange(1, len(value) + 1)}).assign(reference=name, locus=locus))
                    size += len(value)
            if made and (size >= CHUNK or ref == len(self.names) - 1):
                yield pd.concat(made, ignore_index=True)[["reference", "locus", "taxon", "average_r", "place"]]
                made, size = [], 0
        if made:
            yield pd.concat(made, ignore_index=True)[["reference", "locus", "taxon", "average_r", "place"]]


def influence(cells: DataFrame, k: int, method: str, min_overlap: int = 1, top: int = 10) -> DataFrame:
    """(reference, locus, taxon, average_r, place) of the cells (locus, taxon, seq), one of each locus and taxon at most; k: number of loci."""
    spark = cells.sparkSession
    loci = cells.groupBy("locus").agg(F.max(F.length("seq")).alias("width")).where("width > 0").orderBy("locus").collect()  # a row a locus
    names, widths = [x["locus"] for x in loci], [x["width"] for x in loci]
    schema = "reference string, locus string, taxon string, average_r double, place int"
    if not loci:
        return spark.createDataFrame([], schema)
    # a taxon's cells side by side, each as wide as its locus; what is absent has no positions
    own, places = F.map_from_entries(F.collect_list(F.struct("locus", "seq"))), F.array(*[F.struct(F.lit(n).alias("locus"), F.lit(w).alias("width")) for n, w in zip(names, widths, strict=True)])
    rows = cells.groupBy("taxon").agg(own.alias("own"))
    rows = store(rows.select("taxon", F.array_join(F.transform(places, lambda x: F.rpad(F.coalesce(F.element_at("own", x["locus"]), F.lit("")), x["width"], F.lit("_"))), "").alias("cells")))
    size = max(1, min(TILE_ROWS, SUMS // (4 * len(names) ** 2), POSITIONS // sum(widths)))
    blocks = max(math.ceil(rows.count() / size), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measures, block = [_Distances(w, method, min_overlap) for w in widths], None
        for turn, taxa, own in _chunks(batches, widths):
            if turn == 0:
                block = _Block(taxa, own, names, measures, k, top)
            elif block:
                (block.add if turn == 1 else block.look)(taxa, own)
        if block:
            yield from block.found()

    # turn 0: the block's references; 1 and 2: all taxa
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("taxon"), F.lit(blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    turns = F.when(F.col("_b") == F.col("block"), F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    dealt = dealt.select("block", F.explode(turns).alias("turn"), "taxon", "cells")
    return dealt.repartition(blocks, "block").sortWithinPartitions("block", "turn", "taxon").groupBy("block").applyInPandas(run, schema)
