"""Pairs as rows, where the pairs themselves are asked for.

Tiles are those of `tiles`; their pairs are measured in numpy a strip at a time and leave the tile at once, so memory
is that of a strip and no pair is shuffled.  There are n² of them whatever is done, so what counts is what a
pair takes in the files that they are written to.  A pair's a comes from the side that the strip goes along, so
that it stays the same for long runs.  Partners either come in the same order for each row of a strip, some hundred at a
time, and repeat; or, where more than one column follows from overlap and hits, rows of equal ones come together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .pairs import SCALE, _Planes

#: Partners in the same order, for each row of a strip in turn.
WIDTH = 512
#: Rows of so many words differ in so many ways that pairs are brought together over a strip, not for each row.
ROW_WORDS = 2
_LETTERS = {"A": ("p", "a", "g"), "G": ("p", "g", "a"), "C": ("y", "c", "t"), "T": ("y", "t", "c")}
#: Method -> counts of a pair: the first one is the overlap; sums of unions of planes that have bits in common.
_COUNTS = {
    "uncorrected": ([[("real", "real")]], [[(c, c) for c in "actgi"]]),
    "transversions": ([[("known", "known")], [("i", "real"), ("base", "i")]], [[("p", "y"), ("y", "p")]]),
    "k2p": ([[("base", "base")]], [[("p", "p"), ("y", "y")]], [[("p", "y"), ("y", "p")]], [[(f"only{c}", f"only{c}") for c in "AGCTRY"]]),
}
METHODS = tuple(_COUNTS)


class Side:
    """Bit planes of rows: arrays [word, row]."""

    def __init__(self, seqs: list[str], words: int, method: str):
        p = _Planes(seqs, words)
        p.real = p.base | p.i
        if method == "k2p":
            for letter, (kind, own, other) in _LETTERS.items():
                setattr(p, f"only{letter}", getattr(p, kind) & getattr(p, own) & ~getattr(p, other))
            p.onlyR, p.onlyY = p.p & p.a & p.g, p.y & p.c & p.t
        used = {name for count in _COUNTS[method] for union in count for pair in union for name in pair}
        self.planes = {name: np.ascontiguousarray(bits.T) for name, bits in p.__dict__.items() if name in used}
        self.filled = np.array([tiles.words_of(len(s)) for s in seqs], np.int64)


class Strip:
    """Counts of the pairs of some rows and all partners from one on."""

    def __init__(self, counts: list, most: int):
        self.counts, self.kind = counts, np.uint16 if most < 1 << 16 else np.uint32
        self.held: tuple[np.ndarray, ...] = ()

    def counted(self, x: Side, rows: range, y: Side, begin: int, end: int) -> np.ndarray:
        """Arrays [count, row, partner]."""
        n = end - begin
        if not self.held or len(self.held[0]) < n:
            self.held = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint8)
        bits, more, ones = (h[:n] for h in self.held)
        out = np.zeros((len(self.counts), len(rows), n), self.kind)
        for r, k in enumerate(rows):
            for count, total in zip(self.counts, out[:, r], strict=True):
                for w in range(int(x.filled[k])):
                    for union in count:
                        first = True
                        for a, b in union:
                            if own := x.planes[a][w, k]:
                                np.bitwise_and(y.planes[b][w, begin:end], own, out=bits if first else more)
                                if not first:
                                    np.bitwise_or(bits, more, out=bits)
                                first = False
                        if not first:
                            np.bitwise_count(bits, out=ones)
                            np.add(total, ones, out=total)
        return out


def distance(counts: tuple[np.ndarray, ...], method: str) -> np.ndarray:
    """Distances of counts, as pairs.METHODS has them; nan where there is none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if method == "uncorrected":
            return 1.0 - counts[1] / counts[0].astype(float)
        if method == "transversions":
            return counts[1] / counts[0].astype(float)
        _, same, crossed, exact = (c.astype(np.int64) for c in counts)
        n = (same + crossed).astype(float)
        p, q = (same - exact) / n, crossed / n
        one, two = 1 - 2 * p - q, 1 - 2 * q
        return np.where((one > 0) & (two > 0), np.maximum(0.0, -0.5 * np.log(one) - 0.25 * np.log(two)), np.nan)


class Found:
    """What leaves a strip: a column for each one asked for."""

    def __init__(self, method: str, columns: list[str], least: int, valid_only: bool, words: int, digits: int | None, runs: bool):
        self.method, self.columns, self.least, self.valid_only, self.digits = method, columns, least, valid_only, digits
        wanted = {"dist", "bucket", "mismatches"} & set(columns)
        self.runs, self.by_row = runs and method != "k2p" and wanted, words <= ROW_WORDS
        self.counts = list(_COUNTS[method][: None if wanted or valid_only else 1])
        self.base = 64 * words + 1

    def strip(self, words: int) -> Strip:
        return Strip(self.counts, 128 * words + 1)

    def of(self, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(row, partner, columns) of the pairs to keep, of arrays [count, row, partner]."""
        width = keep.shape[1]
        keep = keep & (counts[0] >= self.least)
        if self.runs:
            at = np.flatnonzero(keep)
            if not len(at):
                return at, at, {}
            overlap, hits = (c.ravel()[at].astype(np.int64) for c in counts)
            code = overlap * self.base + hits
            if self.by_row:
                code += (at // width) * ((int(overlap.max()) + 1) * self.base)
            shift = int(keep.size).bit_length()
            at = np.sort(code << shift | at) & ((1 << shift) - 1)
        else:
            places = np.arange(keep.size).reshape(keep.shape)
            at = np.concatenate([places[:, s : s + WIDTH][keep[:, s : s + WIDTH]] for s in range(0, width, WIDTH)])
        got = tuple(c.ravel()[at] for c in counts)
        out = {"overlap": got[0].astype(np.int32)}
        if len(got) > 1:
            dist = distance(got, self.method)
            if self.method == "k2p" and not self.valid_only:  # what no known position is compared at is no pair
                there = got[1].astype(np.int64) + got[2] > 0
            else:
                there = ~np.isnan(dist)
            if not there.all():
                at, dist, out = at[there], dist[there], {"overlap": out["overlap"][there]}
            out["bucket"] = np.floor(dist * SCALE) if self.method == "k2p" else np.floor(dist * SCALE).astype(np.int64)
            if "mismatches" in self.columns:
                out["mismatches"] = np.rint(dist * out["overlap"]).astype(np.int32)
            out["dist"] = dist if self.digits is None else np.floor(dist * 10.0**self.digits + 0.5) / 10.0**self.digits
        row, partner = np.divmod(at, width)
        return row, partner, out


def _constant(value: str, n: int) -> pd.Series:
    return pd.Series(pd.arrays.ArrowExtensionArray(pa.repeat(pa.scalar(value, pa.string()), n)))


def every_pair(df: DataFrame, columns: str = "overlap int, dist double, bucket long", method: str = "uncorrected", min_overlap: int = 300, scope: str = "all", valid_only: bool = True, digits: int | None = None) -> DataFrame:
    """(a, b and columns) of pairs a < b by `ord` as pairs.pair_distances has them, without names.

    columns: of overlap int, dist double, bucket long, and species string (scope intra).  digits: those that dist is rounded to.
    Not only valid pairs (valid_only=False): all that overlap by min_overlap, which may be 0; by k2p those that have known bases in common.
    """
    keys = {"all": [], "intra": ["species"], "inter_congeneric": ["genus"]}[scope]
    inter, least = scope == "inter_congeneric", max(min_overlap, 1) if valid_only else min_overlap
    names = [c.split()[0] for c in columns.split(", ")]
    dealt, words = tiles.dealt(df.where("ord is not null"), ["species_epithet"] if inter else [], keys, min_overlap)
    found = Found(method, names, least, valid_only, words, digits, {"dist", "bucket"} <= set(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["block", "ord"], ignore_index=True)
        ord_, side, strip = rows["ord"].to_numpy(), Side(rows["seq"].tolist(), words, method), found.strip(words)
        epithet = pd.factorize(rows["species_epithet"])[0] if inter else None
        low, n = int((rows["block"] == rows["lo"]).sum()), len(rows)
        itself = bool(low and rows["lo"].iloc[0] == rows["hi"].iloc[0])
        for (first, last), (begin, end) in [((0, low), (0, low))] if itself else [((0, low), (low, n)), ((low, n), (0, low))]:
            starts = begin + np.searchsorted(ord_[begin:end], ord_[first:last], side="right")
            k = first
            while k < last and (start := int(starts[k - first])) < end:
                own = range(k, min(last, k + max(1, tiles.STRIP // (end - start))))
                k = own.stop
                counts = strip.counted(side, own, side, start, end)
                keep = np.arange(start, end)[None, :] >= starts[own.start - first : own.stop - first, None]
                if inter:
                    x, y = epithet[own.start : own.stop, None], epithet[None, start:end]
                    keep &= (x != y) & (x >= 0) & (y >= 0)
                row, partner, out = found.of(counts, keep)
                if len(row):
                    made = {"a": ord_[own.start + row], "b": ord_[start + partner]} | out
                    if "species" in names:
                        made["species"] = _constant(rows["species"].iloc[0], len(row))
                    yield pd.DataFrame({c: made[c] for c in ("a", "b", *names)})

    return dealt.groupBy("lo", "hi", *keys).applyInPandas(run, f"a long, b long, {columns}")


def query_pairs(queries: DataFrame, reference: DataFrame, columns: str = "overlap int, dist double, bucket long, mismatches int", min_overlap: int = 300, method: str = "uncorrected") -> DataFrame:
    """(q, m and columns) of the valid pairs of each query and the reference sequences of other ords, as pairs.query_distances has them, without names."""
    names = [c.split()[0] for c in columns.split(", ")]
    dealt, words = tiles.dealt_sides(queries, reference, min_overlap)
    found = Found(method, names, max(min_overlap, 1), True, words, None, {"dist", "bucket"} <= set(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        x, y = (rows[rows["asked"] == asked].sort_values("ord", ignore_index=True) for asked in (True, False))
        a, b, end, strip = x["ord"].to_numpy(), y["ord"].to_numpy(), len(y), found.strip(words)
        if not len(a) or not end:
            return
        one, two = (Side(s["seq"].tolist(), words, method) for s in (x, y))
        step = max(1, tiles.STRIP // end)
        for k in range(0, len(a), step):
            own = range(k, min(len(a), k + step))
            row, partner, out = found.of(strip.counted(one, own, two, 0, end), a[own.start : own.stop, None] != b[None, :])
            if len(row):
                made = {"q": a[own.start + row], "m": b[partner]} | out
                yield pd.DataFrame({c: made[c] for c in ("q", "m", *names)})

    return dealt.groupBy("tq", "tm").applyInPandas(run, f"q long, m long, {columns}")
