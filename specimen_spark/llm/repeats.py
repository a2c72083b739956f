"""Removes repeated passages: every byte of a 50-byte string that an earlier document has too.

Prefix doubling over sparse positions.  Ranking every byte position would shuffle the corpus many
times over, so only positions that each 50-byte string picks by its own content are ranked: the
place of the smallest hash among its 35 runs of 16 bytes.  Equal strings pick equal runs, and
about one position in eighteen is picked.  Ranks grow with the prefix, and what is unique leaves:

1. Whole texts: of byte-equal documents all but the first are repeats throughout and leave.
2. 16 bytes: Spark deals the ranks of picked positions out by range; those of one document leave.
3. 33 bytes: every string that picked a position holds the 17 bytes before or behind the run as well,
   so a position whose ranks of both are of one document leaves.
4. up to 84 bytes: the survivors' surroundings, which hold all 50-byte strings that picked them.
   Of equal surroundings all but the first document's are repeats, together.
5. 50 bytes: where a rank still has several surroundings, their 50-byte strings are ranked by
   pairs of ranks at growing offsets (8, 16, 32, 50) and each string's first document is found.

Texts are written once, compressed, as chunks of a table bucketed by chunk; each later pass reads
a chunk in place and joins it with one small row, so texts are never shuffled.  What a chunk can
settle by itself never leaves it, and what it learns comes back as merged ranges, so the number
of rows does not depend on how often a passage occurs.  A rank of very many documents is dealt out
string by string, by the string's own hash.  Surroundings and strings are compared by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_table, store, table, tidy, unzipped, zipped
from .features import MIX_A, MIX_B, mix

LEAST, SEED = 50, 16
#: Strings that share a picked run lie within so many bytes around it.
AROUND = 2 * LEAST - SEED
#: A string of 50 bytes holds so many bytes before a run of 16 in it, or so many behind it.
BESIDE = (LEAST - SEED) // 2
#: A rank of more documents than this is dealt out string by string.
HOT = 1000
#: Bytes of text that are one chunk, that numpy works on at a time, and that make one part of the ranks.
CHUNK, SLICE, PART = 8 << 20, 1 << 18, 8 << 20
SIX = np.uint64(63)


def _zip_sorted(a: np.ndarray) -> bytes:
    """Rising 64-bit numbers: their differences, byte by byte, so that equal high bytes lie together."""
    return zstandard.compress(np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unzip_sorted(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    counts = np.asarray(counts, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)])[: len(counts)], counts) + np.arange(counts.sum())


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    out = np.empty(max(len(raw) - 7, 0), np.uint64)
    for o in range(min(8, len(out))):
        n = (len(raw) - o) // 8
        out[o::8] = raw[o : o + 8 * n].view("<u8")
    return out


def _double(x: np.ndarray, offset: int, a: np.uint64, b: np.uint64) -> np.ndarray:
    """A rank of longer runs from the ranks of two shorter ones, `offset` apart."""
    y = x[: len(x) - offset] * a
    y ^= y >> np.uint64(29)
    y += x[offset:]
    y *= b
    y ^= y >> np.uint64(32)
    return y


def picked(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other: per picked position its rank (48 bits), the first and
    the last string that picks it, and itself; strings are numbered by where they start.

    Of equal runs within a string either may be picked: their rank is one, and strings are compared
    as a whole.
    """
    n = len(raw) - LEAST + 1
    if n < 1:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    key = _double(eights(raw), 8, MIX_A, MIX_B)
    key ^= key >> np.uint64(29)
    key *= MIX_A
    key &= ~SIX
    key |= np.arange(len(key), dtype=np.uint64) & SIX
    width, reach = LEAST - SEED + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        key = np.minimum(key[:-step], key[step:])
        reach += step
    inside = np.ones(n, bool)  # strings that don't reach over the end of a text
    cut = ends[:-1]
    inside[_spread(np.maximum(cut - LEAST + 1, 0), np.minimum(cut, n) - np.maximum(cut - LEAST + 1, 0))] = False
    w = np.flatnonzero(inside)
    if not len(w):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    key = key[w]
    at = w + (((key & SIX).astype(np.int64) - w) & 63)
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    begin, end = np.concatenate([[0], change]), np.concatenate([change, [len(w)]]) - 1
    return mix(key[begin] >> np.uint64(6)) >> np.uint64(16), w[begin], w[end], at[begin]


def _lanes(x: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of the 50 bytes from each position, of which x has 8 at a time."""
    out = []
    for a, b in ((MIX_A, MIX_B), (MIX_B ^ np.uint64(0x5851F42D4C957F2C), MIX_A ^ np.uint64(0x14057B7EF767814E))):
        y = x
        for offset in (8, 16, LEAST - 32):
            y = _double(y, offset, a | np.uint64(1), b | np.uint64(1))
        out.append(y)
    return out


def windows(around: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row and place of every 50-byte string of the surroundings (one row each), and its two hashes."""
    wide = around.shape[1]
    lanes = _lanes(eights(np.concatenate([around.ravel(), np.zeros(LEAST, np.uint8)])))
    places = wide - LEAST + 1
    row, col = np.nonzero(np.arange(places)[None, :] <= (length - LEAST)[:, None])
    return row, col, [x[row * wide + col] for x in lanes]


def around_hashes(around: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Two hashes of surroundings; bytes beyond their length are 0."""
    words, out = np.ascontiguousarray(around).view("<u8"), []
    for a in (MIX_A, MIX_B):
        h = length.astype(np.uint64) * a
        for j in range(words.shape[1]):
            h = mix(h * a + words[:, j])
        out.append(h)
    return out


def gather(raw: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of surroundings, one row each, filled up with 0."""
    wide = -(-AROUND // 8) * 8
    at = begin[:, None] + np.arange(wide)
    out = raw[np.minimum(at, len(raw) - 1)]
    out[np.arange(wide)[None, :] >= length[:, None]] = 0
    return out


def firsts(lanes: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hashes and doc, where each group of equal hashes starts in it, and by row of that
    order the smallest doc of its group."""
    order = np.lexsort((doc, lanes[1], lanes[0]))
    a, b = lanes[0][order], lanes[1][order]
    edge = np.ones(len(order), bool)
    edge[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, edge, doc[order][edge][np.cumsum(edge) - 1]


def merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of strings by document; those that cover neighbouring bytes become one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    if not len(doc):
        return doc, first, last
    # documents lie one after the other, so the furthest end so far is of the same document or before it
    reach = np.maximum.accumulate(last)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1] + LEAST)])
    at = np.flatnonzero(new)
    return doc[at], first[at], reach[np.append(at[1:], len(doc)) - 1]


def _ranges(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    d, a, b = merged(doc, first, last)
    return zipped(np.concatenate([d, a, b]).astype(np.int64))


def chunked(docs: DataFrame) -> DataFrame:
    """The texts as a table of chunks, bucketed by chunk: ids, sizes and digests by row, and the bytes.

    Each task writes its own chunks, so nothing is shuffled; a chunk has some MB of whole texts.
    """
    spark = docs.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_table("repeats")
    schema = "chunk long, ids array<long>, known array<boolean>, sizes array<long>, digests array<binary>, text binary"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            if not len(texts):
                continue
            _, bounds, data = texts.buffers()
            bounds = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data, at = memoryview(data if data is not None else b""), 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
                own = bounds[at : to + 1]
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(own[:-1], own[1:], strict=True)]
                ids = batch.column(0).slice(at, to - at)
                columns = [[number], [ids.fill_null(0).to_numpy()], [ids.is_valid().to_numpy(zero_copy_only=False)], [np.diff(own)], [digests], [zstandard.compress(data[own[0] : own[-1]], 3)]]
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "ids", "known", "sizes", "digests", "text"])
                number, at = number + 1, to

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(run, schema).write.format("parquet").bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def later_copies(chunks: DataFrame, counts: Column | None = None, *more: str) -> DataFrame:
    """(chunk, copies): the rows whose text a row with a smaller id has too, of those that count: by default of 50 bytes or more.

    more: further columns of the rows that `counts` looks at.
    """
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "known", "sizes", "digests", *more)).alias("at", "r"))
    rows = rows.where(F.col("r.known") & (F.col("r.sizes") >= LEAST if counts is None else counts)).select("chunk", "at", F.col("r.ids").alias("id"), F.col("r.digests").alias("sha"))
    first = store(rows.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first"), "copied")
    return rows.join(first.hint("merge"), "sha").where("id > first").groupBy("chunk").agg(F.collect_list("at").alias("copies"))


class Chunk:
    """The texts of one row of `chunked`, and their picked positions: rank, row, first and last string."""

    def __init__(self, r):
        self.raw = np.frombuffer(zstandard.decompress(r.text), np.uint8)
        self.ids, self.known, self.sizes = np.asarray(r.ids, np.int64), np.asarray(r.known, bool), np.asarray(r.sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.copy = np.zeros(len(self.sizes), bool)
        if r.copies is not None:
            self.copy[np.asarray(r.copies, np.int64)] = True
        self.live = self.known & ~self.copy & (self.sizes >= LEAST)

    def picks(self) -> tuple[np.ndarray, ...]:
        """Rank, row, first and last string and place of each picked position."""
        found, at = [], 0
        starts = self.ends - self.sizes
        while at < len(self.sizes):
            to = max(at + 1, int(np.searchsorted(self.ends, starts[at] + SLICE, "right")))
            if self.live[at:to].any():
                rank, first, last, place = picked(self.raw[starts[at] : self.ends[to - 1]], self.ends[at:to] - starts[at])
                row = at + np.searchsorted(self.ends[at:to] - starts[at], first, "right")
                keep = self.live[row]
                found.append((rank[keep], row[keep], *(x[keep] + starts[at] for x in (first, last, place))))
            at = to
        return tuple(_joined([f[i] for f in found], kind) for i, kind in enumerate((np.uint64, *[np.int64] * 4)))


def ranks_of(rank: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ranks and in how many rows each occurs."""
    order = np.argsort(rank, kind="stable")  # rows come in order
    rank, row = rank[order], row[order]
    new = np.ones(len(rank), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (row[1:] != row[:-1])
    return np.unique(rank[new], return_counts=True)


def part_of(rank: np.ndarray, parts: int) -> np.ndarray:
    """Ranks are dealt out by range, so that those of a part differ little and take few bytes."""
    return ((rank >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def sorted_of(blobs) -> np.ndarray:
    return np.sort(_joined([_unzip_sorted(b) for b in (blobs if blobs is not None else [])], np.uint64))


def shared_by(rank: np.ndarray, row: np.ndarray, elsewhere) -> np.ndarray:
    """Marks the ranks that several rows here have, or rows elsewhere too (`elsewhere`, as found by shared_ranks)."""
    distinct, n = ranks_of(rank, row)
    return ((n > 1) | np.isin(distinct, sorted_of(elsewhere)))[np.searchsorted(distinct, rank)]


def extensions(chunk: Chunk, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of picked positions: the ranks of the run with what lies before it, and with what lies behind it.

    Where no string of the position reaches so far, the rank is 0.
    """
    out = [np.zeros(len(place), np.uint64) for _ in range(2)]
    for lo in range(0, len(place), 50_000):
        s = slice(lo, lo + 50_000)
        around = gather(chunk.raw, np.maximum(place[s] - BESIDE, 0), np.full(len(place[s]), LEAST))
        wide = around.shape[1]
        x = _double(_double(_double(eights(np.concatenate([around.ravel(), np.zeros(LEAST, np.uint8)])), 8, MIX_A, MIX_B), 16, MIX_A, MIX_B), BESIDE + SEED - 32, MIX_A, MIX_B)
        at = np.arange(len(around)) * wide
        # a place too near the start of the chunk has no string that reaches before it
        shift = np.minimum(place[s], BESIDE)
        for side, (values, valid) in enumerate(((x[at], first[s] <= place[s] - BESIDE), (x[at + shift], last[s] >= place[s] - BESIDE))):
            out[side][s] = np.where(valid, (mix(values + np.uint64(side)) >> np.uint64(16)) | np.uint64(1), np.uint64(0))
    return out[0], out[1]


def candidates(r, chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Rank, row, first, last and place of the positions whose rank of 16 bytes several documents have."""
    rank, row, first, last, place = chunk.picks()
    k = shared_by(rank, row, r.shared)
    return rank[k], row[k], first[k], last[k], place[k]


def shared_ranks(rows: DataFrame, longer: bool, parts: int) -> DataFrame:
    """(chunk, shared, hot): ranks of one document here that others have too, and ranks of very many.

    The ranks are of 16 bytes, or of 33 for the positions whose ranks of 16 are shared.
    """

    def keys(r) -> tuple[np.ndarray, np.ndarray]:
        chunk = Chunk(r)
        if not longer:
            return chunk.picks()[:2]
        _, row, first, last, place = candidates(r, chunk)
        rank, row = np.concatenate(extensions(chunk, first, last, place)), np.concatenate([row, row])
        order = np.argsort(row, kind="stable")
        order = order[rank[order] > 0]
        return rank[order], row[order]

    @tidy
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rank, n = ranks_of(*keys(r))
                bounds = np.searchsorted(part_of(rank, parts), np.arange(parts + 1))
                full = np.flatnonzero(np.diff(bounds))
                cells = [(rank[a:b], n[a:b]) for a, b in zip(bounds[full], bounds[full + 1], strict=True)]
                yield pd.DataFrame({
                    "part": full, "chunk": r.chunk, "ones": [_zip_sorted(k[c == 1]) for k, c in cells], "many": [_zip_sorted(k[c > 1]) for k, c in cells],
                    "counts": [zipped(c[c > 1].astype(np.int32)) for k, c in cells],
                })

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        ones, many = [_unzip_sorted(x) for x in rows["ones"]], [_unzip_sorted(x) for x in rows["many"]]
        rank = np.concatenate(ones + many)
        n = np.concatenate([np.ones(sum(map(len, ones)), np.int64), *[unzipped(x, np.int32) for x in rows["counts"]]]).astype(np.int64)
        every, place = np.unique(rank, return_inverse=True)
        total = np.bincount(place, n, len(every))[place]
        out, at_one, at_many = [], 0, sum(map(len, ones))
        for chunk, a, b in zip(rows["chunk"], ones, many, strict=True):
            mine, ours = total[at_one : at_one + len(a)], total[at_many : at_many + len(b)]
            at_one, at_many = at_one + len(a), at_many + len(b)
            hot = np.sort(np.concatenate([a[mine > HOT], b[ours > HOT]]))
            out.append((chunk, _zip_sorted(a[mine > 1]), _zip_sorted(hot)))
        return pd.DataFrame(out, columns=["chunk", "shared", "hot"])

    found = rows.mapInPandas(emit, "part long, chunk long, ones binary, many binary, counts binary").groupBy("part").applyInPandas(settle, "chunk long, shared binary, hot binary")
    return found.groupBy("chunk").agg(F.collect_list("shared").alias("shared"), F.collect_list("hot").alias("hot"))


#: What a chunk asks a part; doc holds ids, place rows of the chunk, `places` how many rows and places
#: an asked string or surroundings has.  Ranges that are settled already come along in `ranges`.
ASKED = "part long, chunk long, hot boolean, lane_a binary, lane_b binary, doc binary, size binary, bytes binary, places binary, place binary, first binary, ranges binary"


def repeated_ranges(chunks: DataFrame, copies: DataFrame, parts: int) -> DataFrame:
    """(chunk, ranges): strings, by row and where they start, that a document with a smaller id has too."""
    rows = chunks.join(copies, "chunk", "left").select("chunk", "ids", "known", "sizes", "text", "copies")
    rows = rows.join(store(shared_ranks(rows, False, parts), "shared"), "chunk", "left")
    longer = store(shared_ranks(rows, True, parts).select("chunk", F.col("shared").alias("longer")), "longer")

    def ask(chunk, hot: bool, to: np.ndarray, lanes, ids, size, raw, counts, place, first) -> Iterator[pd.DataFrame]:
        """Rows for each part: heads (to, lanes, ids, size, raw) with `counts` places each."""
        starts = np.concatenate([[0], np.cumsum(counts)])[: len(counts)]
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(bounds)):
            h = order[bounds[p] : bounds[p + 1]]
            every = _spread(starts[h], counts[h])
            body = b"" if hot else zipped(raw[h][np.arange(raw.shape[1])[None, :] < size[h][:, None]])
            a, b = (zipped(x[h]) for x in lanes) if hot else (b"", b"")
            out.append((int(p), chunk, hot, a, b, zipped(ids[h]), b"" if hot else zipped(size[h].astype(np.uint8)), body, zipped(counts[h].astype(np.int32)), zipped(place[every].astype(np.int32)), zipped(first[every].astype(np.int64)), b""))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ASKED.split(", ")])

    @tidy
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                chunk = Chunk(r)
                rank, row, first, last, place = candidates(r, chunk)
                before, behind = extensions(chunk, first, last, place)
                both = np.concatenate([before, behind])
                order = np.argsort(np.tile(row, 2), kind="stable")
                some = np.zeros(len(both), bool)
                some[order] = shared_by(both[order], np.tile(row, 2)[order], r.longer)
                some &= both > 0
                k = some[: len(row)] | some[len(row) :]
                rank, row, first, last = rank[k], row[k], first[k], last[k]
                doc, length = chunk.ids[row], last - first + LEAST
                done: list[tuple] = []
                heads, lanes = [], []
                for lo in range(0, len(rank), 50_000):
                    s = slice(lo, lo + 50_000)
                    lanes.append(around_hashes(gather(chunk.raw, first[s], length[s]), length[s]))
                if lanes:
                    lanes = [np.concatenate(x) for x in zip(*lanes, strict=True)]
                    order, edge, least = firsts(lanes, doc)
                    again = doc[order] > least
                    w = order[again]
                    done.append((row[w], first[w], last[w]))
                    # what is left of equal surroundings lies in one document and asks once, for all its places
                    w = order[~again]
                    heads = np.flatnonzero(edge[~again])
                    counts = np.diff(np.append(heads, len(w)))
                    head = w[heads]
                    hot = np.isin(rank[head], sorted_of(r.hot))
                    cold = np.flatnonzero(~hot)
                    every = w[_spread(heads[cold], counts[cold])]
                    raw = gather(chunk.raw, first[head[cold]], length[head[cold]])
                    yield from ask(r.chunk, False, part_of(rank[head[cold]], parts), None, doc[head[cold]], length[head[cold]], raw, counts[cold], row[every], first[every])
                    # each string of a hot rank stands alone, dealt out by its own hash
                    warm = np.flatnonzero(hot)
                    found = []
                    for lo in range(0, len(warm), 20_000):
                        h = warm[lo : lo + 20_000]
                        x, place, both = windows(gather(chunk.raw, first[head[h]], length[head[h]]), length[head[h]])
                        found.append((h[x], place, *both))
                    if found:
                        own, place, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                        d = doc[head[own]]
                        order, edge, least = firsts([a, b], d)
                        gone = order[d[order] > least]
                        every = w[_spread(heads[own[gone]], counts[own[gone]])]
                        at = first[every] + np.repeat(place[gone], counts[own[gone]])
                        done.append((row[every], at, at))
                        left = order[d[order] == least]
                        starts = np.flatnonzero(edge[d[order] == least])
                        top = left[starts]
                        each = counts[own[left]]
                        every = w[_spread(heads[own[left]], each)]
                        n_places = np.add.reduceat(each, starts) if len(starts) else each
                        yield from ask(r.chunk, True, part_of(mix(a[top]) >> np.uint64(16), parts), (a[top], b[top]), d[top], None, None, n_places, row[every], first[every] + np.repeat(place[left], each))
                if done:
                    ranges = _ranges(*(np.concatenate(x) for x in zip(*done, strict=True)))
                    yield pd.DataFrame([(r.chunk % parts, r.chunk, False, *[b""] * 8, ranges)], columns=[c.split()[0] for c in ASKED.split(", ")])

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = [(np.full(len(x) // 3, c), *x.reshape(3, -1)) for c, b in zip(rows["chunk"], rows["ranges"], strict=True) if len(b) for x in [unzipped(b, np.int64)]]
        for hot in (False, True):
            asked = rows[(rows["hot"] == hot) & (rows["doc"].str.len() > 0)]
            if not len(asked):
                continue
            read = lambda c, kind: np.concatenate([unzipped(x, kind) for x in asked[c]])  # noqa: E731,B023
            doc, counts, place, first = read("doc", np.int64), read("places", np.int32).astype(np.int64), read("place", np.int32), read("first", np.int64)
            chunk = np.repeat(asked["chunk"].to_numpy(), [len(unzipped(x, np.int64)) for x in asked["doc"]])
            starts = np.concatenate([[0], np.cumsum(counts)])[: len(counts)]

            def answer(who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
                """Strings lo to hi of what `who` asked are repeats, at each of its places."""
                n = counts[who]  # noqa: B023
                every = _spread(starts[who], n)  # noqa: B023
                out.append((np.repeat(chunk[who], n), place[every], first[every] + np.repeat(lo, n), first[every] + np.repeat(hi, n)))  # noqa: B023

            if hot:
                order, _, least = firsts([read("lane_a", np.uint64), read("lane_b", np.uint64)], doc)
                who = order[doc[order] > least]
                answer(who, np.zeros(len(who), np.int64), np.zeros(len(who), np.int64))
                continue
            size, raw = read("size", np.uint8).astype(np.int64), read("bytes", np.uint8)
            offset = np.concatenate([[0], np.cumsum(size)])[: len(size)]
            lanes = [around_hashes(gather(raw, offset[s], size[s]), size[s]) for lo in range(0, len(size), 50_000) for s in [slice(lo, lo + 50_000)]]
            order, _, least = firsts([np.concatenate(x) for x in zip(*lanes, strict=True)], doc)
            again = doc[order] > least
            who = order[again]
            answer(who, np.zeros(len(who), np.int64), size[who] - LEAST)
            rest = order[~again]
            # strings are compared a range of hashes at a time, to bound the memory
            found = []
            for lo in range(0, len(rest), 20_000):
                w = rest[lo : lo + 20_000]
                row, col, both = windows(gather(raw, offset[w], size[w]), size[w])
                found.append((w[row].astype(np.int32), col.astype(np.uint8), *both))
            if not found:
                continue
            own, col, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            # a string alone by its first hash has no company
            twice = np.sort(a)
            twice = np.unique(twice[1:][twice[1:] == twice[:-1]])
            k = np.flatnonzero(np.isin(a, twice))
            own, col, a, b = own[k].astype(np.int64), col[k].astype(np.int64), a[k], b[k]
            order, _, least = firsts([a, b], doc[own])
            k = order[doc[own[order]] > least]
            k = k[np.lexsort((col[k], own[k]))]
            if len(k):
                new = np.concatenate([[True], (own[k][1:] != own[k][:-1]) | (col[k][1:] != col[k][:-1] + 1)])
                begins = np.flatnonzero(new)
                answer(own[k[begins]], col[k[begins]], col[k[np.append(begins[1:], len(k)) - 1]])
        if not any(len(x[0]) for x in out):
            return pd.DataFrame({"chunk": np.zeros(0, np.int64), "ranges": []})
        c, d, a, b = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
        order = np.argsort(c, kind="stable")
        names, starts = np.unique(c[order], return_index=True)
        cuts = np.split(order, starts[1:])
        return pd.DataFrame({"chunk": names, "ranges": [_ranges(d[k], a[k], b[k]) for k in cuts]})

    rows = rows.join(longer, "chunk", "left")
    found = rows.mapInPandas(emit, ASKED).groupBy("part").applyInPandas(settle, "chunk long, ranges binary")
    return found.groupBy("chunk").agg(F.collect_list("ranges").alias("ranges"))


def removed_mask(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Marks the bytes that the strings starting from first to last cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.minimum(first, n), 1)
    np.add.at(change, np.minimum(last + LEAST, n), -1)
    return np.cumsum(change[:-1]) > 0


def strip_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if `texts`, kept_text of every row.

    A string counts as repeated when it also starts in a document with a smaller doc_id; the input
    decides, not what is left.  kept_text is binary, as a cut may split a character.  Null texts
    count as empty; texts under 50 bytes stay whole; rows with a null doc_id come before and after
    no other and stay whole.  Rows that repeat a doc_id are documents of their own, none before the
    other.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    chunks = chunked(docs)
    size = chunks.agg(F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.lit(0))).first()[0]
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    copies = store(later_copies(chunks), "copies")
    ranges = store(repeated_ranges(chunks, copies, parts), "ranges")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                chunk = Chunk(r)
                gone = np.zeros(len(chunk.raw), bool)
                if r.ranges is not None:
                    found = np.concatenate([unzipped(x, np.int64).reshape(3, -1) for x in r.ranges], axis=1)
                    gone = removed_mask(len(gone), found[1], found[2])
                starts = chunk.ends - chunk.sizes
                for i in np.flatnonzero(chunk.copy):
                    gone[starts[i] : chunk.ends[i]] = True
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[starts[chunk.sizes > 0]] = gone[starts[chunk.sizes > 0]]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins)]
                removed, spans = (s[chunk.ends] - s[starts] for s in sums)
                kept, shas = [], []
                for a, b, n, sha in zip(starts, chunk.ends, removed, r.digests, strict=True):
                    own = chunk.raw[a:b] if not n else chunk.raw[a:b][~gone[a:b]]
                    kept.append(own.tobytes() if texts else None)
                    shas.append(hashlib.sha256(own).hexdigest() if n else bytes(sha).hex())
                made = pd.DataFrame({"doc_id": pd.arrays.IntegerArray(chunk.ids, ~chunk.known), "n_bytes": chunk.sizes, "n_removed": removed, "n_spans": spans, "kept_sha256": shas})
                yield made.assign(kept_text=kept) if texts else made

    rows = chunks.join(copies, "chunk", "left").join(ranges, "chunk", "left").select("chunk", "ids", "known", "sizes", "digests", "text", "copies", "ranges")
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text binary" if texts else ""))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(table(spark, sf_dir, "documents"), texts=False)
