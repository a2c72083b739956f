"""Removes repeated passages of words: every word of a 50-word window that an earlier document has too.

Fixed-block anchors.  Each document is an index of its non-overlapping blocks of 25 words, and is
probed with every rolling window of 25 words.  Where two documents share 50 words, these hold a whole
block of the one, which a rolling window of the other meets, wherever the passage stands in it.

1. Of documents whose words are all equal the later ones are repeats throughout and leave.
2. Blocks and rolling windows are dealt out by range of their hashes.  A hash lives on where a
   document's block meets a rolling window of another document.
3. Live windows are extended by up to 25 words to both sides, a word at a time: these are all the
   50-word windows that hold them.  Windows are compared by 128 bits, dealt out by range, and the
   smallest document that has one is found.  Repeats that touch make up the maximal repeats.

Texts are written once, compressed, as chunks of a table bucketed by chunk; each later pass reads a
chunk in place and joins it with one small row.  A chunk asks once for a window, however often it
holds it, so the rows of a range don't grow with the number of copies within chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, store, table, tidy, unzipped, zipped
from .features import MIX_A, MIX_B, mix, word_hashes
from .repeats import _double, _joined, _unzip_sorted, _zip_sorted, firsts, later_copies, part_of, sorted_of

WINDOW, BLOCK = 50, 25
#: Bytes of text that are one chunk, that are hashed at a time, and that make one range of hashes.
CHUNK, SLICE, PART = 8 << 20, 1 << 20, 32 << 20
#: Multipliers of the two independent hashes of a run of words.
LANES = ((MIX_A, MIX_B), (MIX_B ^ np.uint64(0x5851F42D4C957F2C), MIX_A ^ np.uint64(0x14057B7EF767814E)))


def rolling(words: np.ndarray, lane: int) -> np.ndarray:
    """A hash of the 25 words from each position on, by doubling: of 2, 4, 8, 16 words, and of two runs of 16 that are 9 apart."""
    a, b = (x | np.uint64(1) for x in LANES[lane])
    for offset in (1, 2, 4, 8, BLOCK - 16):
        if len(words) <= offset:
            return words[:0]
        words = _double(words, offset, a, b)
    return words


def chunked(docs: DataFrame) -> DataFrame:
    """The documents' words as chunks, bucketed by chunk: ids, numbers of words, digests by row, and the words joined by spaces."""
    schema = "chunk long, ids array<long>, known array<boolean>, sizes array<long>, words array<long>, digests array<binary>, text binary"
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary())
    names = [c.split()[0] for c in schema.split(", ")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            ids, words, texts = zip(*rows, strict=True)
            columns = [
                [number], [[x or 0 for x in ids]], [[x is not None for x in ids]], [[len(x) for x in texts]], [list(words)],
                [[hashlib.sha256(x).digest() for x in texts]], [zstandard.compress(b" ".join(texts), 3)],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = text.as_py().split()  # bytes are split at just the six separators
                joined = b" ".join(own)
                if rows and size + len(joined) > CHUNK:
                    yield chunk()
                    number, rows, size = number + 1, [], 0
                rows.append((doc, len(own), joined))
                size += len(joined)
        if rows:
            yield chunk()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return bucketed(rows.mapInArrow(run, schema), "substrings", "chunk")


class Chunk:
    """A row of `chunked`: its words' hashes and where documents begin among them."""

    def __init__(self, r):
        self.text = zstandard.decompress(r.text)
        self.ids, self.known = np.asarray(r.ids, np.int64), np.asarray(r.known, bool)
        self.words = np.asarray(r.words, np.int64)
        sizes = np.asarray(r.sizes, np.int64)
        self.begins = np.cumsum(sizes + 1) - sizes - 1  # bytes; documents are joined by a space
        self.ends = self.begins + sizes
        self.first = np.cumsum(self.words) - self.words
        self.copy = np.zeros(len(self.ids), bool)
        if r.copies is not None:
            self.copy[np.asarray(r.copies, np.int64)] = True
        self.copy &= self.words >= WINDOW
        self.row = np.repeat(np.arange(len(self.ids)), self.words)
        live = self.known & ~self.copy & (self.words >= WINDOW)
        #: Words left in the document from each word on; none in documents that can't have or make a repeat.
        self.left = np.where(live[self.row], (self.first + self.words)[self.row] - np.arange(len(self.row)), 0)
        parts, at, space = [], 0, np.array([32], np.uint8)
        raw = np.frombuffer(self.text, np.uint8)
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(self.ends, self.begins[at] + SLICE, "right")))
            parts.append(word_hashes(np.concatenate([space, raw[self.begins[at] : self.ends[to - 1]], space])))
            at = to
        self.hashes = _joined(parts, np.uint64)

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the rolling windows of 25 words start, and their hashes (48 bits)."""
        every = rolling(self.hashes, 0)
        at = np.flatnonzero(self.left[: len(every)] >= BLOCK)
        return at, mix(every[at]) >> np.uint64(16)

    def ranks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes in order, whether one is of a block of the index, and whether several documents have it."""
        at, rank = self.probes()
        row = self.row[at]
        block = (at - self.first[row]) % BLOCK == 0
        order = np.argsort(rank, kind="stable")  # rows stay in order
        rank, row, block = rank[order], row[order], block[order]
        new = np.ones(len(rank), bool)
        new[1:] = rank[1:] != rank[:-1]
        starts = np.flatnonzero(new)
        if not len(starts):
            return rank, block, block
        return rank[starts], np.logical_or.reduceat(block, starts), row[starts] != row[np.append(starts[1:], len(row)) - 1]

    def extended(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The 50-word windows that hold a live window of 25: where they start, the order by their two hashes and
        document, where equal ones start in that order, and the hashes (128 bits)."""
        at, rank = self.probes()
        hit = at[np.isin(rank, live)]
        lowest = np.maximum(hit - (WINDOW - BLOCK), self.first[self.row[hit]])
        highest = np.minimum(hit, hit + self.left[hit] - WINDOW)
        change = np.zeros(len(self.row) + 1, np.int64)
        np.add.at(change, lowest, 1)
        np.add.at(change, highest + 1, -1)
        starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        lanes = []
        for lane in (0, 1):
            every = rolling(self.hashes, lane)
            lanes.append(_double(every, BLOCK, *(x | np.uint64(1) for x in LANES[lane]))[starts] if len(starts) else np.zeros(0, np.uint64))
        order, edge, _ = firsts(lanes, self.ids[self.row[starts]])
        return starts, order, edge, lanes[0], lanes[1]


def live_windows(rows: DataFrame, parts: int) -> DataFrame:
    """(chunk, live): hashes of 25 words of a chunk that are a block of one document and a window of another."""

    @tidy
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rank, block, several = Chunk(r).ranks()
                bounds = np.searchsorted(part_of(rank, parts), np.arange(parts + 1))
                full = np.flatnonzero(np.diff(bounds))
                kind = block + 2 * several
                out = {"part": full, "chunk": np.full(len(full), r.chunk)}
                for k in range(4):
                    out[f"k{k}"] = [_zip_sorted(rank[a:b][kind[a:b] == k]) for a, b in zip(bounds[full], bounds[full + 1], strict=True)]
                yield pd.DataFrame(out)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        own = [[_unzip_sorted(x) for x in rows[f"k{k}"]] for k in range(4)]
        rank = np.concatenate([x for k in own for x in k])
        kind = np.repeat(np.arange(4, dtype=np.uint8), [sum(map(len, k)) for k in own])
        order = np.argsort(rank)
        rank, kind = rank[order], kind[order]
        new = np.ones(len(rank), bool)
        new[1:] = rank[1:] != rank[:-1]
        starts = np.flatnonzero(new)
        met = np.bitwise_or.reduceat(kind, starts)
        live = rank[starts][((np.diff(np.append(starts, len(rank))) > 1) | (met >= 2)) & (met & 1 > 0)]
        mine = [_joined([k[i][np.isin(k[i], live)] for k in own], np.uint64) for i in range(len(rows))]
        return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "live": [_zip_sorted(np.sort(x)) if len(x) else None for x in mine]}).dropna()

    asked = rows.mapInPandas(emit, "part long, chunk long, k0 binary, k1 binary, k2 binary, k3 binary")
    return asked.groupBy("part").applyInPandas(settle, "chunk long, live binary").groupBy("chunk").agg(F.collect_list("live").alias("live"))


def repeated_windows(rows: DataFrame, parts: int) -> DataFrame:
    """(chunk, met): which of the chunk's distinct 50-word windows a smaller document of another chunk has."""

    @tidy
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                chunk = Chunk(r)
                starts, order, edge, a, b = chunk.extended(sorted_of(r.live))
                head = order[edge]  # of equal windows that of the smallest document, by rising hash
                doc = chunk.ids[chunk.row[starts[head]]]
                bounds = np.searchsorted(part_of(a[head] >> np.uint64(16), parts), np.arange(parts + 1))
                full = [(p, slice(bounds[p], bounds[p + 1])) for p in np.flatnonzero(np.diff(bounds))]
                out = [(int(p), r.chunk, s.start, _zip_sorted(a[head[s]]), zipped(b[head[s]]), zipped(doc[s])) for p, s in full]
                yield pd.DataFrame(out, columns=["part", "chunk", "start", "a", "b", "doc"])

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        own = [_unzip_sorted(x) for x in rows["a"]]
        b, doc = (np.concatenate([unzipped(x, kind) for x in rows[c]]) for c, kind in (("b", np.uint64), ("doc", np.int64)))
        order, _, least = firsts([np.concatenate(own), b], doc)
        again = np.zeros(len(b), bool)
        again[order] = doc[order] > least
        cuts = np.cumsum([0, *map(len, own)])
        met = [np.flatnonzero(again[lo:hi]) + start for lo, hi, start in zip(cuts, cuts[1:], rows["start"], strict=False)]
        return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "met": [_zip_sorted(x.astype(np.uint64)) if len(x) else None for x in met]}).dropna()

    asked = rows.where("live is not null").mapInPandas(emit, "part long, chunk long, start long, a binary, b binary, doc binary")
    return asked.groupBy("part").applyInPandas(settle, "chunk long, met binary").groupBy("chunk").agg(F.collect_list("met").alias("met"))


def strip_substrings(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if `texts`, kept_text of every row.

    Words are runs of anything but spaces, tabs and line ends, unchanged.  A window of 50 words counts
    as repeated when its words also start in a document with a smaller doc_id; the input decides, not
    what is left.  Kept words are joined by one space.  Null and empty texts have no words; texts
    under 50 words stay whole, long ones are read whole; rows with a null doc_id come before and
    after no other and stay whole.  Rows that repeat a doc_id are documents of their own, none before
    the other.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    chunks = chunked(docs)
    size = chunks.agg(F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.lit(0))).first()[0]
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    copies = store(later_copies(chunks, F.col("r.words") >= WINDOW, "words"), "copies")
    rows = chunks.join(copies, "chunk", "left")
    rows = rows.join(store(live_windows(rows, parts), "live"), "chunk", "left")
    rows = rows.join(store(repeated_windows(rows, parts), "met"), "chunk", "left")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                chunk = Chunk(r)
                gone = chunk.copy[chunk.row]
                if r.live is not None:
                    starts, order, edge, _, _ = chunk.extended(sorted_of(r.live))
                    doc, group = chunk.ids[chunk.row[starts[order]]], np.cumsum(edge) - 1
                    again = doc > doc[edge][group]
                    if r.met is not None:
                        again |= np.isin(group, sorted_of(r.met).astype(np.int64))
                    change = np.zeros(len(chunk.row) + 1, np.int64)
                    np.add.at(change, starts[order[again]], 1)
                    np.add.at(change, starts[order[again]] + WINDOW, -1)
                    gone |= np.cumsum(change[:-1]) > 0
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = sums[chunk.first + chunk.words] - sums[chunk.first]
                kept, shas = [], []
                for a, b, first, n, k, sha in zip(chunk.begins, chunk.ends, chunk.first, chunk.words, removed, r.digests, strict=True):
                    own = chunk.text[a:b] if not k else b" ".join(compress(chunk.text[a:b].split(b" "), ~gone[first : first + n]))
                    kept.append(own.decode("utf-8", "replace") if texts else None)
                    shas.append(hashlib.sha256(own).hexdigest() if k else bytes(sha).hex())
                made = pd.DataFrame({"doc_id": pd.arrays.IntegerArray(chunk.ids, ~chunk.known), "n_words": chunk.words, "n_removed": removed, "kept_sha256": shas})
                yield made.assign(kept_text=kept) if texts else made

    return rows.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else ""))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_substrings(table(spark, sf_dir, "documents"), texts=False)
