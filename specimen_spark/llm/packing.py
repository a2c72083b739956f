"""Packing along a space-filling curve.

Each document's tokens are hashed into a vector and projected to three dimensions; the point's
Hilbert key puts documents with similar tokens next to each other.  Documents are range-sorted by
that key, and neighbours fill sequences of 1024 tokens one after the other.  Whole blocks of 1024
tokens of a document become sequences of their own, so only the rest of a document (under 1024
ids) is shuffled with it.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, fresh_path, table

LENGTH = 1024
BITS = 10
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: Outside these characters, engines may disagree on what a letter or a space is.
_PLAIN = re.compile("[\t\n -~\u00a1-\u024f\u2013\u2014\u2018-\u201e\u20ac]*")
_LETTER, _DIGIT = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The vocabulary's pattern for plain characters; words are tried first, which changes no match.
_PIECES = re.compile(rf" ?[{_LETTER}]+| ?[{_DIGIT}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")


class Encoder(dict):
    """Ids of texts as little-endian unsigned 16-bit bytes, with no special tokens added, then id 0.

    added: whether the tokenizer's added tokens ("<|endoftext|>") keep their own ids where a text
    holds them, as is the tokenizer's default; else they are cut like any text.

    The ids are those of `tokenizers`.  A byte-level BPE merges within the pieces that its pattern
    cuts, so for plain characters the ids of a piece are worked out once, by the same vocabulary's
    rank file, and kept.  Texts with other characters go through the tokenizer as a whole.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str, most: int = 300_000, added: bool = False):
        super().__init__()
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.ranks, self.most = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), most
        self.path, self.tokenizer, self.added = path, None, None
        if added:
            with open(path, encoding="utf-8") as file:
                contents = [re.escape(t["content"]) for t in json.load(file)["added_tokens"]]
            self.added = re.compile("|".join(contents)) if contents else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        made = self[piece] = array("H", self.ranks.encode_ordinary(piece)).tobytes()
        return made

    def whole(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            if self.added is None:
                self.tokenizer.encode_special_tokens = True
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or self.added is not None and self.added.search(text):
            return self.whole(text) + b"\0\0"
        return b"".join(map(self.__getitem__, _PIECES.findall(text))) + b"\0\0"


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of rows of integer coordinates below 2**bits."""
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & (q - 1)
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray], dims: int = 3, seed: int = 3) -> np.ndarray:
    """Hilbert keys of documents: mean of fixed random token vectors, scaled to fill the cube."""
    directions = np.random.default_rng(seed).standard_normal((1 << 16, dims)).astype(np.float32)
    means = np.array([directions[x].mean(axis=0) for x in ids]).reshape(-1, dims)
    squeezed = 1 / (1 + np.exp(-8.0 * means))
    return hilbert_key(np.minimum((squeezed * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def ids_crc32(raw: bytes) -> int:
    """CRC-32 of ids given as 16-bit bytes, written as little-endian unsigned 32-bit integers."""
    return crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes())


def encoded(docs: DataFrame, folder: str | None = None, added: bool = False) -> DataFrame:
    """doc_id, doc_tokens, Hilbert key, CRCs of whole blocks of 1024 ids, and the remaining ids.

    folder: where the tokenizer's files lie; those installed with public_tokenizers by default.
    added: see Encoder.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        at = public_tokenizers.path if folder is None else lambda name: f"{folder}/{name}"
        encode = Encoder(at(TOKENIZER), at(RANKS), public_tokenizers.PATTERN, added=added)
        for whole_batch in batches:
            for at_row in range(0, len(whole_batch), 500):
                batch = whole_batch.iloc[at_row : at_row + 500]
                raw = [encode(t) for t in batch["text"]]
                whole = [len(r) // (2 * LENGTH) for r in raw]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].to_numpy(), "doc_tokens": [len(r) // 2 for r in raw], "curve": curve_keys([np.frombuffer(r, "<u2") for r in raw]),
                    "blocks": [[ids_crc32(r[2 * LENGTH * i : 2 * LENGTH * (i + 1)]) for i in range(n)] for r, n in zip(raw, whole, strict=True)],
                    "rest": [r[2 * LENGTH * n :] for r, n in zip(raw, whole, strict=True)],
                })

    return docs.select("doc_id", body().alias("text")).mapInPandas(run, "doc_id long, doc_tokens long, curve long, blocks array<long>, rest binary")


def binary_parts(n: int) -> list[int]:
    """Powers of two that sum to n, falling."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Fills sequences in the order in which documents come; `rows` are finished pieces."""

    def __init__(self, first: int):
        self.sequence, self.open, self.room, self.rows = first, [], LENGTH, []

    def emit(self, doc, start, raw, total, offset) -> None:
        self.rows.append((doc, start, len(raw) // 2, ids_crc32(raw), total, self.sequence, offset))

    def flush(self, sizes: list[int]) -> None:
        """Deals the open pieces out to sequences of these sizes."""
        sizes, used = iter(sizes), 0
        size = next(sizes, 0)
        for doc, start, raw, total in self.open:
            while raw:
                take = min(len(raw) // 2, size - used)
                self.emit(doc, start, raw[: 2 * take], total, used)
                raw, start, used = raw[2 * take :], start + take, used + take
                if used == size:
                    self.sequence, used, size = self.sequence + 1, 0, next(sizes, 0)
        self.open, self.room = [], LENGTH

    def add(self, doc, total: int, blocks: list[int], rest: bytes) -> None:
        for i, crc in enumerate(blocks):
            # a whole block takes a number before the open sequence's, which moves on
            self.rows.append((doc, i * LENGTH, LENGTH, int(crc), total, self.sequence, 0))
            self.sequence += 1
        start = len(blocks) * LENGTH
        while rest:
            take = min(len(rest) // 2, self.room)
            self.open.append((doc, start, rest[: 2 * take], total))
            rest, start, self.room = rest[2 * take :], start + take, self.room - take
            if not self.room:
                self.flush([LENGTH])

    def close(self) -> None:
        """What is left over becomes sequences of powers of two, which need no padding."""
        self.flush(binary_parts(LENGTH - self.room))


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, folder: str | None = None, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold 1024 ids; the last ones of each range of the curve hold a power of two.  A null
    or empty text is the id 0 alone.  Rows with equal doc_id are packed each; a null doc_id stays
    null.  No documents give no pieces.  Ids are computed once and kept, with the curve's keys, in
    the shared folder, as sorting by range reads its input twice.  added: see Encoder.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "packing")
    encoded(docs, folder, added).write.option("compression", "zstd").parquet(path)
    kept = spark.read.parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, total, blocks, rest in zip(batch["doc_id"].astype("Int64"), batch["doc_tokens"], batch["blocks"], batch["rest"], strict=True):
                packer.add(None if doc is pd.NA else doc, total, list(blocks), rest)
            if packer.rows:
                yield _frame(packer)
        packer.close()
        if packer.rows:
            yield _frame(packer)

    def _frame(packer: Packer) -> pd.DataFrame:
        made, packer.rows = pd.DataFrame(packer.rows, columns=COLUMNS), []
        return made.astype({"doc_id": "Int64"})

    ordered = kept.repartitionByRange(F.col("curve"), F.col("doc_id"), F.col("doc_tokens")).sortWithinPartitions("curve", "doc_id", "doc_tokens")
    return ordered.mapInPandas(run, ", ".join(f"{c} long" for c in COLUMNS))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), added=True)
