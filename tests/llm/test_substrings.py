"""Repeated passages of words against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from specimen_spark.llm import substrings
from specimen_spark.llm.common import table

from test_llm import EDGE, LONG, SCHEMA, SF

SIZE = substrings.WINDOW


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """A row's (doc_id, n_words, n_removed, kept_sha256), in the order of rows (doc_id, text)."""
    first = {}
    for doc, text in rows:
        own = words_of(text)
        for i in range(len(own) - SIZE + 1):
            if doc is not None:
                key = tuple(own[i : i + SIZE])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        own = words_of(text)
        gone = [False] * len(own)
        for i in range(len(own) - SIZE + 1):
            if doc is not None and first[tuple(own[i : i + SIZE])] < doc:
                gone[i : i + SIZE] = [True] * SIZE
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out.append((doc, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:4] for r in substrings.strip_substrings(df).collect()), key=str)


@pytest.mark.parametrize("chunk", [3000, 16 << 20])
def test_tables(spark, chunk, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(x[2] for x in want) > 1000
    assert got(table(spark, SF, "documents")) == want
    assert sorted(map(tuple, substrings.op11_substrings(spark, SF).collect()), key=str) == want


@pytest.mark.parametrize("seed", range(3))
def test_passages_at_every_offset(spark, seed, monkeypatch):
    """Passages of 45 to 140 words at any place, in groups of copies, with small edits, in several blocks at once."""
    monkeypatch.setattr(substrings, "CHUNK", 6000)
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = [fresh(n) for n in (45, 49, 50, 51, 60, 74, 75, 99, 140)]
    rows = []
    for i in range(60):
        own = fresh(int(rng.integers(0, 60)))
        for _ in range(3):
            own += shared[rng.integers(len(shared))] + fresh(int(rng.integers(0, 5)))
        rows.append((int(rng.permutation(1000)[i]), rng.choice([" ", "\n", "\t \r"]).join(own)))
    base = fresh(400)
    for i in range(60):
        own = list(base)
        own[int(rng.integers(400))] = "changed"
        rows.append((2000 + i // 2, " ".join(own)))
    rows += [(3000, " ".join(["same"] * 200)), (3001, " ".join(["same"] * 120)), (2999, " ".join(["same"] * 49))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(r[0], r[1]) for r in EDGE] + [
        (10, passage), (10, passage), (11, passage), (None, passage), (None, passage), (12, f"\x0b{passage}\x00 tail\x1c x\xa0y"), (13, LONG), (14, LONG + passage), (15, "퟿\U0001f600 " * 60),
    ]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, n_words string, kept_sha256 string, chunk string").repartition(3)
    assert got(df) == brute(rows)
    whole = {r["doc_id"]: r for r in substrings.strip_substrings(df).collect() if r["doc_id"] is not None}
    assert whole[11]["kept_text"] == "" and whole[12]["kept_text"] == "p69\x00 tail\x1c x\xa0y"
    assert substrings.strip_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hash_of_many_copies_stays_small(spark):
    """A passage that every document has makes one question a window and chunk."""
    passage = " ".join(f"q{i}" for i in range(55))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(f" {passage} "), (F.col("id") * 7).cast("string")).alias("text"))
    removed = {r["doc_id"]: r["n_removed"] for r in substrings.strip_substrings(df).collect()}
    assert removed == {i: 55 * (i > 0) for i in range(3000)}
