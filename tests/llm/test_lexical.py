"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from specimen_spark.llm import lexical
from specimen_spark.llm.common import table
from test_llm import EDGE, LONG, SCHEMA, SF

ITEMS = "item_id long, text string"


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top=20):
    own = [(doc, Counter(terms_of(text))) for doc, text in docs]
    own = [(doc, c, sum(c.values())) for doc, c in own if c]
    count, length = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms_of(text)), []
        for doc, c, n in own:
            m = 75 + 25 * n * count // length
            score = sum(k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("block", "scout"), [(7, 0), (64, 5), (4096, 1000)])
def test_tables(spark, block, scout, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SCOUT", scout)
    read = lambda name, *c: [tuple(r) for r in table(spark, SF, name).select(*c).collect()]
    assert got(lexical.op13_lexical_search(spark, SF)) == brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


@pytest.mark.parametrize("seed", range(3))
def test_common_words_ties_and_groups_of_items(spark, seed, monkeypatch):
    """One word that every document has, many equal scores, terms that repeat, items in several groups."""
    monkeypatch.setattr(lexical, "BLOCK", 16)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 200)
    rng = np.random.default_rng(seed)
    word = lambda: f"W{min(int(rng.zipf(1.3)), 400)}"
    docs = [(int(rng.integers(0, 500)), " ".join(["the", *(word() for _ in range(int(rng.integers(0, 30))))])) for _ in range(200)] + [(900 + i, "The same Rare words") for i in range(60)]
    items = [(int(rng.integers(0, 8)), " ".join(word() for _ in range(int(rng.integers(0, 8))))) for _ in range(12)] + [(50, "the THE the"), (51, "rare rare same"), (52, "nowhere"), (53, None), (None, "w1 w2")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    # of documents with equal ids and scores either row may be named: they are the same result
    assert got(lexical.ranked(df, it)) == want and len(want) > 100
    assert got(lexical.ranked(df, it, 3)) == brute(docs, items, 3)


def test_edges(spark):
    items = spark.createDataFrame([(1, "cat mat", "x"), (1, "cat mat", "y"), (2, "LOREM ipsum ünï 漢字 \U0001f600", "z"), (3, "\x7f !?", None)], ITEMS + ", rank string")
    rows = EDGE + [(8, "CÖDÉ cödÉ", "xx", "c", 9, None, None), (9, LONG * 3 + " cat", "la", "a", 1, "rank", "9")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"kept": "item_id", "source": "rank"}).repartition(3)
    assert got(lexical.ranked(df, items)) == brute([(r[0], r[1]) for r in rows], [(r["item_id"], r["text"]) for r in items.collect()])
    empty = spark.createDataFrame([], SCHEMA)
    assert lexical.ranked(empty, items).count() == 0 and lexical.ranked(df, items.limit(0)).count() == 0
    assert [f.name for f in lexical.ranked(empty, items).schema] == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_are_limited_and_survivors_exact():
    """Common terms make no accumulators once they can't lift a document to the kth partial score."""
    made = lexical.Block.__new__(lexical.Block)
    made.sizes = np.full(1000, 10)
    rare, common = np.arange(5), np.arange(1000)
    made.slots, made.adds = np.concatenate([rare, common]), np.concatenate([np.full(5, 900), np.full(1000, 10)])
    made.most, made.span = np.array([900, 10]), np.array([[0, 5], [5, 1005]])
    acc = made.scores([(0, 1), (1, 1)], 0, 3)
    assert (acc[:5] == 910).all() and not acc[5:].any()
    assert (made.scores([(0, 1), (1, 1)], 0, 20) > 0).all()
    assert not made.scores([(1, 2)], 21, 3).any() and (made.scores([(1, 2)], 20, 3) == 20).all()
