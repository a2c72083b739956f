"""Ranked lexical search: accumulator-limited, term at a time.

Documents are tokenised once into blocks that hold the postings of the items' terms.  Within a block
an item's terms are taken rarest first.  Each posting adds to the accumulator of its document; new
accumulators are made only while the terms that remain could lift a document without one to the kth
partial score.  After that the remaining terms only update the accumulators there are, exactly.

The kth partial score is the block's own or a global one, whichever is higher.  The global one comes
from a first pass over the rarest terms of each item: a partial score never exceeds the final one, so
what cannot reach it is in no result.  Blocks therefore pass on few rows, whatever their number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import body, store, table, tidy, unzipped, zipped

TOP = 20
#: Documents of a block at most; accumulators of an item are one array of that length.
BLOCK = 4096
#: Bytes of item text whose terms are sent to every task at a time; more items are taken in several groups.
ITEM_BYTES = 16 << 20
#: The first pass takes an item's rarest terms up to so many postings in all.  It has no effect on results.
SCOUT = 1000
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
BLOCKS = "block long, ids array<long>, known array<boolean>, sizes array<long>, terms binary, slots binary, counts binary"


def terms_of(text: str) -> Counter:
    """How often each term occurs; only A-Z are lower-cased."""
    out: Counter = Counter()
    for term, n in Counter(TERM.findall(text)).items():
        out[term.translate(FOLD)] += n
    return out


def blocks_of(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """Blocks of the documents with a term: doc_id, number of terms, and postings (term, slot, count) by term.

    Each task makes its own blocks, so texts aren't shuffled.
    """

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, slots = TaskContext.get().partitionId() << 32, []

        def block() -> pd.DataFrame:
            ids, sizes, found = zip(*slots, strict=True)
            term = np.array([t for f in found for t in f], np.int32)
            slot = np.repeat(np.arange(len(slots), dtype=np.int32), [len(f) for f in found])
            count = np.array([n for f in found for n in f.values()], np.int64)
            order = np.argsort(term, kind="stable")
            known = [x is not None for x in ids]
            row = (number, [x or 0 for x in ids], known, list(sizes), zipped(term[order]), zipped(slot[order]), zipped(count[order]))
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                every = terms_of(text)
                if not every:
                    continue
                slots.append((None if pd.isna(doc) else int(doc), every.total(), {terms[t]: n for t, n in every.items() if t in terms}))
                if len(slots) == BLOCK:
                    yield block()
                    number, slots = number + 1, []
        if slots:
            yield block()

    # ids as text: pandas would turn a column of longs with nulls into floats
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), body().alias("text")).mapInPandas(run, BLOCKS)


def term_stats(blocks: DataFrame) -> DataFrame:
    """term and df, the number of documents that hold it."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["terms"]:
                term, n = np.unique(unzipped(raw, np.int32), return_counts=True)
                yield pd.DataFrame({"term": term, "n": n})

    return blocks.select("terms").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Block:
    """A block's postings, with what each adds to a score for one occurrence of its term in an item."""

    def __init__(self, r, documents: int, length: int, weights: np.ndarray):
        self.slots, counts = unzipped(r.slots, np.int32), unzipped(r.counts, np.int64)
        term = unzipped(r.terms, np.int32)
        self.sizes = np.asarray(r.sizes, np.int64)
        m = 75 + 25 * self.sizes * documents // length
        self.adds = weights[term] * (1_000_000_000 * counts // (1000 * counts + 12 * m[self.slots]))
        heads, at = np.unique(term, return_index=True)
        self.most = np.zeros(len(weights), np.int64)
        self.span = np.zeros((len(weights), 2), np.int64)
        if len(heads):
            self.most[heads] = np.maximum.reduceat(self.adds, at)
            self.span[heads, 0], self.span[heads, 1] = at, np.append(at[1:], len(term))

    def scores(self, terms: list[tuple[int, int]], least: int, top: int) -> np.ndarray:
        """Scores by slot of all documents that may be among the best; others may have a lower one or 0.

        terms: (term, occurrences in the item), rarest first.  least: a score that `top` documents are known to reach.
        """
        acc = np.zeros(len(self.sizes), np.int64)
        remaining = int(sum(self.most[t] * n for t, n in terms))
        growing = True
        for t, n in terms:
            # with nothing left to gain on the kth partial score, documents without an accumulator are out
            if growing and remaining < least:
                growing = False
            a, b = self.span[t]
            if a == b:
                continue
            slot, add = self.slots[a:b], self.adds[a:b] * n
            if not growing:
                old = acc[slot] > 0
                slot, add = slot[old], add[old]
            acc[slot] += add
            remaining -= int(self.most[t]) * n
            if growing and remaining and len(acc) > top:
                least = max(least, int(np.partition(acc, len(acc) - top)[len(acc) - top]))
        return acc


def group_results(docs: DataFrame, items: list[tuple[int, dict[str, int]]], top: int) -> DataFrame:
    """item (its number), doc_id and score of the best documents of each of a bounded list of items."""
    terms: dict[str, int] = {}
    for _, own in items:
        for t in own:
            terms.setdefault(t, len(terms))
    blocks = store(blocks_of(docs, terms), "blocks")
    documents, length = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.lit(0))).first()
    # one row per term of the items, which ITEM_BYTES bounds
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1)))
    weights, held = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for t, df, w in term_stats(blocks).select("term", "df", weight.cast("long")).collect():
        weights[t], held[t] = w, df
    ordered = [(number, sorted(((terms[t], n) for t, n in own.items()), key=lambda x: (held[x[0]], x[0]))) for number, own in items]

    def searched(scout: bool, least: dict[int, int]):
        """Per block and item the best documents, or only the best partial scores by the rarest terms."""

        @tidy
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    block = Block(r, documents, length, weights)
                    known, ids = np.asarray(r.known, bool), np.asarray(r.ids, np.int64)
                    out = []
                    for number, own in ordered:
                        if scout:
                            reach = np.cumsum([held[t] for t, _ in own])
                            own = own[: max(1, int(np.searchsorted(reach, SCOUT, "right")))]
                        low = least.get(number, 0)
                        acc = block.scores(own, low, top)
                        slot = np.flatnonzero(acc >= max(low, 1))
                        if len(slot) > top:
                            slot = slot[np.lexsort((ids[slot], ~known[slot], -acc[slot]))[:top]]
                        out.append(pd.DataFrame({"item": number, "doc_id": pd.arrays.IntegerArray(ids[slot], ~known[slot]), "score": acc[slot]}))
                    yield pd.concat(out) if out else pd.DataFrame({"item": [], "doc_id": [], "score": []})

        found = blocks.mapInPandas(run, "item long, doc_id long, score long")
        best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # one row per item
    least = {r["item"]: r["score"] for r in searched(True, {}).where(F.col("rank") == top).select("item", "score").collect()}
    return searched(False, least)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` documents of each row of `items` (item_id, text).

    The score of a document sums, over the item's terms with their repeats, the term's weight times
    what its occurrences count for in a document of that length.  Only scores above 0 count; equal
    scores rank by ascending doc_id, null last.  Null and empty texts have no term: such documents
    are not counted and such items have no result.  Long texts are read whole.  Rows that repeat a
    doc_id or an item_id are documents and items of their own.  Other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    size = items.agg(F.coalesce(F.sum(F.octet_length(body())), F.lit(0))).first()[0]
    groups = -(-size // ITEM_BYTES) or 1
    items = store(items.select("item_id", body().alias("text"), F.monotonically_increasing_id().alias("item")), "items")
    # The work is that of all items on all documents; each turn of the loop has a bounded group of items.
    found = []
    for g in range(groups):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        rows = [(r["item"], dict(terms_of(r["text"]))) for r in own.select("item", "text").toLocalIterator()]
        if rows:
            found.append(group_results(docs, rows, top))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS words FROM documents),
docs AS (SELECT k, doc_id, words, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM docs),
q AS (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS words FROM benchmark),
asked AS (SELECT item, item_id, t, count(*)::BIGINT AS qtf FROM (SELECT item, item_id, unnest(words) AS t FROM q) GROUP BY ALL),
post AS (SELECT k, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, n, unnest(words) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, total GROUP BY t, nn),
s AS (
  SELECT item, item_id, k, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score
  FROM asked JOIN post USING (t) JOIN w USING (t), total GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
