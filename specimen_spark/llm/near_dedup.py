"""Near duplicates: bags of word shingles, weighted min-hashes, bands, exact verification.

A document is the multiset of its runs of five words.  Its signature comes from Poisson processes
over discretised weights: each shingle has one process for each dyadic interval of weights (0-1,
1-2, 2-4, 4-8, ...), whose points carry a time, a register and, within the interval, a weight.  A
document sees the points below its own weight, and each register keeps the earliest time.  Two
registers agree with the probability of the weighted Jaccard similarity.  Points are drawn in
order of time and only until no register can change, so long documents cost about one draw per
shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, body, pick, store, table, tidy
from .components import components
from .features import MIX_A, MIX_B, mix, word_hashes

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
_SEPARATORS = np.array([not chr(i).isalnum() for i in range(128)] + [False] * 128)


def words_of(text: str) -> np.ndarray:
    """Hashes of the words of a text: case folded, ASCII punctuation cuts words."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    return word_hashes(np.where(_SEPARATORS[raw], np.uint8(32), raw))


def shingles(text: str, width: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of `width` words; of all words where there are fewer."""
    w = words_of(text)
    if not len(w):
        return w
    width = min(width, len(w))
    out = np.zeros(len(w) - width + 1, np.uint64)
    for j in range(width):
        out = mix(out * MIX_A + w[j : len(w) - width + 1 + j])
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs."""
    return np.unique(shingles(text), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of earliest times (fixed point) for each bag; an empty bag's times are all the latest.

    Times are whole numbers, so their sums don't depend on the order of computation.
    """
    never = np.int64(1) << np.int64(62)
    out = np.full((len(bags), registers), never, np.int64)
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    if not len(doc):
        return out
    shingle, weight = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(np.int64)
    # processes: (document, seed, lower end and width of the interval, the document's weight)
    parts, low, level = [], 0, 0
    live = np.arange(len(doc))
    while len(live):
        wide = max(low, 1)
        parts.append((doc[live], mix(shingle[live] + np.full(1, level, np.uint64) * MIX_B), np.full(len(live), low), np.full(len(live), wide), weight[live]))
        low, level = low + wide, level + 1
        live = live[weight[live] > low]
    doc, seed, low_end, width, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, drawn, flat = np.zeros(len(doc), np.int64), 0, out.reshape(-1)
    while len(doc):
        many = int(min(64, max(1, 100_000 // len(doc))))
        step = np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64)
        r = mix(seed[:, None] + step[None, :] * MIX_A)
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
        times = time[:, None] + np.cumsum(np.maximum((gap * 2.0**32).astype(np.int64) // width[:, None], 1), axis=1)
        r2 = mix(r ^ MIX_B)
        register = (r2 % np.uint64(registers)).astype(np.int64)
        at = low_end[:, None] + (r2 >> np.uint64(40)).astype(np.float64) / 2.0**24 * width[:, None]
        seen = at < weight[:, None]
        np.minimum.at(flat, (doc[:, None] * registers + register)[seen], times[seen])
        time, drawn = times[:, -1], drawn + many
        keep = time < out.max(axis=1)[doc]
        doc, seed, low_end, width, weight, time = (x[keep] for x in (doc, seed, low_end, width, weight, time))
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit key of the word sequence, the number of shingles, and a hash for each band.

    Texts without words have a key of their whole text, no shingles and no bands.
    """

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                bags, keys = [], []
                for text in part["text"]:
                    w = words_of(text)
                    raw = w if len(w) else mix(np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64))
                    place = np.arange(len(raw), dtype=np.uint64)
                    keys.append([np.uint64(mix(raw + place * c).sum(dtype=np.uint64)).astype(np.int64) for c in (MIX_A, MIX_B)])
                    bags.append(bag(text))
                times = signatures(bags).astype(np.uint64).reshape(len(bags), BANDS, ROWS)
                h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(bags), BANDS)).copy()
                for j in range(ROWS):
                    h = mix(h * MIX_A + times[:, :, j])
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "n": [int(b[1].sum()) for b in bags],
                    "bands": [x if len(b[0]) else x[:0] for x, b in zip(h.view(np.int64), bags, strict=True)],
                })

    return docs.select("doc_id", body().alias("text")).mapInPandas(run, "doc_id long, k1 long, k2 long, n long, bands array<long>")


#: Documents that are candidates of each other are compared in tiles of so many by so many.
TILE = 256
#: About so many pairs are compared in one group.
PAIRS = 1000


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) with the weighted Jaccard similarity of their documents' shingles.

    Documents with the same smallest candidate are dealt out in groups of TILE, and pairs by their
    two groups: a tile gets each of its texts once, however many pairs it is in, and no tile grows
    with its neighbourhood.  n documents that are all candidates of each other cost n / TILE copies
    of each text instead of n, and each text's shingles are hashed as often.
    """
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    label = store(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "label")
    sizes = label.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("groups"))
    place = store(label.join(sizes, "label").select("node", F.xxhash64("label", F.pmod(F.xxhash64("node"), "groups")).alias("g")), "place")
    side = lambda c: place.select(F.col("node").alias(c), F.col("g").alias(f"g{c}"))
    parts = pairs.count() // PAIRS + 1
    tiles = store(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.pmod(F.xxhash64("ga", "gb"), F.lit(parts)).alias("part")), "tiles")
    wanted = store(tiles.select("part", F.col("a").alias("doc_id")).unionByName(tiles.select("part", F.col("b").alias("doc_id"))).distinct(), "wanted")
    few = 32 * wanted.count() <= BROADCAST_BYTES
    texts = docs.select("doc_id", body().alias("text")).join(F.broadcast(wanted) if few else wanted, "doc_id")
    rows = texts.select("part", "doc_id", "text", F.lit(0).cast("long").alias("b"), F.lit(False).alias("pair")).unionByName(tiles.select("part", F.col("a").alias("doc_id"), F.lit("").alias("text"), "b", F.lit(True).alias("pair")))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        asked, held = rows[rows["pair"]], rows[~rows["pair"]]
        bags = {d: bag(t) for d, t in zip(held["doc_id"], held["text"], strict=True)}
        a, b = asked["doc_id"].to_numpy(), asked["b"].to_numpy()
        return pd.DataFrame({"a": a, "b": b, "similarity": [weighted_jaccard(bags[x], bags[y]) for x, y in zip(a, b, strict=True)]})

    return rows.groupBy("part").applyInPandas(compare, "a long, b long, similarity double")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and kept of every row: classes are what links of `threshold` or more connect.

    class_id is the smallest doc_id of the class; the row that has it is kept.  Rows with equal
    word sequences are one class from the start (their similarity is 1), so copies are never
    compared.  A text without words is only in a class with equal texts.  Null texts count as
    empty.  doc_id should be unique: rows that share one are in one class; a row with a null
    doc_id belongs to the class of its copies, or to none (null).

    Candidates: in each bucket of a band every document is compared with the bucket's hub, the one
    with most company over all its buckets, so a bucket of variants of one text costs one
    comparison per document.  Documents of a bucket that these links leave in different components
    are then joined on the rarest of their shingles (rare_pairs), which loses no link among them.
    Documents just under the threshold of each other are all compared, in tiles (see verified).
    A link is lost where its two documents share no bucket, (1 - s**5)**25 of pairs of similarity s
    (5e-5 at 0.8), unless other links or other company in their buckets join them.
    """
    all_rows = store(sketch(docs), "sketch")
    known = all_rows.where("doc_id is not null")
    reps = store(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "reps")
    members = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    sizes = store(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = store(members.join(sizes, "bucket"), "shared")
    company = store(shared.groupBy("rep").agg(F.sum("size").alias("company")), "company")
    hub = F.max(F.struct("company", F.negative("rep").alias("r"), "n"))
    hubs = store(shared.join(company, "rep").groupBy("bucket").agg(hub.alias("h")).select("bucket", F.negative("h.r").alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
    stars = shared.join(hubs, "bucket").where((F.col("rep") != F.col("hub")) & (F.least("n", "hub_n") >= F.lit(threshold) * F.greatest("n", "hub_n") - 1e-9))
    stars = store(stars.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct(), "stars")
    tested = store(verified(stars, docs), "tested")
    links = tested.where(F.col("similarity") >= threshold).select("a", "b")
    labels = components(links)

    # documents that share a bucket with another component
    placed = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = store(placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket"), "apart")
    left = store(placed.join(apart, "bucket", "left_semi").select("rep", "n", "component").distinct(), "left")
    rest = store(rare_pairs(left, docs, threshold).join(tested, ["a", "b"], "left_anti"), "rest")
    more = store(verified(rest, docs).where(F.col("similarity") >= threshold).select("a", "b"), "more")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    classes = store(reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("class_id")), "classes")
    return all_rows.join(classes, ["k1", "k2"], "left").select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def rare_pairs(rows: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of rows (rep, n, component) that can be similar, of different components.

    A shingle's k-th occurrence is a token, so multisets are sets of tokens.  Two sets can only be
    similar if they share one of the rarest tokens of each: among the shorter's n - o + 1 rarest,
    o being the overlap that the threshold asks of two such sets, and among the longer's.  What
    a token's place in both orders leaves room for prunes further.
    """
    texts = pick(docs.select(F.col("doc_id").alias("rep"), body().alias("text")), rows.select("rep"), "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part, made = batch.iloc[at : at + 200], []
                for text in part["text"]:
                    own, counts = bag(text)
                    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    made.append(mix(np.repeat(own, counts) + nth.astype(np.uint64) * MIX_B).view(np.int64))
                yield pd.DataFrame({"rep": np.repeat(part["rep"].to_numpy(), [len(m) for m in made]), "token": np.concatenate(made)})

    tokens = store(texts.mapInPandas(run, "rep long, token long"), "tokens")
    often = store(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    order = tokens.join(often, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    placed = order.join(rows, "rep").select("rep", "n", "component", "t", F.posexplode(F.slice("t", 1, F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("t"))).cast("int"))).alias("i", "x"))
    # tokens of one document alone come first in its order, and join nothing
    placed = store(placed.select("rep", "n", "component", F.col("x.token").alias("token"), (F.col("n") - F.size("t") + F.col("i")).alias("at")), "placed")
    ask = threshold / (1 + threshold)
    x, y = placed.where(F.col("at") <= F.col("n") - F.ceil(F.lit(2 * ask) * F.col("n") - 1e-9)).alias("x"), placed.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= F.ceil(F.lit(ask) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & smaller & (F.col("x.n") >= F.lit(threshold) * F.col("y.n") - 1e-9) & room
    return x.join(y, on).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def drop_near(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class of near duplicates, in all its columns; rows without an id stay."""
    gone = store(near_classes(docs, threshold).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = 16 * gone.count() <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
