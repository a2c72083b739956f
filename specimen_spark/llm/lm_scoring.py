"""Language-model scores: masked pseudo-likelihood of a bidirectional window network.

The network sees the classes of the words left and right of a masked position and predicts the
class of the word there: two embeddings are added, pass a tanh layer, and a softmax gives the
probabilities.  Classes are the most frequent words of the corpus and, for the others, buckets of
their shape and ending.  What the network can see of a corpus is the table of (left, right, word)
counts, so Spark counts it over every document and the network is trained on the counts in numpy,
by full gradients.  Within its class, a word has the probability that its count over the whole
corpus gives it: the vocabulary is counted in full, kept as a table and joined by word.  A document's
score is the sum of log P(class | left, right) + log P(word | class) over its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, store, table

FREQUENT, CLASSES = 400, 512
#: The last class stands for the ends of a text.
END = CLASSES - 1
NEAR_FREQUENT, CONTEXTS = 40, 64
#: Added to every count within a class; words never seen have this alone.
ADDED = 0.5
#: So many of the most frequent words, of at least this share of all, reach every task; the others
#: are joined. Both give the same. Tasks send their own top words, so the share bounds what is sent.
COMMON, COMMON_SHARE = 100_000, 1e-6
#: What cuts words: the same characters as for str.split().
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def word_class(word: str) -> int:
    """The bucket of a word that isn't frequent: by its shape and its last two characters."""
    shape = f"{word.isupper():d}{word[:1].isupper():d}{word.isalpha():d}{any(c.isdigit() for c in word):d}{min(len(word), 12) // 4}"
    return FREQUENT + crc32(f"{shape}{word[-2:].lower()}".encode("utf-8", "replace")) % (END - FREQUENT)


def context_classes() -> np.ndarray:
    """The class of a neighbour: the most frequent words keep theirs, the others share the rest."""
    out = NEAR_FREQUENT + np.arange(CLASSES) % (CONTEXTS - 1 - NEAR_FREQUENT)
    out[:NEAR_FREQUENT] = np.arange(NEAR_FREQUENT)
    out[END] = CONTEXTS - 1
    return out


class Words(dict):
    """word -> class; emptied when it has grown large."""

    def __init__(self, frequent: list[str], most: int = 500_000):
        super().__init__()
        self.first, self.most = {w: i for i, w in enumerate(frequent)}, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        made = self[word] = self.first[word] if word in self.first else word_class(word)
        return made


def cells(text: str, words: Words, near: np.ndarray) -> np.ndarray:
    """For each word, the number of its cell (left context, right context, class)."""
    return _cells(text.split(), words, near)


def _cells(tokens: list[str], words: Words, near: np.ndarray) -> np.ndarray:
    own = np.array([END, *map(words.__getitem__, tokens), END])
    around = near[own]
    return (around[:-2] * CONTEXTS + around[2:]) * CLASSES + own[1:-1]


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n) of every word of every document."""
    words = docs.select(F.explode(F.split(body(), SPACE)).alias("w")).where("w <> ''")
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counted: DataFrame, most: int) -> list:
    """The rows of the most frequent words, ties in order of the words."""
    return counted.orderBy(F.desc("n"), "w").limit(most).collect()


def frequent_words(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """The most frequent words over all documents, ties in order of the words."""
    return [r["w"] for r in most_frequent(word_counts(docs), most)]


class Vocabulary(NamedTuple):
    """P(word | class) = exp(log(n + ADDED) + base[class]), n being 0 for a word never seen.

    counted: (w, n) of all words.  common: log(n + ADDED) of the most frequent ones.  A class of one
    frequent word has a base and a log of 0.
    """

    counted: DataFrame
    common: dict[str, float]
    base: np.ndarray


def vocabulary(counted: DataFrame, frequent: list[str], most: int = COMMON) -> Vocabulary:
    """The vocabulary of stored word counts; its classes' sizes are summed over all words.

    Only classes and at most `most` words reach the driver.  In each class one place is kept for
    words never seen.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skip, total = set(frequent), np.zeros((CLASSES, 2), np.int64)
        for batch in batches:
            own = np.array([0 if w in skip else word_class(w) for w in batch["w"]], np.int64)
            np.add.at(total, own, np.stack([batch["n"].to_numpy(), np.ones(len(own), np.int64)], 1))
        yield pd.DataFrame({"class": np.arange(FREQUENT, CLASSES), "n": total[FREQUENT:, 0], "words": total[FREQUENT:, 1]})

    base = np.zeros(CLASSES)
    base[FREQUENT:] = -np.log(ADDED)
    for r in counted.mapInPandas(run, "class int, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        base[r["class"]] = -np.log(r["n"] + ADDED * (r["words"] + 1))
    least = COMMON_SHARE * (counted.agg(F.sum("n")).first()[0] or 0)
    common = {r["w"]: float(np.log(r["n"] + ADDED)) for r in most_frequent(counted.where(F.col("n") >= least), most)}
    return Vocabulary(counted, common | dict.fromkeys(frequent, 0.0), base)


def count_cells(docs: DataFrame, frequent: list[str]) -> DataFrame:
    """(cell, n) over every word of every document, counted within partitions before the shuffle."""
    near = context_classes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = Words(frequent), np.zeros(CONTEXTS * CONTEXTS * CLASSES, np.int64)
        for batch in batches:
            for text in batch["text"]:
                at, n = np.unique(cells(text, words, near), return_counts=True)
                total[at] += n
        found = np.flatnonzero(total)
        yield pd.DataFrame({"cell": found, "n": total[found]})

    parts = docs.select(body().alias("text")).mapInPandas(run, "cell long, n long")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"))


def train_window(counts: np.ndarray, width: int = 24, steps: int = 60, rate: float = 0.05, seed: int = 5) -> np.ndarray:
    """Log-probabilities [left and right context, class] of the network trained on the counts.

    counts has the same shape.  Adam on the mean cross-entropy; contexts that never occur cost
    nothing and get what their embeddings give.
    """
    rng = np.random.default_rng(seed)
    sides = counts.sum(axis=1)
    total = max(float(sides.sum()), 1.0)
    share = (counts.sum(axis=0) + 0.5) / (total + 0.5 * CLASSES)
    p = {
        "left": rng.normal(0, 0.3, (CONTEXTS, width)), "right": rng.normal(0, 0.3, (CONTEXTS, width)),
        "out": rng.normal(0, 0.1, (width, CLASSES)), "bias": np.log(share),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    l_of, r_of = np.divmod(np.arange(CONTEXTS * CONTEXTS), CONTEXTS)
    target = (counts / total).astype(np.float32)
    weight = (sides / total).astype(np.float32)[:, None]

    def forward() -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(p["left"][l_of] + p["right"][r_of])
        z = hidden @ p["out"] + p["bias"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return hidden, z

    for t in range(1, steps + 1 if sides.any() else 1):
        hidden, z = forward()
        back = np.exp(z) * weight - target
        inner = (back @ p["out"].T) * (1 - hidden**2)
        grid = inner.reshape(CONTEXTS, CONTEXTS, width)
        grad = {"left": grid.sum(axis=1), "right": grid.sum(axis=0), "out": hidden.T @ back, "bias": back.sum(axis=0)}
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.99 * v[k] + 0.01 * grad[k] ** 2
            p[k] -= rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return forward()[1]


def fit(docs: DataFrame, counted: DataFrame | None = None) -> tuple[list[str], np.ndarray]:
    """Frequent words and log-probabilities by cell, from counts over all documents.

    counted: the documents' word counts, where they are already stored.

    What reaches the driver is bounded by the network's shape: 400 words and one number for each
    cell, however large the corpus.
    """
    frequent = frequent_words(docs) if counted is None else [r["w"] for r in most_frequent(counted, FREQUENT)]
    counts = np.zeros(CONTEXTS * CONTEXTS * CLASSES, np.float64)
    found = count_cells(docs, frequent).select(F.col("cell").cast("int").alias("cell"), "n").toArrow()
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    del found
    return frequent, train_window(counts.reshape(-1, CLASSES)).reshape(-1).astype(np.float32)


def score(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum) and mean_log_likelihood of every row's classes.

    Null and empty texts have no tokens, a sum of 0 and a null mean.  Rows that repeat are scored
    each; other columns are ignored.
    """
    shared, near = docs.sparkSession.sparkContext.broadcast(model), context_classes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, table_ = shared.value
        words = Words(frequent)
        for batch in batches:
            found = [table_[cells(t, words, near)] for t in batch["text"]]
            n, total = np.array([len(x) for x in found]), np.array([x.sum(dtype=np.float64) for x in found])
            mean = pd.Series(np.where(n > 0, total / np.maximum(n, 1), np.nan)).round(6)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": n, "log_likelihood": total.round(4), "mean_log_likelihood": mean.astype(object).where(n > 0, None)})

    return docs.select("doc_id", body().alias("text")).mapInPandas(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def score_words(docs: DataFrame, model: tuple[list[str], np.ndarray], words: Vocabulary) -> DataFrame:
    """As score(), for the words themselves: log P(word | class) is added for every word.

    A task adds up the network's part and the common words; its other words are joined with the
    counts of the whole vocabulary.  These logs are summed as whole numbers, in any order.
    """
    shared, near = docs.sparkSession.sparkContext.broadcast((model, words.common, words.base)), context_classes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (frequent, table_), common, base = shared.value
        classes, row = Words(frequent), TaskContext.get().partitionId() << 33
        for whole_batch in batches:
            for at_row in range(0, len(whole_batch), 500):
                batch = whole_batch.iloc[at_row : at_row + 500]
                n, total, rest = [], [], []
                for text in batch["text"]:
                    own = text.split()
                    at = _cells(own, classes, near)
                    logs = np.array(list(map(common.get, own)), np.float64)
                    other = np.isnan(logs)
                    n.append(len(own))
                    total.append(table_[at].sum(dtype=np.float64) + base[at % CLASSES].sum() + logs[~other].sum())
                    rest.append([own[i] for i in np.flatnonzero(other)])
                yield pd.DataFrame({"row": np.arange(row, row + len(batch)), "doc_id": batch["doc_id"].to_numpy(), "n_tokens": n, "total": total, "rest": rest})
                row += len(batch)

    placed = store(docs.select("doc_id", body().alias("text")).mapInPandas(run, "row long, doc_id long, n_tokens long, total double, rest array<string>"), "placed")
    log = F.round(F.log(F.coalesce("n", F.lit(0)) + ADDED) * 1e9).cast("long")
    rest = placed.select("row", F.explode("rest").alias("w")).join(words.counted, "w", "left").groupBy("row").agg(F.sum(log).alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0)) / 1e9
    mean = F.when(F.col("n_tokens") > 0, F.round(total / F.col("n_tokens"), 6))
    return placed.drop("rest").join(rest, "row", "left").select("doc_id", "n_tokens", F.round(total, 4).alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = store(word_counts(docs), "words")
    model = fit(docs, counted)
    return score_words(docs, model, vocabulary(counted, model[0]))
