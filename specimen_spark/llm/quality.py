"""Quality classifier: supervised subword embeddings.

Every word stands for the mean of the learned vectors of its hashed self and its hashed character
n-grams, every pair of neighbouring words for a vector of its own (one shared vector where a word
repeats the word before it).  A document is the mean of all these, and a softmax layer tells its
class.  Vectors and layer are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows; scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, crc_mod, table, tidy, unzipped, zipped
from .features import MIX_A, MIX_B, mix, ngram_hashes, text_bytes, word_hashes

BUCKETS = 1 << 17
#: The feature of a text without any other.
EMPTY = BUCKETS
#: The model is fitted on at most so many labelled rows of each class.
SAMPLE_PER_CLASS = 3000
NGRAMS = range(3, 6)


def buckets(text: str) -> list[np.ndarray]:
    """Buckets of the words, of the pairs of neighbours and of the character n-grams of a text.

    A pair that repeats one word always has bucket 0.  An empty text has one bucket of its own.
    """
    if not text.strip():
        return [np.array([EMPTY], np.int32)]
    raw = text_bytes(text)
    words, most = word_hashes(raw), np.uint64(BUCKETS - 1)
    a, b = words[:-1], words[1:]
    pairs = np.where(a == b, np.uint64(0), np.uint64(1) + mix(a * MIX_A + b * MIX_B) % most)
    return [x.astype(np.int32) for x in (words % most + np.uint64(1), pairs, ngram_hashes(raw, NGRAMS) % most + np.uint64(1)) if len(x)]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights: words, pairs and n-grams count a third each."""
    parts = buckets(text)
    at, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    weights = np.bincount(inverse, np.concatenate([np.full(len(x), 1 / len(x)) for x in parts]))
    return at.astype(np.int32), (weights / len(parts)).astype(np.float32)


def kept(features: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, bytes]:
    """Features of a text, compressed: a sample of them is held by one task."""
    return zipped(np.diff(features[0], prepend=np.int32(0))), zipped(features[1])


def read(features: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unzipped(features[0], np.int32)), unzipped(features[1], np.float32)


def train_embeddings(rows: list[tuple[bytes, bytes]], labels: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 0.3, seed: int = 7):
    """Bucket scores (log-odds each bucket adds to a mean) and bias, from SGD on vectors and softmax.

    rows: features as `kept` gives them.

    A step on a document is scaled by the squared length of its weights, so that it moves the
    document's mean as far for a long text as for a short one.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((BUCKETS + 1, dim)) * 0.02).astype(np.float32)
    layer, bias = (rng.standard_normal((dim, 2)) * 0.3).astype(np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            at, weight = read(rows[i])
            if not len(at):
                continue
            hidden = weight @ vectors[at]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= min(0.5 / share[labels[i]], 4.0) * step
            back = layer @ p
            layer -= np.outer(hidden, p).clip(-0.1, 0.1)
            bias -= 0.05 * p
            vectors[at] -= np.outer(weight / float(weight @ weight), back).astype(np.float32)
        layer *= min(1.0, 4.0 / float(np.abs(layer).max()))
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Trains on at most `per_class` labelled rows of each class, the first by a hash of doc_id.

    Null labels and ids take no part.  Without rows of both classes every score is 0.5.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    by_hash = lambda y: one.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = by_hash(0).unionByName(by_hash(1))  # a bounded number of rows, small enough to broadcast
    texts = docs.select("doc_id", body().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_y")

    @tidy
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [kept(document_features(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["_y"], "at": [m[0] for m in made], "weight": [m[1] for m in made]})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "at", "weight"]).drop_duplicates("doc_id")
        scores, bias = train_embeddings(list(zip(rows["at"], rows["weight"], strict=True)), rows["y"].to_numpy(np.int64))
        return pd.DataFrame({"scores": [scores.tobytes()], "bias": [bias]})

    ready = texts.mapInPandas(features, "doc_id long, y int, at binary, weight binary")
    model = ready.groupBy().applyInPandas(learn, "scores binary, bias double").first()
    if model is None or not np.isfinite(np.frombuffer(model["scores"], np.float32)).all():
        return np.zeros(BUCKETS + 1, np.float32), 0.0
    return np.frombuffer(model["scores"], np.float32), model["bias"]


def scorer(model: tuple[np.ndarray, float]):
    """A function from texts to scores."""
    scores, bias = model

    def scored(texts: pd.Series) -> np.ndarray:
        z = np.array([np.mean([scores[x].mean(dtype=np.float64) for x in buckets(t)]) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z + bias, -700, 700)))

    return scored


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text; a text without words
    is scored by its marks alone, and empty ones (of white space alone too) share a learnt score.

    Other columns are ignored, null texts count as empty, repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scored = scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scored(batch["text"])})

    return docs.select("doc_id", body().alias("text")).mapInPandas(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose quality score is `least` or more, in all their columns.

    Rows are scored in place, so nothing is shuffled; a score column of docs stays as it is.
    """
    model = fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scored = scorer(shared.value)
        for texts in batches:
            yield pd.Series(scored(texts))

    return docs.where(good(body()) >= least)
