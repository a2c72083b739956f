"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples carry a label; every other text counts as unlabelled, toxic ones
among them.  The share of toxic rows (the class prior) corrects the risk: what unlabelled text
costs as non-toxic, less what the prior's share of toxic text would cost, must not fall below
zero; where it does, the step goes the other way.  The classifier is linear over hashed words and
character n-grams, each of which a text can hold, and hold densely; it is trained in numpy by
mini-batches.  Which features have a weight at all is decided by counts over every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, crc_mod, table, tidy, unzipped, zipped
from .features import ngram_hashes, text_bytes, word_hashes

BUCKETS = 1 << 19
#: The model is fitted on at most so many confirmed toxic rows, and on at most so many unlabelled.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 2000, 6000
NGRAMS = range(4, 7)
#: A text holds a feature densely from so many occurrences in 1000 bytes on (a shorter text counts as 1000).
DENSE = 2
SEGMENTS = 64


def held(text: str) -> np.ndarray:
    """Sorted distinct buckets of the words and character n-grams of a text, case folded.

    The lower half of the buckets is for what the text holds, the upper for what it holds densely.
    """
    raw, half = text_bytes(text.lower()), np.uint64(BUCKETS // 2)
    at, n = np.unique(np.concatenate([word_hashes(raw) % half, ngram_hashes(raw, NGRAMS) % half]).astype(np.int32), return_counts=True)
    return np.concatenate([at, at[1000 * n >= DENSE * max(len(raw), 1000)] + BUCKETS // 2])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def screened(in_p: np.ndarray, positives: int, in_all: np.ndarray, everything: int, prior: float, least: float = 4.0, share: float = 0.35, most: int = 8192) -> np.ndarray:
    """Buckets that confirmed rows hold significantly more often than all documents do, and of whose
    holders, by the prior, at least `share` are toxic; the most significant ones, if there are more.
    """
    expected = (in_all + 1) * positives / max(everything, 1)
    z = np.where(in_p > 2, (in_p - expected) / np.sqrt(expected + 1), 0)
    z = np.where(prior * in_p >= share * expected, z, 0)
    at = np.flatnonzero(z >= least)
    return np.sort(at[np.argsort(-z[at], kind="stable")[:most]])


def train_pu(rows: list[np.ndarray], positive: np.ndarray, prior: float, size: int, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-3, seed: int = 11) -> tuple[np.ndarray, float]:
    """`size` weights and a bias that minimise the non-negative risk with the logistic loss (Adam steps).

    rows: the numbers of the features that each row holds.
    """
    rng = np.random.default_rng(seed)
    sizes = np.array([len(r) for r in rows])
    weights, bias = np.zeros(size, np.float64), float(np.log(prior / (1 - prior)))
    m, v, mb, vb, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    p_rows, u_rows = np.flatnonzero(positive), np.flatnonzero(~positive)
    parts = max(1, -(-len(u_rows) // batch))
    for epoch in range(epochs if size else 0):
        order_p, order_u = np.array_split(rng.permutation(p_rows), parts), np.array_split(rng.permutation(u_rows), parts)
        for ps, us in zip(order_p, order_u, strict=True):
            if not len(ps):
                ps = rng.choice(p_rows, 1)
            picked = np.concatenate([ps, us])
            at = np.concatenate([rows[i] for i in picked])
            doc = np.repeat(np.arange(len(picked)), sizes[picked])
            s = _sigmoid(np.bincount(doc, weights[at], len(picked)) + bias)
            np_, nu = len(ps), max(len(us), 1)
            # gradients of the three risks by each document's logit
            as_positive = np.zeros(len(picked))
            as_positive[:np_] = prior * (s[:np_] - 1) / np_
            as_negative = np.concatenate([-prior * s[:np_] / np_, s[np_:] / nu])
            loss = -np.log(np.maximum(1 - s, 1e-12))
            risk = loss[np_:].sum() / nu - prior * loss[:np_].mean()
            by_doc = as_positive + as_negative if risk >= 0 else -as_negative
            grad = np.bincount(at, by_doc[doc], size) + decay * weights / BUCKETS**0.5
            t += 1
            step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            weights -= step * m / (np.sqrt(v) + 1e-6)
            gb = by_doc.sum()
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            bias -= step * mb / (np.sqrt(vb) + 1e-6)
    return weights.astype(np.float32), bias


def bucket_counts(docs: DataFrame, confirmed: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each bucket, how many confirmed rows and how many documents hold it, over all documents.

    Each task counts for itself, then segments of buckets are summed; the driver gets one number a bucket.
    """
    rows = docs.select("doc_id", body().alias("text")).join(F.broadcast(confirmed), "doc_id", "left").select("text", F.coalesce("_p", F.lit(False)).alias("p"))

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, number = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, p in zip(batch["text"], batch["p"], strict=True):
                at = held(text)
                total[:, at] += np.array([[p], [1]])
                number += (int(p), 1)
        made = total.reshape(2, SEGMENTS, -1)
        yield pd.DataFrame({"segment": range(SEGMENTS), "p": int(number[0]), "n": int(number[1]), "counts": [zipped(made[:, i]) for i in range(SEGMENTS)]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(unzipped(x, np.int64) for x in parts["counts"])
        return pd.DataFrame({"segment": [parts["segment"].iloc[0]], "p": [parts["p"].sum()], "n": [parts["n"].sum()], "counts": [zipped(total)]})

    schema = "segment int, p long, n long, counts binary"
    found = sorted(rows.mapInPandas(count, schema).groupBy("segment").applyInPandas(add, schema).collect())
    if not found:
        return np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0, 0
    both = np.concatenate([unzipped(r["counts"], np.int64).reshape(2, -1) for r in found], axis=1)
    return both[0], both[1], found[0]["p"], found[0]["n"]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights and the bias.

    Features are picked by counts over all documents; the weights are trained on confirmed rows of
    `labels` and on unlabelled documents, the first by a hash of doc_id.  `labels` may only hold rows
    that may be learnt from.  The class prior is the share of toxic rows among all of them, 0.001 at
    least and 0.999 at most.  Without a confirmed row every score is the prior, without labels 0.5.
    Null labels and ids take no part; of several labels of one document the largest counts.
    """
    none = np.zeros(0, np.int32), np.zeros(0, np.float32)
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    total, toxic = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not total:
        return *none, 0.0
    prior = min(max(toxic / total, 1e-3), 0.999)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    confirmed = one.where("_y = 1").orderBy(*by_hash).limit(positives).select("doc_id", F.lit(True).alias("_p"))
    in_p, in_all, p, n = bucket_counts(docs, confirmed)
    if not p:
        return *none, float(np.log(prior / (1 - prior)))
    chosen = screened(in_p, p, in_all, n, prior)
    others = docs.where("doc_id is not null").select("doc_id").orderBy(*by_hash).limit(unlabelled).select("doc_id", F.lit(False).alias("_p"))
    sample = confirmed.unionByName(others)  # a bounded number of rows, small enough to broadcast
    texts = docs.select("doc_id", body().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "_p", "text")

    @tidy
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # of the screened features alone, by their number
            yield pd.DataFrame({"doc_id": batch["doc_id"], "p": batch["_p"], "at": [np.flatnonzero(np.isin(chosen, held(t), assume_unique=True)).astype(np.int32).tobytes() for t in batch["text"]]})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["p", "doc_id", "at"]).drop_duplicates(["p", "doc_id"])
        weights, bias = train_pu([np.frombuffer(a, np.int32) for a in rows["at"]], rows["p"].to_numpy(bool), prior, len(chosen))
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    ready = texts.mapInPandas(features, "doc_id long, p boolean, at binary")
    model = ready.groupBy().applyInPandas(learn, "weights binary, bias double").first()
    return chosen.astype(np.int32), np.frombuffer(model["weights"], np.float32), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text.

    A text without any known feature gets the bias alone.  Null texts count as empty, other
    columns are ignored, repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen, weights, bias = shared.value
        dense = np.zeros(BUCKETS, np.float32)
        dense[chosen] = weights
        for batch in batches:
            z = np.array([dense[held(text)].sum(dtype=np.float64) for text in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": _sigmoid(z + bias)})

    return docs.select("doc_id", body().alias("text")).mapInPandas(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
