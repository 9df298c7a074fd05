"""Operator 4: toxicity by a classifier chain.

Each category has a linear model over presence features (whole words and word beginnings, hashed). Category k's model
also gets the probabilities of the categories before it: out-of-fold ones in training, so that it learns from what the
earlier models say of texts they haven't seen, and the final models' in scoring. Features are chosen by a two-proportion
test inside each training fold, all that pass it. The threshold of the last category is set on its out-of-fold predictions.

Training uses at most MOST_LABELLED labelled documents, those with the smallest hash of their id: a fixed bound, so
the sample fits the driver at every input size. Scoring runs over every whole text in one pass without a shuffle.

Defined results: null texts and texts without words have no features, score as the intercept says and are never
rejected; very long texts are taken whole, a set of features each; null labels are ignored; of repeated labels of an id the
largest holds, of its texts the one with the smallest features, so training is the same in every run; repeated rows are scored
each, and equal texts alike; ties in the order of training go by id; without labels of both kinds a category's probability
is their constant share (0 without any) and nothing is rejected; empty tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory, table

MOST_LABELLED = 6_000
FOLDS = 4
LEAST_DOCS = 4
LEAST_Z = 4.0
RIDGE = 2.0
STOP = 1e-6
MOST_STEPS = 50
PRECISION = 0.98
LEAST_P = 0.3
BITS = 24
BEGINNINGS = (3, 4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    keys = ["=" + word] + ["^" + word[:k] for k in BEGINNINGS if len(word) > k]
    return [xxhash.xxh64_intdigest(k) >> (64 - BITS) for k in keys]


class Features(dict):
    """word -> ids of its features, only those `wanted` where that is given; bounded."""

    MOST = 150_000

    def __init__(self, wanted: set[int] | None = None) -> None:
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.MOST:
            self.clear()
        ids = features_of(word)
        f = self[word] = tuple(ids if self.wanted is None else [i for i in ids if i in self.wanted])
        return f

    def of(self, text: str | None) -> set[int]:
        words = set(WORDS.findall(text.lower())) if text else ()
        return set().union(*filter(None, map(self.__getitem__, words)))


@dataclass
class Linear:
    ids: np.ndarray  # sorted feature ids
    weights: np.ndarray  # of the ids, then of the earlier categories' probabilities
    bias: float

    def logits(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        z = np.full(len(rows), self.bias)
        k = len(self.ids)
        for i, r in enumerate(rows):
            if k:
                at = np.minimum(np.searchsorted(self.ids, r), k - 1)
                z[i] += self.weights[at[self.ids[at] == r]].sum()
        return z + earlier @ self.weights[k:]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def choose(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Ids whose share differs between the classes, by z-score; sorted."""
    every = np.concatenate(rows) if rows else np.empty(0, np.int64)
    hot = np.concatenate([r for r, t in zip(rows, y, strict=True) if t] or [np.empty(0, np.int64)])
    ids, n = np.unique(every, return_counts=True)
    ids, n = ids[n >= LEAST_DOCS], n[n >= LEAST_DOCS]
    hot_ids, hot_n = np.unique(hot, return_counts=True)
    a = np.zeros(len(ids))
    both, at, at_hot = np.intersect1d(ids, hot_ids, return_indices=True)
    a[at] = hot_n[at_hot]
    n1, n0, p = y.sum(), len(y) - y.sum(), n / len(y)
    z = np.abs(a / n1 - (n - a) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return ids[z >= LEAST_Z]


def fit(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Ridge logistic regression by Newton steps on the chosen features, of which rows have few."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Linear(np.empty(0, np.int64), np.zeros(earlier.shape[1]), 30.0 if share else -30.0)
    ids = choose(rows, y)
    k, n = len(ids), len(rows)
    own = [np.nonzero(np.isin(ids, r, assume_unique=True))[0] for r in rows]
    row, at = np.repeat(np.arange(n), [len(r) for r in own]), np.concatenate(own)
    rest = np.column_stack([earlier, np.ones(n)])

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[at], n) + rest @ v[k:]

    def back(v: np.ndarray, rest: np.ndarray = rest) -> np.ndarray:
        return np.concatenate([np.bincount(at, v[row], k), v @ rest])

    w, ridge = np.zeros(k + rest.shape[1]), np.full(k + rest.shape[1], RIDGE)
    ridge[-1] = 1e-3
    for _ in range(MOST_STEPS):
        p = sigmoid(times(w))
        d, left = p * (1 - p), back(p - y) + ridge * w
        scale = back(d, rest**2) + ridge
        # Conjugate gradients for Newton's step: no matrix of features by features is held, however many there are.
        step, z = np.zeros(len(w)), left / scale
        along, rz = z, left @ z
        least = 1e-6 * rz
        while rz > least:
            h = back(d * times(along)) + ridge * along
            a = rz / (along @ h)
            step, left = step + a * along, left - a * h
            z = left / scale
            rz, before = left @ z, rz
            along = z + rz / before * along
        w -= step
        if np.abs(step).max() < STOP:
            break
    return Linear(ids, w[:-1], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    threshold: float

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        p = np.zeros((len(rows), len(self.models)))
        for k, m in enumerate(self.models):
            p[:, k] = sigmoid(m.logits(rows, p[:, :k]))
        return p


def threshold_of(p: np.ndarray, y: np.ndarray) -> float:
    """The smallest threshold from which on predictions are right at PRECISION, at least LEAST_P."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.nonzero((right >= PRECISION) & (p[order] >= LEAST_P))[0]
    return float(max(LEAST_P, p[order][good[-1]])) if len(good) else 1.1


def train(rows: list[np.ndarray], labels: np.ndarray, categories: list[str]) -> Chain:
    """labels: a column for each category, in the chain's order."""
    folds = np.arange(len(rows)) % FOLDS
    out = np.zeros(labels.shape)
    models = []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        for f in range(FOLDS):
            rest, own = np.nonzero(folds != f)[0], np.nonzero(folds == f)[0]
            if len(own):
                m = fit([rows[i] for i in rest], out[rest, :k], y[rest])
                out[own, k] = sigmoid(m.logits([rows[i] for i in own], out[own, :k]))
        models.append(fit(rows, out[:, :k], y))
    y = labels[:, -1] if len(rows) else np.zeros(0)
    return Chain(categories, models, threshold_of(out[:, -1], y) if len(rows) and y.min() < y.max() else 1.1)


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature ids and labels of the bounded sample; categories: name -> SQL condition on `labels`."""
    one = labels.select("doc_id", *[F.expr(c).cast("int").alias(k) for k, c in categories.items()]).dropna().groupBy("doc_id").agg(*[F.max(k).alias(k) for k in categories])
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "_id")
    names = list(categories)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", *names)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for b in batches:
            ids = [np.array(sorted(known.of(t.as_py())), dtype=np.int32).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), *[b.column(n) for n in names]], names=["doc_id", "ids", *names])

    got = texts.mapInArrow(extract, "doc_id long, ids binary, " + ", ".join(f"{n} int" for n in names)).groupBy("doc_id").agg(F.min(F.struct("ids", *names)).alias("one")).select("doc_id", "one.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    y = np.array([[r[n] for n in names] for r in got]).reshape(len(got), len(names))
    return often([np.frombuffer(r["ids"], np.int32) for r in got]), y


def often(rows: list[np.ndarray]) -> list[np.ndarray]:
    """The rows without ids that no fold could choose, as too few of all rows have them."""
    ids, n = np.unique(np.concatenate(rows or [np.empty(0, np.int32)]), return_counts=True)
    ids = ids[n >= LEAST_DOCS]
    return [r[np.isin(r, ids, assume_unique=True)] for r in rows]


CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, most: int = MOST_LABELLED) -> Chain:
    categories = categories or CATEGORIES
    rows, y = labelled(docs, labels, categories, most)
    chain = train(rows, y, list(categories))
    del rows, y
    give_back_memory()
    return chain


def score(docs: DataFrame, chain: Chain, keep: bool = False) -> DataFrame:
    """doc_id, a probability p_<category> each and `rejected`; with `keep`, the columns of `docs` of what isn't rejected."""
    ids = {int(i): [] for m in chain.models for i in m.ids}
    for k, m in enumerate(chain.models):
        for i, w in zip(m.ids, m.weights, strict=False):
            ids[int(i)].append((k, float(w)))
    links = [m.weights[len(m.ids) :] for m in chain.models]
    bias = [m.bias for m in chain.models]
    threshold, names = chain.threshold, [f"p_{c}" for c in chain.categories]

    def judge(texts: pa.Array, known: Features) -> tuple[np.ndarray, np.ndarray]:
        z, any_word = np.tile(np.array(bias), (len(texts), 1)), np.zeros(len(texts), bool)
        for n, t in enumerate(texts):
            s = t.as_py()
            any_word[n] = bool(s) and WORDS.search(s) is not None
            for i in sorted(known.of(s)):
                for k, w in ids[i]:
                    z[n, k] += w
        p = np.zeros(z.shape)
        for k in range(len(bias)):
            p[:, k] = sigmoid(z[:, k] + p[:, :k] @ links[k])
        return p, (p[:, -1] >= threshold) & any_word

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(set(ids))
        for b in batches:
            p, bad = judge(b.column("text"), known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(np.round(p[:, k], 6)) for k in range(len(bias))], pa.array(bad)], names=["doc_id", *names, "rejected"])

    at = docs.columns.index("text") if keep else 0

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(set(ids))
        for b in batches:
            yield b.filter(pa.array(~judge(b.column(at), known)[1]))

    if keep:
        return docs.mapInArrow(clean, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", rejected boolean")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
