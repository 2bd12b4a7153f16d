"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (proximal) updates and scored as sparse dot products.

Tokens are runs of letters and digits or runs of symbols. A document's features are its
lower-cased tokens, pairs of neighbouring tokens, pairs of neighbouring token shapes (lower
case, capitalised, capitals, digits, symbols) and of equal neighbours, all hashed into
2**BITS weights; a feature's value is log(1 + count), and the vector has unit length.

Training takes at most ``TRAINING_ROWS`` labelled rows, those of the smallest hash of the id,
dealt into groups of about ``SHARD_ROWS``; each group runs the updates on its own and the weights are
averaged. The model has a fixed size.

Defined results: null and empty texts have no features and score as the intercept does; texts of any length
are read whole; labels other than 0 and 1 and null labels or ids are not learned from; of different labels of
one id the larger counts, and every row of a labelled id is learned from; without labelled rows
every score is 0.5; an empty table gives an empty table; rows are scored one by one; columns other than id and text are
not read, whatever their names are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, mapped, pieces, ship, table

BITS = 18
SIZE = 1 << BITS
TRAINING_ROWS = 20_000
SHARD_ROWS = 2500
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.1
TOKENS = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+").findall
#: The last place is the intercept's.
INTERCEPT = SIZE - 1
_REMEMBERED = 300_000


def _shape(token: str) -> int:
    if not token[0].isalnum():
        return 4
    if token[0].isdigit():
        return 3
    if token.isupper() and len(token) > 1:
        return 2
    return int(token[0].isupper())


class _Codes(dict):
    """token -> hash of its lower-cased form, with the shape in the low three bits."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        code = (xxhash.xxh64_intdigest(token.lower()) >> 2 & ~7) | _shape(token)
        self[token] = code
        return code


_CODES = _Codes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places, in order, and values of a text's features, the intercept last."""
    tokens = TOKENS(text or "")
    codes = np.fromiter(map(_CODES.__getitem__, tokens), np.int64, len(tokens))
    words, shapes = (codes >> 3).astype(np.uint64), codes & 7
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
    near = (shapes[:-1] * 8 + shapes[1:]) * 2 + (words[:-1] == words[1:])
    places = np.concatenate([words % np.uint64(SIZE - 256), pairs % np.uint64(SIZE - 256), near.astype(np.uint64) + np.uint64(SIZE - 256)])
    found, counts = np.unique(places, return_counts=True)
    values = np.log1p(counts)
    values /= max(float(np.sqrt(values @ values)), 1e-9)
    return np.append(found, INTERCEPT).astype(np.int64), np.append(values, 1.0)


class FollowTheLeader:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self, size: int = SIZE):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-min(50.0, max(-50.0, x)))))


def labelled_sample(labels: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows (k, y) with label 0 or 1, of the smallest hash of the id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    return known.orderBy(F.xxhash64("k"), "k").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", rows: int = TRAINING_ROWS) -> np.ndarray:
    """The averaged weights."""
    ship(docs.sparkSession)
    sample = labelled_sample(labels, label, key, rows)
    shards = max(1, round(sample.count() / SHARD_ROWS))
    sample = F.broadcast(sample)  # at most ``rows`` rows of 12 bytes
    train = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(sample, "k")

    def extract(batches):
        for b in pieces(batches, "t"):
            made = [features(t) for t in b.column("t").to_pylist()]
            yield {"k": b.column("k"), "y": b.column("y"), "at": pa.array([a for a, _ in made], pa.list_(pa.int64())), "x": pa.array([x for _, x in made], pa.list_(pa.float64()))}

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("k", "ascending")])
        data = [(np.asarray(a), np.asarray(x), y) for a, x, y in zip(group["at"].to_pylist(), group["x"].to_pylist(), group["y"].to_pylist())]
        model, rng = FollowTheLeader(), np.random.default_rng(1)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(data)):
                model.update(*data[i])
        w = model.weights()
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array([-1, *at.tolist()], pa.int64()), "w": pa.array([1.0, *w[at].tolist()], pa.float64())})

    made = mapped(train, extract, f"k {docs.schema[key].dataType.simpleString()}, y int, at array<long>, x array<double>")
    trained = made.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards))).groupBy("shard").applyInArrow(learn, "at long, w double")
    summed = trained.groupBy("at").agg(F.sum("w").alias("w")).toArrow()
    at, w = summed["at"].to_numpy(), summed["w"].to_numpy()
    out = np.zeros(SIZE, np.float32)
    trained_shards = float(w[at < 0].sum()) or 1.0
    out[at[at >= 0]] = w[at >= 0] / trained_shards
    return out


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, key: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns ``also`` (Boolean), score and predicted of every row."""
    also = also or {}
    passed = tuple(also)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in pieces(batches, "t"):
            made = [_sigmoid(float(w[at] @ x)) for at, x in map(features, b.column("t").to_pylist())]
            yield {"doc_id": b.column("k"), **{c: b.column(c) for c in passed}, "score": made, "predicted": [int(s >= threshold) for s in made]}

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *(c.alias(n) for n, c in also.items()))
    return mapped(rows, run, f"doc_id {docs.schema[key].dataType.simpleString()}, {''.join(f'{c} boolean, ' for c in also)}score double, predicted int")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels.filter(~held_out("doc_id", 3, 1))), also={"held_out": held_out("doc_id", 3, 1)})
