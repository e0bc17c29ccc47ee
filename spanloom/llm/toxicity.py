"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic examples are the positives; any other text is unlabelled and holds toxic rows too,
at the class prior. The risk is prior * R+(positives) + max(0, R-(unlabelled) - prior *
R-(positives)); when the second part turns negative, a step goes the other way, so that the
classifier cannot fit noise by calling all unlabelled rows clean.

Features are a text's distinct words (lower case, letters and digits), hashed. Only words that are
clearly more common among positives than among unlabelled texts enter the classifier; a text without
any of them has the score of no evidence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import least_by_hash, slices

WORD = re.compile(r"\w+").findall
#: Bounds of the training sample, in rows.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 16_000
#: A word is used from this z-score of the difference of shares, and this many positives.
LEAST_Z, LEAST_ROWS = 5.0, 5


def word_hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's words, as unsigned 32-bit integers."""
    crc = zlib.crc32
    return np.unique(np.fromiter((crc(w.encode("utf-8", "surrogatepass")) for w in set(WORD(text.lower()))), np.uint32)) if text else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Hashes (sorted), their weights, and a bias: a linear score through the logistic function."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, hashes: np.ndarray) -> float:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        return self.bias + float(self.weights[at[hit]].sum())

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.margin(word_hashes(text))))))


def nnpu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, l2: float = 1e-6, batch: int = 1024, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk, sigmoid loss, Adam."""
    rnd = np.random.default_rng(seed)
    d = x_pos.shape[1]
    w = np.zeros(d + 1)
    w[d] = math.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    def parts(x, sign):
        """Mean sigmoid loss of sign * margin, and its gradient."""
        x = np.column_stack([x, np.ones(len(x))])
        s = 1 / (1 + np.exp(np.clip(sign * (x @ w), -60, 60)))
        return s.mean(), x.T @ (-sign * s * (1 - s)) / len(x)

    for t in range(1, steps + 1):
        p = x_pos[rnd.integers(len(x_pos), size=min(batch, len(x_pos)))]
        u = x_unl[rnd.integers(len(x_unl), size=min(batch, len(x_unl)))]
        _, up = parts(p, 1)
        risk_p, down_p = parts(p, -1)
        risk_u, down_u = parts(u, -1)
        negative = risk_u - prior * risk_p
        grad = prior * up + (down_u - prior * down_p) if negative >= 0 else prior * down_p - down_u
        grad += l2 * np.append(w[:d], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:d], float(w[d])


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """A model from word hashes of positive and of unlabelled texts. Without enough rows: the prior alone."""
    prior = min(max(prior, 1e-4), 0.5)
    if not positives or not unlabelled:
        return Model(np.zeros(0, np.uint32), np.zeros(0), math.log(prior / (1 - prior)), prior)
    words, counts = np.unique(np.concatenate(positives), return_counts=True)
    other, seen = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(other, words), max(len(other) - 1, 0))
    back = np.where(other[at] == words, seen[at], 0) if len(other) else np.zeros(len(words))
    p, u = len(positives), len(unlabelled)
    share = (counts + back) / (p + u)
    z = (counts / p - back / u) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / p + 1 / u))
    keep = (z >= LEAST_Z) & (counts >= LEAST_ROWS)
    used = words[keep]
    if not len(used):
        return Model(np.zeros(0, np.uint32), np.zeros(0), math.log(prior / (1 - prior)), prior)

    def matrix(rows):
        x = np.zeros((len(rows), len(used)), np.float32)
        for i, r in enumerate(rows):
            x[i, np.searchsorted(used, np.intersect1d(r, used, assume_unique=True))] = 1
        return x

    weights, bias = nnpu(matrix(positives), matrix(unlabelled), prior)
    return Model(used, weights, bias, prior)


def _sample(docs: DataFrame, rows: DataFrame, key: str, text: str, limit: int, total: int) -> list[np.ndarray]:
    """Word hashes of at most ``limit`` texts, one for each key in ``rows``, picked by the keys' hash; of a repeated key's texts, the first."""
    picked = least_by_hash(rows, limit, total)
    # At most ``limit`` keys, so no text is shuffled to find theirs.
    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(picked), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([word_hashes(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["k", "h"])

    made = src.select("k", "t").mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, h binary")
    return [np.frombuffer(r[0], np.uint32) for r in made.groupBy("k").agg(F.min("h").alias("h")).select("h").collect()]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: F.Column | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on rows of ``labels`` that pass ``learn`` (a condition on the column k, the key).

    Positives: labelled toxic. Unlabelled: texts of rows that pass and are not labelled toxic,
    which the risk treats as unknown. The class prior is the share of toxic labels. Both samples
    are bounded (``max_positive``, ``max_unlabelled`` rows), picked by the hash of their keys, ties
    by key; a key that repeats gives one row. A null label counts as none, a key with two labels is
    toxic; without labels or texts the model has no words. Other columns are ignored.
    """
    learn = F.lit(True) if learn is None else learn
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null").where(learn).groupBy("k").agg(F.max("y").alias("y"))
    row = known.agg(F.avg(F.col("y").cast("double")).alias("prior")).first()
    if row["prior"] is None:
        return fit([], [], 0.01)
    toxic = known.where("y = 1").select("k")
    rest = docs.select(F.col(key).alias("k")).where("k is not null").where(learn).distinct().join(toxic, "k", "left_anti")
    # The rest has lost the positives in the sample of labels: it holds them at a lower rate.
    total = rest.agg(F.count(F.lit(1))).first()[0]
    positive = known.where("y = 1").count()
    prior = row["prior"]
    hidden = max(0.0, (total + positive) * prior - positive) / max(1, total)
    return fit(_sample(docs, toxic, key, text, max_positive, positive), _sample(docs, rest, key, text, max_unlabelled, total), hidden if hidden > 0 else prior / 10)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, 0 to 1, from the whole text, however long; null and empty texts have the score of no words.

    Equal texts and repeated rows score alike, whatever their keys; an input column named ``out`` is
    replaced, all others stay; an empty table gives an empty result.
    """
    return docs.withColumn(out, scorer(model)(F.col(text).cast("string")))


def scorer(model: Model):
    """The model as a column function; the model has at most a few hundred weights."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        weights = dict(zip(model.hashes.tolist(), model.weights.tolist()))
        crc, get, out = zlib.crc32, weights.get, []
        for x in texts:
            z, t = model.bias, x.as_py()
            if t:
                seen = {crc(w.encode("utf-8", "surrogatepass")) for w in set(WORD(t.lower()))}
                z += sum(get(h, 0.0) for h in seen & weights.keys())
            out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
        return pa.array(out, pa.float64())

    return run
