"""Quality by weak supervision: heuristic labellers, expectation-maximisation, hashed linear scorer.

Each labeller looks at one trait of a text and votes good (1), poor (0) or abstains (-1). Votes
overlap and err. Expectation-maximisation over the counts of all vote patterns of the corpus
estimates how often each labeller is right for good and for poor texts, and how many texts are
good; no label is read. The posterior of a text's pattern is its soft label, and a linear scorer
over hashed words and word shapes learns those labels, so that texts on which all labellers
abstain are scored as well.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import least_by_hash, slices, written

LABELLERS = ("signs", "capitals", "shouting", "repeated_words", "repeated_lines", "tables", "digits", "sentences", "word_length")
#: Rows that the scorer is fitted on, for each side of the posterior.
MAX_ROWS = 4_000
BUCKETS = 1 << 16
#: Tokens longer than this are cut into pieces of it, each with a shape of its own.
PIECE = 24
#: Distinct tokens that a worker remembers the traits of; longer ones than KEPT are worked out every time.
TOKENS, KEPT = 200_000, 2 * PIECE
_WORDS = re.compile(r"[^\W\d_]+").findall


class Kinds(dict):
    """The kind of a character: A upper case, a other letters, 0 digits, else itself."""

    def __missing__(self, c: str) -> str:
        made = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if len(self) < 1 << 17:
            self[c] = made
        return made


_KINDS = Kinds()


def shape(piece: str) -> str:
    """Kinds of characters in order, runs shortened: 'Word!!' is 'Aa!'."""
    return "".join(k for k, _ in groupby(map(_KINDS.__getitem__, piece)))


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


ONE_TIME = bucket("one time")


class Tokens(dict):
    """Token to (characters, letters, upper case, digits, letter runs, stop, shout, buckets of its shapes and of a short word)."""

    def __missing__(self, token: str) -> tuple:
        letters = _WORDS(token)
        buckets = [bucket("s " + shape(token[i : i + PIECE])) for i in range(0, len(token), PIECE)]
        if len(token) <= 4:
            buckets.append(bucket("w " + token.lower()))
        upper = 0 if token.isascii() and token == token.lower() else sum(map(str.isupper, token))
        digits = 0 if token.isalpha() else sum(map(str.isdigit, token))
        made = (len(token), sum(map(len, letters)), upper, digits, len(letters), token[-1] in ".!?", token.endswith(("!!", "??")), tuple(buckets))
        if len(token) <= KEPT:
            if len(self) >= TOKENS:
                self.clear()
            self[token] = made
        return made


_TOKENS = Tokens()


def read(text: str | None) -> tuple[list[int], dict[int, int]]:
    """(votes of LABELLERS, counts of the scorer's buckets) from one look at the whole text; none without a token."""
    tokens = text.split() if text else []
    if not tokens:
        return [-1] * (len(LABELLERS) - 2) + [0, 0], {}
    count = Counter(tokens)
    n = len(tokens)
    dense = letters = upper = digits = runs = stops = shouts = once = 0
    made: dict[int, int] = {}
    for token, m in count.items():
        size, a, u, d, r, stop, shout, buckets = _TOKENS[token]
        dense += m * size
        letters += m * a
        upper += m * u
        digits += m * d
        runs += m * r
        stops += m * stop
        shouts += m * shout
        once += m == 1
        for b in buckets:
            made[b] = made.get(b, 0) + m
    if once:
        made[ONE_TIME] = made.get(ONE_TIME, 0) + once
    breaks = text.count("\n")
    lines = [x for x in text.split("\n") if x.strip()] if breaks >= 2 else []
    sentences, length = stops / n, letters / max(1, runs)
    band = lambda x, good, poor: 1 if x <= good else 0 if x >= poor else -1
    return [
        band(1 - letters / dense - digits / dense, 0.12, 0.25),
        band(upper / max(1, letters), 0.15, 0.4),
        band(shouts / n, 0.02, 0.2),
        band(1 - len(set(zip(tokens, tokens[1:]))) / max(1, n - 1), 0.2, 0.45) if n >= 8 else -1,
        band(1 - len(set(lines)) / max(1, len(lines)), 0.1, 0.4) if breaks >= 2 else -1,
        band(count["|"] / n, 0.02, 0.3),
        band(digits / dense, 0.03, 0.15),
        (1 if 0.02 <= sentences <= 0.4 else 0 if sentences == 0 and n >= 60 else -1),
        (1 if 2.5 <= length <= 9 else 0 if length < 1.5 or length > 15 else -1),
    ], made


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """(share of good texts, P(vote = 0, 1 or none | poor or good) of each labeller), by EM.

    Starts from votes that weigh the more the rarer they are; counts of one more keep a side alive.
    """
    keys = list(patterns)
    v = np.array(keys, np.int64).reshape(len(keys), -1) + 1  # 0 none, 1 poor, 2 good
    n = np.array([patterns[k] for k in keys], np.float64)
    seen = np.array([[n[v[:, i] == c].sum() + 1 for c in range(3)] for i in range(v.shape[1])]) / (n.sum() + 3)
    weight = -np.log(seen) * np.array([0, -1, 1])
    post = np.clip(1 / (1 + np.exp(-weight[np.arange(v.shape[1]), v].sum(axis=1))), 0.02, 0.98)
    prob = np.zeros((2, v.shape[1], 3))
    share = 0.5
    for _ in range(rounds):
        share = float(np.clip((n * post).sum() / n.sum(), 0.02, 0.98))
        for side, w in ((0, n * (1 - post)), (1, n * post)):
            for c in range(3):
                prob[side, :, c] = ((v == c) * w[:, None]).sum(axis=0) + 1
            prob[side] /= prob[side].sum(axis=1, keepdims=True)
        post = posterior(v, share, prob)
    return share, prob


def posterior(v: np.ndarray, share: float, prob: np.ndarray) -> np.ndarray:
    """P(good) of vote rows (0 none, 1 poor, 2 good)."""
    at = np.arange(v.shape[1])
    good = math.log(share) + np.log(prob[1][at, v]).sum(axis=1)
    poor = math.log(1 - share) + np.log(prob[0][at, v]).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(poor - good, -60, 60)))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad, one row at a time."""
    w, g2, b, gb = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0, 1e-6
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rnd.permutation(len(rows)):
            at, x = rows[i]
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, float(w[at] @ x) + b))))
            g = (p - soft[i]) * x + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            gb += (p - soft[i]) ** 2
            b -= rate * (p - soft[i]) / math.sqrt(gb)
    return w, b


def values(counts: np.ndarray) -> np.ndarray:
    """A row's feature values: square roots of the shares of its bucket counts."""
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def weak_labels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, pattern, a, c): every text's votes, one character each ('-', '0', '1'), and its buckets (16 bits) with counts (32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                rows = [read(t) for t in part.column(1).to_pylist()]
                pattern = ["".join("-01"[x + 1] for x in v) for v, _ in rows]
                a = [np.fromiter(c.keys(), "<u2", len(c)).tobytes() for _, c in rows]
                c = [np.fromiter(c.values(), "<u4", len(c)).tobytes() for _, c in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pattern), pa.array(a, pa.binary()), pa.array(c, pa.binary())], ["k", "pattern", "a", "c"])

    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return src.mapInArrow(run, "k long, pattern string, a binary, c binary")


@dataclass
class Model:
    """Posterior of each vote pattern; weights and bias of the linear scorer."""

    posterior: dict[str, float]
    weights: np.ndarray
    bias: float


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from the table of ``weak_labels``: patterns of all rows, the scorer from at most ``max_rows`` rows a side.

    Those rows are the least by the hash of their keys, one for a key that repeats.
    """
    # At most 3 ** labellers patterns.
    patterns = {r["pattern"]: r["n"] for r in labelled.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not patterns:
        return Model({}, np.zeros(BUCKETS), 0.0)
    keys = np.array([["-01".index(c) for c in p] for p in patterns], np.int64)
    share, prob = estimate({tuple((v - 1).tolist()): n for v, n in zip(keys, patterns.values())})
    known = dict(zip(patterns, posterior(keys, share, prob).tolist()))
    rows, soft = [], []
    for good in (True, False):
        side = [p for p, x in known.items() if (x >= 0.5) == good]
        total = sum(patterns[p] for p in side)
        for r in least_by_hash(labelled.where(F.col("pattern").isin(side)), max_rows, total).collect():
            rows.append((np.frombuffer(r["a"], "<u2").astype(np.int64), values(np.frombuffer(r["c"], "<u4"))))
            soft.append(known[r["pattern"]])
    weights, bias = fit_scorer(rows, np.array(soft))
    return Model(known, weights, bias)


def scored(labelled: DataFrame, model: Model) -> DataFrame:
    """(k, weak, score) of the rows of ``weak_labels``; rows without a token score 0."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, at most 3 ** labellers patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, known = shared.value.weights, shared.value.bias, shared.value.posterior
        for batch in batches:
            score = []
            for a, c in zip(batch.column(2), batch.column(3)):
                counts = np.frombuffer(c.as_buffer(), "<u4")
                z = float(w[np.frombuffer(a.as_buffer(), "<u2")] @ values(counts)) + b if len(counts) else -60.0
                score.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
            weak = [known[p] for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(score, pa.float64())], ["k", "weak", "score"])

    return labelled.select("k", "pattern", "a", "c").mapInArrow(run, "k long, weak double, score double")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, weak, score, predicted): posterior of the labellers, the scorer's 0 to 1, 1 if >= 0.5.

    Texts are read once: votes and features of every whole text are written, and patterns, sample
    and scores come from that table. The scorer is fitted on at most ``max_rows`` rows of each
    side. Null and empty texts are poor. An empty table gives an empty result; repeated rows and
    rows of one key are scored by their texts alone; other columns, whatever their names, are
    ignored. A very long text is read whole; its tokens are counted, not kept.
    """
    labelled = written(weak_labels(docs, key, text), "votes")
    done = scored(labelled, train(labelled, max_rows))
    return done.select(F.col("k").alias(key), "weak", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
