"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are byte n-grams (2 to 4 bytes of the lower-cased UTF-8 text, blanks and signs folded into
one separator), hashed into buckets. A text is the mean of its subwords' embeddings; a linear layer
and a softmax give the languages. Embeddings and layer are trained together by stochastic gradient
descent on segments of the sampled texts. A temperature fitted on segments left out calibrates the
probabilities, and a text is rejected if the calibrated probability is below a threshold that keeps
the wanted share of right answers there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import slices

BUCKETS, DIM, GRAMS = 1 << 14, 16, (2, 3, 4)
SEGMENT = 400
#: Bounds of the training sample: rows for each language, rows in all, random segments for each row.
MAX_PER_LANGUAGE, MAX_ROWS, MAX_SEGMENTS = 1_500, 12_000, 12
_LETTER = regex.compile(r"\p{L}").search
#: Bytes that separate words: all below 0x80 but a-z (texts are lower-cased first).
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_MULT = {2: (0x9E3779B1, 0x85EBCA6B), 3: (0xC2B2AE35, 0x27D4EB2F, 0x165667B1), 4: (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x7FEB352D)}


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER(text) is not None


def folded(text: str) -> np.ndarray:
    """Bytes of the lower-cased text, between separators."""
    return _FOLD[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte but the last n - 1."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for i, m in enumerate(_MULT[n]):
        out += data[i : len(data) - n + 1 + i].astype(np.uint32) * np.uint32(m)
    out ^= out >> np.uint32(15)
    return (out * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))


@dataclass
class Model:
    """Languages, logits of every bucket (embedding times layer), bias, temperature, threshold."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, data: np.ndarray, rows: int = 1 << 18) -> np.ndarray:
        """Of one folded text, a bounded number of subwords at a time."""
        total, count = np.zeros(len(self.langs)), 0
        for at in range(0, len(data), rows):
            part = data[at : at + rows + max(GRAMS) - 1]
            for n in GRAMS:
                b = buckets(part, n)[:rows]
                total += self.table[b].sum(axis=0, dtype=np.float64)
                count += len(b)
        return total / max(1, count) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, accepted); ('und', 0, False) without a letter."""
        if not has_letter(text) or not self.langs:
            return "und", 0.0, False
        p = softmax(self.logits(folded(text))[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def segments(text: str, size: int = SEGMENT) -> Iterator[np.ndarray]:
    data = folded(text)
    for i in range(0, len(data), size):
        if i == 0 or len(data) - i >= 40:
            yield data[i : i + size]


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, data in enumerate(rows):
        b = np.concatenate([buckets(data, n) for n in GRAMS])
        if len(b):
            x[i] = np.bincount(b, minlength=BUCKETS) / len(b)
    return x


def picked(text: str, seed: int, most: int = MAX_SEGMENTS) -> list[bytes]:
    """At most ``most`` random segments of a whole text; none without a letter."""
    parts = list(segments(text)) if has_letter(text) else []
    return [parts[i].tobytes() for i in np.random.default_rng(seed).permutation(len(parts))[:most]]


def fit(rows: list[list[bytes]], langs: list[str], steps: int = 500, batch: int = 64, rate: float = 20.0, keep: float = 0.995, seed: int = 3) -> Model:
    """SGD on the rows' segments; every tenth row is left out for temperature and threshold, all its segments counting."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rnd = np.random.default_rng(seed)
    train, held = [], []
    for i, (parts, lang) in enumerate(zip(rows, langs)):
        (held if i % 10 == 9 else train).extend((np.frombuffer(x, np.uint8), names.index(lang)) for x in parts)
    k = len(names)
    emb = rnd.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rnd.normal(0, 0.3, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    if train:
        by_lang = [[i for i, (_, y) in enumerate(train) if y == c] for c in range(k)]
        by_lang = [b for b in by_lang if b]
        for step in range(steps):
            lr = rate * (1 - step / steps)
            # Languages in turn, so that a rare one is learnt as well as a frequent one.
            pick = [by_lang[j % len(by_lang)][rnd.integers(len(by_lang[j % len(by_lang)]))] for j in range(batch)]
            x = _counts([train[i][0] for i in pick])
            y = np.array([train[i][1] for i in pick])
            mean = x @ emb
            g = softmax(mean @ layer + bias)
            g[np.arange(batch), y] -= 1
            g /= batch
            down = g @ layer.T
            layer -= lr * 0.1 * (mean.T @ g)
            bias -= lr * 0.01 * g.sum(axis=0)
            emb -= lr * (x.T @ down)
    model = Model(names, (emb @ layer).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if held:
        z = np.array([model.logits(s) for s, _ in held])
        y = np.array([c for _, c in held])
        grid = np.geomspace(0.2, 10, 60)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            model.threshold = float(np.quantile(p.max(axis=1)[right], 1 - keep))
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learn: F.Column | None = None, per_language: int = MAX_PER_LANGUAGE, max_rows: int = MAX_ROWS, max_segments: int = MAX_SEGMENTS) -> Model:
    """Fit on at most ``max_segments`` segments of at most ``per_language`` rows of each language, ``max_rows`` in all.

    Rows are picked by the hash of their keys, one for a key that repeats; segments by a seed from
    the key. What reaches the driver is bounded by the three parameters, whatever the rows and
    however long their texts. Beyond ``max_rows`` languages, those with most rows are learnt.
    ``learn``: a condition on the column k, the key. Null keys, texts and languages are not learnt.
    """
    from pyspark.sql.window import Window

    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("y"))
    src = src.where("k is not null and t is not null and y is not null")
    src = src.where(learn) if learn is not None else src
    # One random number per key; per language, those below the bound's share, then the least of them.
    sizes = src.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(max_rows)
    known = sizes.count()
    most = max(1, min(per_language, max_rows // max(1, known)))
    unit = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = src.join(F.broadcast(sizes), "y").withColumn("u", unit).where(F.col("u") <= 2.0 * most / F.col("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                made = [picked(t, s, max_segments) for t, s in zip(part.column(2).to_pylist(), part.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(made, pa.list_(pa.binary()))], ["k", "y", "u", "parts"])

    kind = src.schema["k"].dataType.simpleString()
    cut = near.select("k", "y", "t", "u", F.pmod(F.xxhash64("k", "t"), F.lit(1 << 31)).alias("s")).mapInArrow(read, f"k {kind}, y string, u double, parts array<binary>")
    once = cut.groupBy("k", "u").agg(F.min(F.struct("y", "parts")).alias("x")).select("k", "u", "x.*")
    order = Window.partitionBy("y").orderBy("u", "k")
    rows = once.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).orderBy("k").select("y", "parts").collect()
    return fit([[bytes(x) for x in r["parts"]] for r in rows], [r["y"] for r in rows])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, accepted) from whole texts.

    lang_pred is 'und', with score 0, if the text is null or has no letter (Unicode category L), or
    no language was learnt; otherwise the likeliest learnt language, the first by name of equals.
    accepted: the calibrated rejection. Repeated rows are predicted alike; null keys stay; an empty
    table gives an empty result; other columns, whatever their names, are ignored. A very long text
    is read whole, a bounded number of subwords at a time.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "t"):
                made = [model.predict(t) for t in part.column(1).to_pylist()]
                lang, p, ok = zip(*made)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(p, pa.float64()), pa.array(ok)], ["k", "lang_pred", "score", "accepted"])

    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, lang_pred string, score double, accepted boolean").withColumnRenamed("k", key)
