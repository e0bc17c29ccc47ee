"""Document fingerprints: SimHash of weighted terms, and what an edit does to them.

A term is a pair of neighbouring words (lower-cased, between white space; words of more than 24
characters are cut every 8, so that unspaced text has terms too); one word alone is a term of its
own. Its weight is the length of its words, each counted up to 12, so that short function words
say less. Every occurrence votes. A fingerprint has 256 bits, as four 64-bit words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import looked_up, range_ids, shuffle_partitions, slices, written
from spanloom.llm.simhash import block_bounds, block_tables, likeness, pack_bits, vote_sums, within_radius

WORDS = 4
LONG_WORD, CUT, WEIGHT_CAP = 24, 8, 12
#: Radius of the counting search: eight tables of 32 bits.
NEAR = 7
#: Blocks of queries that are broadcast to leave out blocks that no query has; more of them are shuffled.
MOST_BROADCAST = 500_000
#: Odd multipliers that spread one 64-bit term hash over the words of the fingerprint.
_SPREAD = np.array([xxhash.xxh64_intdigest(f"word {i}", 7) | 1 for i in range(WORDS)], np.uint64)


def term_words(text: str) -> list[bytes]:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if any(len(w) > LONG_WORD for w in words):
        words = [w[i : i + CUT] for w in words for i in range(0, len(w), CUT if len(w) > LONG_WORD else len(w))]
    return words


def text_fingerprint(text: str | None) -> np.ndarray:
    """The four words, lowest first; zero for a text without terms."""
    words = term_words(text) if text else []
    if not words:
        return np.zeros(WORDS, np.uint64)
    h = xxhash.xxh64_intdigest
    size = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), WEIGHT_CAP)
    if len(words) == 1:
        terms, weights = words, size
    else:
        terms, weights = map(b" ".join, zip(words, words[1:])), size[1:] + size[:-1]
    one = np.fromiter(map(h, terms), np.uint64)
    many = one[:, None] * _SPREAD[None, :]
    many ^= many >> np.uint64(29)
    many *= np.uint64(0xBF58476D1CE4E5B9)  # the finalizer of SplitMix64
    many ^= many >> np.uint64(32)
    return pack_bits(vote_sums(many, weights.astype(np.float64)) * 2 > weights.sum())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, w0 .. w3): fingerprint words as signed integers. Null and empty texts: zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                made = np.array([text_fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).reshape(-1, WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(made[:, i]) for i in range(WORDS))], ["k", *(f"w{i}" for i in range(WORDS))])

    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = f"k {src.schema['k'].dataType.simpleString()}, " + ", ".join(f"w{i} long" for i in range(WORDS))
    return src.mapInArrow(run, schema).withColumnRenamed("k", key)


def search(prints: DataFrame, queries: DataFrame, key: str = "doc_id", radius: int = 12) -> DataFrame:
    """(q_key, key, distance): every row of ``prints`` within ``radius`` bits of a query row.

    Distinct fingerprints meet through the permuted block tables; keys are attached afterwards.
    """
    names = [f"w{i}" for i in range(WORDS)]
    near = within_radius(prints, queries, names, radius)
    left = queries.select(F.col(key).alias(f"q_{key}"), *[F.col(n).alias(f"q_{n}") for n in names])
    return near.join(left, [f"q_{n}" for n in names]).join(prints, names).select(f"q_{key}", key, "distance")


def near_counts(q: np.ndarray, d: np.ndarray, n: np.ndarray, table: int, radius: int, most: int = 1 << 16) -> np.ndarray:
    """For each query (rows of uint64 words) the sum of ``n`` of the rows of ``d`` within ``radius`` bits that first agree with it in block ``table``."""
    out = np.zeros(len(q), np.int64)
    bounds = block_bounds(64 * q.shape[1], radius + 1)[: table + 1]
    for i in range(0, len(d), step := max(1, most // max(1, len(q)))):
        x = q[:, None, :] ^ d[None, i : i + step, :]
        a, b = np.nonzero(np.bitwise_count(x).sum(axis=2) <= radius)
        bits = np.unpackbits(x[a, b].view(np.uint8), axis=1, bitorder="little")
        agree = np.stack([~bits[:, at : at + width].any(axis=1) for at, width in bounds], 1)
        keep = agree[:, table] & ~agree[:, :table].any(axis=1)
        np.add.at(out, a[keep], n[i + b[keep]])
    return out


def counted_within(prints: DataFrame, queries: DataFrame, radius: int = NEAR) -> DataFrame:
    """(w0 .. w3, n_within): for each distinct query fingerprint, the rows of ``prints`` within ``radius`` bits.

    Distinct fingerprints meet through the permuted block tables. A pair is counted at the first
    table in which it meets, inside its bucket: what leaves a bucket is a number for each query, so
    no pair becomes a row, however large a group of near copies. A bucket's queries stand before
    its other rows, which are streamed past them; rows of a very large bucket are dealt over several
    tasks, each with the bucket's queries. Null fingerprints match nothing; empty frames give none.
    """
    names = [f"w{i}" for i in range(WORDS)]
    known = written(prints.select(*names).dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "prints")
    bucket = F.xxhash64("table", "block").alias("bucket")
    asked = written(block_tables(queries.select(*names).dropna().distinct(), names, radius).select(bucket, "table", *names), "asked")
    wanted = asked.select("bucket").distinct()
    if asked.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    rows = written(block_tables(known, names, radius).select(bucket, "table", *names, "n").join(wanted, "bucket", "left_semi"), "met")
    parts = shuffle_partitions(prints.sparkSession)
    cap = max(1_000, 2 * rows.count() // parts)
    hot = rows.groupBy("bucket").count().where(F.col("count") > cap).select("bucket", F.ceil(F.col("count") / F.lit(cap)).cast("int").alias("parts"))
    hot = F.broadcast(written(hot, "hot-buckets"))  # half the partitions at most
    dealt = rows.join(hot, "bucket", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*names), F.col("parts")).cast("int"), F.lit(0)))
    sent = asked.join(hot, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumn("n", F.lit(None).cast("long"))
    columns = ["bucket", "part", "table", *names, "n"]
    both = sent.select(*columns).unionByName(dealt.select(*columns)).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "table", F.asc_nulls_first("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, q, found = None, np.zeros((0, WORDS), np.uint64), np.zeros(0, np.int64)

        def done():
            hit = found > 0
            return pa.RecordBatch.from_arrays([*(pa.array(q[hit, i].view(np.int64)) for i in range(WORDS)), pa.array(found[hit])], [*names, "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            words = np.stack([batch.column(3 + i).to_numpy() for i in range(WORDS)], 1).view(np.uint64)
            query = batch.column(7).is_null().to_numpy(zero_copy_only=False)
            n = batch.column(7).fill_null(0).to_numpy()
            begins = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for a, b in zip(begins, [*begins[1:], len(keys)]):
                if key != tuple(keys[a]):
                    if len(q):
                        yield done()
                    key, q, found = tuple(keys[a]), np.zeros((0, WORDS), np.uint64), np.zeros(0, np.int64)
                cut = a + int(query[a:b].sum())
                if cut > a:
                    q, found = np.concatenate([q, words[a:cut]]), np.concatenate([found, np.zeros(cut - a, np.int64)])
                if len(q) and cut < b:
                    found = found + near_counts(q, words[cut:b], n[cut:b], int(keys[a, 2]), radius)
        if len(q):
            yield done()

    return both.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("n_within"))


def with_counts(made: DataFrame, asked: F.Column, radius: int = NEAR) -> DataFrame:
    """The written rows (.., w0 .. w3) with n_within: rows within ``radius`` bits, itself included, where ``asked`` holds; else, and without a fingerprint, null."""
    names = [f"w{i}" for i in range(WORDS)]
    asked = F.coalesce(asked, F.lit(False)) & F.concat(*[F.col(n).cast("string") for n in names]).isNotNull()
    mine = made.where(asked)
    found = written(counted_within(made, mine, radius).select(F.xxhash64(*names).alias("__f"), F.struct(*names).alias("__w"), "n_within"), "within")
    # Two fingerprints with one 64-bit hash are told apart by the words themselves.
    lists = found.groupBy("__f").agg(F.collect_list(F.struct("__w", "n_within")).alias("__l"))
    joined = looked_up(mine.withColumn("__f", F.xxhash64(*names)), written(lists, "within-lists"), "__f")
    hit = F.filter("__l", lambda x: (x["__w"]["w0"] == F.col("w0")) & (x["__w"]["w1"] == F.col("w1")) & (x["__w"]["w2"] == F.col("w2")) & (x["__w"]["w3"] == F.col("w3")))
    out = joined.withColumn("n_within", hit[0]["n_within"]).select(*made.columns, "n_within")
    return out.unionByName(made.where(~asked).withColumn("n_within", F.lit(None).cast("long")))


def edited(text: str, following: str) -> str:
    """The last third (floored, in code points) replaced by as many from the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def edit_probe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next text by descending key.

    (key, n_chars, edited_sha256, w0 .. w3, e0 .. e3, near_edited, near_next). The last key is
    followed by the first; a lone row by itself. Equal keys are ordered by text, descending; null
    keys come last; a null text is empty, and an empty one has fingerprint zero. Repeated rows follow
    one another; an empty table gives an empty result; other columns, whatever their names, are
    ignored; a very long text votes in bounded parts. Texts move once: to key ranges, sorted. A range's last
    row needs the first text of the range after it, which is sent along as one more row of the
    range; there are as many of those as ranges.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    src = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    src = range_ids(src, "k", n, "s").select("s", "k", "t")

    # The range below each (the highest below the lowest), and the key its first row has.
    tops = {r["s"]: r["top"] for r in src.groupBy("s").agg(F.max("k").alias("top")).collect()}
    known = sorted(tops)
    heads = spark.createDataFrame([(known[i], known[i - 1], tops[known[i - 1]]) for i in range(len(known))], "target int, below int, top long")
    firsts = src.join(F.broadcast(heads), (F.col("s") == F.col("below")) & F.col("k").eqNullSafe(F.col("top")))
    firsts = firsts.groupBy(F.col("target").alias("s")).agg(F.max("t").alias("t"))
    firsts = firsts.select("s", F.lit(None).cast("long").alias("k"), "t", F.lit(True).alias("extra"))
    rows = src.withColumn("extra", F.lit(False)).unionByName(firsts)
    dealt = rows.repartitionById(n, F.col("s")).sortWithinPartitions("s", "extra", F.desc_nulls_last("k"), F.desc("t"))
    names = ["k", "n_chars", "edited_sha256", *(f"w{i}" for i in range(WORDS)), *(f"e{i}" for i in range(WORDS)), "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, key, text, fingerprint) of the row that waits for its next one
        for batch in batches:
            for part in slices(batch, "t"):
                made = []
                for s, k, t, extra in zip(*(part.column(i).to_pylist() for i in range(4))):
                    fp = text_fingerprint(t)
                    if held is not None and held[0] == s:
                        made.append(_compared(*held[1:], t, fp))
                    held = None if extra else (s, k, t, fp)
                if made:
                    yield _probe_batch(made, names)

    kinds = {"k": "long", "n_chars": "long", "edited_sha256": "string", "near_edited": "double", "near_next": "double"}
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names)).withColumnRenamed("k", key)


def _compared(k, text: str, fp: np.ndarray, following: str, next_fp: np.ndarray) -> tuple:
    other = edited(text, following)
    other_fp = text_fingerprint(other) if other != text else fp
    return k, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), fp, other_fp, likeness(fp, other_fp), likeness(fp, next_fp)


def _probe_batch(made: list[tuple], names: list[str]) -> pa.RecordBatch:
    k, n, sha, fp, other, near, after = zip(*made)
    fp, other = np.array(fp).view(np.int64), np.array(other).view(np.int64)
    arrays = [pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), *(pa.array(fp[:, i]) for i in range(WORDS)), *(pa.array(other[:, i]) for i in range(WORDS)), pa.array(near, pa.float64()), pa.array(after, pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, names)


def hex_of(prefix: str):
    """Column: the words prefix0 .. as one lowercase hex string, highest word first."""
    return F.concat(*[F.lpad(F.lower(F.hex(f"{prefix}{i}")), 16, "0") for i in reversed(range(WORDS))])

