"""Near duplicates by SimHash, linked through pivot distance tables.

A fingerprint's pivot table holds its Hamming distances to a fixed list of reference fingerprints.
By the triangle inequality, two fingerprints within r bits differ by at most r in every coordinate
of their tables; a pair with a larger difference anywhere is discarded without being compared, and
the survivors are verified exactly.

So that no pair needs the whole corpus in one place, fingerprints meet in buckets: of r + 1 blocks
of bits, two fingerprints within r bits agree on one at least. A bucket of more than ``bucket_cap``
distinct fingerprints is split again on the bits that are left, as often as needed; that is exact,
and 11 bits are left in the end, so that no bucket can hold more than 2,048. Within a bucket,
rows sorted by their first coordinate are only paired inside a window of r. A bucket yields the
edges of a spanning forest, so that a group of n near copies gives n - 1 rows, never n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import connected_components, looked_up, salted, settled, slices, written
from spanloom.llm.simhash import pack_bits, vote_sums
from spanloom.llm.tokens import Encoder

RADIUS = 3
SHINGLE = 3
PIVOTS = 16
BUCKET_CAP = 4096
#: Bits left, and the widths of the blocks they are cut into, level by level.
LEVELS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6), (5, 5, 5, 5), (4, 4, 4, 3))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: XXH64 of 0, 1, 2, ... as text."""
    return np.array([xxhash.xxh64_intdigest(str(i), 42) for i in range(n)], np.uint64)


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space, word shingles.

    A bit is set if over half the shingles' XXH64 (seed 42) have it. Null and wordless texts: 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((h(g, 42) for g in grams), np.uint64)
    return int(pack_bits(vote_sums(hashes) * 2 > len(hashes))[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, table): fingerprint as a signed 64-bit integer, distances to the pivots as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for batch in batches:
            for part in slices(batch, "t"):
                fp = np.fromiter((text_fingerprint(t, shingle) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), pa.array([r.tobytes() for r in table], pa.binary())], ["k", "fp", "pivots"])

    src = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, fp long, pivots binary").withColumnRenamed("k", key)


def _chunks(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose counts sum to about ``most``."""
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(counts):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + most, "right")))
        yield begin, end
        begin = end


def bucket_forest(keys: np.ndarray, fps: np.ndarray, tables: np.ndarray, radius: int, most: int = 1 << 17, nodes: np.ndarray | None = None, checks: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, its root) that join what is linked within each bucket.

    keys: bucket of each row; fps: uint64; tables: uint8 (rows, pivots). Pairs are made ``most``
    at a time: those in the window of the first pivot, then thinned pivot by pivot, then verified.
    nodes: what a row stands for, the fingerprint itself if not given. checks: wide fingerprints
    (uint64, rows x words); if given, a link also needs at most ``limit`` differing bits there.
    """
    nodes = fps if nodes is None else nodes
    order = np.lexsort((tables[:, 0], keys))
    keys, fps, tables, nodes = keys[order], fps[order], tables[order].astype(np.int16), nodes[order]
    checks = checks[order] if checks is not None else None
    rank = np.cumsum(np.r_[False, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    line = rank.astype(np.int64) * 256 + tables[:, 0]
    n = len(line)
    counts = np.searchsorted(line, line + radius, "right") - np.arange(n) - 1
    label = np.arange(n)
    for a, b in _chunks(counts, most):
        c = counts[a:b]
        i = np.repeat(np.arange(a, b), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        for p in range(1, tables.shape[1]):
            keep = np.abs(tables[i, p] - tables[j, p]) <= radius
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        i, j = i[keep], j[keep]
        if checks is not None and len(i):
            keep = np.bitwise_count(checks[i] ^ checks[j]).sum(axis=1) <= limit
            i, j = i[keep], j[keep]
        while len(i):
            x, y = label[i], label[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    moved = label != np.arange(n)
    return nodes[moved], nodes[label[moved]]


def bucket_edges(buckets: DataFrame, radius: int, limit: int = 0) -> DataFrame:
    """Spanning-forest edges (u, v) of every bucket of (bucket, fp, pivots[, node, check]); a bucket is at most BUCKET_CAP rows."""
    wide = "check" in buckets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, fp, table, node=None, check=None):
            u, v = bucket_forest(key, fp, table, radius, nodes=node, checks=check, limit=limit)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        def matrix(column, kind, rows):
            return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            now = [key, batch.column(1).to_numpy().view(np.uint64), matrix(batch.column(2), np.uint8, len(key))]
            if wide:
                now += [batch.column(3).to_numpy(), matrix(batch.column(4), "<u8", len(key))]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                yield done(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held is not None:
            yield done(*held)

    dealt = buckets.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "fp", "pivots", *(["node", "check"] if wide else [])).mapInArrow(run, "u long, v long")


def links(distinct: DataFrame, radius: int = RADIUS, bucket_cap: int = BUCKET_CAP, limit: int = 0) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (fp, pivots) that chains of links join.

    With the columns node and check, edges join nodes, and links are held against ``limit`` bits of
    the wide fingerprint ``check``; salt tells fingerprints of different hash functions apart.
    """
    extra = [c for c in ("node", "check") if c in distinct.columns]
    if radius > 3:
        raise ValueError("the four blocks of LEVELS serve a radius of 3 at most")
    salt = F.col("salt").cast("long") if "salt" in distinct.columns else F.lit(0).cast("long")
    rows = distinct.select(salt.alias("bucket"), "fp", "pivots", F.col("fp").alias("rest"), *extra)
    out = []
    for level, widths in enumerate(LEVELS):
        low, parts = 0, []
        for j, w in enumerate(widths):
            value = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << w) - 1))
            under = F.col("rest").bitwiseAND(F.lit((1 << low) - 1))
            above = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned("rest", low), w), low)
            parts.append(F.struct(F.xxhash64("bucket", F.lit(4 * level + j), value).alias("bucket"), under.bitwiseOR(above).alias("rest")))
            low += w
        rows = rows.select("fp", "pivots", *extra, F.explode(F.array(*parts)).alias("x")).select("x.bucket", "fp", "pivots", "x.rest", *extra)
        hot = rows.groupBy("bucket").count().where(F.col("count") > bucket_cap).select("bucket")
        if level + 1 == len(LEVELS) or hot.isEmpty():
            out.append(bucket_edges(rows, radius, limit))
            break
        hot = written(hot, "hot-buckets")
        out.append(bucket_edges(rows.join(hot, "bucket", "left_anti"), radius, limit))
        rows = written(rows.join(hot, "bucket", "left_semi"), "hot-rows")
    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return edges


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(key, fp, component): the least key that chains of links within ``radius`` bits reach.

    Null and wordless texts have fingerprint 0 and are linked like any other. Repeated rows are
    kept; a row with a null key gets its group's least key, or null if the group has none. An
    empty table gives an empty result; other columns, whatever their names, are ignored; a very long
    text votes in bounded parts.
    """
    return settled(docs.sparkSession, "near-duplicates", lambda: _near_duplicates(docs, key, text, shingle, radius, bucket_cap))


def _near_duplicates(docs: DataFrame, key: str, text: str, shingle: int, radius: int, bucket_cap: int) -> DataFrame:
    each = written(fingerprints(docs, key, text, shingle).select(F.col(key).alias("k"), "fp", "pivots"), "fingerprints")
    distinct = written(each.groupBy("fp").agg(F.min("k").alias("least"), F.first("pivots").alias("pivots")), "distinct")
    roots = connected_components(links(distinct, radius, bucket_cap))
    by_fp = with_component(distinct.select("fp", "least"), roots.select(F.col("node").alias("fp"), "root"), "fp")
    return looked_up(each.select("k", "fp"), by_fp, "fp").select(F.col("k").alias(key), "fp", "component")


def with_component(distinct: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(node, component), written, of (node, least) and the (node, root) of those that have links: the least key of each root's nodes.

    Only linked nodes are grouped; a giant component's nodes are dealt over several tasks.
    """
    members = distinct.join(roots, node).select(node, "least", "root")
    whole = members.groupBy("root").agg(F.min("least").alias("component"))
    alone = distinct.join(roots, node, "left_anti").select(node, F.col("least").alias("component"))
    return written(salted(members, whole, "root").select(node, "component").unionByName(alone), "by-node")


#: Fingerprints of one text in the similarity mode, bits of the fingerprint that verifies, and how
#: far beyond the expected number of differing bits (in standard deviations) a pair still links.
TABLES, CHECK_WORDS, SLACK = 8, 4, 1.0
#: How much below the similarity a SimHash link may be for all that the sketches tell.
LOOSE = 0.1
_SPREAD = np.array([xxhash.xxh64_intdigest(f"table {i}", 11) | 1 for i in range(TABLES)], np.uint64)


def _spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """One 64-bit hash as ``words`` of them: odd multiples, finalized as SplitMix64 does."""
    many = hashes[:, None] * _SPREAD[None, :words]
    many ^= many >> np.uint64(30)
    many *= np.uint64(0xBF58476D1CE4E5B9)
    many ^= many >> np.uint64(27)
    many *= np.uint64(0x94D049BB133111EB)
    return many ^ (many >> np.uint64(31))


def wide_fingerprints(text: str | None, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(TABLES words over words, CHECK_WORDS words over shingles) of a text; zeros without words.

    The first ones vote by words, weighted by their length, so that a few edits flip few bits; the
    second votes by shingles and measures what the similarity is about.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(TABLES, np.uint64), np.zeros(CHECK_WORDS, np.uint64)
    h = xxhash.xxh64_intdigest
    one = np.fromiter((h(w, 42) for w in words), np.uint64)
    weight = np.minimum(np.fromiter(map(len, words), np.float64, len(words)), 12.0)
    finds = pack_bits(vote_sums(_spread(one, TABLES), weight) * 2 > weight.sum())
    grams = [b" ".join(words)] if len(words) <= shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    many = np.fromiter((h(g, 43) for g in grams), np.uint64)
    return finds, pack_bits(vote_sums(_spread(many, CHECK_WORDS)) * 2 > len(many))


def _word(column: str, i: int) -> F.Column:
    """The i-th eight bytes of a binary column as a number (any order of bytes serves to compare two)."""
    return F.conv(F.hex(F.substring(column, 8 * i + 1, 8)), 16, -10).cast("long")


def bit_limit(similarity: float, bits: int, slack: float = SLACK) -> int:
    """Differing bits of ``bits`` that two texts of this shingle similarity (Jaccard) have, and ``slack`` deviations more."""
    p = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return int(bits * p + slack * (bits * p * (1 - p)) ** 0.5)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)][: len(words)], np.uint64)
    one = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64)
    total = np.zeros(len(words) - shingle + 1, np.uint64)
    for j in range(shingle):
        total += one[j : j + len(total)] * np.uint64(xxhash.xxh64_intdigest(f"place {j}", 11) | 1)
    return np.unique(_spread(total, 1)[:, 0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


#: Against rounding in the bounds below, which may let a pair through but never lose one.
EPS = 1e-9


def prefix(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """32 bits each of a set's first shingles in an order that all texts share: by hash, those in ``common`` last.

    Two sets of this similarity share one of them at least (prefix filter), whatever ``common`` holds.
    """
    if not len(hashes):
        return np.zeros(0, np.int32)
    late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    most = len(hashes) - int(np.ceil(similarity * len(hashes) - EPS)) + 1
    return np.r_[hashes[~late], hashes[late]][:most].astype(np.uint32).view(np.int32)


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of a set's counts by the low bits of its hashes, two to four times as many bits as the set has members.

    Two sets' sketches differ in no more bits than the sets have members apart, so that the
    difference bounds their similarity from above, whatever the sets.
    """
    bits = max(64, 2 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, n: int, m: int, similarity: float) -> bool:
    """False only if the sketches prove that sets of n and m members have less than the similarity."""
    if len(a) < len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    shared = (n + m - (x ^ y).bit_count()) / 2
    return shared * (1 + similarity) >= similarity * (n + m) - EPS


#: One text in SAMPLE is looked at for shingles that stand in at least COMMON of those; at most COMMON_MOST
#: are kept. They only set the order of shingles, so the result does not depend on them.
SAMPLE, COMMON, COMMON_MOST = 64, 8, 1 << 17


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts ``t`` share, so that they open no large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                made = [shingle_set(t, shingle) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64))], ["h"])

    sample = texts.where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0).select("t").distinct()
    found = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    rows = found.orderBy(F.desc("count"), "h").limit(COMMON_MOST).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def crossing_pairs(token: np.ndarray, pos: np.ndarray, size: np.ndarray, node: np.ndarray, root: np.ndarray, similarity: float, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """All distinct pairs of ``crossing_parts`` at once."""
    parts = [np.zeros((0, 2), np.int64), *crossing_parts(token, pos, size, node, root, similarity, most)]
    pairs = np.unique(np.concatenate(parts), axis=0)
    return pairs[:, 0], pairs[:, 1]


def crossing_parts(token: np.ndarray, pos: np.ndarray, size: np.ndarray, node: np.ndarray, root: np.ndarray, similarity: float, most: int = 1 << 17) -> Iterator[np.ndarray]:
    """(node, node) of rows with one token and two roots that can have the similarity, distinct in each part.

    A part comes of about ``most`` pairs of rows, so that memory does not grow with a bucket's pairs.

    A pair is ruled out by the sizes, or by how much can follow the shared token in both sets; the
    bucket of the first token they share never rules out a similar pair. Rows of a bucket's largest
    root come last and open no pairs, so that a group already linked costs nothing by itself.
    """
    order = np.lexsort((root, token))
    token, root = token[order], root[order]
    begins = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (root[1:] != root[:-1])])
    lengths = np.diff(np.r_[begins, len(token)])
    by = np.lexsort((lengths, token[begins]))
    largest = by[np.r_[token[begins][by][1:] != token[begins][by][:-1], True]]
    main = np.zeros(len(begins), bool)
    main[largest] = True
    main = np.repeat(main, lengths)
    again = np.lexsort((main, token))
    order, token, root, main = order[again], token[again], root[again], main[again]
    pos, size, node = pos[order].astype(np.int64), size[order].astype(np.int64), node[order]
    counts = np.where(main, 0, np.searchsorted(token, token, "right") - np.arange(len(token)) - 1)
    for a, b in _chunks(counts, most):
        c = counts[a:b]
        i = np.repeat(np.arange(a, b), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        shared = np.minimum(size[i] - pos[i], size[j] - pos[j])
        can = shared >= (similarity - EPS) * (size[i] + size[j] - shared)
        i, j = i[can], j[can]
        if len(i):
            yield np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1), axis=0)


def likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` that the sketches in ``sets`` (node, sketch, size) do not rule out."""

    @F.arrow_udf("boolean")
    def may(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([may_be_similar(*x, similarity) for x in zip(*(c.to_pylist() for c in (a, b, n, m)))], pa.bool_())

    small = sets.select("node", "sketch", "size")
    met = pairs.join(small.toDF("u", "a", "n"), "u").join(small.toDF("v", "b", "m"), "v")
    return met.where(may("a", "b", "n", "m")).select("u", "v")


def similar_pairs(sets: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): every pair of nodes under different roots whose shingle sets have the similarity, and no other.

    sets: (node, th, size, prefix, sketch, root), one row a node; texts: (th, t), a text's hash and
    the text. Nodes meet by the tokens of their prefixes. Of the pairs that meet, the sketches rule
    out nearly all that are not similar, and no other; the few left are verified on their texts.
    """

    def parts(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for pairs in crossing_parts(*rows, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in range(5)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                yield from parts([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield from parts(held)

    rows = sets.select(F.posexplode("prefix").alias("pos", "token"), "size", "node", "root").select("token", "pos", "size", "node", "root")
    pairs = written(rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "u long, v long").distinct(), "pairs")

    pairs = written(likely(pairs, sets, similarity), "likely-pairs")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    needed = written(sets.join(nodes, "node", "left_semi").select("node", "th"), "pair-nodes")
    if needed.count() <= 1 << 18:
        needed = F.broadcast(needed)
    found = written(texts.join(needed, "th").groupBy("node").agg(F.first("t").alias("t")), "pair-texts")

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([jaccard(shingle_set(x.as_py(), shingle), shingle_set(y.as_py(), shingle)) >= similarity for x, y in zip(a, b)], pa.bool_())

    both = pairs.join(found.toDF("u", "a"), "u").join(found.toDF("v", "b"), "v")
    return both.where(alike("a", "b")).select("u", "v")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(key, node, component): groups of texts whose shingle sets are similar; the least key of each.

    First a pair within RADIUS bits in any of TABLES fingerprints, found through pivot distance
    tables, links by CHECK_WORDS x 64 bits over the shingles, unless the sketches show it to be more
    than LOOSE below the similarity; that joins most copies at little cost, and with them some pairs
    somewhat below the similarity, but misses others. Then every pair that
    is still apart and has the similarity by its exact shingle sets is found and linked
    (``similar_pairs``). Nulls and wordless texts are equal to each other; null keys never are the
    least; repeated rows are in one group; an empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    return settled(docs.sparkSession, "groups", lambda: _similar_groups(docs, key, text, shingle, similarity, bucket_cap))


def _similar_groups(docs: DataFrame, key: str, text: str, shingle: int, similarity: float, bucket_cap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Encoder.release()  # of an earlier packing in the same worker
        refs = pivots()
        for batch in batches:
            for part in slices(batch, "t"):
                made = [wide_fingerprints(t, shingle) for t in part.column(1).to_pylist()]
                fp = np.array([m[0] for m in made], np.uint64)
                table = np.bitwise_count(fp[:, :, None] ^ refs[None, None, :]).astype(np.uint8)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                node = [xxhash.xxh64_intdigest(m[0].tobytes() + m[1].tobytes() + s.tobytes(), 42) for m, s in zip(made, sets)]
                first = [prefix(s, common, similarity) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(fp.view(np.int64).tolist(), pa.list_(pa.int64())), pa.array([r.tobytes() for r in table], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary()), part.column(2), pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.list_(pa.int32())), pa.array([sketch(s) for s in sets], pa.binary())], ["k", "node", "fps", "tables", "check", "th", "size", "prefix", "sketch"])

    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).withColumn("th", F.xxhash64("t"))
    common = common_shingles(src, shingle)
    each = written(src.mapInArrow(run, "k long, node long, fps array<long>, tables binary, check binary, th long, size int, prefix array<int>, sketch binary"), "wide")
    distinct = written(each.groupBy("node").agg(F.min("k").alias("least"), *[F.first(c).alias(c) for c in ("fps", "tables", "check", "th", "size", "prefix", "sketch")]), "wide-distinct")
    n = PIVOTS
    parts = distinct.select("node", "check", "tables", F.posexplode("fps").alias("salt", "fp"))
    parts = parts.select("node", "check", "salt", "fp", F.expr(f"substring(tables, salt * {n} + 1, {n})").alias("pivots"))
    limit = bit_limit(similarity, 64 * CHECK_WORDS)
    # One row for each fingerprint, so that no bucket of the last level can exceed its bound; the
    # other texts under a fingerprint are held against that row's. What this leaves apart, the
    # exact pass finds.
    first = F.min(F.struct("node", "check"))
    heads = written(parts.groupBy("salt", "fp").agg(first.alias("x"), F.first("pivots").alias("pivots"), F.count(F.lit(1)).alias("n")).select("salt", "fp", "pivots", "x.*", "n"), "heads")
    same = parts.join(heads.where("n > 1").select("salt", "fp", F.col("node").alias("v"), F.col("check").alias("vc")), ["salt", "fp"]).where("node <> v")
    bits = sum((F.bit_count(_word("check", i).bitwiseXOR(_word("vc", i))) for i in range(CHECK_WORDS)), F.lit(0))
    edges = links(heads.drop("n"), RADIUS, bucket_cap, limit).unionByName(same.where(bits <= limit).select(F.col("node").alias("u"), "v"))
    roots = connected_components(likely(written(edges.distinct(), "edges"), distinct, similarity - LOOSE))
    sets = distinct.join(roots, "node", "left").select("node", "th", "size", "prefix", "sketch", F.coalesce("root", "node").alias("root"))
    apart = written(similar_pairs(written(sets, "sets"), src.select("th", "t"), shingle, similarity), "similar-pairs")
    roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(apart))
    by_node = with_component(distinct.select("node", "least"), written(roots, "roots"), "node")
    return looked_up(each.select("k", "node"), by_node, "node").select(F.col("k").alias(key), "node", "component")
