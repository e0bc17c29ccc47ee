"""Benchmark decontamination in DataFrame operations: SimHash of item-sized windows.

Texts and items are lower-cased and cut into words at whatever is neither a letter, a mark nor a
digit. A window has as many words as the item it is held against, and is compared by its word
shingles (five words; all words of a shorter item) as a weighted set: a shingle weighs as often as
it occurs, and similarity is the sum of lesser weights over the sum of greater ones.

1. A window that is similar to an item by 0.8 has a shingle of an item of its size at 0.8 of its
   places at least. Shingles of all whole texts meet the items' shingles, and windows are made at
   the starts from which that holds; which item it may be is left open.
2. Each such window has a SimHash of its shingles' hashes. Windows and items of one size meet where
   one of RADIUS + 1 blocks of bits is equal: by the pigeonhole principle this index finds every
   (window, item) within RADIUS bits. A pair counts at the first of its equal blocks, so once.
3. The pairs found are verified by the exact weighted similarity.

The radius is wide, as the exact similarity decides: windows at 0.8 differ in about 10 of 64 bits,
with a deviation of 3, and in more than RADIUS about once in a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanloom.llm.common import written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BITS = 64
#: Items' shingles (long integers) and fingerprints that are broadcast; more of them are shuffled.
MOST_BROADCAST = 500_000


def words_of(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def shingle_hashes(words: Column, width: int) -> Column:
    """XXH64 of every run of ``width`` words, in order; empty if there are fewer."""
    n = F.size(words) - width + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(*[F.get(words, i + j - 1) for j in range(width)]))
    return F.when(n >= 1, runs).otherwise(F.array().cast("array<bigint>"))


def hashes_by_width(text: Column, widths: list[int]) -> Column:
    """Array of (width, h), the hashes of each width's shingles; the words are cut once, through a one-element array."""
    made = F.transform(F.array(words_of(text)), lambda w: F.array(*[F.struct(F.lit(k).alias("width"), shingle_hashes(w, k).alias("h")) for k in widths]))
    return made[0]


def simhash(hashes: Column, most: int) -> Column:
    """Majority of the bits of an array of at most ``most`` hashes; ties are zero.

    Lane by lane: with counters of 16 bits, sum s adds up bits s, s + 16, s + 32 and s + 48 in four
    lanes of a long integer; beyond 65,535 hashes the counters have 32 bits.
    """
    bits = 16 if most < 1 << 16 else 32
    ones = sum(1 << k for k in range(0, 64, bits))
    word, half = F.lit(0).cast("long"), F.size(hashes)
    for s in range(bits):
        lanes = _lane_sums(hashes, s, ones)
        for k in range(64 // bits):
            count = F.shiftrightunsigned(lanes, bits * k).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            bit = 1 << (s + bits * k)
            word = word.bitwiseOR(F.when(count * 2 > half, F.lit(bit if bit < 1 << 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return word


def _lane_sums(hashes: Column, s: int, ones: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, s).bitwiseAND(F.lit(ones)))


def blocks(fp: str, radius: int = RADIUS) -> Column:
    """(block, value) structs of radius + 1 blocks of the fingerprint's bits."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def first_equal_block(a: str, b: str, radius: int = RADIUS) -> Column:
    """The number of the first block in which two fingerprints agree."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    differ = F.col(a).bitwiseXOR(F.col(b))
    return F.coalesce(*[F.when(F.shiftrightunsigned(differ, x).bitwiseAND(F.lit((1 << (y - x)) - 1)) == 0, i) for i, (x, y) in enumerate(zip(edges, edges[1:]))])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of hashes as multisets, both sorted or not: sum of minima over sum of maxima."""
    common = F.aggregate(
        F.array_intersect(a, b),
        F.lit(0),
        lambda n, h: n + F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h))),
    )
    return common / (F.size(a) + F.size(b) - common)


def prepared(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, n, width, h): distinct items with a word at least; n words, h their shingles' hashes."""
    rows = items.select(F.col(key).alias("item"), words_of(F.col(text).cast("string")).alias("w")).where(F.size("w") > 0)
    rows = rows.dropDuplicates(["item", "w"]).withColumn("n", F.size("w")).withColumn("width", F.least(F.lit(SHINGLE), "n"))
    hashes = F.when(F.col("width") == 1, shingle_hashes(F.col("w"), 1))
    for width in range(2, SHINGLE + 1):
        hashes = hashes.when(F.col("width") == width, shingle_hashes(F.col("w"), width))
    # A text with several versions of one item counts as the item; the versions have numbers.
    number = F.row_number().over(Window.partitionBy("item").orderBy("w"))
    return rows.withColumn("version", number).withColumn("h", hashes).drop("w")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, item key, similarity, start_word, n_words): texts that hold an item, one row a pair.

    The best window of each pair, the first of equals. Null and empty texts hold nothing; a null
    key is a key; repeated rows, and texts of one key, give a pair once; empty tables give an empty
    result; other columns, whatever their names, are ignored. Items without a word are left out,
    and an item with several texts is found by any of them. Very long texts are cut into words
    whole; a row carries one text's matching places, never those of several.
    """
    known = written(prepared(items, item_key, item_text), "items")
    stats = known.agg(F.count(F.lit(1)).alias("items"), F.max(F.size("h")).alias("most"), F.collect_set("width").alias("widths")).first()
    if not stats["items"]:
        kinds = [docs.select(F.col(key).alias(key)).schema[0], items.select(F.col(item_key).alias(item_key)).schema[0]]
        return docs.sparkSession.createDataFrame([], T.StructType(kinds).add("similarity", T.DoubleType()).add("start_word", T.IntegerType()).add("n_words", T.IntegerType()))
    widths = sorted(stats["widths"])  # SHINGLE at most
    sizes = written(known.select("n", "width", F.explode("h").alias("x")).distinct(), "sizes")
    few = stats["items"] * (radius + 1) <= MOST_BROADCAST and sizes.count() <= MOST_BROADCAST
    small = F.broadcast if few else lambda x: x

    # Places of each text at which a shingle of some item of n words stands.
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    seen = rows.select("k", F.xxhash64("t").alias("v"), F.explode(hashes_by_width(F.col("t"), widths)).alias("w")).select("k", "v", "w.width", F.posexplode("w.h").alias("at", "x"))
    met = seen.join(small(sizes), ["width", "x"]).groupBy("k", "v", "n", "width").agg(F.array_sort(F.collect_set("at")).alias("spots"))
    met = met.withColumn("m", F.col("n") - F.col("width") + 1).withColumn("need", F.ceil(F.col("m") * F.lit(similarity) - 1e-9).cast("int")).where(F.size("spots") >= F.col("need"))
    # From the start s, ``need`` of them lie inside if the i-th is not before s and the one ``need`` - 1 on is not behind the end.
    first = F.transform(F.sequence(F.lit(0), F.size("spots") - F.col("need")), lambda i: F.struct(F.greatest(F.lit(0), F.get("spots", i + F.col("need") - 1) - F.col("m") + 1).alias("low"), F.get("spots", i).alias("high")))
    ranges = F.filter(first, lambda r: r["low"] <= r["high"])
    met = written(met.withColumn("ranges", ranges).where(F.size("ranges") > 0).select("k", "v", "n", "width", "m", "ranges"), "places")

    # Windows of those texts, and their fingerprints.
    which = met.select(F.col("k").alias("pk"), F.col("v").alias("pv")).distinct()
    texts = rows.withColumn("v", F.xxhash64("t")).join(which, F.col("k").eqNullSafe(F.col("pk")) & (F.col("v") == F.col("pv")), "left_semi").dropDuplicates(["k", "v"])
    hashed = texts.select(F.col("k").alias("tk"), F.col("v").alias("tv"), F.explode(hashes_by_width(F.col("t"), widths)).alias("w")).select("tk", "tv", F.col("w.width").alias("tw"), F.col("w.h").alias("h"))
    sized = met.join(hashed, F.col("k").eqNullSafe(F.col("tk")) & (F.col("v") == F.col("tv")) & (F.col("width") == F.col("tw")))
    last = F.greatest(F.lit(0), F.size("h") - F.col("m"))
    starts = F.array_distinct(F.transform(F.flatten(F.transform("ranges", lambda r: F.sequence(r["low"], r["high"]))), lambda s: F.least(s, last)))
    windows = sized.select("k", "v", "n", "m", "h", F.explode(starts).alias("start")).select("k", "v", "n", "start", F.expr("slice(h, start + 1, m)").alias("wh"))
    windows = written(windows.withColumn("fp", simhash(F.col("wh"), stats["most"])), "windows")

    # The block index: windows meet the items of their size.
    prints = known.select("item", "version", "n", simhash(F.col("h"), stats["most"]).alias("ifp")).select("*", F.explode(blocks("ifp", radius)).alias("b"))
    index = windows.select(F.col("k").alias("ck"), F.col("v").alias("cv"), F.col("start").alias("cs"), F.col("n"), "fp", F.explode(blocks("fp", radius)).alias("b"))
    near = index.join(small(prints), ["n", "b"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).where(F.col("b.block") == first_equal_block("fp", "ifp", radius))
    near = near.select("ck", "cv", "cs", F.col("n").alias("cn"), F.col("item").alias("ci"), F.col("version").alias("cver"))
    pairs = near.join(windows, F.col("ck").eqNullSafe(F.col("k")) & (F.col("cv") == F.col("v")) & (F.col("cs") == F.col("start")) & (F.col("cn") == F.col("n"))).select("k", "start", "n", "wh", "ci", "cver")
    pairs = pairs.join(small(known.select("item", "version", F.col("h").alias("ih"))), F.col("ci").eqNullSafe(F.col("item")) & (F.col("cver") == F.col("version")))
    exact = pairs.withColumn("similarity", weighted_similarity(F.col("wh"), F.col("ih"))).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.col("n")))
    found = exact.groupBy("k", "item").agg(best.alias("x"))
    return found.select(F.col("k").alias(key), F.col("item").alias(item_key), F.col("x.similarity").alias("similarity"), (-F.col("x.s")).alias("start_word"), F.col("x.n").alias("n_words"))
