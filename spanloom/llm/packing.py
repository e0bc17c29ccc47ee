"""Best-fit packing of token pieces into fixed-length sequences by minimum bin slack.

A document's ids and its end id are cut into pieces of at most ``size`` tokens; only the first may
be shorter. For each bin, a bitset subset-sum table over the lengths that are left tells the
fullest fill that can be reached; the combination is traced back and removed. Bins of one pattern
are made together: as many as the counts allow, so that the work depends on the number of lengths
(at most ``size``), not of pieces. Only the counts by length reach the driver.

Pieces find their place by their number within their length: the table of pieces carries a running
number within (shard, length), the shards' counts give each shard its offset, and the plan says
which numbers of a length go to which bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import scratch, slices, write
from spanloom.llm.tokens import CACHE, Encoder, vocabulary_json

SIZE = 1024


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % size or size
    return [(0, min(first, n)), *((at, size) for at in range(first, n, size))] if n else []


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """Lengths (each as often as used) with the largest sum up to ``size``, longest lengths first.

    Bit s of the table after the i-th length is set if the first i lengths can sum to s. A length
    of count c enters as powers of two, the usual reduction of a bounded subset sum.
    """
    items, tables = [], [1]
    mask = (1 << (size + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, step = min(counts[length], size // length), 1
        while left:
            take = min(step, left)
            items.append((length, take))
            tables.append((tables[-1] | tables[-1] << (length * take)) & mask)
            left -= take
            step *= 2
        if tables[-1] >> size & 1:
            break
    total, used = tables[-1].bit_length() - 1, {}
    for i in range(len(items), 0, -1):
        if not tables[i - 1] >> total & 1:
            length, take = items[i - 1]
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """[(bins, {length: how often in each})] that use all of ``counts`` up.

    Every bin starts from the longest length that is left (the bin's anchor), and is filled to the
    least slack that the others allow.
    """
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        anchor = max(left)
        rest = dict(left)
        rest[anchor] -= 1
        rest = {k: v for k, v in rest.items() if v and k <= size - anchor}
        used = fullest(rest, size - anchor) if rest else {}
        used[anchor] = used.get(anchor, 0) + 1
        bins = min(left[k] // v for k, v in used.items())
        out.append((bins, used))
        for k, v in used.items():
            left[k] -= bins * v
            if not left[k]:
                del left[k]
    return out


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first number, last number, each, first bin, offset of the first, id of the range)."""
    rows, seen, first_bin = [], {}, 0
    for bins, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            each = used[length]
            begin = seen.get(length, 0)
            rows.append((length, begin, begin + bins * each - 1, each, first_bin, offset, len(rows)))
            seen[length] = begin + bins * each
            offset += length * each
        first_bin += bins
    return rows


def write_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 2, size: int = SIZE, vocabulary: str | None = None, cache: int = CACHE) -> str:
    """Encode whole texts and write their pieces to the shared folder; returns the path.

    Columns: k, piece, start, length, ids (little-endian unsigned 16 or 32 bits), width (bytes of
    an id), shard, number (running, within shard and length).
    """
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary_json(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocab.value, cache)
        end = np.array([end_id], encoder.dtype)
        shard = TaskContext.get().partitionId()
        numbers: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                cols: list[list] = [[] for _ in range(6)]
                for k, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for i, (at, n) in enumerate(cut_points(len(ids), size)):
                        number = numbers.get(n, 0)
                        numbers[n] = number + 1
                        for c, x in zip(cols, (k, i, at, n, ids[at : at + n].tobytes(), number)):
                            c.append(x)
                m = len(cols[0])
                types = (kind, pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(cols, types)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([encoder.dtype.itemsize] * m, pa.int32()), pa.array([shard] * m, pa.int32())], ["k", "piece", "start", "length", "ids", "number", "width", "shard"])

    kind = pa.int64()
    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    path = scratch(spark, "pieces")
    write(src.mapInArrow(run, "k long, piece int, start long, length int, ids binary, number long, width int, shard int"), path, compression="zstd")
    return path


PIECES = "k long, piece int, start long, length int, ids binary, number long, width int, shard int"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 2, size: int = SIZE, vocabulary: str | None = None, as_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids, width, sequence_id, offset): every piece and its place.

    Without ``as_ids``, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) is taken
    from the written pieces and stands for ids and width, so that no ids are shuffled. A null text is empty and has one piece, the end id. Repeated rows are packed as often as they
    occur; null keys stay null; equal lengths are placed in the order of their shards and rows. An
    empty table gives an empty result; other columns, whatever their names, are ignored; a very long
    text is encoded whole and cut. Sequences are gapless from 0.
    """
    spark = docs.sparkSession
    path = write_pieces(docs, key, text, end_id, size, vocabulary)
    pieces = spark.read.schema(PIECES).parquet(path)
    by_shard = pieces.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_shard.withColumn("before", F.coalesce(before, F.lit(0)))
    # At most ``size`` lengths, each a few ranges: patterns end when one of their lengths is used up.
    ranges = places(plan_bins(counts, size))
    plan = spark.createDataFrame(ranges, "length int, first long, last long, each long, bin long, begin long, r long")
    by_length = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "last", "each", "bin", "begin"))).alias("ranges"))
    # Each shard's numbers of a length start at ``before``; both small tables meet first.
    local = offsets.join(F.broadcast(by_length), "length").select("shard", "length", "before", "ranges")
    content = ["ids", "width"] if as_ids else ["ids_crc32"]
    narrow = (pieces if as_ids else digest(pieces)).join(local, ["shard", "length"])
    number = F.col("number") + F.col("before")
    found = F.filter("ranges", lambda r: (r["first"] <= number) & (number <= r["last"]))[0]
    placed = narrow.withColumn("n", number).withColumn("r", found)
    within = F.col("n") - F.col("r.first")
    return placed.select(
        F.col("k").alias(key), "piece", "start", F.col("length").cast("long").alias("length"), *content,
        (F.col("r.bin") + F.expr("(n - r.first) div r.each")).alias("sequence_id"),
        (F.col("r.begin") + F.pmod(within, F.col("r.each")) * F.col("length")).cast("long").alias("offset"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32, of the ids as unsigned 32-bit integers, in place of ids and width."""
    names = [f.name for f in pieces.schema if f.name not in ("ids", "width")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, width = b.column("ids"), b.column("width").to_pylist()
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4").tobytes()) for x, w in zip(ids, width)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    schema = ", ".join([*(f"`{n}` {pieces.schema[n].dataType.simpleString()}" for n in names), "ids_crc32 long"])
    return pieces.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, width): the packed sequences themselves."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.max("width").alias("width"))
    return whole.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "width")
