"""Token-id shards whose blocks are shuffled into bit or byte planes and compressed.

A shard is one file::

    magic "SLTOK1" | header length (u32) | header (JSON) | frames ... | index | index length (u64)

Ids are cut into chunks of a fixed number of ids. A chunk is transposed into planes: plane b holds
bit b (or byte b) of every id, so that the slowly varying high planes compress well. Planes above
the largest id of the chunk are left out. Each plane is one zstandard frame. The index, a
zstandard frame itself, has a row for each chunk (offset, ids, bytes of each plane) and a row for
each document (key, ids), so that a reader can fetch a range of ids without the rest.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanloom.llm.common import range_ids, scratch, shuffle_partitions, slices, write
from spanloom.llm.tokens import CACHE, Encoder, vocabulary_json

MAGIC = b"SLTOK1"
CHUNK_IDS = 1 << 16
SHARD_IDS = 1 << 24
LEVEL = 3


def transposed(words: np.ndarray) -> np.ndarray:
    """8 x 8 bit matrices, one in each 64-bit word, transposed (three rounds of masked swaps)."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (words ^ (words >> np.uint64(shift))) & np.uint64(mask)
        words = words ^ t ^ (t << np.uint64(shift))
    return words


def to_planes(ids: np.ndarray, planes: str = "bit") -> list[bytes]:
    """Planes of a chunk, lowest first; none if all ids are zero. In a bit plane the first id is the lowest bit."""
    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max(initial=0)).bit_length()
    octets = ids.view(np.uint8).reshape(-1, 4)[:, : (bits + 7) // 8]
    out = []
    for i in range(octets.shape[1]):
        if planes == "byte":
            out.append(octets[:, i].tobytes())
        else:
            line = np.zeros(-(-len(ids) // 8) * 8, np.uint8)
            line[: len(ids)] = octets[:, i]
            turned = transposed(line.view("<u8")).astype("<u8").view(np.uint8).reshape(-1, 8)
            out += [turned[:, b].tobytes() for b in range(min(8, bits - 8 * i))]
    return out


def from_planes(frames: list[bytes], n: int, planes: str = "bit") -> np.ndarray:
    """The ids of a chunk of ``n`` ids."""
    octets = np.zeros((n, 4), np.uint8)
    if planes == "byte":
        for i, f in enumerate(frames):
            octets[:, i] = np.frombuffer(f, np.uint8)
    else:
        for i in range(0, len(frames), 8):
            turned = np.zeros((-(-n // 8), 8), np.uint8)
            for b, f in enumerate(frames[i : i + 8]):
                turned[:, b] = np.frombuffer(f, np.uint8)
            octets[:, i // 8] = transposed(turned.view("<u8").ravel()).astype("<u8").view(np.uint8)[:n]
    return octets.view("<u4").ravel()


def pack_shard(keys: list[int | None], docs: list[np.ndarray], shard: int, part: int, planes: str = "bit", chunk: int = CHUNK_IDS, level: int = LEVEL) -> bytes:
    """Bytes of a shard file with the documents' ids, end to end."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    ids = np.concatenate(docs) if docs else np.zeros(0, "<u4")
    head = json.dumps({"shard": shard, "part": part, "planes": planes, "chunk": chunk, "ids": len(ids), "docs": len(docs)}).encode()
    out = [MAGIC, struct.pack("<I", len(head)), head]
    at, chunks = sum(map(len, out)), []
    for i in range(0, len(ids), chunk):
        frames = [squeeze(p) for p in to_planes(ids[i : i + chunk], planes)]
        chunks.append([at, min(chunk, len(ids) - i), [len(f) for f in frames]])
        out += frames
        at += sum(map(len, frames))
    index = squeeze(json.dumps({"chunks": chunks, "keys": keys, "sizes": [len(d) for d in docs]}).encode())
    return b"".join([*out, index, struct.pack("<Q", len(index))])


def open_shard(data: bytes) -> tuple[dict, dict]:
    """(header, index) of a shard's bytes."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    (n,) = struct.unpack_from("<I", data, len(MAGIC))
    at = len(MAGIC) + 4
    (m,) = struct.unpack_from("<Q", data, len(data) - 8)
    return json.loads(data[at : at + n]), json.loads(zstandard.ZstdDecompressor().decompress(data[len(data) - 8 - m : len(data) - 8]))


def read_ids(data: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids begin to end of a shard; only the chunks that hold them are unpacked."""
    head, index = open_shard(data)
    end = head["ids"] if end is None else min(end, head["ids"])
    if begin >= end:
        return np.zeros(0, "<u4")
    unpack, made = zstandard.ZstdDecompressor().decompress, []
    first = begin // head["chunk"]
    for at, n, sizes in index["chunks"][first : (end - 1) // head["chunk"] + 1]:
        frames = []
        for size in sizes:
            frames.append(unpack(data[at : at + size]))
            at += size
        made.append(from_planes(frames, n, head["planes"]))
    return np.concatenate(made)[begin - first * head["chunk"] : end - first * head["chunk"]]


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all: attempts at one name leave one file with the same bytes."""
    if "://" in folder or folder.startswith("file:"):
        fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    else:
        fs, path = pafs.LocalFileSystem(), os.path.abspath(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{path}/{name}")


def write_tokens(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0, vocabulary: str | None = None, planes: str = "bit", shard_ids: int = SHARD_IDS, cache: int = CACHE) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, write shards in ascending key order.

    Documents are dealt by key ranges, one per shuffle partition, and sorted in each; a range of
    more than ``shard_ids`` ids has several parts. Equal keys are ordered by text, null keys come
    first. A null text is empty; an empty table gives no shard; other columns, whatever their names,
    are ignored. Returns the manifest that was written beside the shards:
    (shard, part, docs, ids, base), base being the ids before the shard part.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    vocab = spark.sparkContext.broadcast(vocabulary_json(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocab.value, cache)
        end = np.array([end_id], "<u4")
        keys, rows, total, shard, part = [], [], 0, None, 0

        def flush():
            nonlocal keys, rows, total, part
            put(folder, f"shard-{shard:06d}-{part:04d}.tok", pack_shard(keys, rows, shard, part, planes))
            made = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([total], pa.int64())], ["shard", "part", "docs", "ids"])
            keys, rows, total, part = [], [], 0, part + 1
            return made

        for batch in batches:
            for piece in slices(batch, "t"):
                ids = encoder.encode(piece.column(2).to_pylist())
                for s, k, x in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), ids):
                    if rows and (s != shard or total >= shard_ids):
                        yield flush()
                    if s != shard:
                        shard, part = s, 0
                    keys.append(k)
                    rows.append(np.concatenate([x.astype("<u4"), end]))
                    total += len(x) + 1
        if rows:
            yield flush()

    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    dealt = range_ids(src, "k", n, "s").select("s", "k", "t").repartitionById(n, F.col("s")).sortWithinPartitions("s", F.asc_nulls_first("k"), "t")
    write(dealt.mapInArrow(run, "shard int, part int, docs long, ids long"), f"{folder}/_counts")
    counts = spark.read.schema("shard int, part int, docs long, ids long").parquet(f"{folder}/_counts")
    # One row for each shard file: the running sum is over shards, never over documents.
    before = F.sum("ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    counts.withColumn("base", F.coalesce(before, F.lit(0))).write.parquet(f"{folder}/_manifest")
    return spark.read.schema("shard int, part int, docs long, ids long, base long").parquet(f"{folder}/_manifest")


def read_tokens(spark, folder: str, as_ids: bool = True) -> DataFrame:
    """Documents of a folder of shards: (key, start, n_tokens, ids_crc32) and, if asked for, ids.

    The shards are read through Spark's binaryFile source, whatever store they are in. start: ids
    of all documents before. ids_crc32: over little-endian unsigned 32-bit ids.
    """
    fields = [T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if as_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer().to_pybytes()
                head, index = open_shard(data)
                ids = read_ids(data)
                ends = np.cumsum(np.array(index["sizes"], np.int64))
                starts = np.r_[0, ends[:-1]] if len(ends) else ends
                raw = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                n = len(raw)
                cols = [pa.array([head["shard"]] * n, pa.int32()), pa.array([head["part"]] * n, pa.int32()), pa.array(index["keys"], pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(raw, pa.binary())] if as_ids else [])], [f.name for f in fields])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("content")
    docs = files.mapInArrow(run, T.StructType(fields))
    base = spark.read.schema("shard int, part int, docs long, ids long, base long").parquet(f"{folder}/_manifest").select("shard", "part", "base")
    return docs.join(base, ["shard", "part"]).withColumn("start", F.col("base") + F.col("at")).drop("shard", "part", "base", "at")


def token_table(docs: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 0, vocabulary: str | None = None, planes: str = "bit") -> DataFrame:
    """Write ``docs`` to a new folder of the shared directory and read the documents back."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    write_tokens(docs, folder, key, text, end_id, vocabulary, planes)
    return read_tokens(spark, folder, as_ids=False)
