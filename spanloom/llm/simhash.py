"""SimHash over term hashes: votes on signed bits, likeness, and permuted block tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def vote_sums(hashes: np.ndarray, weights: np.ndarray | None = None, rows: int = 1 << 12) -> np.ndarray:
    """Weight of the hashes that have each bit set, lowest bit first.

    ``hashes``: uint64, shape (n,) for 64 bits or (n, k) for 64 k bits. Works on histograms of
    byte values, ``rows`` hashes at a time, so memory does not grow with a text.
    """
    h = hashes.reshape(len(hashes), -1)
    width = h.shape[1] * 8
    offsets = (np.arange(width) * 256)[None, :]
    total = np.zeros(width * 256)
    for i in range(0, len(h), rows):
        part = np.ascontiguousarray(h[i : i + rows]).view(np.uint8).reshape(-1, width) + offsets
        w = None if weights is None else np.repeat(weights[i : i + rows], width)
        total += np.bincount(part.ravel(), weights=w, minlength=width * 256)
    return (total.reshape(width, 256) @ _BITS).ravel()


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Booleans, lowest bit first, as uint64 words."""
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def hex_words(words: np.ndarray) -> str:
    """Words as hex digits, highest word first."""
    return "".join(f"{int(w):016x}" for w in words[::-1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine that the share of differing bits stands for, from 0 to 1."""
    share = int(np.bitwise_count(a ^ b).sum()) / (64 * len(a))
    return 1.0 if share == 0 else max(0.0, math.cos(math.pi * share))


def block_bounds(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``blocks`` blocks as even as can be."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_tables(df: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Adds (table, block): every fingerprint once for each of radius + 1 blocks of its bits.

    Table t is the permutation that brings block t to the front; by the pigeonhole principle two
    fingerprints with at most ``radius`` differing bits agree on the whole of one block at least.
    ``words``: columns with 64 bits each, lowest first. A block may cross words.
    """
    parts = []
    for first, width in block_bounds(64 * len(words), radius + 1):
        pieces, at = [], first
        while at < first + width:
            k, low = divmod(at, 64)
            take = min(64 - low, first + width - at)
            pieces.append(F.shiftrightunsigned(words[k], low).bitwiseAND(F.lit((1 << take) - 1 if take < 64 else -1)))
            at += take
        parts.append(F.concat_ws(":", *[p.cast("string") for p in pieces]))
    return df.select("*", F.posexplode(F.array(*parts)).alias("table", "block"))


def within_radius(fingerprints: DataFrame, queries: DataFrame, words: list[str], radius: int) -> DataFrame:
    """All distinct fingerprints within ``radius`` bits of each distinct query fingerprint.

    Both frames have the 64-bit columns ``words``; returns q_<word>, <word> and distance. Equal
    fingerprints are joined once, whatever the number of documents that have them.
    """
    left = block_tables(queries.select(*words).dropna().distinct(), words, radius)
    left = left.select("table", "block", *[F.col(w).alias(f"q_{w}") for w in words])
    right = block_tables(fingerprints.select(*words).dropna().distinct(), words, radius)
    distance = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"q_{w}"))) for w in words[1:]), F.bit_count(F.col(words[0]).bitwiseXOR(F.col(f"q_{words[0]}"))))
    near = left.join(right, ["table", "block"]).withColumn("distance", distance).where(F.col("distance") <= radius)
    return near.select(*[f"q_{w}" for w in words], *words, "distance").distinct()
