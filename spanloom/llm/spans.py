"""Substring dedup by sliding sentence spans.

A text is cut into sentence units: after . ! ? or an ellipsis that stands before white space, and
at line ends. A sentence of more than LONG words is cut further by winnowing: after the word of the
least hash of any WINDOW words in a row, so that no piece is longer, and where a passage begins
inside a long sentence matters only up to WINDOW words. A span starts at every unit and runs over
consecutive units (at least LEAST_UNITS) until it has LEAST_WORDS words. Two texts that share 50
words share a whole span of them, wherever they stand: both cut after one of their first LONG or
WINDOW words, and alike from there up to the last WINDOW words or the last, unfinished sentence.
What stands before the first and after the last shared cut stays. Spans are hashed (case folded,
white space joined) and joined globally. Of the spans with one hash, the first by (key, version of
the text, position) stays; units that any other one covers are removed from their texts, and the
rest of the text stays as it is. Shorter repeats (single lines of under LEAST_WORDS words) stay.

Counting is a map-side aggregation, so a passage that a third of all documents hold is one row per
task before the shuffle; only spans that repeat are joined back, against one row for each hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import settled, slices, written

LEAST_UNITS, LEAST_WORDS = 2, 20
LONG = 12
#: A power of two; 3 * WINDOW + LEAST_WORDS - 1 is at most 50.
WINDOW = 8
#: Stands for a null key.
LAST = 2**63 - 1
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?…]+(?=\s)|(?=\n)|$)\s*", re.S)
_TOKEN = re.compile(r"\S+")


def cuts(words: list[str]) -> set[int]:
    """Places of the words that a long sentence is cut after; of equal hashes in a window, the first counts."""
    xxh = xxhash.xxh32_intdigest
    least = [xxh(w.lower().encode("utf-8", "surrogatepass")) << 32 | i for i, w in enumerate(words)]
    step = 1
    while step < WINDOW:
        least = list(map(min, least, least[step:]))
        step *= 2
    return {x & 0xFFFFFFFF for x in least}


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(begin, end, words) of each unit; ends include the white space that follows."""
    out = []
    at = len(text) - len(text.lstrip())
    while at < len(text):
        m = _SENTENCE.match(text, at)
        end = m.end() if m.end() > at else len(text)
        words = text[at:end].split()
        if not words:
            out[-1] = (out[-1][0], end, out[-1][2])
        elif len(words) <= LONG:
            out.append((at, end, words))
        else:
            begin, held = at, []
            spots = list(_TOKEN.finditer(text, at, end))
            after = cuts([t.group() for t in spots])
            for i, t in enumerate(spots):
                held.append(t.group())
                last = i + 1 == len(spots)
                if last or i in after:
                    stop = end if last else spots[i + 1].start()
                    out.append((begin, stop, held))
                    begin, held = stop, []
        at = end
    if out:
        out[0] = (0, *out[0][1:])
    return out


def spans(cut: list[tuple[int, int, list[str]]], least_units: int = LEAST_UNITS, least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """(first, last) unit of the span that starts at each unit, as far as the text reaches."""
    sizes = [len(w) for _, _, w in cut]
    out, last, total = [], -1, 0
    for first in range(len(cut)):
        while last + 1 < len(cut) and (total < least_words or last - first + 1 < least_units):
            last += 1
            total += sizes[last]
        if total < least_words or last - first + 1 < least_units:
            break
        out.append((first, last))
        total -= sizes[first]
    return out


def span_hashes(text: str | None, least_units: int = LEAST_UNITS, least_words: int = LEAST_WORDS) -> tuple[list[int], list[int], list[int]]:
    """(hashes as signed 64-bit, first units, last units)."""
    cut = units(text) if text else []
    keys = [" ".join(w).lower().encode("utf-8", "surrogatepass") for _, _, w in cut]
    h, first, last = [], [], []
    for a, b in spans(cut, least_units, least_words):
        h.append(xxhash.xxh64_intdigest(b"\n".join(keys[a : b + 1]).replace(b"\n", b" ")))
        first.append(a)
        last.append(b)
    return np.array(h, np.uint64).view(np.int64).tolist(), first, last


def without(text: str, repeats: list[int], least_units: int = LEAST_UNITS, least_words: int = LEAST_WORDS) -> tuple[str, int]:
    """The text without the units of the spans that start at ``repeats``, and how many those are."""
    cut = units(text)
    found, gone = set(repeats), np.zeros(len(cut) + 1, np.int64)
    for a, b in spans(cut, least_units, least_words):
        if a in found:
            gone[a] += 1
            gone[b + 1] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return "".join(text[a:b] for (a, b, _), g in zip(cut, gone) if not g), int(gone.sum())


#: Bits of a text's hash that tell texts of one key apart, beside the unit's number in one integer.
VERSION_BITS = 31


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least_units: int = LEAST_UNITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(k, at): spans other than the first of their hash; at: first unit and version of the text, packed.

    Within a text the first occurrence counts, and the others are known at once; between texts the
    least (key, version) keeps the span, version being a hash of the text; null keys come last.
    Rows with one key and different texts are so different documents; rows alike in both are one.
    Only the hash, the key and ``at`` are shuffled; a span's end follows from its start. Where no
    key has two texts the key alone is the order, and spares the aggregation the wide numbers.
    """
    t = F.col(text).cast("string")
    src = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("k"), version(t).alias("v"), t.alias("t")).where("t is not null")
    several = not src.groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            for part in slices(batch, "t"):
                cols: list[list] = [[] for _ in kinds]
                for k, v, t in zip(*(part.column(i).to_pylist() for i in range(3))):
                    seen: set[int] = set()
                    for h, a, _ in zip(*span_hashes(t, least_units, least_words)):
                        for c, x in zip(cols, (k, a << VERSION_BITS | v, h, h in seen)):
                            c.append(x)
                        seen.add(h)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["k", "at", "h", "again"])

    found = written(src.mapInArrow(run, "k long, at long, h long, again boolean"), "spans", compression="zstd")
    place = f"cast(k as decimal(20,0)) * cast({1 << VERSION_BITS} as decimal(10,0)) + cast(at & {(1 << VERSION_BITS) - 1} as decimal(10,0))"
    order = F.expr(place) if several else F.col("k")
    heads = found.where("not again").groupBy("h").agg(F.min(order).alias("head"), F.max(order).alias("tail")).where("head < tail").select("h", "head")
    later = found.where("not again").join(heads, "h").where(order > F.col("head"))
    return later.select("k", "at").unionByName(found.where("again").select("k", "at"))


def version(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << VERSION_BITS) - 1))


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_units: int = LEAST_UNITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated spans taken out of ``text``, and removed_units, removed_chars added.

    Every row stays, with all its columns; a text that repeats as a whole becomes empty. Null and
    empty texts stay as they are, with nothing removed. What is first is told by key, then by the
    hash of the text: rows of one key but different texts are different documents, and so are
    those with a null key, which come last. Rows alike in key and text keep or lose the same spans.
    Input columns named removed_units or removed_chars are replaced; an empty table gives an empty
    result. A span takes ``least_units`` units and ``least_words`` words at least, so a repeated line
    of fewer words stays, whatever the number of its copies.
    """
    # For each text, its repeats: at most one for each of its units.
    unit = F.shiftright("at", VERSION_BITS)

    def hits() -> DataFrame:
        found = repeated_spans(docs, key, text, least_units, least_words)
        return found.groupBy(F.col("k").alias("__k"), F.col("at").bitwiseAND(F.lit((1 << VERSION_BITS) - 1)).alias("__v")).agg(F.collect_set(unit).alias("__hits"))

    by_doc = settled(docs.sparkSession, "repeats", hits)

    @F.arrow_udf("struct<text:string,units:int>")
    def cut(t: pa.Array, hits: pa.Array) -> pa.Array:
        made = [(None, 0) if not x.is_valid else without(x.as_py(), h.as_py(), least_units, least_words) for x, h in zip(t, hits)]
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], ["text", "units"])

    t = F.col(text).cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("__d"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("__k"), t.alias("__t"))
    names = [c for c in docs.columns if c not in ("removed_units", "removed_chars")]
    joined = keyed.withColumn("__v", version(F.col("__t"))).join(by_doc, ["__k", "__v"], "left")
    made = joined.withColumn("__cut", cut(F.when(F.col("__hits").isNotNull(), F.col("__t")), F.col("__hits")))
    new = F.when(F.col("__hits").isNotNull(), F.col("__cut.text")).otherwise(F.col("__t"))
    columns = [new.alias(c) if c == text else F.col("__d").getField(c).alias(c) for c in names]
    return made.select(*columns, F.coalesce(F.col("__cut.units"), F.lit(0)).alias("removed_units"), F.coalesce(F.length("__t") - F.length(new), F.lit(0)).alias("removed_chars"))
