"""Samples of transcripts and frames: windows worth listening to, strides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx
from spanloom.operators.heatmap import greedy, unrolled
from spanloom.operators.scan import meeting

# Issues whose places are listened to.
RISKY = ("TOO_MANY_WORDS_FOR_DURATION", "REPEATED_WORDS", "DUPLICATED_ADJACENT_TEXT", "MODEL_ARTIFACT", "SUSPICIOUS_CHARACTERS", "OVERLAPPING_SEGMENTS")


def strided(rows: DataFrame, step: int = 5, order: str = "idx") -> DataFrame:
    """Every ``step``-th row by its number from 0."""
    return rows.where(F.pmod(F.col(order), F.lit(step)) == 0)


def clip_window(center2: Column, length: Column, last2: Column) -> Column:
    """Struct (s2, e2): a window of ``length`` around a centre, moved inside 0 to the end; all but the length in half units."""
    low = F.greatest(F.lit(0).cast("long"), center2 - length)
    over = low + 2 * length > last2
    return F.struct(F.when(over, F.greatest(F.lit(0).cast("long"), last2 - 2 * length)).otherwise(low).alias("s2"), F.when(over, last2).otherwise(low + 2 * length).alias("e2"))


def sample_windows(segments: DataFrame, issues: DataFrame, audio: DataFrame | None = None, most: int = 4, length_cs: int = 900, chars: int = 1200) -> DataFrame:
    """(doc_id, i, start, end, text): up to ``most`` windows of each transcript, in seconds, and what should be heard there.

    Centres come, in this order, from issues (doc_id, place, code, start_cs, end_cs) of the risky
    codes, from every n-th segment with text, and from the segments with most words a second. A
    window is taken if it has a second at least, begins 0.45 of the length away from all taken
    before, and some segment with text overlaps it. audio: (doc_id, audio_cs).
    """
    s = segments.select("doc_id", "idx", F.col("start_cs").alias("s"), F.col("end_cs").alias("e"), tx.compact(F.col("text")).alias("t"))
    ends = s.groupBy("doc_id").agg(F.max("e").alias("last"))
    ends = ends.join(audio, "doc_id", "left") if audio is not None else ends.withColumn("audio_cs", F.lit(0).cast("long"))
    ends = ends.select("doc_id", F.greatest("last", F.coalesce("audio_cs", F.lit(0))).alias("last")).where("last > 0")
    line = Window.partitionBy("doc_id")
    center = (F.col("s") + F.col("e")).alias("c2")
    risky = issues.where(F.col("code").isin(*RISKY) & F.col("start_cs").isNotNull())
    risky = risky.select("doc_id", F.lit(0).alias("kind"), F.row_number().over(line.orderBy("place")).alias("rank"), (F.col("start_cs") + F.coalesce("end_cs", "start_cs")).alias("c2"))
    before = risky.groupBy("doc_id").agg(F.count(F.lit(1)).alias("before"))
    full = s.where("t <> ''").withColumn("i", F.row_number().over(line.orderBy("idx")) - 1).withColumn("n", F.count(F.lit(1)).over(line)).join(before, "doc_id", "left")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most)).cast("int")
    k = F.floor(F.col("i") / step)
    spread = full.where((F.pmod(F.col("i"), step) == 0) & ((k == 0) | (F.coalesce("before", F.lit(0)) + k < 3 * most))).select("doc_id", F.lit(1).alias("kind"), (k + 1).cast("int").alias("rank"), center)
    density = F.size(tx.tokens(F.col("t"), tx.CHECKER_WORD)) / F.greatest((F.col("e") - F.col("s")) / 100, F.lit(0.01))
    dense = full.withColumn("rank", F.row_number().over(line.orderBy(density.desc(), "idx"))).where(F.col("rank") <= most).select("doc_id", F.lit(2).alias("kind"), "rank", center)
    c = risky.unionByName(spread).unionByName(dense).join(ends, "doc_id").withColumn("w", clip_window(F.col("c2"), F.lit(length_cs), F.col("last") * 2))
    c = c.select("doc_id", "kind", "rank", "w.*").where("e2 - s2 >= 200")
    lo, hi = F.floor(F.col("s2") / 2), F.floor((F.col("e2") + 1) / 2)
    heard = meeting(c.select("doc_id", "s2", "e2").distinct().withColumn("lo", lo).withColumn("hi", hi), "lo", "hi", s.where("t <> ''"), "s", "e").where("2 * e > s2 and 2 * s < e2")
    texts = heard.groupBy("doc_id", "s2", "e2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), " ").alias("text"))
    ready = c.join(texts, ["doc_id", "s2", "e2"])
    made = ready.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "s2", "e2"))).alias("c"))
    kept = unrolled(made.withColumn("k", F.expr(greedy("c", f"abs(y.s2 - x.s2) * 100 >= {90 * length_cs}", most))), "k", "doc_id")
    out = kept.select("doc_id", F.col("i").cast("long").alias("i"), F.col("x.s2").alias("s2"), F.col("x.e2").alias("e2")).join(texts, ["doc_id", "s2", "e2"])
    return out.select("doc_id", "i", (F.col("s2") / 200).alias("start"), (F.col("e2") / 200).alias("end"), F.left("text", F.lit(chars)).alias("text"))


def rolling(rows: DataFrame, track: str, order: str, value: str, reset: str, size: int = 15) -> DataFrame:
    """``rows`` with total and n of ``value`` over the last ``size`` rows since a reset, which begins anew."""
    line = Window.partitionBy(track).orderBy(order)
    g = rows.withColumn("__g", F.sum(F.when(F.col(reset), 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    last = Window.partitionBy(track, "__g").orderBy(order).rowsBetween(1 - size, 0)
    return g.withColumn("total", F.sum(value).over(last)).withColumn("n", F.count(F.lit(1)).over(last)).drop("__g")
