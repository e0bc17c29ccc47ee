"""Clip candidates around ranked peaks: windows, near-identical and overlap suppression, stable IDs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx

from spanloom.operators.heatmap import greedy, unrolled

SAME = 1e-6


@dataclass(frozen=True)
class WindowConfig:
    """Seconds; ``max_overlap`` is intersection over the shorter duration."""

    min_duration: float = 30.0
    target_duration: float = 60.0
    max_duration: float = 90.0
    max_overlap: float = 0.65
    limit: int = 12

    def __post_init__(self):
        if not 0 < self.min_duration <= self.target_duration <= self.max_duration or not 0 <= self.max_overlap <= 1 or self.limit < 1:
            raise ValueError("window settings out of range")


def microseconds(seconds: Column) -> Column:
    """Half-up microseconds of a double, through its shortest decimal form."""
    return (F.round(seconds.cast("string").cast("decimal(30,12)"), 6) * 1_000_000).cast("long")


def candidate_id(video_id: Column, start: Column, end: Column, generator: str = "peak_centered_candidate_windows", version: int = 1) -> Column:
    """cand_v1_ and the SHA-256 of the sorted, compact JSON of the identity."""
    text = F.concat(F.lit('{"candidate_id_version":1,"end_microseconds":'), microseconds(end).cast("string"), F.lit(f',"generator":"{generator}","generator_version":{version},"start_microseconds":'), microseconds(start).cast("string"), F.lit(',"video_id":"'), tx.json_string(video_id), F.lit('"}'))
    return F.concat(F.lit("cand_v1_"), F.sha2(text, 256))


def peak_violations(peaks: DataFrame) -> DataFrame:
    """(video_id, rank, code): ranks positive and unique, peak inside interval, interval inside the recording."""
    same = F.count(F.lit(1)).over(Window.partitionBy("video_id", "rank"))
    checks = F.array(
        F.when(F.col("rank") <= 0, "rank"), F.when(same > 1, "rank_repeated"),
        F.when((F.col("peak_time") < F.col("start_time")) | (F.col("peak_time") > F.col("end_time")), "peak_outside"),
        F.when((F.col("start_time") < 0) | (F.col("end_time") > F.col("duration_seconds")), "interval_outside"),
    )
    return peaks.select("video_id", "rank", checks.alias("c")).select("video_id", "rank", F.explode(F.filter("c", lambda x: x.isNotNull())).alias("code"))


def candidates(peaks: DataFrame, config: WindowConfig = WindowConfig()) -> DataFrame:
    """(video_id, rank, source_peak_rank, peak_time, start_time, end_time, duration_seconds, candidate_id).

    Windows of the target length centred on the peak and shifted inside the recording, in rank
    order; one that starts and ends within a microsecond of a kept one goes, and one that shares
    more than ``max_overlap`` of the shorter. Recordings shorter than the minimum have none.
    """
    c = config
    length = F.least(F.lit(c.target_duration), F.col("duration_seconds"))
    start = F.greatest(F.lit(0.0), F.least(F.col("peak_time") - length / 2, F.col("duration_seconds") - length))
    rows = peaks.where(F.col("duration_seconds") >= c.min_duration).withColumn("len", length).withColumn("ws", start).withColumn("we", start + length)
    order = F.struct("rank", (-F.col("prominence")).alias("np"), (-F.col("smoothed_value")).alias("ns"), (-F.col("raw_value")).alias("nr"), F.col("peak_time").alias("t"), "ws", "we")
    made = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(order)).alias("w"))
    made = made.withColumn("w", F.expr(greedy("w", f"not (abs(y.ws - x.ws) <= {SAME}D and abs(y.we - x.we) <= {SAME}D)", 2**31 - 1)))
    share = "greatest(0D, least(x.we, y.we) - greatest(x.ws, y.ws)) / least(x.we - x.ws, y.we - y.ws)"
    made = made.withColumn("w", F.expr(greedy("w", f"{share} <= {c.max_overlap}D", c.limit)))
    out = unrolled(made, "w", "video_id")
    ident = candidate_id(F.col("video_id"), F.col("x.ws"), F.col("x.we"))
    return out.select("video_id", (F.col("i") + 1).alias("rank"), F.col("x.rank").alias("source_peak_rank"), F.col("x.t").alias("peak_time"), F.col("x.ws").alias("start_time"), F.col("x.we").alias("end_time"), (F.col("x.we") - F.col("x.ws")).alias("duration_seconds"), ident.alias("candidate_id"))


def adapter(found: DataFrame) -> DataFrame:
    """Flat projection for consumers that know clips only by start, end and id."""
    return found.select("video_id", F.col("candidate_id").alias("id"), "rank", F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("duration_seconds").alias("duration"), F.lit("replay_interest_peak").alias("boundary_source"), F.lit("heatmap").alias("selection_source"))


def adapter_differences(found: DataFrame, flat: DataFrame) -> DataFrame:
    """(video_id, id, problem): full outer comparison of an adapter with what it was made from."""
    a, b = adapter(found).alias("a"), flat.alias("b")
    both = a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.id") == F.col("b.id")), "full")
    same = F.lit(True)
    for c in ("rank", "start", "end", "duration"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    problem = F.when(F.col("a.id").isNull(), "unexpected").when(F.col("b.id").isNull(), "missing").when(~same, "different")
    return both.select(F.coalesce("a.video_id", "b.video_id").alias("video_id"), F.coalesce("a.id", "b.id").alias("id"), problem.alias("problem")).where("problem is not null")
