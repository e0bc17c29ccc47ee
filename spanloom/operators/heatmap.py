"""Interest heatmaps: contract check, time-weighted smoothing, plateau peaks, suppression.

A recording's points travel as one sorted array, so a whole detection costs one shuffle, by
recording; arrays hold about a hundred points (what a player publishes), never a corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END_TOLERANCE = 1.0
PLATEAU = 1e-9


@dataclass(frozen=True)
class PeakConfig:
    """Defaults of the peak contract; all in seconds or shares."""

    radius: float = 5.0
    window: float = 30.0
    min_prominence: float = 0.05
    min_distance: float = 30.0
    max_peaks: int = 20

    def __post_init__(self):
        if self.radius < 0 or self.window <= 0 or not 0 <= self.min_prominence <= 1 or self.min_distance < 0 or self.max_peaks < 1:
            raise ValueError("peak settings out of range")


def violations(points: DataFrame) -> DataFrame:
    """(video_id, idx, code) of every point that breaks the contract; empty if all is well."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    line = Window.partitionBy("video_id").orderBy("idx")
    checks = F.array(
        F.when(~(finite("start_time") & finite("end_time") & finite("value")), "not_finite"),
        F.when(F.col("start_time") < 0, "negative_start"),
        F.when(F.col("end_time") <= F.col("start_time"), "empty_interval"),
        F.when((F.col("value") < 0) | (F.col("value") > 1), "value_range"),
        F.when(F.col("end_time") > F.col("duration_seconds") + END_TOLERANCE, "past_end"),
        F.when(F.col("start_time") < F.lag("start_time").over(line), "unsorted"),
    )
    return points.select("video_id", "idx", checks.alias("c")).select("video_id", "idx", F.explode(F.filter("c", lambda x: x.isNotNull())).alias("code"))


def _arrays(points: DataFrame) -> DataFrame:
    order = F.struct(F.col("idx"), F.col("start_time").alias("s"), F.col("end_time").alias("e"), F.col("value").alias("v"))
    return points.groupBy("video_id").agg(F.array_sort(F.collect_list(order)).alias("p"), F.max("duration_seconds").alias("duration_seconds"))


def unrolled(df: DataFrame, array, *columns) -> DataFrame:
    """(columns, i, x): elements of an array. The outer form keeps Catalyst from deriving a filter on
    the array's size, which would evaluate the whole fold behind it once for every use it inlines."""
    return df.select(*columns, F.posexplode_outer(array).alias("i", "x")).where("x is not null")


def _smooth(radius: float) -> str:
    if radius == 0:
        return "transform(p, x -> x.v)"
    low, high = f"(x.s + x.e) / 2 - {radius}D", f"(x.s + x.e) / 2 + {radius}D"
    over = f"least(y.e, {high}) - greatest(y.s, {low})"
    return f"""transform(p, x -> aggregate(filter(p, y -> y.e > {low} and y.s < {high}), named_struct('a', 0D, 'b', 0D),
      (t, y) -> named_struct('a', t.a + y.v * ({over}), 'b', t.b + ({over})), t -> t.a / t.b))"""


def smoothed(points: DataFrame, radius: float = 5.0) -> DataFrame:
    """(video_id, idx, value, smoothed): mean of the values that overlap mid +/- radius, weighted by overlap."""
    made = _arrays(points).withColumn("m", F.expr(_smooth(radius)))
    return unrolled(made, F.arrays_zip("p", "m"), "video_id").select("video_id", F.col("x.p.idx").alias("idx"), F.col("x.p.v").alias("value"), F.col("x.m").alias("smoothed"))


def greedy(array: str, accept: str, limit: int) -> str:
    """Fold that keeps an element x if ``accept`` holds for every kept y, until ``limit`` are kept."""
    kept = f"filter({array}, z -> false)"
    return f"aggregate({array}, {kept}, (a, x) -> if(size(a) < {limit} and forall(a, y -> {accept}), concat(a, array(x)), a))"


def peaks(points: DataFrame, config: PeakConfig = PeakConfig()) -> DataFrame:
    """Ranked peaks: (video_id, rank, peak_time, start_time, end_time, raw_value, smoothed_value, prominence, duration_seconds).

    A plateau is a run within 1e-9 of its first value; it peaks if it touches neither end and both
    neighbours are lower. Prominence is the height over the higher of the two sides' lowest points
    in the window. Peaks are taken by prominence, smoothed and raw value, then time, if they are
    ``min_distance`` from all taken before. Recordings of fewer than three points have none.
    """
    c = config
    made = _arrays(points).where(F.size("p") >= 3).withColumn("m", F.expr(_smooth(c.radius)))
    # Plateaus (first, last) by a fold: a value belongs while it is within reach of the first.
    made = made.withColumn("plateaus", F.expr(f"""aggregate(sequence(1, size(m) - 1), array(named_struct('f', 0, 'l', 0)),
      (a, i) -> if(abs(m[element_at(a, -1).f] - m[i]) <= {PLATEAU}D,
                   concat(slice(a, 1, size(a) - 1), array(named_struct('f', element_at(a, -1).f, 'l', i))),
                   concat(a, array(named_struct('f', i, 'l', i)))))"""))  # fmt: skip
    made = made.withColumn("tops", F.expr(f"filter(plateaus, x -> x.f > 0 and x.l < size(m) - 1 and m[x.f - 1] < m[x.f] - {PLATEAU}D and m[x.l + 1] < m[x.f] - {PLATEAU}D)"))
    made = made.withColumn("mids", F.expr("transform(p, x -> (x.s + x.e) / 2)"))
    rep = "array_min(transform(sequence(x.f, x.l), i -> named_struct('d', abs(mids[i] - (mids[x.f] + mids[x.l]) / 2), 'i', i))).i"
    made = made.withColumn("cand", F.expr(f"transform(tops, x -> named_struct('f', x.f, 'l', x.l, 'r', {rep}))"))
    left = f"array_min(transform(filter(sequence(0, x.f - 1), i -> mids[i] >= mids[x.r] - {c.window}D or i = x.f - 1 and not exists(sequence(0, x.f - 1), j -> mids[j] >= mids[x.r] - {c.window}D)), i -> m[i]))"
    right = f"array_min(transform(filter(sequence(x.l + 1, size(m) - 1), i -> mids[i] <= mids[x.r] + {c.window}D or i = x.l + 1 and not exists(sequence(x.l + 1, size(m) - 1), j -> mids[j] <= mids[x.r] + {c.window}D)), i -> m[i]))"
    made = made.withColumn("found", F.expr(f"""transform(cand, x -> named_struct('np', -least(1D, greatest(0D, m[x.f] - greatest({left}, {right}))), 'ns', -m[x.r], 'nr', -p[x.r].v, 't', mids[x.r], 's', p[x.r].s, 'e', p[x.r].e))"""))
    made = made.withColumn("found", F.expr(f"array_sort(filter(found, x -> -x.np >= {c.min_prominence}D))"))
    made = made.withColumn("kept", F.expr(greedy("found", f"abs(y.t - x.t) >= {c.min_distance}D", c.max_peaks)))
    rows = unrolled(made, "kept", "video_id", "duration_seconds")
    return rows.select(
        "video_id", (F.col("i") + 1).alias("rank"), F.col("x.t").alias("peak_time"), F.col("x.s").alias("start_time"), F.col("x.e").alias("end_time"),
        (-F.col("x.nr")).alias("raw_value"), (-F.col("x.ns")).alias("smoothed_value"), (-F.col("x.np")).alias("prominence"), "duration_seconds",
    )
