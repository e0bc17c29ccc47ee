
from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import candidates as cand
from spanloom.operators import heatmap
from spanloom.plans import oracle_k12, views


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 9))
    return df


def k1_heatmap_peaks(spark, sf):
    """Smoothed, plateau-based, suppressed and ranked peaks."""
    return _rounded(heatmap.peaks(views.heatmap_points(spark, sf)), "smoothed_value", "prominence")


def j1_smoothing(spark, sf):
    """Overlap-weighted mean of each point's window."""
    return _rounded(heatmap.smoothed(views.heatmap_points(spark, sf)), "smoothed")


def v1_heatmap_violations(spark, sf):
    """Points that break the contract, among points made to break it."""
    p = views.heatmap_points(spark, sf)
    broken = p.withColumn("value", F.when(F.col("idx") % 7 == 0, 1.5).otherwise(F.col("value"))).withColumn("start_time", F.when(F.col("idx") % 11 == 0, F.col("start_time") - 9).otherwise(F.col("start_time")))
    return heatmap.violations(broken)


def k2_candidates(spark, sf):
    """Candidate windows with stable ids."""
    return cand.candidates(heatmap.peaks(views.heatmap_points(spark, sf)))


def v2_peak_violations(spark, sf):
    """Peaks made to break their contract."""
    p = heatmap.peaks(views.heatmap_points(spark, sf))
    return cand.peak_violations(p.withColumn("rank", F.when(F.col("rank") == 2, 1).otherwise(F.col("rank"))).withColumn("end_time", F.when(F.col("rank") == 3, F.col("duration_seconds") + 1).otherwise(F.col("end_time"))))


def v10_adapter_differences(spark, sf):
    """An adapter with one row changed and one lost, against what it was made from."""
    found = cand.candidates(heatmap.peaks(views.heatmap_points(spark, sf)))
    flat = cand.adapter(found).where("rank <> 2").withColumn("start", F.when(F.col("rank") == 1, F.col("start") + 1).otherwise(F.col("start")))
    return cand.adapter_differences(found, flat)


QUERIES = {f.__name__: f for f in (k1_heatmap_peaks, j1_smoothing, v1_heatmap_violations, k2_candidates, v2_peak_violations, v10_adapter_differences)}
SQL = {
    **oracle_k12.SQL,
    "k2_candidates": oracle_k12.candidates("peak_centered_candidate_windows", 1),
    "v1_heatmap_violations": views.with_views("heatmap_points", """WITH b AS (SELECT video_id, idx, CASE WHEN idx % 7 = 0 THEN 1.5 ELSE value END AS v, CASE WHEN idx % 11 = 0 THEN start_time - 9 ELSE start_time END AS s, end_time AS e, duration_seconds AS d FROM heatmap_points),
      l AS (SELECT *, lag(s) OVER (PARTITION BY video_id ORDER BY idx) AS ps FROM b)
      SELECT video_id, idx, 'negative_start' AS code FROM l WHERE s < 0 UNION ALL SELECT video_id, idx, 'empty_interval' FROM l WHERE e <= s UNION ALL SELECT video_id, idx, 'value_range' FROM l WHERE v < 0 OR v > 1
      UNION ALL SELECT video_id, idx, 'past_end' FROM l WHERE e > d + 1 UNION ALL SELECT video_id, idx, 'unsorted' FROM l WHERE s < ps"""),
    "v2_peak_violations": views.with_views("heatmap_points", f"""WITH {oracle_k12.PEAKS},
      b AS (SELECT video_id, CAST(CASE WHEN rank = 2 THEN 1 ELSE rank END AS INTEGER) AS rank, peak_time, start_time, CASE WHEN rank = 3 THEN duration_seconds + 1 ELSE end_time END AS end_time, duration_seconds FROM peaks),
      c AS (SELECT *, count(*) OVER (PARTITION BY video_id, rank) AS n FROM b)
      SELECT video_id, rank, 'rank_repeated' AS code FROM c WHERE n > 1 UNION ALL SELECT video_id, rank, 'peak_outside' FROM c WHERE peak_time < start_time OR peak_time > end_time
      UNION ALL SELECT video_id, rank, 'interval_outside' FROM c WHERE start_time < 0 OR end_time > duration_seconds"""),
    "v10_adapter_differences": views.with_views("heatmap_points", f"""WITH {oracle_k12.CANDS.replace("GENERATOR", "peak_centered_candidate_windows").replace("GENVER", "1")}
      SELECT video_id, candidate_id AS id, CASE WHEN rank = 2 THEN 'missing' ELSE 'different' END AS problem FROM cands WHERE rank IN (1, 2)"""),
}
