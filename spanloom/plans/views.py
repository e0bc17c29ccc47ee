"""Time-coded views of the driver tables, in Spark and, by the same definition, in DuckDB SQL.

The tables hold no recordings, so every kernel reads a view derived in integer arithmetic:

- heatmap_points: per event type a recording of four-second points, one for each four hours.
- segments, words: conversations as transcripts, 0.40 s a word; turns: the same, shifted by 0.15 s
  on alternate turns so that overlaps, gaps and ties occur; clips: one for each long conversation.
- jobs, evaluations, artifacts: events as rows of a project store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heatmap_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, idx, start_time, end_time, value (0 to 1), duration_seconds; points tile from 0."""
    events = table(spark, sf_dir, "events")
    bucket = (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) * 6 + F.floor(F.hour("ts") / 4)).cast("long")
    counts = events.groupBy(F.col("event_type").alias("video_id"), bucket.alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("video_id").agg(F.max("n").alias("top"), F.max("idx").alias("last"))
    grid = tops.withColumn("idx", F.explode(F.expr("sequence(0L, last)")))
    bp = F.expr("(20000 * coalesce(n, 0) + top) div (2 * top)")
    filled = grid.join(counts, ["video_id", "idx"], "left").withColumn("value_bp", bp)
    return filled.select(
        "video_id", "idx", (F.col("idx") * 4).cast("double").alias("start_time"), ((F.col("idx") + 1) * 4).cast("double").alias("end_time"),
        (F.col("value_bp") / F.lit(10000.0)).alias("value"), ((F.col("last") + 1) * 4).cast("double").alias("duration_seconds"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, start_cs, end_cs, speaker, text."""
    rows = table(spark, sf_dir, "conversations")
    n = F.greatest(F.lit(1), F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))).cast("long")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    made = rows.withColumn("n", n).withColumn("b", F.coalesce(before, F.lit(0)))
    return made.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), (F.col("b") * 40).alias("start_cs"), ((F.col("b") + F.col("n")) * 40).alias("end_cs"), F.col("role").alias("speaker"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seg_idx, word_idx, start_cs, end_cs, text."""
    s = segments(spark, sf_dir).select("doc_id", F.col("idx").alias("seg_idx"), F.col("start_cs").alias("s"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)).alias("word_idx", "text"))
    start = F.col("s") + F.col("word_idx") * 40
    return s.select("doc_id", "seg_idx", F.col("word_idx").cast("long"), start.alias("start_cs"), (start + 40).alias("end_cs"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_cs, end_cs, raw_speaker: segments, the odd ones 15 cs later, the even ones earlier."""
    shift = F.when(F.col("idx") % 2 == 0, -15).otherwise(15)
    start = F.greatest(F.lit(0), F.col("start_cs") + shift)
    return segments(spark, sf_dir).select("doc_id", start.alias("start_cs"), (F.col("end_cs") + shift).alias("end_cs"), F.col("speaker").alias("raw_speaker"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_cs, end_cs and the bounds each may move in, for conversations of 30 s and more."""
    total = segments(spark, sf_dir).groupBy("doc_id").agg(F.max("end_cs").alias("total")).where("total >= 3000")
    made = total.withColumn("len", F.least(F.lit(6000), "total")).withColumn("start_cs", F.expr("(total - len) div 2")).withColumn("end_cs", F.col("start_cs") + F.col("len"))
    low = lambda c: F.greatest(F.lit(0), F.col(c) - 2000)
    return made.select("doc_id", "start_cs", "end_cs", low("start_cs").alias("min_start_cs"), (F.col("start_cs") + 2000).alias("max_start_cs"), low("end_cs").alias("min_end_cs"), (F.col("end_cs") + 2000).alias("max_end_cs"))


STATUS = {"click": "running", "signup": "queued", "purchase": "completed", "error": "failed", "view": "cancelled"}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, project_id, status, created_at (whole seconds, as text), score."""
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()], F.lit("queued"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("project_id"), status.alias("status"), F.date_format(F.date_trunc("HOUR", "ts"), "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("value").alias("score"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artifact_id, project_id, artifact_type, at_s (seconds since 2024): clicks as raw, views as subtitled."""
    at = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    return rows.select(F.col("event_id").alias("artifact_id"), F.col("user_id").alias("project_id"), F.when(F.col("event_type") == "click", "raw").otherwise("subtitled").alias("artifact_type"), at.alias("at_s"))


#: The same views for DuckDB, each may use those before it.
SQL = {
    "heatmap_points": """
  hp_counts AS (SELECT event_type AS video_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 6 + hour(ts) // 4 AS BIGINT) AS idx, count(*) AS n FROM events GROUP BY ALL),
  hp_tops AS (SELECT video_id, max(n) AS top, max(idx) AS last FROM hp_counts GROUP BY video_id),
  hp_grid AS (SELECT video_id, top, last, unnest(range(0, last + 1)) AS idx FROM hp_tops),
  heatmap_points AS (SELECT g.video_id, g.idx, CAST(g.idx * 4 AS DOUBLE) AS start_time, CAST((g.idx + 1) * 4 AS DOUBLE) AS end_time,
    CAST((20000 * coalesce(c.n, 0) + g.top) // (2 * g.top) AS DOUBLE) / 10000.0 AS value, CAST((g.last + 1) * 4 AS DOUBLE) AS duration_seconds
    FROM hp_grid g LEFT JOIN hp_counts c ON c.video_id = g.video_id AND c.idx = g.idx)""",
    "segments": r"""
  sg_n AS (SELECT conv_id AS doc_id, turn AS idx, role AS speaker, text, greatest(1, len(regexp_extract_all(text, '\S+'))) AS n FROM conversations),
  segments AS (SELECT doc_id, idx, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 40 AS start_cs,
    sum(n) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 40 AS end_cs, speaker, text FROM sg_n)""",
    "words": r"""
  wd AS (SELECT doc_id, idx AS seg_idx, start_cs AS s, regexp_extract_all(text, '\S+') AS l FROM segments),
  wx AS (SELECT doc_id, seg_idx, s, unnest(l) AS text, unnest(range(0, len(l))) AS word_idx FROM wd),
  words AS (SELECT doc_id, seg_idx, word_idx, s + word_idx * 40 AS start_cs, s + word_idx * 40 + 40 AS end_cs, text FROM wx)""",
    "turns": """
  turns AS (SELECT doc_id, greatest(0, start_cs + CASE WHEN idx % 2 = 0 THEN -15 ELSE 15 END) AS start_cs, end_cs + CASE WHEN idx % 2 = 0 THEN -15 ELSE 15 END AS end_cs, speaker AS raw_speaker FROM segments)""",
    "clips": """
  cl_t AS (SELECT doc_id, max(end_cs) AS total FROM segments GROUP BY doc_id HAVING max(end_cs) >= 3000),
  cl_s AS (SELECT doc_id, (total - least(6000, total)) // 2 AS start_cs, (total - least(6000, total)) // 2 + least(6000, total) AS end_cs FROM cl_t),
  clips AS (SELECT doc_id, start_cs, end_cs, greatest(0, start_cs - 2000) AS min_start_cs, start_cs + 2000 AS max_start_cs, greatest(0, end_cs - 2000) AS min_end_cs, end_cs + 2000 AS max_end_cs FROM cl_s)""",
    "jobs": """
  jobs AS (SELECT event_id AS job_id, user_id AS project_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'cancelled' ELSE 'queued' END AS status,
    strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS created_at, value AS score FROM events)""",
    "artifacts": """
  artifacts AS (SELECT event_id AS artifact_id, user_id AS project_id, CASE event_type WHEN 'click' THEN 'raw' ELSE 'subtitled' END AS artifact_type, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01')) AS BIGINT) AS at_s FROM events WHERE event_type IN ('click', 'view'))""",
}
_NEEDS = {"words": ["segments"], "turns": ["segments"], "clips": ["segments"]}


def with_views(names: str, body: str) -> str:
    """The SQL ``body`` after the definitions of the views named (space-separated), recursion allowed."""
    order: list[str] = []
    for name in names.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    views = ",".join(SQL[n] for n in order)
    body = body.strip()
    return f"WITH RECURSIVE {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH RECURSIVE {views} {body}"
