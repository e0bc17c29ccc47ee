"""Processing events as streams: marker lines, stages, and the state of each project.

``event_lines`` and ``project_states`` work on batch and streaming frames alike; the latter keeps a
project's state in the state store when the frame is a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import text as tx

MARK = "@@PIPELINE_EVENT@@"
# How far a project is when a stage begins.
PROGRESS = {"waiting": 0, "downloading": 10, "detecting_heatmap_peaks": 20, "transcribing": 30, "validating_transcript": 45, "generating_candidates": 60, "importing_candidates": 75, "reviewing_with_ai": 85, "ready": 100}
EVENT = "event string, stage string, message string, progress_percent double, success boolean, metadata map<string,string>, timestamp string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as a stream: a row for each line that is appended in new files."""
    return spark.readStream.text(path)


def event_lines(lines: DataFrame) -> DataFrame:
    """The columns of ``lines`` with (event, stage, progress, message): marker lines parsed, other lines by what they say.

    A marker line that is no JSON object has neither event nor stage. Secrets in messages are
    replaced. progress: given, else the stage's.
    """
    marked = F.startswith(F.col("value"), F.lit(MARK))
    made = lines.withColumn("e", F.from_json(F.when(marked, F.trim(F.substring("value", F.lit(len(MARK) + 1), F.length("value")))), EVENT))
    stage = F.when(marked, F.col("e.stage")).otherwise(tx.log_stage(F.col("value")))
    table = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])
    event = F.when(marked, F.col("e.event")).otherwise(F.when(stage.isNotNull(), "stage_started"))
    return made.select(*lines.columns, event.alias("event"), stage.alias("stage"), F.coalesce(F.col("e.progress_percent"), F.try_element_at(table, stage).cast("double")).alias("progress"), tx.redacted(F.coalesce("e.message", F.when(~marked, F.col("value")))).alias("message"))


_OUT = T.StructType().add("project_id", T.LongType()).add("state", T.StringType()).add("progress", T.DoubleType()).add("n", T.LongType())


def project_states(events: DataFrame) -> DataFrame:
    """A stream of (project_id, state, progress, n) after each batch, of (project_id, seq, event, progress).

    A cancelled project stays cancelled and its later events are dropped; progress never falls.
    """

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, progress, n = state.get if state.exists else ("waiting", 0.0, 0)
        if now != "cancelled":
            rows = pd.concat(list(parts)).sort_values("seq")
            # What stands behind the first cancel no longer counts.
            rows = rows[(rows["event"] == "cancelled").cumsum().shift(fill_value=0) == 0]
            now, progress, n = rows["event"].iloc[-1], max(progress, float(rows["progress"].max())), n + len(rows)
        state.update((now, progress, n))
        yield pd.DataFrame([(key[0], now, progress, n)], columns=_OUT.names)

    return events.groupBy("project_id").applyInPandasWithState(step, _OUT, "state string, progress double, n long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """Extension: events by type in tumbling windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
