"""Boundary review: context of a clip, boundary options and pairs, validation, a rule-based reviewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx
from spanloom.operators.scan import meeting

CONTEXT, SHORTEST, LONGEST = 2000, 1000, 9000


def context(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, idx, side): segments before, in and after each clip, within the context."""
    c = clips.select("doc_id", F.col("start_cs").alias("cs"), F.col("end_cs").alias("ce"))
    s, e = F.col("start_cs"), F.col("end_cs")
    side = (
        F.when((e > F.col("cs") - CONTEXT) & (s < F.col("cs")) & (e <= F.col("cs")), "before")
        .when((s < F.col("ce")) & (e > F.col("cs")), "candidate")
        .when((s < F.col("ce") + CONTEXT) & (e > F.col("ce")) & (s >= F.col("ce")), "after")
    )
    reach = c.withColumn("lo", F.col("cs") - CONTEXT).withColumn("hi", F.col("ce") + CONTEXT)
    return meeting(reach, "lo", "hi", segments, "start_cs", "end_cs").withColumn("side", side).where("side is not null").select("doc_id", "idx", "side", "start_cs", "end_cs", "text")


def options(clips: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(start options, end options): (doc_id, pos, at_cs). Positions number what may be chosen before it is filtered by the clip's bounds."""
    line = Window.partitionBy("doc_id").orderBy("start_cs", "end_cs", "idx")
    ctx = context(clips, segments)
    bounds = clips.select("doc_id", "min_start_cs", "max_start_cs", "min_end_cs", "max_end_cs")
    first = ctx.where("side <> 'after'").withColumn("pos", F.row_number().over(line) - 1).join(bounds, "doc_id").where("start_cs between min_start_cs and max_start_cs")
    last = ctx.where("side <> 'before'").withColumn("pos", F.row_number().over(line) - 1).join(bounds, "doc_id").where("end_cs between min_end_cs and max_end_cs")
    return first.select("doc_id", "pos", F.col("start_cs").alias("at_cs"), "text"), last.select("doc_id", "pos", F.col("end_cs").alias("at_cs"), "text")


def pairs(starts: DataFrame, ends: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(doc_id, s_pos, e_pos, s_cs, e_cs): pairs of options whose distance is allowed."""
    s = starts.select("doc_id", F.col("pos").alias("s_pos"), F.col("at_cs").alias("s_cs"))
    e = ends.select("doc_id", F.col("pos").alias("e_pos"), F.col("at_cs").alias("e_cs"))
    return s.join(e, "doc_id").where(F.col("e_cs") - F.col("s_cs") > 0).where((F.col("e_cs") - F.col("s_cs")).between(shortest, longest)).select("doc_id", "s_pos", "e_pos", "s_cs", "e_cs")


def paired(opts: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    """Options that occur in a pair."""
    return opts.join(allowed.select("doc_id", F.col(column).alias("pos")), ["doc_id", "pos"], "left_semi")


def nearest_pair(clips: DataFrame, allowed: DataFrame) -> DataFrame:
    """(doc_id, s_pos, e_pos): the pair nearest to the clip: summed, then start, then end distance, then order."""
    m = allowed.join(clips.select("doc_id", "start_cs", "end_cs"), "doc_id")
    ds, de = F.abs(F.col("s_cs") - F.col("start_cs")), F.abs(F.col("e_cs") - F.col("end_cs"))
    return m.groupBy("doc_id").agg(F.min(F.struct((ds + de).alias("t"), ds.alias("ds"), de.alias("de"), "s_pos", "e_pos")).alias("x")).select("doc_id", "x.s_pos", "x.e_pos")


def nearest_option(clips: DataFrame, opts: DataFrame, target: str) -> DataFrame:
    """(doc_id, pos): the option nearest to the clip's ``target`` column, the first of equals."""
    m = opts.join(clips.select("doc_id", F.col(target).alias("t")), "doc_id")
    return m.groupBy("doc_id").agg(F.min(F.struct(F.abs(F.col("at_cs") - F.col("t")).alias("d"), "pos")).alias("x")).select("doc_id", "x.pos")


def bound_errors(start: Column, end: Column) -> Column:
    """All errors of adjusted bounds against the clip's columns, joined by blanks; '' if there are none."""
    errors = F.array(
        F.when((start < F.col("min_start_cs")) | (start > F.col("max_start_cs")), "start out of bounds."), F.when((end < F.col("min_end_cs")) | (end > F.col("max_end_cs")), "end out of bounds."),
        F.when(end <= start, "end not after start."), F.when((end > start) & ~(end - start).between(SHORTEST, LONGEST), "duration out of bounds."),
    )
    return F.concat_ws(" ", F.filter(errors, lambda x: x.isNotNull()))


def rule_review(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, s_cs, e_cs, extended): the reviewer that needs no model.

    First and last candidate segment; one back if the first starts mid-thought, one ahead if the
    last ends unfinished; then the allowed pair nearest to that.
    """
    ctx = context(clips, segments)
    ends = ctx.groupBy("doc_id").agg(
        F.min(F.when(F.col("side") == "candidate", F.struct("start_cs", "idx", "text"))).alias("a"), F.max(F.when(F.col("side") == "candidate", F.struct("end_cs", "idx", "text"))).alias("z"),
        F.max(F.when(F.col("side") == "before", F.col("start_cs"))).alias("b"), F.min(F.when(F.col("side") == "after", F.col("end_cs"))).alias("c"),
    )
    back, ahead = tx.starts_mid_thought(F.col("a.text")) & F.col("b").isNotNull(), tx.ends_unfinished(F.col("z.text")) & F.col("c").isNotNull()
    want = ends.where("a is not null").select("doc_id", F.when(back, F.col("b")).otherwise(F.col("a.start_cs")).alias("start_cs"), F.when(ahead, F.col("c")).otherwise(F.col("z.end_cs")).alias("end_cs"), (back | ahead).alias("extended"))
    allowed = pairs(*options(clips, segments))
    best = nearest_pair(want, allowed)
    return best.join(allowed, ["doc_id", "s_pos", "e_pos"]).join(want.select("doc_id", "extended"), "doc_id").select("doc_id", "s_cs", "e_cs", "extended")
