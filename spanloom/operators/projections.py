"""What a project's views show: clips, evaluations, states and messages, as columns of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators.scan import meeting

# What a stage's message says.
STAGE_MESSAGES = {
    "waiting": "Waiting to start", "downloading": "Downloading source media", "detecting_heatmap_peaks": "Detecting replay-interest peaks", "transcribing": "Transcribing podcast",
    "validating_transcript": "Validating transcript", "generating_candidates": "Generating candidate clips", "importing_candidates": "Importing candidate clips",
    "reviewing_with_ai": "Reviewing boundaries with AI", "ready": "Ready for review", "failed": "Failed", "cancelled": "Cancelled",
}


def rounded(value: Column, digits: int = 2) -> Column:
    """Half up on the shortest decimal form of a double."""
    return F.round(value.cast("string").cast("decimal(30,12)"), digits).cast("double")


def given(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def nonzero(*columns: Column) -> Column:
    """The first number that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in columns])


def delta(reviewed: Column, original: Column) -> Column:
    """Signed difference, two digits; null if either is."""
    return rounded(F.round(reviewed.cast("string").cast("decimal(30,12)") - original.cast("string").cast("decimal(30,12)"), 12).cast("double"))


def truncated(text: Column, most: int = 150, mark: str = "...") -> Column:
    """The text, or its first characters and the mark, ``most`` in all."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - len(mark))), F.lit(mark)))


RAW = "struct<provider:string,model:string,selected_start_segment_id:string,selected_end_segment_id:string,start_delta_seconds:double,end_delta_seconds:double,reasoning_summary:string,context_expansions:int,failed:boolean,failure_category:string,provider_attempt_count:int>"
_SCORES = ("quality_score", "context_score", "hook_score", "payoff_score", "boundary_score")


def evaluations(rows: DataFrame) -> DataFrame:
    """Evaluations as they are shown: a column, else the raw answer's field, else a default.

    rows: evaluation_id, project_id, provider, model, decision, selected_start_segment_id,
    reasoning_summary, suggested_start, reviewed_start, start_delta_seconds, the five scores and
    raw_json. Empty texts and zeros count as missing where a raw field can stand in, as nulls do.
    """
    r = rows.withColumn("r", F.from_json("raw_json", RAW))
    provider = F.coalesce(given(F.col("provider"), F.col("r.provider")), F.lit("unknown"))
    scored = F.lit(False)
    for c in _SCORES:
        scored = scored | F.col(c).isNotNull()
    kind = (
        F.when(F.col("decision") == "manual_review", "manual_review")
        .when((provider == "gemini") & F.col("decision").isin("render_ready", "adjust_boundaries", "reject"), "gemini_boundary_decision")
        .when(scored, "legacy_heuristic").otherwise("unknown")
    )
    shown = lambda c: F.when(provider != "gemini", F.col(c)).alias(c)
    return r.select(
        "evaluation_id", "project_id", provider.alias("provider"), F.coalesce(given(F.col("model"), F.col("r.model")), F.lit("unknown")).alias("model"), "decision", kind.alias("review_kind"),
        F.when(kind == "legacy_heuristic", kind).otherwise("not_available").alias("score_provenance"), given(F.col("selected_start_segment_id"), F.col("r.selected_start_segment_id")).alias("selected_start_segment_id"),
        F.coalesce("reviewed_start", "suggested_start").alias("reviewed_start"), F.coalesce(F.nullif(F.col("start_delta_seconds"), F.lit(0.0)), F.col("r.start_delta_seconds")).alias("start_delta_seconds"),
        given(F.col("reasoning_summary"), F.col("r.reasoning_summary")).alias("reasoning_summary"), F.coalesce("r.context_expansions", F.lit(0)).alias("context_expansions"),
        F.coalesce("r.failed", F.lit(False)).alias("failed"), F.coalesce(F.nullif(F.col("r.provider_attempt_count"), F.lit(0)), F.lit(1)).alias("provider_attempt_count"), *[shown(c) for c in _SCORES],
    )


def batch_summary(shown: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, clips, succeeded, render_ready, adjust_boundaries, reject, manual_review, failed, applied, message) of shown evaluations."""
    one = lambda d: F.count_if(F.col("decision") == d).alias(d)
    c = shown.groupBy(key).agg(F.count(F.lit(1)).alias("clips"), one("render_ready"), one("adjust_boundaries"), one("reject"), one("manual_review"), F.count_if(F.col("failed")).alias("failed"))
    c = c.withColumn("succeeded", F.col("clips") - F.col("failed")).withColumn("applied", F.col("render_ready") + F.col("adjust_boundaries"))
    verb = F.when(F.col("manual_review") == 1, "requires").otherwise("require")
    return c.withColumn("message", F.concat(F.lit("Review finished: "), F.col("applied").cast("string"), F.lit(" applied, "), F.col("manual_review").cast("string"), F.lit(" "), verb, F.lit(" attention.")))


def normalized_window(start: Column, end: Column, margin: float = 20.0) -> Column:
    """Struct of a window's row: rounded bounds, the range each may move in, and the duration."""
    low = lambda c: rounded(F.greatest(F.lit(0.0), c - margin))
    return F.struct(rounded(start).alias("ai_start"), rounded(end).alias("ai_end"), low(start).alias("min_start"), rounded(start + margin).alias("max_start"), low(end).alias("min_end"), rounded(end + margin).alias("max_end"), rounded(end - start).alias("duration"))


def excerpts(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, start_cs, end_cs, text): the texts of the segments that overlap each clip, in transcript order."""
    c = clips.select("doc_id", F.col("start_cs").alias("cs"), F.col("end_cs").alias("ce")).distinct()
    s = segments.select("doc_id", "idx", F.col("start_cs").alias("s"), F.col("end_cs").alias("e"), F.trim("text").alias("t")).where("t <> ''")
    met = meeting(c, "cs", "ce", s, "s", "e").where("s < ce and e > cs")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "t"))), lambda x: x["t"]), " ")
    made = met.groupBy("doc_id", "cs", "ce").agg(text.alias("text"))
    return c.join(made, ["doc_id", "cs", "ce"], "left").select("doc_id", F.col("cs").alias("start_cs"), F.col("ce").alias("end_cs"), F.coalesce("text", F.lit("")).alias("text"))


def clip_view(clips: DataFrame, latest: DataFrame, texts: DataFrame) -> DataFrame:
    """Clips with duration, excerpt, states and what their latest evaluation says.

    clips: doc_id, start_cs, end_cs, status, render_status, boundary_source, summary; latest: one
    row a doc_id of shown evaluations; texts: ``excerpts``.
    """
    e = latest.select(F.col("project_id").alias("doc_id"), "evaluation_id", "decision", F.col("provider").alias("review_provider"), "failed")
    made = clips.join(texts, ["doc_id", "start_cs", "end_cs"], "left").join(e, "doc_id", "left")
    state = workflow_state(F.col("render_status"), F.col("status"), F.col("decision"), F.col("boundary_source"))
    return made.select(
        "doc_id", "start_cs", "end_cs", rounded((F.col("end_cs") - F.col("start_cs")) / 100).alias("duration"), F.coalesce(given(F.col("status")), F.lit("draft")).alias("status"),
        F.coalesce(given(F.col("render_status")), F.lit("not_rendered")).alias("render_status"), F.coalesce(given(F.col("boundary_source")), F.lit("heuristic")).alias("boundary_source"), F.col("decision").alias("latest_decision"), F.col("review_provider").alias("latest_provider"),
        F.coalesce("failed", F.lit(False)).alias("latest_failed"), F.col("evaluation_id"), state.alias("workflow_state"), truncated(F.coalesce(given(F.trim("summary")), F.col("text"))).alias("excerpt"),
    )


def workflow_state(render_status: Column, status: Column, decision: Column, boundary_source: Column) -> Column:
    """A clip's one state: rendered, then decided, then for manual review, then adjusted, else a draft."""
    return (
        F.when(render_status.isin("completed", "completed_with_warnings"), render_status).when(status.isin("accepted", "rejected"), status).when(decision == "manual_review", decision)
        .when(boundary_source.isin("user", "ai_review") | (decision == "adjust_boundaries"), "adjust_boundaries").otherwise("draft")
    )


def clip_in_tab(tab: Column, status: Column, render_status: Column) -> Column:
    """Whether a clip is listed under a tab: all, rendered, review (undecided), else a status."""
    return F.when(tab == "all", True).when(tab == "rendered", F.coalesce(render_status.isin("completed", "completed_with_warnings"), F.lit(False))).when(tab == "review", ~F.coalesce(status.isin("accepted", "rejected"), F.lit(False))).otherwise(F.coalesce(status == tab, F.lit(False)))


def project_in_tab(tab: Column, status: Column) -> Column:
    """Whether a project is listed under a tab: all, active (created too), attention, else a status."""
    return F.when(tab == "all", True).when(tab == "active", status.isin("created", "queued", "running")).when(tab == "attention", status.isin("failed", "cancelled")).otherwise(status == tab)


def effective_stage(status: Column, stage: Column, progress: Column, clips: Column) -> Column:
    """Struct (stage, progress): a ready project with clips is at 'ready' and 100."""
    s, p = F.coalesce(given(stage), F.lit("waiting")), F.coalesce(progress, F.lit(0.0))
    ready = F.coalesce((status == "ready") & (clips > 0), F.lit(False))
    return F.struct(F.when(ready & (s == "waiting"), "ready").otherwise(s).alias("stage"), F.when(ready, F.greatest(p, F.lit(100.0))).otherwise(p).alias("progress"))


def status_message(stage: Column, progress: Column, clips: Column) -> Column:
    """What a stage says; during the review, how many clips are done by the progress from 85 to 95."""
    table = F.create_map(*[F.lit(x) for kv in STAGE_MESSAGES.items() for x in kv])
    done = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(10.0), progress - 85.0)) * clips / 10.0, 0).cast("long")
    done = F.greatest(F.lit(0).cast("long"), F.least(clips, done))
    counted = F.concat(F.lit("Reviewing clip boundaries ("), done.cast("string"), F.lit(" of "), clips.cast("string"), F.lit(" complete)"))
    return F.when((stage == "reviewing_with_ai") & (clips > 0), counted).otherwise(F.coalesce(F.try_element_at(table, stage), F.initcap(F.replace(stage, F.lit("_"), F.lit(" ")))))


def displayable(text: Column, start: Column, end: Column) -> Column:
    """Struct (seconds, shown): a segment's duration, 0 if a time is missing, and whether there is something to show."""
    seconds = F.coalesce(F.greatest(F.lit(0.0), end - start), F.lit(0.0))
    return F.struct(seconds.alias("seconds"), ((seconds > 0) & (tx.subtitle_text(text) != "")).alias("shown"))


def is_demo(external_id: Column, start: Column, end: Column, summary: Column) -> Column:
    """The row of the demonstration project."""
    return F.coalesce((external_id == "clip_001") & (rounded(start) == 100.0) & (rounded(end) == 140.0) & F.contains(F.lower(F.coalesce(summary, F.lit(""))), F.lit("clear podcast answer")), F.lit(False))


def found_or_error(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of a key; running it raises if there are none."""
    hit = rows.where(F.col(key) == value)
    n = hit.agg(F.count(F.lit(1)).alias("__n")).where(F.when(F.col("__n") == 0, F.raise_error(F.lit(f"unknown {key}: {value}")).cast("boolean")).otherwise(True))
    return hit.join(F.broadcast(n)).drop("__n")


def review_request(clips: DataFrame, ctx: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc_id, start_cs, end_cs, segments): what a reviewer is asked, one row a clip.

    segments: each context segment once, in order of start, end and position, with its side and
    whether a clip may start or end there. starts, ends: (doc_id, at_cs) of the options.
    """
    mark = lambda o, at, name: o.select("doc_id", F.col("at_cs").alias(at), F.lit(True).alias(name)).distinct()
    c = ctx.join(mark(starts, "start_cs", "s"), ["doc_id", "start_cs"], "left").join(mark(ends, "end_cs", "e"), ["doc_id", "end_cs"], "left")
    able = lambda c, bad: F.coalesce(F.col(c), F.lit(False)) & (F.col("side") != bad)
    row = F.struct("start_cs", "end_cs", "idx", "side", "text", able("s", "after").alias("start_eligible"), able("e", "before").alias("end_eligible"))
    made = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("segments"))
    return clips.select("doc_id", "start_cs", "end_cs").join(made, "doc_id")


# The fields of a transcript segment that extra fields may not replace.
RESERVED = ("segment_id", "start", "end", "text", "speaker", "importance", "chaos", "words")


def with_extra(own: Column, extra: Column) -> Column:
    """A segment's own fields (map) and those of its extra fields that are not reserved; own fields win."""
    free = F.map_filter(extra, lambda k, _: ~k.isin(*RESERVED))
    return F.map_concat(F.map_filter(free, lambda k, _: ~F.map_contains_key(own, k)), own)


def merged_hints(*maps: Column) -> Column:
    """Maps from the weakest to the strongest as one; a later map's entries replace earlier ones, null maps are empty."""
    out = F.coalesce(maps[0], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    for m in maps[1:]:
        strong = F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        out = F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(strong, k)), strong)  # noqa: B023
    return out


def render_plan(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """``rows`` with content_type, layout_mode and hints (map).

    rows: routing_type, strategy_type, layout_type, requested_mode, routing_mode, strategy_mode,
    strategy_hints. The type is the first given one, else podcast; the mode is the requested one
    unless it is auto, else the routing's, else the strategy's. profiles: (layout_mode, profile), a
    small table of hints; they replace the strategy's, and type and modes replace both.
    """
    mode = lambda c: tx.layout_mode(F.col(c))
    r = rows.withColumn("content_type", F.coalesce(given(F.col("routing_type"), F.col("strategy_type"), F.col("layout_type")), F.lit("podcast")))
    r = r.withColumn("layout_mode", F.when(mode("requested_mode") != "auto", mode("requested_mode")).otherwise(tx.layout_mode(given(F.col("routing_mode"), F.col("strategy_mode")))))
    r = r.join(F.broadcast(profiles), "layout_mode", "left")
    forced = F.create_map(F.lit("content_type"), F.col("content_type"), F.lit("requested_layout_mode"), mode("requested_mode"), F.lit("layout_mode"), F.col("layout_mode"))
    crop = F.create_map(F.lit("crop_mode"), F.col("layout_mode"))
    return r.withColumn("hints", merged_hints(crop, F.col("strategy_hints"), F.col("profile"), forced)).drop("profile")


def setting(explicit: Column, environment: Column, file: Column, default: str) -> Column:
    """Struct (value, source): the first that is not blank, else the default."""
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    pick = lambda v, s: F.struct(v.alias("value"), F.lit(s).alias("source"))
    return F.when(there(explicit), pick(explicit, "explicit")).when(there(environment), pick(environment, "environment")).when(there(file), pick(file, ".env")).otherwise(pick(F.lit(default), "default"))
