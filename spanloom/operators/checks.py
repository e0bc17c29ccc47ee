"""Integrity of transcripts, review contexts, checkpoints and project artifacts, as rows or columns of faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx
from spanloom.functions import timecode as tc

SCHEMA_VERSION, ID_SCHEME, ID_VERSION = 2, "transcript_segment_centiseconds", 1


def _named(*rules: tuple[str, Column]) -> Column:
    """Array of the names whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())


def _range(start: str = "start_cs", end: str = "end_cs") -> list[tuple[str, Column]]:
    s, e = F.col(start), F.col(end)
    return [("invalid_time", s.isNull() | e.isNull()), ("negative_start", s < 0), ("end_not_after_start", e <= s)]


def range_violations(segments: DataFrame, words: DataFrame, turns: DataFrame) -> DataFrame:
    """(doc_id, kind, idx, word_idx, rule) of segments, words and turns (doc_id, idx, ..): ranges, order, containment, labels.

    A segment may not begin before the one before it ends, nor have text but no words; a word lies
    inside its segment and does not begin or end before the word before it; a turn has a label.
    """
    none = F.lit(None).cast("long")
    line = Window.partitionBy("doc_id").orderBy("idx")
    spoken = words.groupBy("doc_id", F.col("seg_idx").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    s = segments.withColumn("before", F.lag("end_cs").over(line)).join(spoken, ["doc_id", "idx"], "left")
    s = s.select("doc_id", F.lit("segment").alias("kind"), "idx", none.alias("word_idx"), F.explode(_named(*_range(), ("overlaps_previous", F.col("start_cs") < F.col("before")), ("text_without_words", F.col("n").isNull() & (tx.compact(F.col("text")) != "")))).alias("rule"))
    seq = Window.partitionBy("doc_id", "seg_idx").orderBy("word_idx")
    parent = segments.select("doc_id", F.col("idx").alias("seg_idx"), F.col("start_cs").alias("ps"), F.col("end_cs").alias("pe"))
    w = words.withColumn("bs", F.lag("start_cs").over(seq)).withColumn("be", F.lag("end_cs").over(seq)).join(parent, ["doc_id", "seg_idx"], "left")
    outside = F.col("ps").isNull() | (F.col("start_cs") < F.col("ps")) | (F.col("end_cs") > F.col("pe"))
    w = w.select("doc_id", F.lit("word").alias("kind"), F.col("seg_idx").alias("idx"), "word_idx", F.explode(_named(*_range(), ("outside_segment", outside), ("not_chronological", (F.col("start_cs") < F.col("bs")) | (F.col("end_cs") < F.col("be"))))).alias("rule"))
    t = turns.select("doc_id", F.lit("turn").alias("kind"), "idx", none.alias("word_idx"), F.explode(_named(*_range(), ("empty_label", F.trim(F.coalesce("raw_speaker", F.lit(""))) == ""))).alias("rule"))
    return s.unionByName(w).unionByName(t)


def identity_violations(segments: DataFrame) -> DataFrame:
    """(doc_id, segment_id, problem): ids that do not follow from the range, or occur twice in a transcript."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "segment_id"))
    wrong = ~F.col("segment_id").eqNullSafe(tc.segment_id(F.col("start_cs"), F.col("end_cs")))
    return segments.withColumn("n", n).select("doc_id", "segment_id", F.explode(_named(("id_differs", wrong), ("id_repeated", F.col("n") > 1))).alias("problem"))


def context_violations(canon: DataFrame, options: DataFrame, pairs: DataFrame, current: DataFrame) -> DataFrame:
    """(doc_id, kind, ref, problem) of a review context; none if it may be used.

    canon: (doc_id, segment_id, start_cs, end_cs, text), what options may refer to; options:
    (doc_id, kind 'start' or 'end', option_index, segment_id, start_cs, end_cs, text); pairs:
    (doc_id, s_index, e_index), what is allowed; current: (doc_id, s_index, e_index), one row a
    context, null if nothing is aligned. Options repeat canonical data and must agree with it.
    """
    again = canon.groupBy("doc_id", "segment_id").count().where(F.col("count") > 1).select("doc_id", F.lit("canonical").alias("kind"), F.col("segment_id").alias("ref"), F.lit("segment_repeated").alias("problem"))
    known = canon.groupBy("doc_id", "segment_id").agg(F.min(F.struct(F.col("start_cs").alias("s"), F.col("end_cs").alias("e"), F.col("text").alias("t"))).alias("c"))
    many = lambda c: F.count(F.lit(1)).over(Window.partitionBy("doc_id", "kind", c)) > 1
    o = options.withColumn("same_id", many("segment_id")).withColumn("same_index", many("option_index")).join(known, ["doc_id", "segment_id"], "left")
    valid = F.coalesce(F.col("option_index") > 0, F.lit(False))
    found = o.select("doc_id", "kind", F.col("segment_id").alias("ref"), F.explode(_named(
        ("segment_repeated", F.col("same_id")), ("segment_unknown", F.col("c").isNull()), ("index_invalid", ~valid), ("index_repeated", valid & F.col("same_index")),
        ("start_differs", F.col("c").isNotNull() & ~F.col("start_cs").eqNullSafe(F.col("c.s"))), ("end_differs", F.col("c").isNotNull() & ~F.col("end_cs").eqNullSafe(F.col("c.e"))), ("text_differs", F.col("c").isNotNull() & ~F.col("text").eqNullSafe(F.col("c.t"))),
    )).alias("problem"))
    side = lambda k, c, mark: options.where(F.col("kind") == k).select("doc_id", F.col("option_index").alias(c), F.lit(True).alias(mark)).distinct()
    p = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "s_index", "e_index"))).join(side("start", "s_index", "a"), ["doc_id", "s_index"], "left").join(side("end", "e_index", "b"), ["doc_id", "e_index"], "left")
    ref = F.concat_ws("-", F.col("s_index").cast("string"), F.col("e_index").cast("string"))
    p = p.select("doc_id", F.lit("pair").alias("kind"), ref.alias("ref"), F.explode(_named(("option_unknown", F.col("a").isNull() | F.col("b").isNull()), ("pair_repeated", F.col("n") > 1))).alias("problem"))
    has = pairs.select("doc_id").distinct().withColumn("any", F.lit(True))
    ok = pairs.select("doc_id", "s_index", "e_index").distinct().withColumn("ok", F.lit(True))
    c = current.join(has, "doc_id", "left").join(ok, ["doc_id", "s_index", "e_index"], "left")
    s, e = F.col("s_index").isNull(), F.col("e_index").isNull()
    c = c.select("doc_id", F.lit("current").alias("kind"), ref.alias("ref"), F.explode(_named(("current_half", s != e), ("current_missing", s & e & F.col("any").isNotNull()), ("current_not_allowed", ~s & ~e & F.col("ok").isNull()))).alias("problem"))
    return again.unionByName(found).unionByName(p).unionByName(c)


#: What a project is reported on, in the order that durations are compared in.
ARTIFACTS = ("source_media", "heatmap", "heatmap_peaks", "candidate_windows", "top_windows")


def consistency_report(artifacts: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(project_id, invalid, missing, identity_consistent, duration_consistent, result) of (project_id, artifact, valid, video_id, duration).

    Valid artifacts of a project must name one video and, within the tolerance of the first that
    tells it, one duration; null if there is nothing to compare. FAIL for an invalid artifact or a
    contradiction, INCOMPLETE for one that is missing (no row), else PASS.
    """
    order = F.array_position(F.array(*map(F.lit, ARTIFACTS)), F.col("artifact"))
    good, told = F.col("valid"), F.col("valid") & F.col("duration").isNotNull()
    a = artifacts.where(F.col("artifact").isin(*ARTIFACTS)).groupBy("project_id").agg(
        F.count_if(~good).cast("int").alias("invalid"), (len(ARTIFACTS) - F.count_distinct("artifact")).cast("int").alias("missing"),
        F.min(F.when(good, F.col("video_id"))).alias("v1"), F.max(F.when(good, F.col("video_id"))).alias("v2"),
        F.min(F.when(told, F.struct(order.alias("o"), "duration"))).alias("first"), F.min(F.when(told, F.col("duration"))).alias("low"), F.max(F.when(told, F.col("duration"))).alias("high"), F.count_if(told).alias("n"),
    )
    same = F.when(F.col("v1").isNotNull(), F.col("v1") == F.col("v2"))
    first = F.col("first.duration")
    even = F.when(F.col("n") > 1, (F.col("high") - first <= tolerance) & (first - F.col("low") <= tolerance))
    bad = (F.col("invalid") > 0) | F.coalesce(~same, F.lit(False)) | F.coalesce(~even, F.lit(False))
    return a.select("project_id", "invalid", "missing", same.alias("identity_consistent"), even.alias("duration_consistent"), F.when(bad, "FAIL").when(F.col("missing") > 0, "INCOMPLETE").otherwise("PASS").alias("result"))


def reuse_faults(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, faults): why a finished transcript may not be used again; '' if it may.

    docs: doc_id, schema_version, id_scheme, id_version, mode, requested_mode, used_fallback,
    speaker_count, turn_count, outside_words, outside_distance, labels (map of raw to final
    label), exclusive, status. segments: doc_id, start_cs, end_cs, segment_id, speaker, n_words. A
    conjunction over the document's header and counters and aggregates of its segments.
    """
    same = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "segment_id")) > 1
    wrong = ~F.col("segment_id").eqNullSafe(tc.segment_id(F.col("start_cs"), F.col("end_cs")))
    by = segments.withColumn("bad", same | wrong).groupBy("doc_id").agg(
        F.bool_or("bad").alias("bad"), F.count(F.lit(1)).alias("n"), F.count("speaker").alias("labelled"), F.bool_or(F.trim("speaker") == "").alias("blank"), F.collect_set("speaker").alias("spoken"), F.sum("n_words").alias("words"),
    )
    d = docs.join(by, "doc_id", "left")
    n, words, spoken = F.coalesce("n", F.lit(0)), F.coalesce("words", F.lit(0)), F.coalesce("spoken", F.array().cast("array<string>"))
    count, names = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False)), F.map_values("labels")
    far = F.col("outside_distance")
    finite = F.coalesce(~F.isnan(far) & (far >= 0) & (far < float("inf")), F.lit(False))
    empty = (F.col("speaker_count") == 0) & (F.size("labels") == 0) & (F.col("turn_count") == 0) & (F.col("outside_words") == 0) & (far == 0)
    applied = F.col("exclusive") & (F.col("status") == F.when(n > 0, "applied").otherwise("no_speech"))
    told = (F.col("speaker_count") > 0) & (F.col("turn_count") >= F.col("speaker_count")) & (F.coalesce("labelled", F.lit(0)) == n) & (F.size(spoken) > 0) & (F.size(F.array_except(spoken, names)) == 0)
    off = ~F.col("exclusive") & (F.col("status") == F.when(n > 0, "disabled").otherwise("no_speech")) & empty & (F.size(spoken) == 0)
    good = F.when(F.col("mode") == "pyannote", applied & F.when(n > 0, told).otherwise(empty)).otherwise(off)
    faults = _named(
        ("header", ~(F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)) & F.col("id_scheme").eqNullSafe(F.lit(ID_SCHEME)) & F.col("id_version").eqNullSafe(F.lit(ID_VERSION)))),
        ("request", ~F.col("mode").eqNullSafe(F.col("requested_mode"))), ("fallback", ~F.col("used_fallback").eqNullSafe(F.lit(False))),
        ("counters", ~(count("speaker_count") & count("turn_count") & count("outside_words"))), ("speakers", ~F.coalesce(F.col("speaker_count") == F.size("labels"), F.lit(False))), ("distance", ~finite),
        ("segment_ids", F.coalesce("bad", F.lit(False))), ("blank_speaker", F.coalesce("blank", F.lit(False))),
        ("outside_words", F.coalesce((F.col("outside_words") > words) | ((F.col("outside_words") == 0) & (far != 0)), F.lit(True))),
        ("labels", F.exists(F.concat(F.map_keys("labels"), names), lambda x: F.trim(x) == "") | (F.size(F.array_distinct(names)) < F.size(names))), ("status", ~F.coalesce(good, F.lit(False))),
    )
    return d.select("doc_id", F.array_join(faults, ",").alias("faults"))


def checkpoint_fault(schema_version: Column, fingerprint: Column, audio: Column, config: Column, wanted: Column, complete: Column, transcript_version: Column, ids_match: Column, current: int = 1) -> Column:
    """The first reason not to go on from a recognition checkpoint; null if there is none."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(schema_version == current), "schema_version").when(no(fingerprint == audio), "fingerprint").when(no(config == wanted), "configuration")
        .when(no(complete), "incomplete").when(no(transcript_version == SCHEMA_VERSION), "transcript_version").when(no(ids_match), "segment_id")
    )


def manifest_faults(schema_version: Column, source: Column, video_id: Column, source_url: Column, media_file: Column, wanted_source: str = "youtube") -> Column:
    """Array of what is wrong with a source manifest; a media file must be relative and stay inside the workspace."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    absolute = media_file.rlike(r"^(/|\\\\|[A-Za-z]:)")
    # How deep each part leads: a file that goes above the workspace at any part is outside.
    depth = F.aggregate(F.filter(F.split(media_file, "/"), lambda x: ~x.isin("", ".")), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct((a["d"] + F.when(x == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(x == "..", -1).otherwise(1)).alias("low")), lambda a: a["low"])
    return _named(("schema_version", ~schema_version.eqNullSafe(F.lit(1))), ("source", ~source.eqNullSafe(F.lit(wanted_source))), ("video_id", blank(video_id)), ("source_url", blank(source_url)), ("media_file", blank(media_file)), ("absolute", F.coalesce(absolute, F.lit(False))), ("outside", F.coalesce(~absolute & (depth < 0), F.lit(False))))


def prohibited_fields(document: Column, prohibited: tuple[str, ...]) -> Column:
    """Sorted names among a JSON object's own that may not be there."""
    return F.array_sort(F.array_intersect(F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")), F.array(*map(F.lit, prohibited))))


def key_differences(keys: Column, allowed: tuple[str, ...]) -> Column:
    """Struct (unexpected, missing): names that an object has too many or too few."""
    want = F.array(*map(F.lit, allowed))
    return F.struct(F.array_except(keys, want).alias("unexpected"), F.array_except(want, keys).alias("missing"))
