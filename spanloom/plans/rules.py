"""Registered queries over integrity rules, project views, samples, faces, state changes and further scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx
from spanloom.functions import timecode as tc
from spanloom.operators import checks, cutting, projections, review, sampling, speakers, store, transcripts
from spanloom.plans import views
from spanloom.plans.records import query
from spanloom.plans.views import table
from spanloom.sources import documents
from spanloom.streaming.events import PROGRESS

K = "(doc_id * 7 + idx)"


def _bent(spark, sf):
    """Segments, words and turns made faulty by rule."""
    s = views.segments(spark, sf).withColumn("k", F.expr(K))
    s = s.select("doc_id", "idx", F.expr("case when k % 37 = 0 then -10 when k % 13 = 0 then start_cs - 60 else start_cs end").alias("start_cs"), F.expr("case when k % 19 = 0 then start_cs - 50 when k % 41 = 0 then null else end_cs end").alias("end_cs"), "text")
    w = views.words(spark, sf).withColumn("k", F.expr("doc_id * 11 + seg_idx * 3 + word_idx"))
    w = w.where("(doc_id + seg_idx) % 43 <> 0").select("doc_id", "seg_idx", "word_idx", F.expr("case when k % 31 = 0 then start_cs - 100 else start_cs end").alias("start_cs"), F.expr("case when k % 29 = 0 then end_cs + 200 else end_cs end").alias("end_cs"))
    t = views.segments(spark, sf).select("doc_id", "idx", "start_cs", "end_cs", F.expr("case when idx % 6 = 5 then ' ' else speaker end").alias("raw_speaker"))
    return s, w, t


_BENT = f"""s AS (SELECT doc_id, idx, CASE WHEN {K} % 37 = 0 THEN -10 WHEN {K} % 13 = 0 THEN start_cs - 60 ELSE start_cs END AS s, CASE WHEN {K} % 19 = 0 THEN start_cs - 50 WHEN {K} % 41 = 0 THEN NULL ELSE end_cs END AS e, text FROM segments),
  w AS (SELECT doc_id, seg_idx, word_idx, CASE WHEN (doc_id * 11 + seg_idx * 3 + word_idx) % 31 = 0 THEN start_cs - 100 ELSE start_cs END AS s, CASE WHEN (doc_id * 11 + seg_idx * 3 + word_idx) % 29 = 0 THEN end_cs + 200 ELSE end_cs END AS e FROM words WHERE (doc_id + seg_idx) % 43 <> 0)"""


@query("v4_range_violations", f"""WITH {_BENT}, l AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM s),
  v AS (SELECT w.*, p.s AS ps, p.e AS pe, lag(w.s) OVER (PARTITION BY w.doc_id, seg_idx ORDER BY word_idx) AS bs, lag(w.e) OVER (PARTITION BY w.doc_id, seg_idx ORDER BY word_idx) AS be FROM w JOIN s p ON p.doc_id = w.doc_id AND p.idx = w.seg_idx)
  SELECT doc_id, 'segment' AS kind, idx, NULL AS word_idx, 'invalid_time' AS rule FROM l WHERE s IS NULL OR e IS NULL UNION ALL SELECT doc_id, 'segment', idx, NULL, 'negative_start' FROM l WHERE s < 0
  UNION ALL SELECT doc_id, 'segment', idx, NULL, 'end_not_after_start' FROM l WHERE e <= s UNION ALL SELECT doc_id, 'segment', idx, NULL, 'overlaps_previous' FROM l WHERE s < b
  UNION ALL SELECT doc_id, 'segment', idx, NULL, 'text_without_words' FROM s WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = s.doc_id AND w.seg_idx = s.idx)
  UNION ALL SELECT doc_id, 'word', seg_idx, word_idx, 'negative_start' FROM v WHERE s < 0 UNION ALL SELECT doc_id, 'word', seg_idx, word_idx, 'end_not_after_start' FROM v WHERE e <= s
  UNION ALL SELECT doc_id, 'word', seg_idx, word_idx, 'outside_segment' FROM v WHERE ps IS NULL OR coalesce(s < ps, false) OR coalesce(e > pe, false) UNION ALL SELECT doc_id, 'word', seg_idx, word_idx, 'not_chronological' FROM v WHERE s < bs OR e < be
  UNION ALL SELECT doc_id, 'turn', idx, NULL, 'empty_label' FROM segments WHERE idx % 6 = 5 UNION ALL SELECT doc_id, 'turn', idx, NULL, 'end_not_after_start' FROM segments WHERE end_cs <= start_cs""", "segments words")
def v4_range_violations(spark, sf):
    """V4: ranges, order, containment and labels of segments, words and turns."""
    return checks.range_violations(*_bent(spark, sf))


@query("v6_identity_violations", f"""WITH i AS (SELECT doc_id, idx, 'seg_v1_' || sha256('{{"end_centiseconds":' || CAST(end_cs + CASE WHEN {K} % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR) || ',"segment_id_version":1,"start_centiseconds":' || CAST(start_cs AS VARCHAR) || '}}') AS segment_id, {K} % 9 = 0 AS bad FROM segments),
  d AS (SELECT * FROM i UNION ALL SELECT * FROM i WHERE idx % 10 = 3)
  SELECT doc_id, segment_id, 'id_differs' AS problem FROM d WHERE bad UNION ALL SELECT doc_id, segment_id, 'id_repeated' FROM d WHERE idx % 10 = 3""", "segments")
def v6_identity_violations(spark, sf):
    """Ids that do not follow from their range, or occur twice."""
    s = views.segments(spark, sf).withColumn("segment_id", tc.segment_id(F.col("start_cs"), F.expr(f"end_cs + if({K} % 9 = 0, 1, 0)")))
    return checks.identity_violations(s.unionByName(s.where("idx % 10 = 3")))


def _review_context(spark, sf):
    c = views.segments(spark, sf).select("doc_id", "idx", F.concat(F.lit("s"), F.col("idx").cast("string")).alias("segment_id"), "start_cs", "end_cs", "text").withColumn("k", F.expr("doc_id + idx"))
    o = c.select("doc_id", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("kind"), F.expr("case when k % 19 = 0 then 0 when k % 23 = 0 then idx else idx + 1 end").alias("option_index"), F.expr("if(k % 11 = 0, concat('x', idx), segment_id)").alias("segment_id"), F.expr("start_cs + if(k % 13 = 0, 1, 0)").alias("start_cs"), "end_cs", F.expr("if(k % 17 = 0, concat(text, '!'), text)").alias("text"))
    p = c.join(c.groupBy("doc_id").agg(F.max("idx").alias("last")), "doc_id").where("idx < last").select("doc_id", (F.col("idx") + 1).alias("s_index"), F.expr("idx + 2 + if(k % 9 = 0, 100, 0)").alias("e_index"), "k")
    p = p.drop("k").unionByName(p.where("k % 14 = 0").drop("k"))
    now = c.select("doc_id").distinct().select("doc_id", F.expr("if(doc_id % 5 = 0, null, 1L)").alias("s_index"), F.expr("if(doc_id % 5 < 2, null, 2L)").alias("e_index"))
    return c.select("doc_id", "segment_id", "start_cs", "end_cs", "text"), o, p, now


@query("v7_context_violations", """WITH c AS (SELECT doc_id, idx, 's' || idx AS segment_id, start_cs, text, doc_id + idx AS k, max(idx) OVER (PARTITION BY doc_id) AS last FROM segments),
  o AS (SELECT doc_id, kind, CASE WHEN k % 19 = 0 THEN 0 WHEN k % 23 = 0 THEN idx ELSE idx + 1 END AS oi, CASE WHEN k % 11 = 0 THEN 'x' || idx ELSE segment_id END AS sid, k FROM c, (VALUES ('start'), ('end')) v(kind)),
  n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, kind, oi) AS same FROM o),
  p0 AS (SELECT doc_id, idx + 1 AS si, idx + 2 + CASE WHEN k % 9 = 0 THEN 100 ELSE 0 END AS ei, k FROM c WHERE idx < last), p AS (SELECT doc_id, si, ei FROM p0 UNION ALL SELECT doc_id, si, ei FROM p0 WHERE k % 14 = 0),
  pn AS (SELECT *, count(*) OVER (PARTITION BY doc_id, si, ei) AS same FROM p), docs AS (SELECT DISTINCT doc_id FROM c),
  cur AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 END AS si, CASE WHEN doc_id % 5 < 2 THEN NULL ELSE 2 END AS ei FROM docs)
  SELECT doc_id, kind, sid AS ref, 'segment_unknown' AS problem FROM n WHERE k % 11 = 0 UNION ALL SELECT doc_id, kind, sid, 'index_invalid' FROM n WHERE oi <= 0 UNION ALL SELECT doc_id, kind, sid, 'index_repeated' FROM n WHERE oi > 0 AND same > 1
  UNION ALL SELECT doc_id, kind, sid, 'start_differs' FROM n WHERE k % 13 = 0 AND k % 11 <> 0 UNION ALL SELECT doc_id, kind, sid, 'text_differs' FROM n WHERE k % 17 = 0 AND k % 11 <> 0
  UNION ALL SELECT doc_id, 'pair', si || '-' || ei, 'option_unknown' FROM pn WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = pn.doc_id AND kind = 'start' AND oi = si) OR NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = pn.doc_id AND kind = 'end' AND oi = ei)
  UNION ALL SELECT doc_id, 'pair', si || '-' || ei, 'pair_repeated' FROM pn WHERE same > 1
  UNION ALL SELECT doc_id, 'current', concat_ws('-', CAST(si AS VARCHAR), CAST(ei AS VARCHAR)), CASE WHEN (si IS NULL) <> (ei IS NULL) THEN 'current_half' WHEN si IS NULL THEN 'current_missing' ELSE 'current_not_allowed' END FROM cur
    WHERE (si IS NULL) <> (ei IS NULL) OR (si IS NULL AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = cur.doc_id)) OR (si IS NOT NULL AND ei IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = cur.doc_id AND p.si = cur.si AND p.ei = cur.ei))""", "segments")
def v7_context_violations(spark, sf):
    """Options, pairs and the current pair of a review context against its canonical segments."""
    return checks.context_violations(*_review_context(spark, sf))


@query("v9_consistency_report", """WITH l AS (SELECT user_id, event_type, max(event_id) AS id FROM events GROUP BY 1, 2),
  a AS (SELECT user_id AS project_id, event_type, id % 41 <> 0 AS valid, CASE WHEN id % 29 = 0 THEN 'other' ELSE 'v' || user_id END AS video, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE user_id % 100 + CASE WHEN id % 23 = 0 THEN 0.5 ELSE 0.0 END END AS d FROM l),
  r AS (SELECT project_id, count(*) FILTER (WHERE NOT valid) AS invalid, 5 - count(*) AS missing, count(DISTINCT video) FILTER (WHERE valid) AS videos, count(d) FILTER (WHERE valid) AS n, max(d) FILTER (WHERE valid) - min(d) FILTER (WHERE valid) AS spread FROM a GROUP BY 1)
  SELECT project_id, CAST(invalid AS INTEGER) AS invalid, CAST(missing AS INTEGER) AS missing, CASE WHEN videos > 0 THEN videos = 1 END AS identity_consistent, CASE WHEN n > 1 THEN spread < 0.1 END AS duration_consistent,
    CASE WHEN invalid > 0 OR videos > 1 OR (n > 1 AND spread > 0.1) THEN 'FAIL' WHEN missing > 0 THEN 'INCOMPLETE' ELSE 'PASS' END AS result FROM r""")
def v9_consistency_report(spark, sf):
    """A project's artifacts, their one video and one duration, rolled up (the last event of each type as an artifact)."""
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("id"))
    kinds = F.create_map(*[F.lit(x) for kv in zip(("click", "signup", "purchase", "error", "view"), checks.ARTIFACTS) for x in kv])
    length = F.when(~F.col("event_type").isin("click", "view"), F.col("user_id") % 100 + F.when(F.col("id") % 23 == 0, 0.5).otherwise(0.0))
    a = last.select(F.col("user_id").alias("project_id"), F.try_element_at(kinds, F.col("event_type")).alias("artifact"), (F.col("id") % 41 != 0).alias("valid"), F.when(F.col("id") % 29 == 0, "other").otherwise(F.concat(F.lit("v"), F.col("user_id").cast("string"))).alias("video_id"), length.alias("duration"))
    return checks.consistency_report(a)


def _finished(spark, sf):
    s = views.segments(spark, sf)
    n = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))
    seg = s.select("doc_id", "start_cs", "end_cs", tc.segment_id(F.col("start_cs"), F.expr("end_cs + if(doc_id % 31 = 0 and idx = 0, 1, 0)")).alias("segment_id"), F.expr("case when doc_id % 2 = 1 then null when doc_id % 27 = 0 and idx = 1 then ' ' else speaker end").alias("speaker"), n.alias("n_words"))
    names = F.transform(F.array_sort(F.collect_set("speaker")), lambda x: F.struct(F.concat(F.lit("raw "), x), x))
    d = s.groupBy("doc_id").agg(F.map_from_entries(names).alias("m"), F.count(F.lit(1)).alias("n")).withColumn("on", F.expr("doc_id % 2 = 0"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return d.select(
        "doc_id", F.expr("if(doc_id % 17 = 0, 1, 2)").alias("schema_version"), F.lit(checks.ID_SCHEME).alias("id_scheme"), F.lit(1).alias("id_version"), F.expr("if(on, 'pyannote', 'none')").alias("mode"), F.expr("if(doc_id % 13 = 0, 'none', if(on, 'pyannote', 'none'))").alias("requested_mode"),
        F.expr("doc_id % 29 = 0").alias("used_fallback"), F.when(F.col("on"), F.size("m")).otherwise(0).alias("speaker_count"), F.expr("if(on, if(doc_id % 11 = 0, -1, n), 0)").alias("turn_count"), F.expr("if(on and doc_id % 3 = 0, 1L, 0L)").alias("outside_words"),
        F.expr("if(on and doc_id % 3 = 0, 0.25D, if(doc_id % 19 = 0, double('infinity'), 0D))").alias("outside_distance"), F.when(F.col("on"), F.col("m")).otherwise(none).alias("labels"), F.col("on").alias("exclusive"), F.expr("if(doc_id % 7 = 0, 'no_speech', if(on, 'applied', 'disabled'))").alias("status"),
    ), seg


@query("v12_transcript_reuse", r"""WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS pn, count(*) AS n, sum(len(regexp_extract_all(text, '\S+'))) AS words, bool_or(idx = 1) AS second, bool_or(idx = 0) AS first FROM segments GROUP BY 1),
  f AS (SELECT *, CASE WHEN pn AND doc_id % 11 = 0 THEN -1 WHEN pn THEN n ELSE 0 END AS turns, CASE WHEN pn AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS outside, pn AND doc_id % 27 = 0 AND second AS blank, doc_id % 19 = 0 AND NOT (pn AND doc_id % 3 = 0) AS inf FROM d),
  s AS (SELECT doc_id, count(DISTINCT speaker) AS k FROM segments GROUP BY 1)
  SELECT f.doc_id, array_to_string(list_filter([CASE WHEN f.doc_id % 17 = 0 THEN 'header' END, CASE WHEN f.doc_id % 13 = 0 AND pn THEN 'request' END, CASE WHEN f.doc_id % 29 = 0 THEN 'fallback' END, CASE WHEN turns < 0 THEN 'counters' END, CASE WHEN inf THEN 'distance' END,
    CASE WHEN f.doc_id % 31 = 0 AND first THEN 'segment_ids' END, CASE WHEN blank THEN 'blank_speaker' END, CASE WHEN outside > words OR (outside = 0 AND inf) THEN 'outside_words' END,
    CASE WHEN f.doc_id % 7 = 0 OR (pn AND (turns < k OR blank)) OR (NOT pn AND inf) THEN 'status' END], lambda x: x IS NOT NULL), ',') AS faults FROM f JOIN s USING (doc_id)""", "segments")
def v12_transcript_reuse(spark, sf):
    """Why a finished transcript may not be used again."""
    return checks.reuse_faults(*_finished(spark, sf))


@query("s11_checkpoint_faults", """SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'schema_version' WHEN value > 200 THEN 'fingerprint' WHEN event_type = 'error' THEN 'configuration' WHEN event_id % 7 = 0 THEN 'incomplete' WHEN event_id % 5 = 0 THEN 'transcript_version' WHEN event_id % 3 = 0 THEN 'segment_id' END AS fault FROM events""")
def s11_checkpoint_faults(spark, sf):
    """The first of the checks that a recognition checkpoint does not pass (events as checkpoints)."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    audio = F.sha2(F.col("user_id").cast("string"), 256)
    fault = checks.checkpoint_fault(F.when(i % 23 == 0, 2).otherwise(1), F.when(F.col("value") > 200, F.lit("other")).otherwise(audio), audio, F.col("event_type"), F.when(F.col("event_type") == "error", "none").otherwise(F.col("event_type")), i % 7 != 0, F.when(i % 5 == 0, F.lit(None)).otherwise(2), i % 3 != 0)
    return e.select("event_id", fault.alias("fault"))


@query("s8_manifest_faults", r"""WITH p AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN '../' ELSE '' END || CASE page_id % 3 WHEN 0 THEN '/' ELSE '' END || regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '^www\.', CASE WHEN page_id % 7 = 0 THEN 'a/../../' ELSE '' END) AS f FROM pages)
  SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 11 = 0 THEN 'schema_version' END, CASE WHEN url LIKE 'http:%' THEN 'source' END, CASE WHEN trim(coalesce(url, '')) = '' THEN 'source_url' END, CASE WHEN trim(coalesce(f, '')) = '' THEN 'media_file' END, CASE WHEN f LIKE '/%' THEN 'absolute' END, CASE WHEN f NOT LIKE '/%' AND (f LIKE '../%' OR f LIKE 'a/../../%') THEN 'outside' END], lambda x: x IS NOT NULL), ',') AS faults FROM p""")
def s8_manifest_faults(spark, sf):
    """Manifests whose media file is not a relative path inside the workspace, or that lack a field (pages as manifests)."""
    p = table(spark, sf, "pages")
    rest = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    rest = F.when(F.col("page_id") % 7 == 0, F.regexp_replace(rest, r"^www\.", "a/../../")).otherwise(F.regexp_replace(rest, r"^www\.", ""))
    f = F.concat(F.when(F.col("page_id") % 5 == 0, "../").otherwise(""), F.when(F.col("page_id") % 3 == 0, "/").otherwise(""), rest)
    faults = checks.manifest_faults(F.when(F.col("page_id") % 11 == 0, 2).otherwise(1), F.when(F.col("url").startswith("http:"), "file").otherwise("youtube"), F.col("page_id").cast("string"), F.col("url"), f)
    return p.select("page_id", F.array_join(faults, ",").alias("faults"))


# -- project views --------------------------------------------------------------------------------

_DECISIONS = {"click": "render_ready", "view": "adjust_boundaries", "signup": "manual_review", "purchase": "reject"}


def _evaluations(spark, sf):
    """Events as evaluations; the raw answer has what every other row's columns lack."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    table_ = F.create_map(*[F.lit(x) for kv in _DECISIONS.items() for x in kv])
    raw = F.to_json(F.struct(F.lit("gemini").alias("provider"), F.concat(F.lit("m"), (i % 9).cast("string")).alias("model"), F.concat(F.lit("r"), i.cast("string")).alias("selected_start_segment_id"), (i % 50).cast("double").alias("start_delta_seconds"), F.lit("why").alias("reasoning_summary"), (i % 4).cast("int").alias("context_expansions"), (i % 6 == 0).alias("failed"), (i % 3).cast("int").alias("provider_attempt_count")))
    score = F.when(i % 3 == 0, F.col("value"))
    return e.select(
        i.alias("evaluation_id"), F.col("user_id").alias("project_id"), F.when(i % 4 == 0, "local_stub").when(i % 4 == 1, "").alias("provider"), F.when(i % 5 == 0, "own").alias("model"), F.try_element_at(table_, F.col("event_type")).alias("decision"),
        F.when(i % 2 == 0, F.concat(F.lit("s"), i.cast("string"))).alias("selected_start_segment_id"), F.when(i % 7 == 0, "because").otherwise("").alias("reasoning_summary"), F.col("value").alias("suggested_start"), F.when(i % 10 == 0, i.cast("double")).alias("reviewed_start"), F.when(i % 3 == 0, 0.0).when(i % 3 == 1, 2.5).alias("start_delta_seconds"),
        score.alias("quality_score"), *[F.lit(None).cast("double").alias(f"{c}_score") for c in ("context", "hook", "payoff", "boundary")], F.when(i % 8 != 3, raw).alias("raw_json"),
    )


_EVALS = """ev AS (SELECT event_id AS id, user_id AS project_id, CASE event_type WHEN 'click' THEN 'render_ready' WHEN 'view' THEN 'adjust_boundaries' WHEN 'signup' THEN 'manual_review' WHEN 'purchase' THEN 'reject' END AS decision, event_id % 8 <> 3 AS raw, value FROM events),
  sh AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'local_stub' WHEN raw THEN 'gemini' ELSE 'unknown' END AS provider, raw AND id % 6 = 0 AS failed FROM ev)"""


@query("p10_evaluations", f"""WITH {_EVALS}, k AS (SELECT *, CASE WHEN decision = 'manual_review' THEN 'manual_review' WHEN provider = 'gemini' AND decision IN ('render_ready', 'adjust_boundaries', 'reject') THEN 'gemini_boundary_decision' WHEN id % 3 = 0 AND value IS NOT NULL THEN 'legacy_heuristic' ELSE 'unknown' END AS kind FROM sh)
  SELECT id AS evaluation_id, project_id, provider, CASE WHEN id % 5 = 0 THEN 'own' WHEN raw THEN 'm' || (id % 9) ELSE 'unknown' END AS model, decision, kind AS review_kind, CASE kind WHEN 'legacy_heuristic' THEN kind ELSE 'not_available' END AS score_provenance,
    CASE WHEN id % 2 = 0 THEN 's' || id WHEN raw THEN 'r' || id END AS selected_start_segment_id, CASE WHEN id % 10 = 0 THEN CAST(id AS DOUBLE) ELSE value END AS reviewed_start, CASE WHEN id % 3 = 1 THEN 2.5 WHEN raw THEN CAST(id % 50 AS DOUBLE) END AS start_delta_seconds,
    CASE WHEN id % 7 = 0 THEN 'because' WHEN raw THEN 'why' END AS reasoning_summary, CAST(CASE WHEN raw THEN id % 4 ELSE 0 END AS INTEGER) AS context_expansions, failed, CAST(CASE WHEN raw AND id % 3 <> 0 THEN id % 3 ELSE 1 END AS INTEGER) AS provider_attempt_count,
    CASE WHEN provider <> 'gemini' AND id % 3 = 0 THEN value END AS quality_score, CAST(NULL AS DOUBLE) AS context_score, CAST(NULL AS DOUBLE) AS hook_score, CAST(NULL AS DOUBLE) AS payoff_score, CAST(NULL AS DOUBLE) AS boundary_score FROM k""")
def p10_evaluations(spark, sf):
    """Evaluations by column, else raw answer, else default; where a review comes from."""
    return projections.evaluations(_evaluations(spark, sf))


@query("a9_batch_summary", f"""WITH {_EVALS}, c AS (SELECT project_id, count(*) AS clips, count(*) FILTER (WHERE decision = 'render_ready') AS render_ready, count(*) FILTER (WHERE decision = 'adjust_boundaries') AS adjust_boundaries, count(*) FILTER (WHERE decision = 'reject') AS reject, count(*) FILTER (WHERE decision = 'manual_review') AS manual_review, count(*) FILTER (WHERE failed) AS failed FROM sh GROUP BY 1)
  SELECT *, clips - failed AS succeeded, render_ready + adjust_boundaries AS applied, 'Review finished: ' || (render_ready + adjust_boundaries) || ' applied, ' || manual_review || CASE WHEN manual_review = 1 THEN ' requires' ELSE ' require' END || ' attention.' AS message FROM c""")
def a9_batch_summary(spark, sf):
    """A batch of reviews by decision."""
    return projections.batch_summary(projections.evaluations(_evaluations(spark, sf)))


_CLIPS = """cv AS (SELECT doc_id, start_cs, end_cs, CASE doc_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN '' END AS status, CASE doc_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' END AS render_status, CASE doc_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'heuristic' END AS boundary_source, CASE WHEN doc_id % 6 = 0 THEN ' told ' ELSE '' END AS summary FROM clips),
  ex AS (SELECT c.doc_id, string_agg(trim(s.text), ' ' ORDER BY s.idx) AS text FROM clips c JOIN segments s ON s.doc_id = c.doc_id AND s.start_cs < c.end_cs AND s.end_cs > c.start_cs AND trim(s.text) <> '' GROUP BY 1)"""


def _clip_rows(spark, sf):
    d = F.col("doc_id")
    return views.clips(spark, sf).select("doc_id", "start_cs", "end_cs", F.when(d % 4 == 0, "accepted").when(d % 4 == 1, "rejected").when(d % 4 == 2, "").alias("status"), F.when(d % 5 == 0, "completed").when(d % 5 == 1, "failed").alias("render_status"), F.when(d % 3 == 0, "user").when(d % 3 == 1, "heuristic").alias("boundary_source"), F.when(d % 6 == 0, " told ").otherwise("").alias("summary"))


@query("p9_clip_view", f"""WITH {_EVALS}, {_CLIPS}, l AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY id DESC) = 1), j AS (SELECT c.*, coalesce(nullif(trim(summary), ''), ex.text) AS t, l.id AS evaluation_id, l.decision, l.provider, coalesce(l.failed, false) AS f FROM cv c LEFT JOIN ex USING (doc_id) LEFT JOIN l ON l.project_id = c.doc_id)
  SELECT doc_id, start_cs, end_cs, CAST((end_cs - start_cs) AS DOUBLE) / 100 AS duration, coalesce(nullif(status, ''), 'draft') AS status, coalesce(render_status, 'not_rendered') AS render_status, coalesce(boundary_source, 'heuristic') AS boundary_source, decision AS latest_decision, provider AS latest_provider, f AS latest_failed, evaluation_id,
    CASE WHEN render_status = 'completed' THEN 'completed' WHEN status IN ('accepted', 'rejected') THEN status WHEN decision = 'manual_review' THEN decision WHEN boundary_source = 'user' OR decision = 'adjust_boundaries' THEN 'adjust_boundaries' ELSE 'draft' END AS workflow_state,
    CASE WHEN length(t) <= 150 THEN t ELSE left(t, 147) || '...' END AS excerpt FROM j""", "segments clips")
def p9_clip_view(spark, sf):
    """Clips with excerpt, states and their latest evaluation."""
    latest = store.latest(projections.evaluations(_evaluations(spark, sf)), "project_id", "evaluation_id")
    clips = _clip_rows(spark, sf)
    return projections.clip_view(clips, latest, projections.excerpts(clips, views.segments(spark, sf)))


@query("j9_excerpts", f"WITH {_CLIPS} SELECT c.doc_id, c.start_cs, c.end_cs, coalesce(ex.text, '') AS text FROM clips c LEFT JOIN ex USING (doc_id)", "segments clips")
def j9_excerpts(spark, sf):
    """The text of each clip, by overlapping segments in order."""
    return projections.excerpts(views.clips(spark, sf), views.segments(spark, sf))


@query("p11_workflow_state", """WITH t AS (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'completed_with_warnings' WHEN 2 THEN 'failed' END AS r, CASE WHEN c_acctbal < 0 THEN 'rejected' WHEN c_acctbal > 7000 THEN 'accepted' ELSE 'draft' END AS s, CASE c_mktsegment WHEN 'BUILDING' THEN 'manual_review' WHEN 'MACHINERY' THEN 'adjust_boundaries' END AS d, CASE WHEN c_custkey % 9 = 0 THEN 'ai_review' ELSE 'heuristic' END AS b FROM customer)
  SELECT c_custkey, CASE WHEN r IN ('completed', 'completed_with_warnings') THEN r WHEN s <> 'draft' THEN s WHEN d = 'manual_review' THEN d WHEN b = 'ai_review' OR d IS NOT NULL THEN 'adjust_boundaries' ELSE 'draft' END AS state,
    coalesce(r IN ('completed', 'completed_with_warnings'), false) AS in_rendered, s = 'draft' AS in_review, s = 'accepted' AS in_accepted FROM t""")
def p11_workflow_state(spark, sf):
    """A clip's one state by precedence, and the tabs that list it (customers as clips)."""
    c = table(spark, sf, "customer")
    n, bal, m = F.col("c_nationkey") % 5, F.col("c_acctbal"), F.col("c_mktsegment")
    render, status = F.when(n == 0, "completed").when(n == 1, "completed_with_warnings").when(n == 2, "failed"), F.when(bal < 0, "rejected").when(bal > 7000, "accepted").otherwise("draft")
    decision, source = F.when(m == "BUILDING", "manual_review").when(m == "MACHINERY", "adjust_boundaries"), F.when(F.col("c_custkey") % 9 == 0, "ai_review").otherwise("heuristic")
    tab = lambda t: projections.clip_in_tab(F.lit(t), status, render).alias(f"in_{t}")
    return c.select("c_custkey", projections.workflow_state(render, status, decision, source).alias("state"), tab("rendered"), tab("review"), tab("accepted"))


@query("p7_project_tabs", "SELECT project_id, count(*) FILTER (WHERE status IN ('queued', 'running')) AS active, count(*) FILTER (WHERE status IN ('failed', 'cancelled')) AS attention, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) AS total FROM jobs GROUP BY 1", "jobs")
def p7_project_tabs(spark, sf):
    """How many are listed under each tab."""
    tab = lambda t: F.count_if(projections.project_in_tab(F.lit(t), F.col("status"))).alias("total" if t == "all" else t)
    return views.jobs(spark, sf).groupBy("project_id").agg(*[tab(t) for t in ("active", "attention", "completed", "all")])


_STAGE = "CASE event_type WHEN 'click' THEN 'reviewing_with_ai' WHEN 'view' THEN '' WHEN 'signup' THEN 'transcribing' WHEN 'purchase' THEN 'own_stage' END"


@query("p13_status_messages", f"""WITH t AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'ready' ELSE 'running' END AS st, coalesce(nullif({_STAGE}, ''), 'waiting') AS g, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE CAST(event_id % 100 AS DOUBLE) END AS p, event_id % 13 AS n FROM events),
  e AS (SELECT *, CASE WHEN st = 'ready' AND n > 0 AND g = 'waiting' THEN 'ready' ELSE g END AS stage, CASE WHEN st = 'ready' AND n > 0 AND p < 100 THEN 100.0 ELSE p END AS progress FROM t)
  SELECT event_id, stage, progress, CASE WHEN stage = 'reviewing_with_ai' AND n > 0 THEN 'Reviewing clip boundaries (' || CAST(greatest(0, least(n, round_even(greatest(0, least(10, progress - 85)) * n / 10.0, 0))) AS BIGINT) || ' of ' || n || ' complete)'
    WHEN stage = 'reviewing_with_ai' THEN 'Reviewing boundaries with AI' WHEN stage = 'waiting' THEN 'Waiting to start' WHEN stage = 'ready' THEN 'Ready for review' WHEN stage = 'transcribing' THEN 'Transcribing podcast' ELSE 'Own Stage' END AS message FROM e""")
def p13_status_messages(spark, sf):
    """Effective stage and progress, and what they say."""
    e, i, k = table(spark, sf, "events"), F.col("event_id"), F.col("event_type")
    stage = F.when(k == "click", "reviewing_with_ai").when(k == "view", "").when(k == "signup", "transcribing").when(k == "purchase", "own_stage")
    x = projections.effective_stage(F.when(F.col("user_id") % 3 == 0, "ready").otherwise("running"), stage, F.when(i % 9 != 0, (i % 100).cast("double")), i % 13)
    made = e.select("event_id", x.alias("x"), (i % 13).alias("n"))
    return made.select("event_id", "x.stage", "x.progress", projections.status_message(F.col("x.stage"), F.col("x.progress"), F.col("n")).alias("message"))


@query("p16_windows", """WITH w AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(18, 2)) AS a, CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(18, 2)) + CAST(l_quantity AS DECIMAL(18, 2)) AS b FROM lineitem)
  SELECT l_orderkey, l_linenumber, CAST(a AS DOUBLE) AS ai_start, CAST(b AS DOUBLE) AS ai_end, CAST(greatest(0, a - 20) AS DOUBLE) AS min_start, CAST(a + 20 AS DOUBLE) AS max_start, CAST(greatest(0, b - 20) AS DOUBLE) AS min_end, CAST(b + 20 AS DOUBLE) AS max_end, CAST(b - a AS DOUBLE) AS duration FROM w""")
def p16_windows(spark, sf):
    """Windows as clip rows with the range that each bound may move in (order lines as windows)."""
    s = F.col("l_extendedprice")
    row = projections.normalized_window(s, s + F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", row.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("p17_displayable", r"""SELECT doc_id, idx, CASE WHEN doc_id % 9 = 0 THEN 0.0 ELSE CAST(greatest(0, end_cs - start_cs - CASE WHEN idx % 5 = 0 THEN 9999999 ELSE 0 END) AS DOUBLE) END AS seconds, doc_id % 9 <> 0 AND idx % 5 <> 0 AND end_cs > start_cs AND regexp_matches(text, '\S') AND idx % 7 <> 0 AS shown FROM segments""", "segments")
def p17_displayable(spark, sf):
    """Durations with failure as 0, and what is shown at all."""
    e = F.when(F.col("doc_id") % 9 != 0, F.col("end_cs") - F.when(F.col("idx") % 5 == 0, 9999999).otherwise(0))
    x = projections.displayable(F.when(F.col("idx") % 7 == 0, " ").otherwise(F.col("text")), F.col("start_cs").cast("double"), e.cast("double"))
    return views.segments(spark, sf).select("doc_id", "idx", x.alias("x")).select("doc_id", "idx", "x.*")


@query("p18_demo_rows", """SELECT p_partkey, p_partkey % 10 = 1 AND p_size % 5 = 0 AND p_partkey % 3 = 0 AS demo FROM part""")
def p18_demo_rows(spark, sf):
    """Rows of the demonstration project (parts as clips)."""
    i = F.col("p_partkey")
    demo = projections.is_demo(F.when(i % 10 == 1, "clip_001").otherwise(F.col("p_name")), F.when(F.col("p_size") % 5 == 0, 100.001).otherwise(F.col("p_retailprice")), F.lit(139.999), F.when(i % 3 == 0, "A Clear Podcast Answer.").otherwise(F.col("p_type")))
    return table(spark, sf, "part").select("p_partkey", demo.alias("demo"))


@query("f16_deltas", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(round(CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(18, 6)) - CAST(CAST(l_discount AS VARCHAR) AS DECIMAL(18, 6)), 2) AS DOUBLE) END AS delta FROM lineitem""")
def f16_deltas(spark, sf):
    """F16: signed differences."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", projections.delta(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice")), F.col("l_discount")).alias("delta"))


@query("f59_review_request", """WITH ctx AS (SELECT s.doc_id, s.idx, s.start_cs, s.end_cs, CASE WHEN s.end_cs > c.start_cs - 2000 AND s.start_cs < c.start_cs AND s.end_cs <= c.start_cs THEN 'before' WHEN s.start_cs < c.end_cs AND s.end_cs > c.start_cs THEN 'candidate' WHEN s.start_cs < c.end_cs + 2000 AND s.end_cs > c.end_cs AND s.start_cs >= c.end_cs THEN 'after' END AS side, min_start_cs, max_start_cs, min_end_cs, max_end_cs, c.start_cs AS cs, c.end_cs AS ce FROM segments s JOIN clips c USING (doc_id))
  SELECT doc_id, cs AS start_cs, ce AS end_cs, string_agg(idx || ':' || side || CASE WHEN side <> 'after' AND start_cs BETWEEN min_start_cs AND max_start_cs THEN ':s' ELSE '' END || CASE WHEN side <> 'before' AND end_cs BETWEEN min_end_cs AND max_end_cs THEN ':e' ELSE '' END, ' ' ORDER BY start_cs, end_cs, idx) AS segments FROM ctx WHERE side IS NOT NULL GROUP BY 1, 2, 3""", "segments clips")
def f59_review_request(spark, sf):
    """What a reviewer is asked about each clip: its context once, in order, with eligibility."""
    c, s = views.clips(spark, sf), views.segments(spark, sf)
    starts, ends = review.options(c, s)
    made = projections.review_request(c, review.context(c, s), starts, ends)
    show = lambda x: F.concat(x["idx"].cast("string"), F.lit(":"), x["side"], F.when(x["start_eligible"], ":s").otherwise(""), F.when(x["end_eligible"], ":e").otherwise(""))
    return made.select("doc_id", "start_cs", "end_cs", F.array_join(F.transform("segments", show), " ").alias("segments"))


@query("f60_render_plans", """WITH t AS (SELECT event_id, coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END, ''), CASE WHEN event_id % 3 = 0 THEN 'gaming' END, 'podcast') AS content, CASE WHEN event_id % 5 = 0 THEN 'speaker_face_crop' ELSE 'auto' END AS rq, CASE WHEN event_id % 7 = 0 THEN 'speaker_face_crop' WHEN event_id % 7 = 1 THEN 'odd' ELSE 'auto' END AS ro, value FROM events),
  m AS (SELECT *, CASE WHEN rq <> 'auto' THEN rq WHEN ro = 'speaker_face_crop' THEN ro ELSE 'auto' END AS mode FROM t)
  SELECT event_id, content AS content_type, mode AS layout_mode, 'content_type=' || content || ',crop_mode=' || CASE WHEN event_id % 2 = 0 THEN 'own' ELSE mode END || ',layout_mode=' || mode || ',requested_layout_mode=' || rq || ',weight=' || CASE mode WHEN 'auto' THEN '0.5' ELSE '0.9' END AS hints FROM m""")
def f60_render_plans(spark, sf):
    """Content type, layout mode and hints by precedence."""
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(i % 4 == 0, F.col("event_type")).otherwise("").alias("routing_type"), F.when(i % 3 == 0, "gaming").alias("strategy_type"), F.lit(None).cast("string").alias("layout_type"), F.when(i % 5 == 0, " Speaker_Face_Crop ").alias("requested_mode"), F.when(i % 7 == 0, "speaker_face_crop").when(i % 7 == 1, "odd").alias("routing_mode"), F.lit("auto").alias("strategy_mode"),
        F.when(i % 2 == 0, F.create_map(F.lit("crop_mode"), F.lit("own"), F.lit("weight"), F.lit("0.1"))).alias("strategy_hints"),
    )
    profiles = spark.createDataFrame([("auto", {"weight": "0.5"}), ("speaker_face_crop", {"weight": "0.9"})], "layout_mode string, profile map<string,string>")
    made = projections.render_plan(rows, profiles)
    pairs = F.transform(F.array_sort(F.map_entries("hints")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return made.select("event_id", "content_type", "layout_mode", F.array_join(pairs, ",").alias("hints"))


@query("f58_extra_fields", """SELECT conv_id, turn, 'channel=' || role || ',text=' || CASE WHEN turn % 2 = 0 THEN 'own' ELSE 'mine' END AS fields FROM conversations""")
def f58_extra_fields(spark, sf):
    """a segment's own fields, and extra ones that are not reserved."""
    own = F.create_map(F.lit("text"), F.when(F.col("turn") % 2 == 0, "own").otherwise("mine"))
    extra = F.create_map(F.lit("channel"), F.col("role"), F.lit("text"), F.lit("other"), F.lit("speaker"), F.lit("x"))
    pairs = F.transform(F.array_sort(F.map_entries(projections.with_extra(own, extra))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(pairs, ",").alias("fields"))


@query("f61_settings", """SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_name WHEN c_acctbal > 5000 THEN c_mktsegment WHEN c_custkey % 4 = 0 THEN 'filed' ELSE 'usual' END AS value, CASE WHEN c_nationkey = 3 THEN 'explicit' WHEN c_acctbal > 5000 THEN 'environment' WHEN c_custkey % 4 = 0 THEN '.env' ELSE 'default' END AS source FROM customer""")
def f61_settings(spark, sf):
    """a setting by precedence, and where it comes from."""
    x = projections.setting(F.when(F.col("c_nationkey") == 3, F.col("c_name")).otherwise(" "), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 4 == 0, "filed").otherwise(""), "usual")
    return table(spark, sf, "customer").select("c_custkey", x.alias("x")).select("c_custkey", "x.*")


@query("s13_dotenv", """WITH l AS (SELECT user_id, event_type AS name, max(event_id) AS id FROM events WHERE event_id % 6 <> 0 GROUP BY 1, 2) SELECT user_id AS path, name, CAST(id AS VARCHAR) AS value FROM l""")
def s13_dotenv(spark, sf):
    """Settings of NAME=value lines, the last one of a name (events as lines, some of them comments)."""
    i, k = F.col("event_id").cast("string"), F.col("event_type")
    line = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("# "), k, F.lit("="), i)).when(F.col("event_id") % 6 == 1, F.concat(F.lit("export "), k, F.lit(" = "), i)).when(F.col("event_id") % 6 == 2, F.concat(k, F.lit('="'), i, F.lit('"'))).when(F.col("event_id") % 6 == 3, F.concat(k, F.lit("='"), i, F.lit("'"))).otherwise(F.concat(F.lit("  "), k, F.lit("="), i))
    return documents.dotenv(table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), line.alias("value")))


# -- samples, faces, speakers, cues ---------------------------------------------------------------


@query("w15_sample_windows", r"""WITH s AS (SELECT doc_id, idx, start_cs AS s, end_cs AS e, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM segments), z AS (SELECT doc_id, max(e) AS last FROM s GROUP BY 1),
  r AS (SELECT doc_id, 0 AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rank, s + e AS c2 FROM s WHERE (doc_id * 7 + idx) % 11 = 0), b AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1),
  f AS (SELECT s.*, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s.doc_id) AS m, coalesce(b.n, 0) AS before FROM s LEFT JOIN b USING (doc_id) WHERE t <> '' WINDOW w AS (PARTITION BY s.doc_id ORDER BY idx)),
  g AS (SELECT *, greatest(1, m // 4) AS step FROM f), sp AS (SELECT doc_id, 1 AS kind, i // step + 1 AS rank, s + e AS c2 FROM g WHERE i % step = 0 AND (i = 0 OR before + i // step < 12)),
  dn AS (SELECT doc_id, 2 AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY len(regexp_extract_all(lower(t), '[0-9A-Za-zÀ-žąćęłńóśźżĄĆĘŁŃÓŚŹŻ]+')) / greatest((e - s) / 100, 0.01) DESC, idx) AS rank, s + e AS c2 FROM f QUALIFY rank <= 4),
  c AS (SELECT a.*, last * 2 AS l2, greatest(0, c2 - 900) AS lo FROM (SELECT * FROM r UNION ALL SELECT * FROM sp UNION ALL SELECT * FROM dn) a JOIN z USING (doc_id)),
  w AS (SELECT doc_id, kind, rank, CASE WHEN lo + 1800 > l2 THEN greatest(0, l2 - 1800) ELSE lo END AS s2, least(lo + 1800, l2) AS e2 FROM c),
  h AS (SELECT w.doc_id, kind, rank, s2, e2, string_agg(t, ' ' ORDER BY idx) AS text FROM w JOIN s ON s.doc_id = w.doc_id AND 2 * s.e > s2 AND 2 * s.s < e2 AND t <> '' WHERE e2 - s2 >= 200 GROUP BY ALL),
  o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, rank) AS n FROM h),
  k AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept, CAST([] AS BIGINT[]) AS spots FROM (SELECT DISTINCT doc_id FROM o)
    UNION ALL SELECT k.doc_id, o.n, CASE WHEN len(k.kept) < 4 AND len(list_filter(k.kept, lambda x: abs(x - o.s2) * 100 < 81000)) = 0 THEN list_append(k.kept, CAST(o.s2 AS BIGINT)) ELSE k.kept END, CASE WHEN len(k.kept) < 4 AND len(list_filter(k.kept, lambda x: abs(x - o.s2) * 100 < 81000)) = 0 THEN list_append(k.spots, CAST(o.n AS BIGINT)) ELSE k.spots END FROM k JOIN o ON o.doc_id = k.doc_id AND o.n = k.n + 1),
  q AS (SELECT doc_id, arg_max(spots, n) AS spots FROM k GROUP BY 1), u AS (SELECT doc_id, unnest(spots) AS n, unnest(range(0, len(spots))) AS i FROM q)
  SELECT u.doc_id, u.i, s2 / 200 AS start, e2 / 200 AS "end", left(text, 1200) AS text FROM u JOIN o USING (doc_id, n)""", "segments")
def w15_sample_windows(spark, sf):
    """Windows worth listening to, from issues, a stride and the densest speech."""
    s = views.segments(spark, sf)
    k = F.expr(K)
    issues = s.where((k % 11 == 0) | (k % 13 == 0)).select("doc_id", F.col("idx").alias("place"), F.when(k % 11 == 0, "REPEATED_WORDS").otherwise("EMPTY_TEXT").alias("code"), "start_cs", "end_cs")
    return sampling.sample_windows(s, issues)


@query("w13_strided", "SELECT track_id, idx, face FROM (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, event_type IN ('click', 'view', 'signup') AS face FROM events) WHERE idx % 5 = 0")
def w13_strided(spark, sf):
    """Every fifth frame."""
    line = Window.partitionBy("user_id").orderBy("event_id")
    s = table(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.row_number().over(line).cast("long").alias("idx"), F.col("event_type").isin("click", "view", "signup").alias("face"))
    return sampling.strided(s, 5)


@query("o9_best_face", """WITH f AS (SELECT l_orderkey AS frame, l_linenumber AS n, CAST(l_partkey % 1080 AS DOUBLE) AS x, CAST(l_suppkey % 96 * 20 AS DOUBLE) AS y, l_quantity / 500 AS a, l_discount AS e, CASE WHEN l_orderkey % 3 <> 0 THEN CAST(l_orderkey % 1080 AS DOUBLE) END AS px, l_orderkey % 5 = 0 AS re FROM lineitem),
  s AS (SELECT *, a >= 0.01 AND NOT ((x / 1080 <= 0.18 OR x / 1080 >= 0.82) AND (y / 1920 <= 0.18 OR y / 1920 >= 0.82)) AS ok, a * 10.0 + coalesce(greatest(0.0, 1.5 - abs(x - px) / 1080), 0.0) + greatest(0.0, 1.0 - abs(x - 540.0) / 1080) * CAST(0.5 AS DOUBLE) + e * CASE WHEN re THEN 12.0 ELSE 2.0 END * CAST(0.5 AS DOUBLE) + greatest(0.0, 1.0 - abs(y - 864.0) / 1920) AS score FROM f)
  SELECT frame, CAST(arg_max(n, row(score, -n)) FILTER (WHERE ok) AS INTEGER) AS n, round(max(score) FILTER (WHERE ok), 6) AS score, count(*) FILTER (WHERE ok) AS usable, count(*) FILTER (WHERE NOT ok) AS ignored FROM s GROUP BY 1""")
def o9_best_face(spark, sf):
    """The best of each frame's faces by area, nearness, middle, height and expression (order lines as faces)."""
    k = F.col("l_orderkey")
    f = table(spark, sf, "lineitem").select(
        k.alias("frame"), F.col("l_linenumber").cast("int").alias("n"), (F.col("l_partkey") % 1080).cast("double").alias("center_x"), (F.col("l_suppkey") % 96 * 20).cast("double").alias("center_y"), (F.col("l_quantity") / 500).alias("area_ratio"), F.col("l_discount").alias("expression"),
        F.lit(1080).alias("width"), F.lit(1920).alias("height"), F.when(k % 3 != 0, (k % 1080).cast("double")).alias("previous_x"), (k % 5 == 0).alias("reaction"),
    )
    return cutting.best_faces(f, True, 0.01, 0.5).withColumn("score", F.round("score", 6))


@query("g14_stabilized", """WITH r AS MATERIALIZED (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos, CASE WHEN idx % 4 = 3 THEN 'Default' WHEN idx % 4 = 2 THEN speaker || (idx % 8) ELSE speaker END AS sp, greatest(0, end_cs - start_cs) AS d FROM segments),
  b AS (SELECT doc_id, sp, sum(d) AS t, min(idx) AS f FROM r WHERE sp <> 'Default' GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, f) AS rk, count(*) OVER (PARTITION BY doc_id) AS n, sum(t) OVER (PARTITION BY doc_id) AS total FROM b),
  m AS MATERIALIZED (SELECT r.*, coalesce(rk <= 2, false) AS kept, coalesce(n > 2 AND rk > 2 AND (n >= 6 OR t <= 150 OR t / CASE WHEN total = 0 THEN 100 ELSE total END <= 0.12), false) AS goes, first_value(CASE WHEN rk = 1 THEN c.sp END IGNORE NULLS) OVER (PARTITION BY r.doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS main FROM r LEFT JOIN c ON c.doc_id = r.doc_id AND c.sp = r.sp),
  x AS MATERIALIZED (SELECT *, min(CASE WHEN kept THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ap FROM m), y AS MATERIALIZED (SELECT x.*, a.sp AS asp FROM x LEFT JOIN x a ON a.doc_id = x.doc_id AND a.pos = x.ap),
  w AS (SELECT doc_id, pos, CASE WHEN goes THEN coalesce(asp, main) ELSE sp END AS now, CASE WHEN kept OR goes THEN pos END AS at, CASE WHEN goes THEN coalesce(asp, main) WHEN kept THEN sp END AS who FROM y WHERE pos = 1
    UNION ALL SELECT y.doc_id, y.pos, CASE WHEN NOT y.goes THEN y.sp WHEN w.at IS NOT NULL AND (y.ap IS NULL OR y.pos - w.at <= y.ap - y.pos) THEN w.who ELSE coalesce(y.asp, y.main) END, CASE WHEN y.kept OR y.goes THEN y.pos ELSE w.at END,
      CASE WHEN y.kept THEN y.sp WHEN NOT y.goes THEN w.who WHEN w.at IS NOT NULL AND (y.ap IS NULL OR y.pos - w.at <= y.ap - y.pos) THEN w.who ELSE coalesce(y.asp, y.main) END FROM w JOIN y ON y.doc_id = w.doc_id AND y.pos = w.pos + 1)
  SELECT m.doc_id, m.idx, w.now AS speaker, w.now <> m.sp AS changed FROM w JOIN m USING (doc_id, pos)""", "segments")
def g14_stabilized(spark, sf):
    """Speakers beyond the cap that say little become the nearest kept one, row by row."""
    i = F.col("idx")
    s = views.segments(spark, sf).withColumn("speaker", F.when(i % 4 == 3, "Default").when(i % 4 == 2, F.concat("speaker", (i % 8).cast("string"))).otherwise(F.col("speaker")))
    return speakers.stabilized(s, 2)


@query("a5_colour_policy", """WITH o AS (SELECT doc_id, idx, speaker, end_cs - start_cs AS d, lag(speaker) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM segments WHERE idx % 5 <> 4),
  s AS (SELECT doc_id, count(*) FILTER (WHERE b <> speaker) AS switches, count(b) AS pairs, count(*) FILTER (WHERE d <= 100) AS sh FROM o GROUP BY 1), t AS (SELECT doc_id, count(*) AS k, min(x) AS least FROM (SELECT doc_id, speaker, sum(d) AS x FROM o GROUP BY 1, 2) GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM segments GROUP BY 1),
  j AS (SELECT n.doc_id, coalesce(switches, 0) AS switches, coalesce(pairs, 0) AS pairs, coalesce(k, 0) AS speakers, coalesce(sh, 0) AS short_segments, least, n FROM n LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id))
  SELECT doc_id, switches, pairs, speakers, short_segments, CASE WHEN speakers <> 2 OR (short_segments > 0 AND short_segments >= greatest(2, n // 4)) OR (10 * switches >= 7 * greatest(1, pairs) AND short_segments > 0) OR (speakers > 1 AND least < 200) THEN 'single_style_fallback' ELSE 'stable_per_speaker' END AS mode FROM j""", "segments")
def a5_colour_policy(spark, sf):
    """Whether each speaker of a transcript gets a colour of its own."""
    return speakers.colour_policy(views.segments(spark, sf).withColumn("speaker", F.when(F.col("idx") % 5 == 4, "Default").otherwise(F.col("speaker"))))


@query("g6_merged_short", """WITH w0 AS (SELECT doc_id, seg_idx, word_idx, start_cs + start_cs // 280 * 40 + CASE WHEN (doc_id + word_idx) % 5 = 0 THEN 35 ELSE 0 END AS s, end_cs + start_cs // 280 * 40 - CASE WHEN (doc_id + word_idx) % 3 = 0 THEN 4 ELSE 0 END AS e, text FROM words),
  o AS MATERIALIZED (SELECT doc_id, s, e, text, CAST(1 + word_idx % 5 AS INTEGER) AS imp, word_idx % 11 = 0 AS ch, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, text) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM w0),
  f AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS STRUCT(s BIGINT, e BIGINT, t VARCHAR, i INTEGER, c BOOLEAN)) AS held, CAST(NULL AS STRUCT(s BIGINT, e BIGINT, t VARCHAR, i INTEGER, c BOOLEAN)) AS carry, CAST([] AS STRUCT(s BIGINT, e BIGINT, t VARCHAR, i INTEGER, c BOOLEAN)[]) AS out, total FROM o WHERE n = 1
    UNION ALL SELECT doc_id, n, CASE act WHEN 'left' THEN {'s': least(held.s, cur.s), 'e': greatest(held.e, cur.e), 't': trim(held.t || ' ' || cur.t), 'i': greatest(held.i, cur.i), 'c': held.c OR cur.c} WHEN 'carry' THEN held ELSE {'s': cur.s, 'e': CASE WHEN cur.e - cur.s < 8 THEN cur.s + 8 ELSE cur.e END, 't': cur.t, 'i': cur.i, 'c': cur.c} END,
      CASE act WHEN 'carry' THEN cur END, CASE WHEN act = 'new' AND held IS NOT NULL THEN list_append(out, held) ELSE out END, total
      FROM (SELECT *, CASE WHEN cur.e - cur.s < 8 AND held IS NOT NULL AND cur.s - held.e <= 25 THEN 'left' WHEN cur.e - cur.s < 8 AND ns IS NOT NULL AND ns - cur.e <= 25 THEN 'carry' ELSE 'new' END AS act
        FROM (SELECT f.doc_id, o.n, f.held, f.out, f.total, (SELECT x.s FROM o x WHERE x.doc_id = o.doc_id AND x.n = o.n + 1) AS ns, CASE WHEN f.carry IS NULL THEN {'s': o.s, 'e': o.e, 't': o.text, 'i': o.imp, 'c': o.ch} ELSE {'s': least(f.carry.s, o.s), 'e': greatest(f.carry.e, o.e), 't': trim(f.carry.t || ' ' || o.text), 'i': greatest(f.carry.i, o.imp), 'c': f.carry.c OR o.ch} END AS cur
          FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1))),
  l AS (SELECT doc_id, list_append(out, held) AS out FROM f WHERE n = total), u AS (SELECT doc_id, unnest(range(0, len(out))) AS seg, unnest(out) AS x FROM l)
  SELECT doc_id, seg, x.s AS start_cs, x.e AS end_cs, x.t AS text, x.i AS importance, x.c AS chaos FROM u""", "words")
def g6_merged_short(spark, sf):
    """Short segments joined left, right or padded; the greater importance, either one's chaos (words as segments)."""
    k = F.col("doc_id") + F.col("word_idx")
    gap = F.expr("start_cs div 280") * 40
    s = views.words(spark, sf).select("doc_id", (F.col("start_cs") + gap + F.when(k % 5 == 0, 35).otherwise(0)).alias("start_cs"), (F.col("end_cs") + gap - F.when(k % 3 == 0, 4).otherwise(0)).alias("end_cs"), "text", (1 + F.col("word_idx") % 5).cast("int").alias("importance"), (F.col("word_idx") % 11 == 0).alias("chaos"))
    return transcripts.merge_short(s)


@query("f34_timed_words", r"""WITH w AS (SELECT doc_id, seg_idx, word_idx, start_cs, end_cs, CASE WHEN (doc_id + word_idx) % 6 = 2 THEN ',' WHEN (doc_id + word_idx) % 9 = 5 THEN '' ELSE regexp_replace(text, '[^\p{L}\p{N}]', '', 'g') END AS t FROM words WHERE text <> ''),
  k AS (SELECT * FROM w WHERE t <> '' AND NOT (doc_id + word_idx) % 13 = 4), g AS (SELECT *, sum(CASE WHEN t = ',' AND p IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, seg_idx ORDER BY word_idx) AS g FROM (SELECT *, lag(word_idx) OVER (PARTITION BY doc_id, seg_idx ORDER BY word_idx) AS p FROM k))
  SELECT doc_id, seg_idx, CAST(g - 1 AS BIGINT) AS word_idx, arg_min(start_cs, word_idx) AS start_cs, max(end_cs) AS end_cs, string_agg(t, '' ORDER BY word_idx) AS text FROM g GROUP BY doc_id, seg_idx, g""", "words")
def f34_timed_words(spark, sf):
    """recognized words with lone signs glued to the word before."""
    k = F.col("doc_id") + F.col("word_idx")
    t = F.when(k % 6 == 2, ",").when(k % 9 == 5, "").otherwise(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    w = views.words(spark, sf).select("doc_id", "seg_idx", "word_idx", "start_cs", F.when(k % 13 == 4, F.col("start_cs")).otherwise(F.col("end_cs")).alias("end_cs"), t.alias("text"))
    return cutting.timed_words(w)


# -- changes of the project store -----------------------------------------------------------------


@query("d2_transitions", "SELECT job_id, project_id, created_at, score, job_id % 9 = 0 AS cancel_requested, CASE WHEN job_id % 3 = 0 AND status IN ('queued', 'running') AND job_id % 9 <> 0 THEN 'completed' ELSE status END AS status, job_id % 3 = 0 AND status IN ('queued', 'running') AND job_id % 9 <> 0 AS changed FROM jobs", "jobs")
def d2_transitions(spark, sf):
    """A change of state that takes effect only on active jobs without a cancel; changed counts the rows."""
    j = views.jobs(spark, sf).withColumn("cancel_requested", F.col("job_id") % 9 == 0)
    return store.transitioned(j, j.where("job_id % 3 = 0").select("job_id", F.lit("completed").alias("status")))


@query("d7_bounds", """WITH a AS (SELECT *, start_cs + (doc_id % 7 - 3) * 900 AS s, end_cs + (doc_id % 5 - 2) * 1300 AS e, doc_id % 4 <> 0 AS asked FROM clips), b AS (SELECT *, CASE WHEN asked THEN array_to_string(list_filter([CASE WHEN s < min_start_cs OR s > max_start_cs THEN 'start out of bounds.' END, CASE WHEN e < min_end_cs OR e > max_end_cs THEN 'end out of bounds.' END, CASE WHEN e <= s THEN 'end not after start.' END, CASE WHEN e > s AND NOT e - s BETWEEN 1000 AND 9000 THEN 'duration out of bounds.' END], lambda x: x IS NOT NULL), ' ') ELSE '' END AS errors FROM a)
  SELECT doc_id, CASE WHEN asked AND errors = '' THEN s ELSE start_cs END AS start_cs, CASE WHEN asked AND errors = '' THEN e ELSE end_cs END AS end_cs, CASE WHEN asked AND errors = '' THEN 'user' ELSE 'heuristic' END AS boundary_source, errors FROM b""", "segments clips")
def d7_bounds(spark, sf):
    """New bounds that are valid replace the old ones, and the source becomes the user."""
    c = views.clips(spark, sf).withColumn("boundary_source", F.lit("heuristic"))
    changes = c.where("doc_id % 4 <> 0").select("doc_id", F.expr("start_cs + (doc_id % 7 - 3) * 900").alias("new_start_cs"), F.expr("end_cs + (doc_id % 5 - 2) * 1300").alias("new_end_cs"))
    return store.bounds_set(c, changes, review.bound_errors).select("doc_id", "start_cs", "end_cs", "boundary_source", "errors")


@query("d7_statuses", "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'accepted' WHEN c_nationkey % 4 = 1 THEN 'rejected' ELSE 'draft' END AS status, c_nationkey % 4 = 2 AS rejected FROM customer")
def d7_statuses(spark, sf):
    """Only known statuses are set, whatever their case."""
    n = F.col("c_nationkey") % 4
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.lit("draft").alias("status"))
    changes = c.where(n < 3).select("c_custkey", F.when(n == 0, " Accepted").when(n == 1, "REJECTED").otherwise("done").alias("status"))
    return store.statuses_set(c, changes, "c_custkey").drop("c_nationkey")


@query("d7_render_artifacts", "SELECT doc_id, 'raw' AS artifact_type, 'r' || doc_id AS path FROM clips WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'subtitled', 's' || doc_id || '_' || i FROM clips, (VALUES (0), (1)) v(i) WHERE doc_id % 2 = 0 AND doc_id % 3 = 0", "segments clips")
def d7_render_artifacts(spark, sf):
    """Outputs of a render as artifact rows."""
    c = views.clips(spark, sf).withColumn("render_status", F.lit("not_rendered"))
    d = F.col("doc_id").cast("string")
    r = c.where("doc_id % 2 = 0").select("doc_id", F.lit("").alias("status"), F.array(F.concat(F.lit("r"), d)).alias("raw_outputs"), F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("s"), d, F.lit("_0")), F.concat(F.lit("s"), d, F.lit("_1")))).alias("subtitled_outputs"))
    return store.renders_recorded(c, r)[1]


@query("x6_orphans", "SELECT job_id, project_id, created_at, score, CASE WHEN status IN ('queued', 'running') AND project_id % 3 <> 0 AND job_id % 9 <> 0 THEN 'failed' ELSE status END AS status, job_id % 9 = 0 AS cancel_requested, status IN ('queued', 'running') AND project_id % 3 <> 0 AND job_id % 9 <> 0 AS recovered FROM jobs", "jobs")
def x6_orphans(spark, sf):
    """Active jobs without a worker fail."""
    j = views.jobs(spark, sf).withColumn("cancel_requested", F.col("job_id") % 9 == 0)
    return store.orphans_failed(j, j.where("project_id % 3 = 0").select("project_id"))


@query("o10_current_task", """WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 53 = 0 THEN 'up_for_retry' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'queued' WHEN event_type = 'click' AND event_id % 11 = 0 THEN 'scheduled' WHEN event_type = 'purchase' THEN 'success' ELSE 'skipped' END AS s FROM events),
  r AS (SELECT *, list_position(['up_for_retry', 'restarting', 'up_for_reschedule', 'running', 'failed', 'queued', 'scheduled'], s) AS p FROM t), a AS (SELECT user_id, arg_min('t' || event_id, row(p, event_id)) FILTER (WHERE p > 0) AS x, arg_min(s, row(p, event_id)) FILTER (WHERE p > 0) AS xs, max(event_id) FILTER (WHERE s = 'success') AS z FROM r GROUP BY 1)
  SELECT user_id AS run_id, coalesce(x, 't' || z) AS task, coalesce(xs, CASE WHEN z IS NOT NULL THEN 'success' END) AS state FROM a""")
def o10_current_task(spark, sf):
    """The task that stands for a run: the first by the states' order, else the last that succeeded; over all events."""
    i, k = F.col("event_id"), F.col("event_type")
    state = F.when(i % 53 == 0, "up_for_retry").when((k == "error") & (i % 3 == 0), "failed").when((k == "signup") & (i % 5 == 0), "queued").when((k == "click") & (i % 11 == 0), "scheduled").when(k == "purchase", "success").otherwise("skipped")
    return store.current_task(table(spark, sf, "events").select(F.col("user_id").alias("run_id"), i.alias("ordinal"), F.concat(F.lit("t"), i.cast("string")).alias("task"), state.alias("state")))


@query("x5_reconciled", """WITH r AS (SELECT job_id, status, CAST(job_id % 100 AS DOUBLE) AS p, job_id % 17 = 0 AS cr, CASE WHEN job_id % 19 = 0 THEN NULL ELSE ['running', 'queued', 'success', 'failed', 'cancelled'][job_id % 5 + 1] END AS rs, CASE WHEN job_id % 4 <> 0 THEN CASE job_id % 3 WHEN 0 THEN 'transcribing' WHEN 1 THEN 'generating_candidates' ELSE 'reviewing_with_ai' END END AS g, job_id % 6 = 0 AS tf, job_id % 7 AS tr FROM jobs),
  s AS (SELECT *, cr OR status = 'cancelled' OR rs IS NULL AS still, tf AND tr > 2 AS spent, CASE g WHEN 'transcribing' THEN 30.0 WHEN 'generating_candidates' THEN 60.0 WHEN 'reviewing_with_ai' THEN 85.0 ELSE 0.0 END AS base FROM r)
  SELECT job_id, CASE WHEN still THEN status WHEN rs = 'cancelled' THEN 'cancelled' WHEN rs = 'success' THEN 'completed' WHEN rs = 'failed' OR spent THEN 'failed' WHEN rs = 'running' OR g IS NOT NULL THEN 'running' ELSE 'queued' END AS status,
    CASE WHEN still THEN 'downloading' WHEN rs = 'cancelled' THEN 'cancelled' WHEN rs = 'success' THEN 'ready' ELSE coalesce(g, 'waiting') END AS stage, CASE WHEN still OR rs = 'cancelled' THEN p WHEN rs = 'success' THEN 100.0 WHEN rs = 'failed' OR spent THEN p ELSE greatest(p, base) END AS progress FROM s""", "jobs")
def x5_reconciled(spark, sf):
    """Jobs after a look at the state of their runs."""
    i = F.col("job_id")
    j = views.jobs(spark, sf).select("job_id", "status", F.lit("downloading").alias("stage"), (i % 100).cast("double").alias("progress"), (i % 17 == 0).alias("cancel_requested"))
    states = F.array(*map(F.lit, ("running", "queued", "success", "failed", "cancelled")))
    stage = F.when(i % 4 != 0, F.when(i % 3 == 0, "transcribing").when(i % 3 == 1, "generating_candidates").otherwise("reviewing_with_ai"))
    runs = j.select("job_id", F.when(i % 19 != 0, F.get(states, (i % 5).cast("int"))).alias("run_state"), stage.alias("task_stage"), F.when(i % 6 == 0, "failed").otherwise("running").alias("task_state"), (i % 7).alias("try_number"), F.lit(2).alias("max_tries"))
    return store.reconciled(j, runs, {k: float(v) for k, v in PROGRESS.items()})


@query("x7_retries", "SELECT event_id, CASE WHEN event_id % 4 + 1 < CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 ELSE 1 END + CASE event_type WHEN 'click' THEN 1 ELSE 0 END THEN 'retrying' ELSE 'failed' END AS next FROM events")
def x7_retries(spark, sf):
    """Whether a failed attempt is followed by another within the task's budget."""
    k = F.col("event_type")
    task = F.when(k == "click", "transcribe").when(k == "view", "import_candidates").when(k == "signup", "prepare_workspace").otherwise(k)
    return table(spark, sf, "events").select("event_id", store.after_failure(task, F.col("event_id") % 4 + 1).alias("next"))


@query("x8_overdue", "SELECT o_orderkey, o_orderstatus = 'O' AND date_diff('second', o_orderdate, TIMESTAMP '1998-01-01') > CASE o_orderpriority WHEN '1-URGENT' THEN 86400 WHEN '2-HIGH' THEN 8640000 ELSE 31536000 END AS timed_out FROM orders")
def x8_overdue(spark, sf):
    """Running work beyond its kind's limit (open orders as running jobs)."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").cast("timestamp_ntz").alias("started"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    return store.overdue(o, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), {"1-URGENT": 86400, "2-HIGH": 8640000}, 31536000).select("o_orderkey", "timed_out")


@query("z5_adjustments", """WITH e AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS v, 0 AS g FROM lineitem WHERE l_linenumber % 3 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, 1 FROM lineitem WHERE l_linenumber % 2 = 0), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY g DESC, v DESC) = 1)
  SELECT k AS doc_id, string_agg(i || ':' || v, ' ' ORDER BY i) AS entries FROM l GROUP BY 1""")
def z5_adjustments(spark, sf):
    """A log's entries replaced by their index, sorted (order lines as entries)."""
    li = table(spark, sf, "lineitem")
    row = lambda w, c: li.where(w).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("segment_index"), F.col(c).alias("v"))
    made = store.adjustments_logged(row("l_linenumber % 3 <> 0", "l_partkey"), row("l_linenumber % 2 = 0", "l_suppkey"))
    return made.select("doc_id", F.array_join(F.transform("entries", lambda x: F.concat(x["segment_index"].cast("string"), F.lit(":"), x["v"].cast("string"))), " ").alias("entries"))


# -- scalars --------------------------------------------------------------------------------------


@query("f3_positions", """WITH t AS (SELECT event_id, CAST(floor(CAST(CAST(value AS VARCHAR) AS DECIMAL(18, 6)) * 370 + 0.5) AS BIGINT) AS t, CAST(CAST(value AS VARCHAR) AS DECIMAL(18, 2)) * 37 AS s FROM events),
  c AS (SELECT *, CAST(s * 100 AS BIGINT) AS cs, CAST(floor(s / 60) AS BIGINT) AS m FROM t), r AS (SELECT *, CAST(round(s - m * 60, 1) AS DECIMAL(10, 1)) AS rest FROM c)
  SELECT event_id, lpad(CAST(t // 36000 AS VARCHAR), CAST(greatest(2, length(CAST(t // 36000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(t // 600 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 10 % 60 AS VARCHAR), 2, '0') || '.' || (t % 10) AS position,
    lpad(CAST(t // 600 AS VARCHAR), CAST(greatest(2, length(CAST(t // 600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(t // 10 % 60 AS VARCHAR), 2, '0') || '.' || (t % 10) AS duration, CASE WHEN m > 0 THEN m || ':' || lpad(CAST(rest AS VARCHAR), 4, '0') ELSE rest || 's' END AS short,
    CASE WHEN cs >= 360000 THEN lpad(CAST(cs // 360000 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(cs // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(cs // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(cs % 100 AS VARCHAR), 2, '0') AS checker FROM r""")
def f3_positions(spark, sf):
    """positions, durations and short seconds as the service and the pages show them."""
    s = (F.col("value").cast("string").cast("decimal(18,2)") * 37).cast("double")
    return table(spark, sf, "events").select("event_id", tc.position(s).alias("position"), tc.duration(s).alias("duration"), tc.short_seconds(s).alias("short"), tc.checker_time(s).alias("checker"))


@query("f12_run_stamps", "SELECT event_id, 'project-' || user_id || '-job-' || event_id || '-' || strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def f12_run_stamps(spark, sf):
    """ids of runs with a UTC stamp."""
    return table(spark, sf, "events").select("event_id", tc.run_stamp(F.col("user_id"), F.col("event_id"), F.col("ts")).alias("stamp"))


@query("f27_subtitle_labels", r"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Speaker  ' || turn WHEN 1 THEN 'speaker ' || left(role, 1) WHEN 2 THEN role ELSE 'SPEAKER ' || role END AS r, role FROM conversations)
  SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Speaker ' || turn WHEN 1 THEN 'Speaker ' || (ascii(upper(left(role, 1))) - 65) WHEN 2 THEN 'Default' ELSE 'SPEAKER ' || role END AS label FROM t""")
def f27_subtitle_labels(spark, sf):
    """Speakers as subtitles name them."""
    t = F.col("turn")
    raw = F.when(t % 4 == 0, F.concat(F.lit("Speaker  "), t.cast("string"))).when(t % 4 == 1, F.concat(F.lit("speaker "), F.left("role", F.lit(1)))).when(t % 4 == 2, F.col("role")).otherwise(F.concat(F.lit("SPEAKER "), F.col("role")))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.subtitle_label(raw).alias("label"))


@query("f22_progress", "SELECT event_id, greatest(0.0, least(100.0, value - 20)) AS percent, 85.0 + 10.0 * CASE WHEN event_type = 'click' THEN greatest(1, event_id % 20) - 1 ELSE greatest(1, event_id % 20) END / greatest(1, user_id % 30) AS review FROM events")
def f22_progress(spark, sf):
    """progress inside its range, and that of a review."""
    return table(spark, sf, "events").select("event_id", tx.progress_percent(F.col("value") - 20).alias("percent"), tx.review_progress(F.col("event_id") % 20, F.col("user_id") % 30, F.col("event_type") == "click").alias("review"))


@query("f47_failures", """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'boundary_validation' WHEN 1 THEN 'provider_output' WHEN 2 THEN 'structured_output' WHEN 3 THEN 'provider_compatibility' WHEN 4 THEN 'quota' WHEN 5 THEN 'provider_timeout' ELSE 'provider' END AS category, p_size % 7 = 6 AS other FROM part""")
def f47_failures(spark, sf):
    """categories of failures by the error's type."""
    names = F.array(*map(F.lit, ("BoundaryOptionSelectionError", "ReviewProviderExtractionError", "ReviewProviderOutputError", "ReviewProviderCompatibilityError", "ReviewProviderQuotaError", "ReviewProviderTimeoutError")))
    c = tx.failure_category(F.coalesce(F.get(names, (F.col("p_size") % 7).cast("int")), F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", c.alias("category"), (tx.failure_detail(c) == "Gemini provider request failed.").alias("other"))


@query("f49_source_urls", r"SELECT page_id, CASE WHEN regexp_matches(trim(url), '^[hH][tT][tT][pP][sS]?://[^/?#\s]') AND length(trim(url)) <= 60 THEN trim(url) END AS url FROM pages")
def f49_source_urls(spark, sf):
    """absolute web addresses of bounded length."""
    return table(spark, sf, "pages").select("page_id", tx.source_url(F.concat(F.lit(" "), F.col("url")), 60).alias("url"))


@query("f51_state_labels", """SELECT job_id, CASE status WHEN 'completed' THEN 'Rendered' ELSE upper(left(status, 1)) || substr(status, 2) END AS label, greatest(0, least(100, CAST(floor(score + 0.5) AS BIGINT))) || '%' AS percent FROM jobs""", "jobs")
def f51_state_labels(spark, sf):
    """labels of states, whole percents."""
    return views.jobs(spark, sf).select("job_id", tx.status_label(F.col("status")).alias("label"), tx.percent_label(F.col("score")).alias("percent"))


@query("f56_answers", """SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS matches_audio, least(1.0, value / 100) AS confidence, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_type || ',' || user_id ELSE '' END AS hallucinated FROM events""")
def f56_answers(spark, sf):
    """A model's answer with its types set right."""
    i, k = F.col("event_id"), F.col("event_type")
    words = F.when(i % 3 == 0, F.concat(F.lit('" '), k, F.lit('"'))).when(i % 3 == 1, F.concat(F.lit('["'), k, F.lit(' ", " ", "'), F.col("user_id").cast("string"), F.lit('"]'))).otherwise("null")
    flag = F.when(k == "click", "Tak").when(k == "view", "no").otherwise("so so")
    text = F.concat(F.lit('{"matches_audio":"'), flag, F.lit('","confidence":'), (F.col("value") / 100).cast("string"), F.lit(',"hallucinated_words":'), words, F.lit("}"))
    x = tx.checked_answer(F.try_parse_json(text))
    return table(spark, sf, "events").select("event_id", x.alias("x")).select("event_id", "x.matches_audio", "x.confidence", F.array_join("x.hallucinated_words", ",").alias("hallucinated"))


@query("f50_speaker_modes", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'single' WHEN event_type = 'view' THEN 'multi' ELSE 'unknown' END AS speakers, CASE WHEN event_id % 3 = 0 THEN 'gemini_optional' WHEN event_id % 3 = 1 THEN 'local_only' END AS ai, CASE WHEN event_id % 4 = 0 THEN 'local_only' WHEN event_id % 4 = 1 THEN 'limited' WHEN event_id % 4 = 2 THEN 'full' END AS mode, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 5 END AS samples FROM events")
def f50_speaker_modes(spark, sf):
    """modes through their other spellings; an unknown one is null where it configures a run."""
    i, k = F.col("event_id"), F.col("event_type")
    mode = tx.checker_mode(F.when(i % 4 == 0, "").when(i % 4 == 1, " Limited ").when(i % 4 == 2, "FULL").otherwise(k))
    return table(spark, sf, "events").select("event_id", tx.speaker_mode(F.when(k == "click", "Single-Speaker").when(k == "view", " multiple ").otherwise(k)).alias("speakers"), tx.ai_mode(F.when(i % 3 == 0, F.lit(None)).when(i % 3 == 1, "LOCAL_only").otherwise(k)).alias("ai"), mode.alias("mode"), tx.checker_samples(mode, 5).alias("samples"))


# -- sources, summaries ---------------------------------------------------------------------------


@query("s2_heatmap_rows", "SELECT video_id, idx, start_time, end_time, value, duration_seconds FROM heatmap_points", "heatmap_points")
def s2_heatmap_rows(spark, sf):
    """Points of heatmap documents, through their JSON."""
    p = views.heatmap_points(spark, sf)
    points = F.transform(F.array_sort(F.collect_list(F.struct("idx", "start_time", "end_time", "value"))), lambda x: F.struct(x["start_time"].alias("start_time"), x["end_time"].alias("end_time"), x["value"].alias("value")))
    docs = p.groupBy("video_id", "duration_seconds").agg(points.alias("points"))
    return documents.heatmap_rows(docs.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("test").alias("source"), F.lit(False).alias("synthetic"), "video_id", "duration_seconds", "points")).alias("value")))


@query("a13_merge_summary", """WITH t AS (SELECT doc_id, start_cs, start_cs + (end_cs - start_cs) // 3 AS end_cs, raw_speaker FROM turns), ov AS (SELECT DISTINCT w.doc_id, seg_idx, word_idx FROM words w JOIN t ON t.doc_id = w.doc_id AND t.start_cs < w.end_cs AND t.end_cs > w.start_cs),
  d AS (SELECT w.doc_id, w.seg_idx, w.word_idx, min(CASE WHEN t.end_cs <= w.start_cs THEN w.start_cs - t.end_cs ELSE t.start_cs - w.end_cs END) AS d FROM words w ANTI JOIN ov USING (doc_id, seg_idx, word_idx) JOIN t ON t.doc_id = w.doc_id GROUP BY ALL)
  SELECT w.doc_id, count(*) AS words, count(d.d) AS outside_words, coalesce(max(d.d), 0) AS outside_cs FROM words w LEFT JOIN d USING (doc_id, seg_idx, word_idx) GROUP BY 1""", "words turns")
def a13_merge_summary(spark, sf):
    """Words that no turn overlaps, and their greatest distance to a turn (turns cut to a third of their length, so that there are gaps)."""
    return speakers.merge_summary(speakers.merged(views.words(spark, sf), views.turns(spark, sf).withColumn("end_cs", F.expr("start_cs + (end_cs - start_cs) div 3"))))


@query("u3_prohibited_fields", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'score,' || event_type WHEN event_type IN ('click', 'view') THEN event_type ELSE '' END AS fields FROM events WHERE event_id % 4 <> 0 OR event_type IN ('click', 'view') UNION ALL SELECT event_id, 'score' FROM events WHERE event_id % 4 = 0 AND event_type NOT IN ('click', 'view')".replace("'score,' || event_type", "CASE WHEN event_type = 'click' THEN 'click,score' ELSE 'score,view' END"))
def u3_prohibited_fields(spark, sf):
    """Fields of a document that may not be there."""
    k = F.col("event_type")
    doc = F.concat(F.lit('{"'), k, F.lit('": 1, "id": 2'), F.when(F.col("event_id") % 4 == 0, ', "score": 0.5').otherwise(""), F.lit("}"))
    return table(spark, sf, "events").select("event_id", F.array_join(checks.prohibited_fields(doc, ("score", "click", "view")), ",").alias("fields"))


@query("f57_enums", """SELECT c_custkey, '{"type":"object","a":{"enum":["' || c_mktsegment || '"]},"b":{"enum":[' || c_nationkey || ']}}' AS schema FROM customer""")
def f57_enums(spark, sf):
    """constants of a JSON schema as enums of one value."""
    doc = F.concat(F.lit('{"type":"object","a":{"const": "'), F.col("c_mktsegment"), F.lit('"},"b":{"const":'), F.col("c_nationkey").cast("string"), F.lit("}}"))
    return table(spark, sf, "customer").select("c_custkey", tx.enums_for_constants(doc).alias("schema"))


@query("p8_public_rows", "SELECT artifact_id, project_id, artifact_type, at_s FROM artifacts", "artifacts")
def p8_public_rows(spark, sf):
    """Rows without the columns that name paths."""
    return store.public(views.artifacts(spark, sf).withColumn("transcript_path", F.lit("/srv/x")).withColumn("output_dir", F.lit("/srv/y")))


@query("j16_children", """SELECT c_custkey AS project_id, coalesce(j.n, 0) AS jobs, coalesce(a.n, 0) AS artifacts, coalesce(e.n, 0) AS evaluations, coalesce(o.n, 0) AS clips FROM customer LEFT JOIN (SELECT project_id, count(*) AS n FROM jobs GROUP BY 1) j ON j.project_id = c_custkey
  LEFT JOIN (SELECT project_id, count(*) AS n FROM artifacts GROUP BY 1) a ON a.project_id = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON e.user_id = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey""", "jobs artifacts")
def j16_children(spark, sf):
    """A project's jobs, artifacts, evaluations and clips (orders as clips)."""
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"))
    clips = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"))
    return store.with_children(p, "project_id", jobs=views.jobs(spark, sf), artifacts=views.artifacts(spark, sf), evaluations=_evaluations(spark, sf), clips=clips)


@query("a11_distinct_speakers", "SELECT doc_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM segments GROUP BY 1", "segments")
def a11_distinct_speakers(spark, sf):
    """Each transcript's speakers, sorted."""
    return speakers.distinct_speakers(views.segments(spark, sf)).select("doc_id", F.array_join("speakers", ",").alias("speakers"))


@query("o14_preferred_artifacts", "SELECT project_id, artifact_id, artifact_type FROM artifacts QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY CASE artifact_type WHEN 'subtitled' THEN 1 ELSE 2 END, at_s DESC, artifact_id DESC) = 1", "artifacts")
def o14_preferred_artifacts(spark, sf):
    """The artifact that stands for a project: subtitled before raw, the newest of equals."""
    return store.preferred(views.artifacts(spark, sf), "project_id")


@query("o6_newest_artifacts", "SELECT artifact_id, project_id, artifact_type, at_s FROM artifacts ORDER BY at_s DESC, artifact_id DESC LIMIT 100", "artifacts")
def o6_newest_artifacts(spark, sf):
    """The hundred newest artifacts (a report)."""
    return store.newest(views.artifacts(spark, sf), 100)


@query("f46_metadata", "SELECT event_id, 'api_key=<redacted>,note=token=<redacted> of ' || user_id AS metadata FROM events")
def f46_metadata(spark, sf):
    """metadata without secrets, by name and by value."""
    m = F.create_map(F.lit("api_key"), F.col("event_type"), F.lit("note"), F.concat(F.lit("token="), F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string")))
    pairs = F.transform(F.array_sort(F.map_entries(tx.redacted_metadata(m))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return table(spark, sf, "events").select("event_id", F.array_join(pairs, ",").alias("metadata"))
