"""Registered queries over transcripts, speakers, reviews, cuts, text and the project store."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import sensitive
from spanloom.functions import text as tx
from spanloom.functions import timecode as tc
from spanloom.operators import cutting, review, speakers, store, transcripts
from spanloom.plans import views
from spanloom.plans.views import table, with_views

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, views_used: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(views_used, sql) if views_used else sql
        return f

    return add


# -- time codes -----------------------------------------------------------------------------------

_CODES = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN CAST(event_id % 100 AS VARCHAR) || '.5' WHEN 1 THEN '1:' || CAST(event_id % 60 AS VARCHAR) WHEN 2 THEN '0:05,25'
  WHEN 3 THEN '1:02:03.75' WHEN 4 THEN '::7' WHEN 5 THEN 'abc' WHEN 6 THEN '-4' WHEN 7 THEN '1.5:30' ELSE '' END AS code FROM events"""


def _codes(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    k = F.col("event_id") % 9
    texts = {0: F.concat((F.col("event_id") % 100).cast("string"), F.lit(".5")), 1: F.concat(F.lit("1:"), (F.col("event_id") % 60).cast("string")), 2: F.lit("0:05,25"), 3: F.lit("1:02:03.75"), 4: F.lit("::7"), 5: F.lit("abc"), 6: F.lit("-4"), 7: F.lit("1.5:30")}
    code = F.lit("")
    for i, v in texts.items():
        code = F.when(k == i, v).otherwise(code)
    return e.withColumn("code", code)


@query("f1_parse_time", f"""WITH c AS ({_CODES}), p AS (SELECT *, string_split(replace(code, ',', '.'), ':') AS l FROM c)
  SELECT event_id, code,
    CASE len(l) WHEN 1 THEN TRY_CAST(l[1] AS DOUBLE) WHEN 2 THEN CASE WHEN regexp_matches(l[1], '^[+-]?[0-9]+$') THEN TRY_CAST(l[1] AS DOUBLE) END * 60 + TRY_CAST(l[2] AS DOUBLE) WHEN 3 THEN TRY_CAST(l[1] AS DOUBLE) * 3600 + TRY_CAST(l[2] AS DOUBLE) * 60 + TRY_CAST(l[3] AS DOUBLE) END AS checker,
    CASE WHEN code = '::7' THEN 7.0 WHEN len(l) = 1 THEN TRY_CAST(l[1] AS DOUBLE) WHEN len(l) = 2 THEN CASE WHEN regexp_matches(l[1], '^[0-9]+$') THEN TRY_CAST(l[1] AS DOUBLE) END * 60 + TRY_CAST(l[2] AS DOUBLE) WHEN len(l) = 3 THEN TRY_CAST(l[1] AS DOUBLE) * 3600 + TRY_CAST(l[2] AS DOUBLE) * 60 + TRY_CAST(l[3] AS DOUBLE) END AS cutter,
    CASE len(l) WHEN 1 THEN TRY_CAST(l[1] AS DOUBLE) WHEN 2 THEN TRY_CAST(l[1] AS DOUBLE) * 60 + TRY_CAST(l[2] AS DOUBLE) WHEN 3 THEN TRY_CAST(l[1] AS DOUBLE) * 3600 + TRY_CAST(l[2] AS DOUBLE) * 60 + TRY_CAST(l[3] AS DOUBLE) END AS base,
    CASE WHEN regexp_matches(replace(code, ',', '.'), '^[0-9]+:[0-9][0-9]?:[0-9][0-9]([.][0-9]+)?$') THEN CAST(l[1] AS DOUBLE) * 3600 + CAST(l[2] AS DOUBLE) * 60 + CAST(l[3] AS DOUBLE)
      WHEN regexp_matches(replace(code, ',', '.'), '^[0-9][0-9]?:[0-9][0-9]([.][0-9]+)?$') THEN CAST(l[1] AS DOUBLE) * 60 + CAST(l[2] AS DOUBLE) END AS subtitler,
    CASE WHEN code = '-4' THEN NULL WHEN len(l) = 1 THEN TRY_CAST(l[1] AS DOUBLE) WHEN len(l) = 2 THEN CASE WHEN regexp_matches(l[1], '^[0-9]+$') THEN TRY_CAST(l[1] AS DOUBLE) END * 60 + TRY_CAST(l[2] AS DOUBLE) WHEN len(l) = 3 THEN TRY_CAST(l[1] AS DOUBLE) * 3600 + TRY_CAST(l[2] AS DOUBLE) * 60 + TRY_CAST(l[3] AS DOUBLE) END AS strict
  FROM p""")
def f1_parse_time(spark, sf):
    """five of the parsers side by side, over codes that tell them apart (the other two: checked in the tests)."""
    c = F.col("code")
    return _codes(spark, sf).select("event_id", "code", tc.parse_checker(c).alias("checker"), tc.parse_cutter(c).alias("cutter"), tc.parse_base(c).alias("base"), tc.parse_subtitler(c).alias("subtitler"), tc.parse_strict(c).alias("strict"))


@query("f2_timecodes", """WITH e AS (SELECT event_id, CAST(CAST(CAST(value AS VARCHAR) AS DECIMAL(18, 2)) * 100 AS BIGINT) * 37 AS cs FROM events)
  SELECT event_id, cs, CASE WHEN cs >= 360000 THEN lpad(CAST(cs // 360000 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(cs % 360000 // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(cs % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(cs % 100 AS VARCHAR), 2, '0') AS hms,
    CAST(cs // 360000 AS VARCHAR) || ':' || lpad(CAST(cs % 360000 // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(cs % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(cs % 100 AS VARCHAR), 2, '0') AS ass,
    CASE WHEN length(CAST(cs // 6000 AS VARCHAR)) < 2 THEN lpad(CAST(cs // 6000 AS VARCHAR), 2, '0') ELSE left(CAST(cs // 6000 AS VARCHAR), 2) END || '-' || lpad(CAST(cs // 100 % 60 AS VARCHAR), 2, '0') AS stamp FROM e""")
def f2_timecodes(spark, sf):
    """Formatters of centiseconds, quantized half up."""
    cs = tc.centiseconds(F.col("value")) * 37
    return table(spark, sf, "events").select("event_id", cs.alias("cs")).select("event_id", "cs", tc.hms(F.col("cs")).alias("hms"), tc.ass_time(F.col("cs")).alias("ass"), tc.file_stamp(F.col("cs")).alias("stamp"))


@query("k5_normalized", r"""SELECT doc_id, 'seg_v1_' || sha256('{"end_centiseconds":' || CAST(end_cs AS VARCHAR) || ',"segment_id_version":1,"start_centiseconds":' || CAST(start_cs AS VARCHAR) || '}') AS segment_id, start_cs, end_cs, speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, 3 AS importance FROM segments""", "segments")
def k5_normalized(spark, sf):
    """Canonical segments with content ids."""
    return transcripts.normalized(views.segments(spark, sf))


# -- text scores ----------------------------------------------------------------------------------

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*')"


@query("f25_scores", rf"""WITH t AS (SELECT doc_id, idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, (end_cs - start_cs) / 100.0 AS sec, {_TOK} AS k FROM segments),
  s AS (SELECT *, 3 + CASE WHEN len(list_filter({list(tx.PROFANITY)}, lambda w: contains(lower(text), w))) > 0 THEN 1 ELSE 0 END + CASE WHEN contains(text, '!') OR length(text) - length(replace(text, '?', '')) >= 2 THEN 1 ELSE 0 END
    + CASE WHEN len(list_intersect(k, {list(tx.EMPHASIS)})) > 0 THEN 1 ELSE 0 END + CASE WHEN sec > 0 AND sec <= 2 AND len(k) <= 6 THEN 1 ELSE 0 END - CASE WHEN len(k) >= 22 AND sec > 9 THEN 1 ELSE 0 END AS raw FROM t)
  SELECT doc_id, idx, CAST(len(k) AS INTEGER) AS tokens, CAST(CASE WHEN text = '' THEN 1 ELSE greatest(1, least(5, raw)) END AS INTEGER) AS importance,
    CASE WHEN text = '' OR sec <= 0 THEN false ELSE len(k) / greatest(sec, 0.01) >= 4.8 OR length(text) - length(replace(text, '/', '')) >= 2 END AS chaos FROM s""", "segments")
def f25_scores(spark, sf):
    """Tokens, importance and chaos of segments."""
    sec = (F.col("end_cs") - F.col("start_cs")) / 100
    t = F.col("text")
    return views.segments(spark, sf).select("doc_id", "idx", F.size(tx.tokens(t)).alias("tokens"), tx.importance(t, sec).alias("importance"), tx.chaos(t, sec).alias("chaos"))


@query("f27_speaker_labels", """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Speaker ' || CAST(turn AS VARCHAR) WHEN 1 THEN 'Speaker 1' WHEN 2 THEN 'Speaker 0' WHEN 3 THEN 'Speaker ' || role ELSE 'Speaker 0' END AS label FROM conversations""")
def f27_speaker_labels(spark, sf):
    """labels from numbers, letters and names."""
    t = F.col("turn")
    raw = F.when(t % 5 == 0, F.concat(F.lit("SPK_0"), t.cast("string"))).when(t % 5 == 1, " speaker b ").when(t % 5 == 2, F.lit(None)).when(t % 5 == 3, F.col("role")).otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.speaker_label(raw).alias("label"))


@query("f28_subtitle_text")
def f28_subtitle_text(spark, sf):
    """Normalized and wrapped subtitle text (look-around: checked in the tests)."""
    return views.segments(spark, sf).select("doc_id", "idx", tx.subtitle_text(F.col("text"), capitalize=True).alias("text"), tx.wrapped(F.col("text")).alias("lines"))


@query("f36_without_repeats", r"""WITH RECURSIVE w AS (SELECT doc_id, idx, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS l FROM segments),
  u AS (SELECT doc_id, idx, unnest(l) AS w, unnest(range(0, len(l))) AS i FROM w),
  p AS (SELECT *, lower(regexp_replace(w, '[^\p{L}\p{N}_]+', '', 'g')) AS k FROM u),
  q AS (SELECT *, lag(k) OVER (PARTITION BY doc_id, idx ORDER BY i) AS b FROM p)
  SELECT s.doc_id, s.idx, coalesce((SELECT string_agg(q.w, ' ' ORDER BY q.i) FROM q WHERE q.doc_id = s.doc_id AND q.idx = s.idx AND (q.k = '' OR q.b IS NULL OR q.k <> q.b)), '') AS text FROM segments s""".replace("WITH RECURSIVE", "WITH"), "segments")
def f36_without_repeats(spark, sf):
    """neighbouring equal words once."""
    return views.segments(spark, sf).select("doc_id", "idx", tx.without_repeats(F.col("text")).alias("text"))


@query("f37_repaired")
def f37_repaired(spark, sf):
    """text repairs and what they were (the order matters: checked in the tests)."""
    made = views.segments(spark, sf).select("doc_id", "idx", tx.repaired(F.col("text")).alias("r"))
    return made.select("doc_id", "idx", "r.text", F.array_join("r.fixes", ",").alias("fixes"))


@query("f42_thought_edges", r"""WITH t AS (SELECT doc_id, idx, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM segments)
  SELECT doc_id, idx, regexp_extract(lower(t), '^([\p{L}\p{N}_]+)', 1) IN ('and', 'but', 'so', 'because', 'ale', 'bo', 'wiec', 'czyli') AS starts_mid,
    t = '' OR right(t, 1) IN (',', ':', ';', '-') OR regexp_extract(lower(regexp_extract(t, '([^ ]*)$', 1)), '^([\p{L}\p{N}_]+)', 1) IN ('and', 'but', 'because', 'so', 'ale', 'bo', 'wiec') AS ends_open FROM t""", "segments")
def f42_thought_edges(spark, sf):
    """starts mid-thought, ends unfinished."""
    return views.segments(spark, sf).select("doc_id", "idx", tx.starts_mid_thought(F.col("text")).alias("starts_mid"), tx.ends_unfinished(F.col("text")).alias("ends_open"))


@query("k14_sensitive")
def k14_sensitive(spark, sf):
    """Sensitive matches, masked, and each document's risk (look-behind: checked in the tests)."""
    made = table(spark, sf, "documents").select("doc_id", sensitive.matches(F.col("text")).alias("m"))
    return made.select("doc_id", F.size("m").alias("matches"), sensitive.risk(F.col("m")).alias("risk"), F.to_json("m").alias("found"))


@query("k14_emails", r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS e FROM documents),
  p AS (SELECT doc_id, split_part(e, '@', 1) AS u, string_split(split_part(e, '@', -1), '.') AS d FROM m)
  SELECT doc_id, CASE WHEN length(u) > 2 THEN left(u, 2) || '***' ELSE '***' END || '@' || array_to_string(list_concat([CASE WHEN length(d[1]) > 2 THEN left(d[1], 2) || '***' ELSE '***' END], d[2:]), '.') AS masked FROM p""")
def k14_emails(spark, sf):
    """E-mail addresses, masked."""
    made = table(spark, sf, "documents").select("doc_id", F.explode(F.filter(sensitive.matches(F.col("text")), lambda x: x["type"] == "email")).alias("m"))
    return made.select("doc_id", F.col("m.text").alias("masked"))


@query("f46_redacted", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(gemini_api_key|google_api_key|api[_-]?key|password|secret|token)\s*=\s*([^\s,;]+)', '\1=<redacted>', 'gi'), '([?&](?:api[_-]?key|key|token|access_token|signature|sig|authorization)=)([^&\s"'']+)', '\1<redacted>', 'gi'), '(authorization\s*:\s*bearer\s+)([^\s,;]+)', '\1<redacted>', 'gi') AS text FROM documents""")
def f46_redacted(spark, sf):
    """secrets in texts."""
    return table(spark, sf, "documents").select("doc_id", tx.redacted(F.col("text")).alias("text"))


@query("f48_log_stage", """WITH l AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Start DOWNLOAD of ' WHEN 'view' THEN 'Transcribing ' WHEN 'signup' THEN 'workflow completed ' WHEN 'error' THEN 'an error in ' ELSE 'nothing ' END || props AS line FROM events)
  SELECT event_id, CASE WHEN contains(lower(line), 'transcrib') THEN 'transcribing' WHEN contains(lower(line), 'download') THEN 'downloading' WHEN contains(lower(line), 'workflow completed') THEN 'ready' WHEN contains(lower(line), 'error') THEN 'failed' END AS stage FROM l""")
def f48_log_stage(spark, sf):
    """Stages of log lines."""
    heads = F.create_map(*[F.lit(x) for kv in {"click": "Start DOWNLOAD of ", "view": "Transcribing ", "signup": "workflow completed ", "error": "an error in ", "purchase": "nothing "}.items() for x in kv])
    return table(spark, sf, "events").select("event_id", tx.log_stage(F.concat(F.try_element_at(heads, F.col("event_type")), F.col("props"))).alias("stage"))


# -- transcript quality ---------------------------------------------------------------------------


@query("g5_segmented", r"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_cs, seg_idx, word_idx) AS r, lead(start_cs) OVER (PARTITION BY doc_id ORDER BY start_cs, seg_idx, word_idx) AS nx FROM words),
  m AS MATERIALIZED (SELECT doc_id, r, start_cs, end_cs, text, regexp_matches(text, '[.!?…]$') OR coalesce(nx - end_cs >= 65, false) AS hard FROM o),
  f AS (SELECT doc_id, r, start_cs AS s, 1 AS n, length(text) AS c, 0 AS k, hard OR end_cs - start_cs >= 750 OR length(text) >= 180 AS stop FROM m WHERE r = 1
    UNION ALL SELECT m.doc_id, m.r, CASE WHEN f.stop THEN m.start_cs ELSE f.s END, CASE WHEN f.stop THEN 1 ELSE f.n + 1 END, CASE WHEN f.stop THEN length(m.text) ELSE f.c + 1 + length(m.text) END, f.k + CASE WHEN f.stop THEN 1 ELSE 0 END,
      m.hard OR m.end_cs - CASE WHEN f.stop THEN m.start_cs ELSE f.s END >= 750 OR CASE WHEN f.stop THEN 1 ELSE f.n + 1 END >= 18 OR CASE WHEN f.stop THEN length(m.text) ELSE f.c + 1 + length(m.text) END >= 180
      FROM f JOIN m ON m.doc_id = f.doc_id AND m.r = f.r + 1)
  SELECT m.doc_id, CAST(f.k AS BIGINT) AS seg, min(m.start_cs) AS start_cs, max(m.end_cs) AS end_cs, string_agg(m.text, ' ' ORDER BY m.r) AS text, count(*) AS n_words FROM m JOIN f USING (doc_id, r) GROUP BY 1, 2""", "words")
def g5_segmented(spark, sf):
    """Words to segments by five ordered rules."""
    return transcripts.segmented(views.words(spark, sf))


def _qa_rows(spark, sf):
    s = views.segments(spark, sf)
    k = F.col("doc_id") * 7 + F.col("idx")
    start = F.when(k % 13 == 0, F.col("start_cs") - 60).when(k % 17 == 0, F.lit(None)).otherwise(F.col("start_cs"))
    end = F.when(k % 19 == 0, F.col("start_cs") - 50).when(k % 23 == 0, F.col("start_cs")).otherwise(F.col("end_cs"))
    text = F.when(k % 29 == 0, "").when(k % 31 == 0, "json aaaaaaaaaa").when(k % 11 == 0, "no no no no no no no").otherwise(F.col("text"))
    return s.select("doc_id", "idx", start.alias("start_cs"), end.alias("end_cs"), text.alias("text"))


_QA = r"""WITH r AS (SELECT doc_id, idx, CASE WHEN (doc_id * 7 + idx) % 13 = 0 THEN start_cs - 60 WHEN (doc_id * 7 + idx) % 17 = 0 THEN NULL ELSE start_cs END AS s,
    CASE WHEN (doc_id * 7 + idx) % 19 = 0 THEN start_cs - 50 WHEN (doc_id * 7 + idx) % 23 = 0 THEN start_cs ELSE end_cs END AS e,
    CASE WHEN (doc_id * 7 + idx) % 29 = 0 THEN '' WHEN (doc_id * 7 + idx) % 31 = 0 THEN 'json aaaaaaaaaa' WHEN (doc_id * 7 + idx) % 11 = 0 THEN 'no no no no no no no' ELSE text END AS text FROM segments),
  au AS (SELECT doc_id, max(end_cs) - 300 AS audio FROM segments GROUP BY doc_id),
  x AS (SELECT r.*, audio, CASE WHEN s IS NULL OR e IS NULL THEN 'INVALID_TIME' WHEN e < s - 5 THEN 'NEGATIVE_DURATION' END AS fault FROM r JOIN au USING (doc_id)),
  y AS (SELECT doc_id, idx, audio, s, e <= s + 5 AS zero, CASE WHEN e <= s + 5 THEN s + 50 ELSE e END AS e, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, regexp_extract_all(lower(text), '[0-9A-Za-zÀ-žąćęłńóśźżĄĆĘŁŃÓŚŹŻ]+') AS k FROM x WHERE fault IS NULL),
  z AS (SELECT *, lag(e) OVER w AS pe, lag(lower(t)) OVER w AS pt, len(k) AS n, (e - s) / 100 AS sec FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
  found AS (SELECT doc_id, idx, fault AS code FROM x WHERE fault IS NOT NULL
    UNION ALL SELECT doc_id, idx, 'ZERO_DURATION' FROM z WHERE zero UNION ALL SELECT doc_id, idx, 'NEGATIVE_TIME' FROM z WHERE s < -5 UNION ALL SELECT doc_id, idx, 'OUT_OF_AUDIO_RANGE' FROM z WHERE e > audio + 200
    UNION ALL SELECT doc_id, idx, 'OVERLAPPING_SEGMENTS' FROM z WHERE s < pe - 25 UNION ALL SELECT doc_id, idx, 'EMPTY_TEXT' FROM z WHERE t = '' UNION ALL SELECT doc_id, idx, 'NO_WORDS' FROM z WHERE t <> '' AND n = 0
    UNION ALL SELECT doc_id, idx, 'TOO_MANY_WORDS_FOR_DURATION' FROM z WHERE t <> '' AND n > 0 AND n / greatest(sec, 0.01) > 7 UNION ALL SELECT doc_id, idx, 'TEXT_TOO_SLOW_FOR_DURATION' FROM z WHERE t <> '' AND n >= 8 AND n / greatest(sec, 0.01) < 0.35
    UNION ALL SELECT doc_id, idx, 'REPEATED_WORDS' FROM z WHERE n >= 6 AND len(list_distinct(k)) / n <= 0.34 UNION ALL SELECT doc_id, idx, 'REPEATED_CHARACTERS' FROM z WHERE contains(t, 'aaaaaaaa')
    UNION ALL SELECT doc_id, idx, 'MODEL_ARTIFACT' FROM z WHERE regexp_matches(t, '(?i)(```|^\s*json\b|transkrypcj[aię]|nie mogę|nie jestem w stanie|brak dźwięku|w załączonym audio)')
    UNION ALL SELECT doc_id, idx, 'SUSPICIOUS_CHARACTERS' FROM z WHERE t <> '' AND length(regexp_replace(t, '[\p{L}\p{N}\s.,!?;:''"()…%/-]', '', 'g')) / length(t) > 0.18
    UNION ALL SELECT doc_id, idx, 'DUPLICATED_ADJACENT_TEXT' FROM z WHERE t <> '' AND lower(t) = pt AND sec > 1
    UNION ALL SELECT doc_id, NULL, 'LATE_TRANSCRIPT_START' FROM z GROUP BY doc_id HAVING min(s) > 1500 UNION ALL SELECT doc_id, NULL, 'EARLY_TRANSCRIPT_END' FROM z GROUP BY doc_id HAVING max(audio) - max(e) > 3000
    UNION ALL SELECT doc_id, NULL, 'EMPTY_TRANSCRIPT' FROM au WHERE doc_id NOT IN (SELECT doc_id FROM r)),
  rated AS (SELECT *, CASE WHEN code IN ('EMPTY_TRANSCRIPT', 'INVALID_TIME', 'NEGATIVE_DURATION', 'ZERO_DURATION', 'NEGATIVE_TIME', 'OUT_OF_AUDIO_RANGE') THEN 'error' ELSE 'warning' END AS severity FROM found)"""


def _audio(spark, sf):
    return views.segments(spark, sf).groupBy("doc_id").agg((F.max("end_cs") - 300).alias("audio_cs"))


@query("k6_issues", f"{_QA} SELECT doc_id, idx, code, severity FROM rated", "segments")
def k6_issues(spark, sf):
    """Quality issues of transcripts made faulty by rule."""
    return transcripts.issues(_qa_rows(spark, sf), _audio(spark, sf))


@query("a8_quality_summary", f"""{_QA}, c AS (SELECT a.doc_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM au a LEFT JOIN rated USING (doc_id) GROUP BY 1),
  s AS (SELECT *, greatest(0, 100 - least(45, 15 * errors) - least(30, 4 * warnings)) AS score FROM c)
  SELECT doc_id, errors, warnings, CAST(score AS BIGINT) AS score, CASE WHEN errors > 0 OR score < 65 THEN 'fail' WHEN warnings > 0 THEN 'warning' ELSE 'pass' END AS status FROM s""", "segments")
def a8_quality_summary(spark, sf):
    """Counts by severity, score with capped penalties, status."""
    audio = _audio(spark, sf)
    return transcripts.summary(transcripts.issues(_qa_rows(spark, sf), audio), audio)


@query("g11_overlaps_fixed", r"""WITH r AS MATERIALIZED (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n, CASE WHEN idx % 3 = 1 THEN start_cs - 120 ELSE start_cs END AS s, CASE WHEN idx % 4 = 2 THEN start_cs - 10 ELSE end_cs END AS e FROM segments),
  f AS (SELECT doc_id, idx, n, s, CASE WHEN e <= s THEN s + 50 ELSE e END AS e FROM r WHERE n = 1
    UNION ALL SELECT r.doc_id, r.idx, r.n, CASE WHEN r.s < f.e - 25 THEN f.e ELSE r.s END, CASE WHEN r.e <= CASE WHEN r.s < f.e - 25 THEN f.e ELSE r.s END THEN CASE WHEN r.s < f.e - 25 THEN f.e ELSE r.s END + 50 ELSE r.e END FROM f JOIN r ON r.doc_id = f.doc_id AND r.n = f.n + 1)
  SELECT doc_id, idx, s AS start_cs, e AS end_cs FROM f""", "segments")
def g11_overlaps_fixed(spark, sf):
    """Overlaps removed, each row by the fixed end before it."""
    i = F.col("idx")
    made = views.segments(spark, sf).withColumn("b", F.col("start_cs")).withColumn("start_cs", F.when(i % 3 == 1, F.col("b") - 120).otherwise(F.col("b"))).withColumn("end_cs", F.when(i % 4 == 2, F.col("b") - 10).otherwise(F.col("end_cs")))
    return transcripts.overlaps_fixed(made)


@query("w9_smoothed_speakers", r"""WITH r AS MATERIALIZED (SELECT doc_id, idx, speaker, end_cs - start_cs AS d, row_number() OVER w AS n, lead(speaker) OVER w AS nx FROM segments WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
  f AS (SELECT doc_id, idx, n, speaker FROM r WHERE n = 1 UNION ALL SELECT r.doc_id, r.idx, r.n, CASE WHEN f.speaker = r.nx AND r.speaker <> f.speaker AND r.d <= 3000 THEN f.speaker ELSE r.speaker END FROM f JOIN r ON r.doc_id = f.doc_id AND r.n = f.n + 1)
  SELECT doc_id, idx, speaker FROM f""", "segments")
def w9_smoothed_speakers(spark, sf):
    """Short A-B-A flips smoothed, left to right."""
    return transcripts.smoothed_speakers(views.segments(spark, sf), 3000)


@query("a4_speaker_stats", """WITH b AS (SELECT doc_id, speaker, sum(end_cs - start_cs) AS total_cs, count(*) AS segments, count(*) FILTER (WHERE end_cs - start_cs < 100) AS short_segments FROM segments GROUP BY 1, 2)
  SELECT doc_id, speaker, CAST(total_cs AS BIGINT) AS total_cs, segments, short_segments, CAST(total_cs * 10000 // sum(total_cs) OVER (PARTITION BY doc_id) AS BIGINT) AS share_bp, row_number() OVER (PARTITION BY doc_id ORDER BY total_cs DESC, speaker) = 1 AS dominant FROM b""", "segments")
def a4_speaker_stats(spark, sf):
    """Time, segments and share of each speaker."""
    return transcripts.speaker_stats(views.segments(spark, sf))


@query("a5_speaker_switches", "WITH l AS (SELECT doc_id, speaker, lag(speaker) OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM segments) SELECT doc_id, count(*) FILTER (WHERE p <> speaker) AS switches, count(p) AS pairs FROM l GROUP BY 1", "segments")
def a5_speaker_switches(spark, sf):
    """A5: switches between neighbours."""
    return transcripts.speaker_switches(views.segments(spark, sf))


# -- speaker merge --------------------------------------------------------------------------------

_J2 = """WITH m AS (SELECT w.doc_id, w.seg_idx, w.word_idx, w.start_cs, w.end_cs, w.text, t.raw_speaker, least(w.end_cs, t.end_cs) - greatest(w.start_cs, t.start_cs) AS o,
    row_number() OVER (PARTITION BY w.doc_id, w.seg_idx, w.word_idx ORDER BY least(w.end_cs, t.end_cs) - greatest(w.start_cs, t.start_cs) DESC, CASE WHEN w.start_cs + w.end_cs >= 2 * t.start_cs AND w.start_cs + w.end_cs < 2 * t.end_cs THEN 0 ELSE 1 END, abs(w.start_cs + w.end_cs - t.start_cs - t.end_cs), t.start_cs, t.end_cs, t.raw_speaker) AS rn
    FROM words w LEFT JOIN turns t ON t.doc_id = w.doc_id AND t.start_cs < w.end_cs AND t.end_cs > w.start_cs),
  sp AS (SELECT * FROM m WHERE rn = 1)"""


@query("j2_overlap_turn", f"{_J2} SELECT doc_id, seg_idx, word_idx, start_cs, end_cs, text, raw_speaker, o AS overlap_cs FROM sp", "words turns")
def j2_overlap_turn(spark, sf):
    """Each word's turn by largest overlap, with tie-breaks."""
    return speakers.overlap_turn(views.words(spark, sf), views.turns(spark, sf))


@query("j3_nearest_turn", """WITH t AS (SELECT doc_id, start_cs, start_cs + (end_cs - start_cs) // 3 AS end_cs, raw_speaker FROM turns),
  lo AS (SELECT w.doc_id, w.seg_idx, w.word_idx, t.raw_speaker, w.start_cs - t.end_cs AS d, row_number() OVER (PARTITION BY w.doc_id, w.seg_idx, w.word_idx ORDER BY t.end_cs DESC, t.start_cs, t.raw_speaker DESC) AS rn FROM words w JOIN t ON t.doc_id = w.doc_id AND t.end_cs <= w.start_cs),
  hi AS (SELECT w.doc_id, w.seg_idx, w.word_idx, t.raw_speaker, t.start_cs - w.end_cs AS d, row_number() OVER (PARTITION BY w.doc_id, w.seg_idx, w.word_idx ORDER BY t.start_cs, t.end_cs, t.raw_speaker) AS rn FROM words w JOIN t ON t.doc_id = w.doc_id AND t.start_cs >= w.end_cs),
  ov AS (SELECT DISTINCT w.doc_id, w.seg_idx, w.word_idx FROM words w JOIN t ON t.doc_id = w.doc_id AND t.start_cs < w.end_cs AND t.end_cs > w.start_cs)
  SELECT w.doc_id, w.seg_idx, w.word_idx, CASE WHEN lo.d IS NOT NULL AND (hi.d IS NULL OR lo.d <= hi.d) THEN lo.raw_speaker ELSE hi.raw_speaker END AS near_speaker, CASE WHEN lo.d IS NOT NULL AND (hi.d IS NULL OR lo.d <= hi.d) THEN lo.d ELSE hi.d END AS distance_cs
  FROM words w LEFT JOIN (SELECT * FROM lo WHERE rn = 1) lo USING (doc_id, seg_idx, word_idx) LEFT JOIN (SELECT * FROM hi WHERE rn = 1) hi USING (doc_id, seg_idx, word_idx) ANTI JOIN ov USING (doc_id, seg_idx, word_idx)""", "words turns")
def j3_nearest_turn(spark, sf):
    """Words that no turn overlaps, by the nearer neighbour in time (all turns, cut to a third of their length, so that there are gaps)."""
    t = views.turns(spark, sf).withColumn("end_cs", F.expr("start_cs + (end_cs - start_cs) div 3"))
    left = speakers.overlap_turn(views.words(spark, sf), t).where("raw_speaker is null").drop("raw_speaker", "overlap_cs")
    return speakers.nearest_turn(left, t).select("doc_id", "seg_idx", "word_idx", "near_speaker", "distance_cs")


@query("a12_speaker_names", f"""{_J2}, f AS (SELECT doc_id, raw_speaker, min(start_cs) AS s FROM sp GROUP BY 1, 2)
  SELECT doc_id, raw_speaker, 'Speaker ' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, raw_speaker) - 1 AS VARCHAR) AS speaker FROM f""", "words turns")
def a12_speaker_names(spark, sf):
    """Names by first start."""
    return speakers.labels(speakers.merged(views.words(spark, sf), views.turns(spark, sf)))


@query("w6_speaker_runs", f"""{_J2}, c AS (SELECT *, CASE WHEN lag(raw_speaker) OVER w IS NOT DISTINCT FROM raw_speaker THEN 0 ELSE 1 END AS fresh FROM sp WINDOW w AS (PARTITION BY doc_id, seg_idx ORDER BY word_idx)),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, seg_idx ORDER BY word_idx) AS run FROM c),
  r AS (SELECT doc_id, seg_idx, run, any_value(raw_speaker) AS raw_speaker, min(start_cs) AS s, max(end_cs) AS e, arg_min(start_cs, word_idx) AS a1, arg_min(end_cs, word_idx) AS a2, arg_max(start_cs, word_idx) AS z1, arg_max(end_cs, word_idx) AS z2, string_agg(text, ' ' ORDER BY word_idx) AS text, count(*) AS n_words FROM g GROUP BY 1, 2, 3),
  l AS (SELECT *, lag(z1) OVER w AS p1, lag(z2) OVER w AS p2, lead(a1) OVER w AS n1, lead(a2) OVER w AS n2 FROM r WINDOW w AS (PARTITION BY doc_id, seg_idx ORDER BY run))
  SELECT doc_id, seg_idx, CAST(run AS BIGINT) AS run, raw_speaker, CASE WHEN p2 IS NULL THEN s WHEN p2 <= a1 THEN (p2 + a1 + 1) // 2 ELSE (p1 + p2 + a1 + a2 + 2) // 4 END AS start_cs, CASE WHEN n1 IS NULL THEN e WHEN z2 <= n1 THEN (z2 + n1 + 1) // 2 ELSE (z1 + z2 + n1 + n2 + 2) // 4 END AS end_cs, text, n_words FROM l""", "words turns")
def w6_speaker_runs(spark, sf):
    """Runs of one speaker inside segments, with boundaries in the middle."""
    spoken = speakers.overlap_turn(views.words(spark, sf), views.turns(spark, sf))
    return speakers.runs(spoken)


# -- boundary review ------------------------------------------------------------------------------

_CTX = """WITH ctx AS (SELECT s.doc_id, s.idx, s.start_cs, s.end_cs, s.text, CASE WHEN s.end_cs > c.start_cs - 2000 AND s.start_cs < c.start_cs AND s.end_cs <= c.start_cs THEN 'before' WHEN s.start_cs < c.end_cs AND s.end_cs > c.start_cs THEN 'candidate' WHEN s.start_cs < c.end_cs + 2000 AND s.end_cs > c.end_cs AND s.start_cs >= c.end_cs THEN 'after' END AS side FROM segments s JOIN clips c USING (doc_id)),
  so AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_cs, end_cs, idx) - 1 AS pos, start_cs AS at_cs FROM ctx WHERE side IN ('before', 'candidate')),
  eo AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_cs, end_cs, idx) - 1 AS pos, end_cs AS at_cs FROM ctx WHERE side IN ('candidate', 'after')),
  ss AS (SELECT so.* FROM so JOIN clips USING (doc_id) WHERE at_cs BETWEEN min_start_cs AND max_start_cs), ee AS (SELECT eo.* FROM eo JOIN clips USING (doc_id) WHERE at_cs BETWEEN min_end_cs AND max_end_cs),
  pr AS (SELECT doc_id, ss.pos AS s_pos, ee.pos AS e_pos, ss.at_cs AS s_cs, ee.at_cs AS e_cs FROM ss JOIN ee USING (doc_id) WHERE ee.at_cs - ss.at_cs BETWEEN 1000 AND 9000)"""


@query("j4_clip_context", f"{_CTX} SELECT doc_id, idx, side, start_cs, end_cs, text FROM ctx WHERE side IS NOT NULL", "segments clips")
def j4_clip_context(spark, sf):
    """Segments before, in and after each clip."""
    return review.context(views.clips(spark, sf), views.segments(spark, sf))


@query("j5_boundary_pairs", f"{_CTX} SELECT doc_id, CAST(s_pos AS INTEGER) AS s_pos, CAST(e_pos AS INTEGER) AS e_pos, s_cs, e_cs FROM pr", "segments clips")
def j5_boundary_pairs(spark, sf):
    """Allowed pairs of start and end options."""
    return review.pairs(*review.options(views.clips(spark, sf), views.segments(spark, sf)))


@query("j6_paired_options", f"{_CTX} SELECT 'start' AS kind, doc_id, CAST(pos AS INTEGER) AS pos, at_cs FROM ss SEMI JOIN pr ON pr.doc_id = ss.doc_id AND pr.s_pos = ss.pos UNION ALL SELECT 'end', doc_id, CAST(pos AS INTEGER), at_cs FROM ee SEMI JOIN pr ON pr.doc_id = ee.doc_id AND pr.e_pos = ee.pos", "segments clips")
def j6_paired_options(spark, sf):
    """Options that occur in a pair."""
    s, e = review.options(views.clips(spark, sf), views.segments(spark, sf))
    ok = review.pairs(s, e)
    one = lambda o, c, k: review.paired(o, ok, c).select(F.lit(k).alias("kind"), "doc_id", "pos", "at_cs")
    return one(s, "s_pos", "start").unionByName(one(e, "e_pos", "end"))


@query("o7_nearest_pair", f"{_CTX}, n AS (SELECT pr.*, row_number() OVER (PARTITION BY pr.doc_id ORDER BY abs(s_cs - start_cs) + abs(e_cs - end_cs), abs(s_cs - start_cs), abs(e_cs - end_cs), s_pos, e_pos) AS rn FROM pr JOIN clips USING (doc_id)) SELECT doc_id, CAST(s_pos AS INTEGER) AS s_pos, CAST(e_pos AS INTEGER) AS e_pos FROM n WHERE rn = 1", "segments clips")
def o7_nearest_pair(spark, sf):
    """The pair nearest to the clip."""
    c = views.clips(spark, sf)
    return review.nearest_pair(c, review.pairs(*review.options(c, views.segments(spark, sf))))


@query("o8_nearest_option", f"{_CTX}, n AS (SELECT ss.*, row_number() OVER (PARTITION BY ss.doc_id ORDER BY abs(at_cs - start_cs), pos) AS rn FROM ss JOIN clips USING (doc_id)) SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM n WHERE rn = 1", "segments clips")
def o8_nearest_option(spark, sf):
    """The start option nearest to the clip's start."""
    c = views.clips(spark, sf)
    return review.nearest_option(c, review.options(c, views.segments(spark, sf))[0], "start_cs")


@query("v8_bound_errors", """WITH a AS (SELECT *, start_cs + (doc_id % 7 - 3) * 900 AS s, end_cs + (doc_id % 5 - 2) * 1300 AS e FROM clips)
  SELECT doc_id, array_to_string(list_filter([CASE WHEN s < min_start_cs OR s > max_start_cs THEN 'start out of bounds.' END, CASE WHEN e < min_end_cs OR e > max_end_cs THEN 'end out of bounds.' END, CASE WHEN e <= s THEN 'end not after start.' END, CASE WHEN e > s AND NOT e - s BETWEEN 1000 AND 9000 THEN 'duration out of bounds.' END], lambda x: x IS NOT NULL), ' ') AS errors FROM a""", "segments clips")
def v8_bound_errors(spark, sf):
    """V8: all errors of adjusted bounds."""
    return views.clips(spark, sf).select("doc_id", review.bound_errors(F.col("start_cs") + (F.col("doc_id") % 7 - 3) * 900, F.col("end_cs") + (F.col("doc_id") % 5 - 2) * 1300).alias("errors"))


@query("k7_rule_review", _CTX + r""", t AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM ctx),
  a AS (SELECT doc_id, arg_min(t, row(start_cs, idx)) FILTER (WHERE side = 'candidate') AS att, arg_max(t, row(end_cs, idx)) FILTER (WHERE side = 'candidate') AS zt, min(start_cs) FILTER (WHERE side = 'candidate') AS s0, max(end_cs) FILTER (WHERE side = 'candidate') AS e0, max(start_cs) FILTER (WHERE side = 'before') AS b, min(end_cs) FILTER (WHERE side = 'after') AS c FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE side = 'candidate') > 0),
  w AS (SELECT *, b IS NOT NULL AND regexp_extract(lower(att), '^([\p{L}\p{N}_]+)', 1) IN ('and', 'but', 'so', 'because', 'ale', 'bo', 'wiec', 'czyli') AS back,
    c IS NOT NULL AND (zt = '' OR right(zt, 1) IN (',', ':', ';', '-') OR regexp_extract(lower(regexp_extract(zt, '([^ ]*)$', 1)), '^([\p{L}\p{N}_]+)', 1) IN ('and', 'but', 'because', 'so', 'ale', 'bo', 'wiec')) AS ahead FROM a),
  g AS (SELECT *, CASE WHEN back THEN b ELSE s0 END AS ws, CASE WHEN ahead THEN c ELSE e0 END AS we FROM w)
  SELECT pr.doc_id, s_cs, e_cs, back OR ahead AS extended FROM pr JOIN g USING (doc_id) QUALIFY row_number() OVER (PARTITION BY pr.doc_id ORDER BY abs(s_cs - ws) + abs(e_cs - we), abs(s_cs - ws), abs(e_cs - we), s_pos, e_pos) = 1""", "segments clips")
def k7_rule_review(spark, sf):
    """The reviewer without a model, coerced to an allowed pair."""
    return review.rule_review(views.clips(spark, sf), views.segments(spark, sf))


# -- cuts, cues, tracking -------------------------------------------------------------------------


@query("k9_snapped", """WITH c AS (SELECT doc_id, start_cs + 13 AS s, end_cs + 17 AS e FROM clips),
  a AS (SELECT c.doc_id, s, e, coalesce(max(w.start_cs) FILTER (WHERE w.start_cs < s AND s < w.end_cs), s) AS s2, coalesce(max(w.end_cs) FILTER (WHERE w.start_cs < e AND e < w.end_cs), e) AS e2 FROM c JOIN words w USING (doc_id) GROUP BY 1, 2, 3),
  b AS (SELECT a.*, max(w.end_cs) FILTER (WHERE w.end_cs <= s2 + 5000) AS l, min(w.end_cs) FILTER (WHERE w.end_cs > s2) AS n FROM a JOIN words w USING (doc_id) GROUP BY ALL),
  d AS (SELECT *, CASE WHEN e2 > s2 + 5000 THEN coalesce(l, s2 + 5000) ELSE e2 END AS e3 FROM b)
  SELECT doc_id, s2 AS start_cs, CASE WHEN e3 <= s2 THEN least(coalesce(n, e), s2 + 5000) ELSE e3 END AS end_cs, 'transcript' AS source FROM d""", "segments clips words")
def k9_snapped(spark, sf):
    """Bounds that cut no word, at most 50 s."""
    c = views.clips(spark, sf).select("doc_id", (F.col("start_cs") + 13).alias("start_cs"), (F.col("end_cs") + 17).alias("end_cs"))
    return cutting.snapped(c, views.words(spark, sf), 5000)


@query("w12_activity", """WITH t AS (SELECT DISTINCT doc_id, start_cs + (end_cs - start_cs) // 2 + CASE WHEN idx % 3 = 0 THEN 20 ELSE -20 END AS at_cs FROM segments), s AS (SELECT doc_id, idx, start_cs, start_cs + (end_cs - start_cs) // 2 AS end_cs FROM segments),
  a AS (SELECT t.doc_id, t.at_cs, arg_min(s.idx, s.start_cs) FILTER (WHERE s.start_cs <= at_cs AND at_cs <= s.end_cs) AS active_idx, count(*) FILTER (WHERE s.start_cs <= at_cs AND at_cs < s.end_cs) AS talk, min(s.start_cs) FILTER (WHERE s.start_cs > at_cs) AS nx FROM t LEFT JOIN s USING (doc_id) GROUP BY 1, 2),
  b AS (SELECT *, CASE WHEN talk = 0 THEN coalesce(nx - at_cs, 0) ELSE 0 END AS silence_cs FROM a) SELECT doc_id, at_cs, active_idx, silence_cs, silence_cs >= 300 AS reaction FROM b""", "segments")
def w12_activity(spark, sf):
    """The active segment, and silence ahead (all segments, cut to half their length, so that there is silence)."""
    s = views.segments(spark, sf).withColumn("end_cs", F.expr("start_cs + (end_cs - start_cs) div 2"))
    at = F.col("end_cs") + F.when(F.col("idx") % 3 == 0, 20).otherwise(-20)
    return cutting.activity(s.select("doc_id", at.alias("at_cs"), F.lit(0.5).alias("energy")).distinct(), s)


@query("g7_cues", r"""WITH o AS MATERIALIZED (SELECT *, regexp_matches(text, '[.!?…]["''”’)]*$') AS st, regexp_matches(text, '[,;:]["''”’)]*$') AS so, lead(start_cs) OVER (PARTITION BY doc_id, seg_idx ORDER BY word_idx) - end_cs >= 55 AS far FROM words),
  f AS (SELECT doc_id, seg_idx, word_idx, 1 AS n, 0 AS k, coalesce(far, false) AS stop FROM o WHERE word_idx = 0
    UNION ALL SELECT o.doc_id, o.seg_idx, o.word_idx, CASE WHEN f.stop THEN 1 ELSE f.n + 1 END, f.k + CASE WHEN f.stop THEN 1 ELSE 0 END,
      CASE WHEN f.stop THEN 1 ELSE f.n + 1 END >= 7 OR (CASE WHEN f.stop THEN 1 ELSE f.n + 1 END >= 3 AND o.st) OR (CASE WHEN f.stop THEN 1 ELSE f.n + 1 END >= 5 AND o.so) OR coalesce(o.far, false) FROM f JOIN o ON o.doc_id = f.doc_id AND o.seg_idx = f.seg_idx AND o.word_idx = f.word_idx + 1)
  SELECT o.doc_id, o.seg_idx, CAST(f.k AS BIGINT) AS cue, min(o.start_cs) AS start_cs, max(o.end_cs) AS end_cs, string_agg(o.text, ' ' ORDER BY o.word_idx) AS text, count(*) AS n_words FROM o JOIN f USING (doc_id, seg_idx, word_idx) GROUP BY 1, 2, 3""", "words")
def g7_cues(spark, sf):
    """Subtitle cues of timed words."""
    return cutting.cues(views.words(spark, sf))


@query("g9_orphans_merged")
def g9_orphans_merged(spark, sf):
    """Orphaned cues joined, stepping back (a walk with state: checked in the tests)."""
    c = cutting.cues(views.words(spark, sf)).withColumn("speaker", (F.col("seg_idx") % 2).cast("string"))
    return cutting.orphans_merged(c)


@query("g10_without_overlap", """WITH o AS MATERIALIZED (SELECT doc_id, greatest(0, least(start_cs - idx % 3 * 150, 12000)) AS s, greatest(0, least(end_cs, 12000)) AS e, text, row_number() OVER (PARTITION BY doc_id ORDER BY start_cs - idx % 3 * 150, end_cs, text) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM segments),
  f AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, total, CAST([] AS STRUCT(s BIGINT, e BIGINT, t VARCHAR)[]) AS out FROM o WHERE n = 1
    UNION ALL SELECT doc_id, n, total, CASE WHEN e > s THEN list_append(cut, {'s': CAST(s AS BIGINT), 'e': CAST(e AS BIGINT), 't': text}) ELSE cut END FROM (SELECT o.*, CASE WHEN len(f.out) > 0 AND o.s < f.out[-1].e THEN CASE WHEN o.s <= f.out[-1].s THEN f.out[:-2] ELSE list_append(f.out[:-2], {'s': f.out[-1].s, 'e': CAST(o.s AS BIGINT), 't': f.out[-1].t}) END ELSE f.out END AS cut FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)),
  u AS (SELECT doc_id, unnest(out) AS x FROM f WHERE n = total) SELECT doc_id, x.s AS start_cs, x.e AS end_cs, x.t AS text FROM u""", "segments")
def g10_without_overlap(spark, sf):
    """Cues inside the clip without overlap."""
    s = views.segments(spark, sf).select("doc_id", (F.col("start_cs") - F.col("idx") % 3 * 150).alias("start_cs"), "end_cs", "text")
    return cutting.without_overlap(s, 12000)


def _samples(spark, sf):
    line = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.row_number().over(line).cast("long").alias("idx"), (F.col("event_type").isin("click", "view", "signup")).alias("face"), F.col("value").alias("target"))


@query("g12_tracking", """WITH RECURSIVE s AS MATERIALIZED (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, event_type IN ('click', 'view', 'signup') AS face FROM events),
  f AS (SELECT track_id, idx, 'safe' AS mode, CASE WHEN face THEN 1 ELSE 0 END AS c, 0 AS n FROM s WHERE idx = 1
    UNION ALL SELECT s.track_id, s.idx, CASE WHEN f.mode = 'active' THEN CASE WHEN s.face THEN 'active' ELSE 'hold' END WHEN s.face AND f.c + 1 >= 2 THEN 'active' WHEN f.mode = 'hold' THEN CASE WHEN f.n + 1 >= 4 THEN 'safe' ELSE 'hold' END ELSE 'safe' END,
      CASE WHEN f.mode = 'active' THEN CASE WHEN s.face THEN 2 ELSE 0 END WHEN s.face THEN least(f.c + 1, 2) ELSE 0 END,
      CASE WHEN f.mode = 'active' THEN CASE WHEN s.face THEN 0 ELSE 1 END WHEN f.mode = 'hold' AND NOT (s.face AND f.c + 1 >= 2) THEN least(f.n + 1, 4) ELSE 0 END FROM f JOIN s ON s.track_id = f.track_id AND s.idx = f.idx + 1)
  SELECT track_id, idx, mode, CAST(c AS INTEGER) AS consecutive, CAST(n AS INTEGER) AS since FROM f""")
def g12_tracking(spark, sf):
    """Face tracking states."""
    return cutting.tracking(_samples(spark, sf))


@query("g13_follower", """WITH RECURSIVE s AS MATERIALIZED (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, value AS target FROM events),
  f AS (SELECT track_id, idx, CAST(500 AS DOUBLE) + CAST(0.5 AS DOUBLE) * greatest(CAST(-50 AS DOUBLE), least(CAST(50 AS DOUBLE), target - CAST(500 AS DOUBLE))) AS center FROM s WHERE idx = 1
    UNION ALL SELECT s.track_id, s.idx, f.center + CAST(0.5 AS DOUBLE) * greatest(CAST(-50 AS DOUBLE), least(CAST(50 AS DOUBLE), s.target - f.center)) FROM f JOIN s ON s.track_id = f.track_id AND s.idx = f.idx + 1) SELECT track_id, idx, center FROM f""")
def g13_follower(spark, sf):
    """A crop centre that follows its target."""
    return cutting.follower(_samples(spark, sf))


# -- project store --------------------------------------------------------------------------------


@query("p1_active_jobs", "SELECT job_id, project_id, status, created_at FROM jobs WHERE status IN ('queued', 'running')", "jobs")
def p1_active_jobs(spark, sf):
    """Rows by status, public columns."""
    return views.jobs(spark, sf).where(F.col("status").isin(*store.ACTIVE)).drop("score")


@query("j15_latest_job", "SELECT project_id, created_at, job_id, status, score FROM jobs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1", "jobs")
def j15_latest_job(spark, sf):
    """The latest row of each key."""
    return store.latest(views.jobs(spark, sf), "project_id", "created_at", "job_id")


@query("a1_status_counts", "SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status IN ('queued', 'running')) AS active, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled FROM jobs GROUP BY 1", "jobs")
def a1_status_counts(spark, sf):
    """A1: conditional counts."""
    return store.status_counts(views.jobs(spark, sf))


@query("p19_status_view", """WITH p AS (SELECT c_custkey AS project_id FROM customer), l AS (SELECT project_id, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1),
  n AS (SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status IN ('queued', 'running')) AS active, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled FROM jobs GROUP BY 1)
  SELECT project_id, job_id, coalesce(status, 'created') AS status, coalesce(total, 0) AS total, coalesce(active, 0) AS active, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(cancelled, 0) AS cancelled, CASE WHEN status = 'failed' THEN job_id END AS error_job FROM p LEFT JOIN l USING (project_id) LEFT JOIN n USING (project_id)""", "jobs")
def p19_status_view(spark, sf):
    """Projects with latest job and counts."""
    return store.status_view(table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id")), views.jobs(spark, sf))


@query("d3_upserted", """WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS price FROM orders WHERE o_orderkey % 3 <> 0), i AS (SELECT o_orderkey AS k, 'N' AS status, 1.0 AS price FROM orders WHERE o_orderkey % 2 = 0)
  SELECT coalesce(t.k, i.k) AS k, coalesce(i.status, t.status) AS status, CASE WHEN i.k IS NOT NULL AND (t.k IS NULL OR t.status = 'O') THEN CAST(i.price AS DOUBLE) ELSE t.price END AS price FROM t FULL JOIN i ON t.k = i.k""")
def d3_upserted(spark, sf):
    """Upsert with a guarded column."""
    o = table(spark, sf, "orders")
    t = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    i = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("N").alias("status"), F.lit(1.0).alias("price"))
    return store.upserted(t, i, "k", ["status", "price"], F.col("t.status") == "O", ("price",))


@query("d8_sparse_update", "SELECT job_id, CASE WHEN job_id % 4 = 0 THEN NULL ELSE status END AS status, CASE WHEN job_id % 4 = 0 THEN score ELSE score END AS score FROM jobs", "jobs")
def d8_sparse_update(spark, sf):
    """A null that is set differs from one that is not given."""
    j = views.jobs(spark, sf)
    u = j.where("job_id % 4 = 0").select("job_id", F.lit(True).alias("set_status"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("set_score"), F.lit(9.0).alias("score"))
    return store.sparse_update(j, u, "job_id", ["status", "score"])


@query("d5_cascade", "SELECT job_id, project_id FROM jobs WHERE project_id % 10 <> 0 UNION ALL SELECT job_id, NULL FROM jobs WHERE project_id % 10 = 0", "jobs")
def d5_cascade(spark, sf):
    """Children of deleted parents: gone, or kept without the reference."""
    j = views.jobs(spark, sf).select("job_id", "project_id")
    gone = j.where("project_id % 10 = 0").select("project_id").distinct()
    return store.cascaded(j, gone, "project_id").select("job_id", "project_id").unionByName(store.nulled(j, gone, "project_id").where("project_id is null").select("job_id", "project_id"))


@query("d6_widened", "SELECT job_id, status, NULL AS note FROM jobs WHERE job_id % 2 = 0 UNION ALL SELECT job_id, NULL, 'new' FROM jobs WHERE job_id % 2 = 1", "jobs")
def d6_widened(spark, sf):
    """Rows of an older and a newer schema."""
    j = views.jobs(spark, sf)
    return store.widened(j.where("job_id % 2 = 0").select("job_id", "status"), j.where("job_id % 2 = 1").select("job_id", F.lit("new").alias("note")))


@query("u2_key_differences", "SELECT c_custkey AS k, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def u2_key_differences(spark, sf):
    """Keys of one side that the other lacks, both ways."""
    c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return store.key_sets_compared(c, o, "k")


@query("k13_export_pairs", """WITH o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY at_s DESC, artifact_id DESC) AS n FROM artifacts),
  f AS (SELECT project_id, n, artifact_type AS t, at_s, true AS open, 0 AS k FROM o WHERE n = 1
    UNION ALL SELECT o.project_id, o.n, o.artifact_type, o.at_s, NOT (f.open AND f.t <> o.artifact_type AND f.at_s - o.at_s <= 86400), f.k + CASE WHEN f.open AND f.t <> o.artifact_type AND f.at_s - o.at_s <= 86400 THEN 0 ELSE 1 END FROM f JOIN o ON o.project_id = f.project_id AND o.n = f.n + 1)
  SELECT o.project_id, CAST(f.k AS BIGINT) AS pair, max(CASE WHEN artifact_type = 'raw' THEN artifact_id END) AS raw_id, max(CASE WHEN artifact_type = 'subtitled' THEN artifact_id END) AS subtitled_id FROM o JOIN f ON f.project_id = o.project_id AND f.n = o.n GROUP BY 1, 2""", "artifacts")
def k13_export_pairs(spark, sf):
    """Raw and subtitled outputs of one attempt, within a day here."""
    return store.export_pairs(views.artifacts(spark, sf), 86400)


@query("x2_folded_state", """WITH e AS (SELECT user_id AS project_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'ready' WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'cancelled' ELSE 'running' END ELSE 'failed' END AS event, CAST(event_id % 101 AS DOUBLE) AS progress FROM events),
  c AS (SELECT *, min(CASE WHEN event = 'cancelled' THEN seq END) OVER (PARTITION BY project_id) AS x FROM e), l AS (SELECT * FROM c WHERE x IS NULL OR seq <= x)
  SELECT project_id, arg_max(event, seq) AS state, max(progress) AS progress, count(*) AS n FROM l GROUP BY 1""")
def x2_folded_state(spark, sf):
    """What a project's events add up to; a cancel absorbs."""
    return store.folded_state(state_events(spark, sf))


def state_events(spark, sf):
    k = F.col("event_type")
    event = F.when(k.isin("click", "view"), "running").when(k == "signup", "ready").when(k == "purchase", F.when(F.col("event_id") % 5 == 0, "cancelled").otherwise("running")).otherwise("failed")
    return table(spark, sf, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), event.alias("event"), (F.col("event_id") % 101).cast("double").alias("progress"))


@query("o15_sorted_projects", "SELECT c_custkey, row_number() OVER (ORDER BY coalesce(o, c_acctbal) DESC, c_custkey) AS rank FROM (SELECT c_custkey, c_acctbal, max(o_totalprice) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) ORDER BY rank LIMIT 50")
def o15_sorted_projects(spark, sf):
    """The first fifty by a fallback column (a top-k report)."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("o"))
    top = table(spark, sf, "customer").join(o, "c_custkey", "left").orderBy(F.coalesce("o", "c_acctbal").desc(), "c_custkey").limit(50)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(F.coalesce("o", "c_acctbal").desc(), "c_custkey")).cast("long").alias("rank"))
