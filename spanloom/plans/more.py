"""Registered queries over sources, timed words, scores, rolling states, reports and small scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx
from spanloom.plans import views
from spanloom.plans.records import query as _query
from spanloom.plans.views import table
from spanloom.sources import documents
from spanloom.streaming.events import event_lines

query = _query


@query("f32_uniform_words", r"""WITH w AS (SELECT doc_id, idx, start_cs, end_cs, regexp_extract_all(text, '\S+') AS l FROM segments), u AS (SELECT doc_id, idx, start_cs AS s, end_cs - start_cs AS d, len(l) AS n, unnest(l) AS word, unnest(range(0, len(l))) AS i FROM w)
  SELECT doc_id, idx, i AS word_idx, word, s * n + i * d AS start_n, s * n + (i + 1) * d AS end_n, n FROM u""", "segments")
def f32_uniform_words(spark, sf):
    """F32: a segment's words at equal lengths; times in units of 1/n centisecond, exactly."""
    s = views.segments(spark, sf).withColumn("l", F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)).withColumn("n", F.size("l").cast("long"))
    r = s.select("doc_id", "idx", "start_cs", (F.col("end_cs") - F.col("start_cs")).alias("d"), "n", F.posexplode("l").alias("i", "word"))
    return r.select("doc_id", "idx", F.col("i").cast("long").alias("word_idx"), "word", (F.col("start_cs") * F.col("n") + F.col("i") * F.col("d")).alias("start_n"), (F.col("start_cs") * F.col("n") + (F.col("i") + 1) * F.col("d")).alias("end_n"), "n")


@query("f33_proportional_words", r"""WITH w AS (SELECT doc_id, idx, start_cs, end_cs, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*') AS l FROM segments), u AS (SELECT doc_id, idx, start_cs AS s, end_cs AS e, unnest(l) AS word, unnest(range(0, len(l))) AS i, len(l) AS n FROM w),
  c AS (SELECT *, sum(length(word)) OVER (PARTITION BY doc_id, idx ORDER BY i) AS upto, sum(length(word)) OVER (PARTITION BY doc_id, idx) AS total FROM u)
  SELECT doc_id, idx, i AS word_idx, word, CASE WHEN i = n - 1 THEN e ELSE s + CAST((e - s) * upto // total AS BIGINT) END AS end_cs FROM c""", "segments")
def f33_proportional_words(spark, sf):
    """word ends by running length; the last ends with its segment."""
    s = views.segments(spark, sf).withColumn("l", F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*)"), 1))
    r = s.select("doc_id", "idx", "start_cs", "end_cs", F.size("l").alias("n"), F.posexplode("l").alias("i", "word"))
    line = Window.partitionBy("doc_id", "idx")
    upto = F.sum(F.length("word")).over(line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("upto", upto).withColumn("total", F.sum(F.length("word")).over(line))
    return r.select("doc_id", "idx", F.col("i").cast("long").alias("word_idx"), "word", F.when(F.col("i") == F.col("n") - 1, F.col("end_cs")).otherwise(F.col("start_cs") + F.expr("(end_cs - start_cs) * upto div total")).alias("end_cs"))


@query("f35_clipped_words", "SELECT w.doc_id, seg_idx, word_idx, greatest(w.start_cs, c.start_cs) - c.start_cs AS start_cs, least(w.end_cs, c.end_cs) - c.start_cs AS end_cs, text FROM words w JOIN clips c ON c.doc_id = w.doc_id AND w.start_cs < c.end_cs AND w.end_cs > c.start_cs", "segments clips words")
def f35_clipped_words(spark, sf):
    """words inside a clip, relative to its start."""
    c = views.clips(spark, sf).select("doc_id", F.col("start_cs").alias("cs"), F.col("end_cs").alias("ce"))
    w = views.words(spark, sf).join(c, "doc_id").where("start_cs < ce and end_cs > cs")
    return w.select("doc_id", "seg_idx", "word_idx", (F.greatest("start_cs", "cs") - F.col("cs")).alias("start_cs"), (F.least("end_cs", "ce") - F.col("cs")).alias("end_cs"), "text")


@query("j20_nearest_kept", """WITH k AS (SELECT doc_id, idx, speaker, CASE WHEN idx % 3 = 0 THEN speaker || CAST(idx AS VARCHAR) END AS kept FROM segments),
  n AS (SELECT a.doc_id, a.idx, b.kept, row_number() OVER (PARTITION BY a.doc_id, a.idx ORDER BY abs(a.idx - b.idx), b.idx) AS rn FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.kept IS NOT NULL AND b.idx <> a.idx)
  SELECT k.doc_id, k.idx, coalesce(k.kept, n.kept, 'none') AS speaker FROM k LEFT JOIN n ON n.doc_id = k.doc_id AND n.idx = k.idx AND n.rn = 1""", "segments")
def j20_nearest_kept(spark, sf):
    """The nearest kept speaker by rows, the left one first."""
    from spanloom.operators import speakers

    k = views.segments(spark, sf).withColumn("kept", F.when(F.col("idx") % 3 == 0, F.concat("speaker", F.col("idx").cast("string"))))
    return speakers.nearest_kept(k).select("doc_id", "idx", F.coalesce("kept", "nearest", F.lit("none")).alias("speaker"))


@query("s5_windows", """SELECT event_id AS path, 0 AS idx, CAST(event_id AS DOUBLE) AS start, CAST(event_id + 30 AS DOUBLE) AS end, 'a' AS summary FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, i, CAST(1 + 2 * i AS DOUBLE), CAST(2 + 2 * i AS DOUBLE), CASE WHEN i = 0 THEN 'w' END FROM events, (VALUES (0), (1)) v(i) WHERE event_id % 5 = 1
  UNION ALL SELECT event_id, 0, 5.0, 9.0, 'r' FROM events WHERE event_id % 5 = 2 UNION ALL SELECT event_id, 0, 2.0, 8.0, 's' FROM events WHERE event_id % 5 = 3""")
def s5_windows(spark, sf):
    """Clip windows from JSON of several shapes, through variants."""
    k = F.col("event_id") % 5
    value = (
        F.when(k == 0, F.concat(F.lit('[{"start": '), F.col("event_id").cast("string"), F.lit(', "end": '), (F.col("event_id") + 30).cast("string"), F.lit(', "summary": "a"}]')))
        .when(k == 1, '{"windows": [{"start": 1, "end": 2, "summary": "w"}, {"start": 3, "end": 4}]}')
        .when(k == 2, '{"decisions": [{"final_start": 5, "heatmap_start": 1, "end": 9, "summary_after": "", "reason": "r"}, {"start": 7}]}')
        .when(k == 3, '{"cutter_adjustments": [{"final_start": 2, "source_window": {"start": 1, "end": 8, "summary": "s"}}]}')
        .otherwise('{"other": 1}')
    )
    return documents.window_rows(table(spark, sf, "events").select(F.col("event_id").alias("path"), value.alias("value")))


@query("s6_first_source", "SELECT user_id, event_id, min(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END) OVER (PARTITION BY user_id) AS priority FROM events QUALIFY CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END = priority")
def s6_first_source(spark, sf):
    """Rows of the first source that each key has."""
    p = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return documents.first_source(table(spark, sf, "events").select("user_id", "event_id", p.alias("priority")), "user_id")


@query("s10_log_tail", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def s10_log_tail(spark, sf):
    """The last five lines of each log."""
    return documents.log_tail(table(spark, sf, "events").select("user_id", "event_id", "event_type"), 5, "user_id", "event_id")


@query("s9_preferred_file", "SELECT user_id, max_by('f' || event_id, (value, event_id)) AS path FROM events GROUP BY 1".replace("max_by('f' || event_id, (value, event_id))", "arg_max('f' || event_id, row(value, event_id))"))
def s9_preferred_file(spark, sf):
    """The newest file of each folder."""
    f = table(spark, sf, "events").select("user_id", F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("value").alias("modified"), F.col("event_id").alias("length"))
    return documents.preferred_file(f, "user_id")


@query("z3_subtitle_script", """WITH t AS (SELECT doc_id, start_cs, end_cs, replace(replace(replace(replace(text, '\\', '\\\\'), '{', '\\{'), '}', '\\}'), chr(10), '\\N') AS t FROM segments),
  f AS (SELECT *, CAST(start_cs // 360000 AS VARCHAR) || ':' || lpad(CAST(start_cs % 360000 // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_cs % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(start_cs % 100 AS VARCHAR), 2, '0') AS a, CAST(end_cs // 360000 AS VARCHAR) || ':' || lpad(CAST(end_cs % 360000 // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(end_cs % 6000 // 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(end_cs % 100 AS VARCHAR), 2, '0') AS b FROM t)
  SELECT doc_id, string_agg('Dialogue: 0,' || a || ',' || b || ',Default,,0,0,0,,' || t, chr(10) ORDER BY start_cs, end_cs) AS script FROM f GROUP BY 1""".replace("\\\\", "\\"), "segments")
def z3_subtitle_script(spark, sf):
    """Dialogue lines of subtitle scripts with escaped text (header and styles: full_script)."""
    return documents.subtitle_script(views.segments(spark, sf))


@query("a14_mean_std", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def a14_mean_std(spark, sf):
    """Population mean and deviation."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("w11_rolling_mean", """WITH g AS (SELECT user_id, event_id, CAST(CAST(CAST(value AS VARCHAR) AS DECIMAL(18, 2)) * 100 AS BIGINT) AS v, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events)
  SELECT user_id, event_id, CAST(sum(v) OVER w AS BIGINT) AS total, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY user_id, grp ORDER BY event_id ROWS 14 PRECEDING)""")
def w11_rolling_mean(spark, sf):
    """Sum and count of the last fifteen states since a reset."""
    from spanloom.functions.timecode import centiseconds

    from spanloom.operators import sampling

    e = table(spark, sf, "events").select("user_id", "event_id", centiseconds(F.col("value")).alias("v"), (F.col("event_type") == "error").alias("reset"))
    return sampling.rolling(e, "user_id", "event_id", "v", "reset").select("user_id", "event_id", "total", "n")


@query("p9_clip_projection", """WITH e AS (SELECT project_id, job_id, score FROM jobs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1)
  SELECT c.doc_id, c.start_cs, c.end_cs, c.end_cs - c.start_cs AS duration_cs, e.job_id AS evaluation_id, CAST(round(CAST(CAST(e.score AS VARCHAR) AS DECIMAL(18, 6)), 1) AS DOUBLE) AS score FROM clips c LEFT JOIN e ON e.project_id = c.doc_id""", "segments clips jobs")
def p9_clip_projection(spark, sf):
    """Clips with derived fields and their latest evaluation."""
    from spanloom.operators import store

    e = store.latest(views.jobs(spark, sf), "project_id", "created_at", "job_id")
    made = views.clips(spark, sf).join(e, F.col("doc_id") == F.col("project_id"), "left")
    score = F.round(F.col("score").cast("string").cast("decimal(18,6)"), 1).cast("double")
    return made.select("doc_id", "start_cs", "end_cs", (F.col("end_cs") - F.col("start_cs")).alias("duration_cs"), F.col("job_id").alias("evaluation_id"), score.alias("score"))


@query("p5_exports", "SELECT a.artifact_id, a.project_id, c_name FROM artifacts a LEFT JOIN customer ON c_custkey = a.project_id WHERE a.artifact_type IN ('raw') AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = a.artifact_id)", "artifacts")
def p5_exports(spark, sf):
    """Artifacts of a type that exist, with their clip if there is one."""
    from spanloom.operators import store

    there = table(spark, sf, "orders").select(F.col("o_orderkey").alias("artifact_id"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), "c_name")
    return store.exports(views.artifacts(spark, sf), there, c, ("raw",)).select("artifact_id", "project_id", "c_name")


@query("v5_word_integrity", """WITH a AS (SELECT doc_id, idx, regexp_extract_all(text, '\\S+') AS l FROM segments), b AS (SELECT doc_id, seg_idx AS idx, list(text ORDER BY word_idx) AS l FROM words WHERE NOT (doc_id % 7 = 0 AND word_idx = 1) GROUP BY 1, 2)
  SELECT a.doc_id, a.idx FROM a LEFT JOIN b ON b.doc_id = a.doc_id AND b.idx = a.idx WHERE a.l <> coalesce(b.l, []) OR (b.l IS NULL AND len(a.l) > 0)""".replace("\\\\", "\\"), "segments words")
def v5_word_integrity(spark, sf):
    """V5: segments whose words were lost, changed or put out of order (every seventh recording loses one)."""
    a = views.segments(spark, sf).select("doc_id", "idx", F.regexp_extract_all("text", F.lit(r"(\S+)"), 1).alias("l"))
    w = views.words(spark, sf).where(~((F.col("doc_id") % 7 == 0) & (F.col("word_idx") == 1)))
    b = w.groupBy("doc_id", F.col("seg_idx").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]).alias("m"))
    return a.join(b, ["doc_id", "idx"], "left").where(F.col("l") != F.coalesce("m", F.array().cast("array<string>"))).select("doc_id", "idx")


@query("x1_event_lines", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'stage_started' WHEN event_id % 4 = 1 THEN NULL WHEN event_id % 4 = 2 THEN 'stage_started' END AS event, CASE event_id % 4 WHEN 0 THEN 'transcribing' WHEN 2 THEN 'downloading' END AS stage,
  CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS DOUBLE) WHEN 2 THEN 10.0 END AS progress, CASE event_id % 4 WHEN 0 THEN 'token=<redacted> ok' WHEN 2 THEN 'yt-dlp password=<redacted>' WHEN 3 THEN 'nothing here' END AS message FROM events""")
def x1_event_lines(spark, sf):
    """Marker lines and plain lines of a log."""
    k = F.col("event_id") % 4
    good = F.concat(F.lit('@@PIPELINE_EVENT@@ {"event":"stage_started","stage":"transcribing","message":"token=abc ok","progress_percent":'), (F.col("event_id") % 100).cast("string"), F.lit("}"))
    value = F.when(k == 0, good).when(k == 1, "@@PIPELINE_EVENT@@ {broken").when(k == 2, "yt-dlp password=x1").otherwise("nothing here")
    return event_lines(table(spark, sf, "events").select("event_id", value.alias("value"))).drop("value")


@query("f47_messages", """WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Duration is over 90 s' WHEN 1 THEN 'end must stay in range' WHEN 2 THEN 'Start must stay in range' WHEN 3 THEN 'bounds are reversed' WHEN 4 THEN 'unknown id' ELSE 'odd' END AS m FROM events)
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'duration' WHEN 1 THEN 'end' WHEN 2 THEN 'start' WHEN 3 THEN 'order' WHEN 4 THEN 'id' ELSE 'invalid' END AS kind FROM m""")
def f47_messages(spark, sf):
    """kinds of correction messages."""
    k = F.col("event_id") % 6
    texts = ("Duration is over 90 s", "end must stay in range", "Start must stay in range", "bounds are reversed", "unknown id")
    m = F.lit("odd")
    for i, t in enumerate(texts):
        m = F.when(k == i, t).otherwise(m)
    return table(spark, sf, "events").select("event_id", tx.correction_kind(m).alias("kind"))


@query("f51_small_labels", """SELECT event_id, CASE WHEN event_id * 700 < 1024 THEN CAST(event_id * 700 AS VARCHAR) || ' B' WHEN event_id * 700 < 1048576 THEN CAST(CAST(round(CAST(event_id * 700 / 1024 AS DECIMAL(20, 6)), 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' KB' ELSE CAST(CAST(round(CAST(event_id * 700 / 1048576 AS DECIMAL(20, 6)), 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' MB' END AS size,
  regexp_replace(props, '[^A-Za-z0-9._-]+', '_', 'g') AS file, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN event_id % 5 >= 4 THEN 1.15 WHEN value >= 100 THEN 1.08 ELSE 1.0 END AS zoom FROM events""")
def f51_small_labels(spark, sf):
    """Sizes, file names, flags, zoom."""
    flag = F.when(F.col("event_id") % 4 == 0, " TAK ").when(F.col("event_id") % 4 == 1, "no").when(F.col("event_id") % 4 == 2, "maybe")
    zoom = F.when(F.col("event_id") % 5 >= 4, 1.15).when(F.col("value") >= 100, 1.08).otherwise(1.0)
    return table(spark, sf, "events").select("event_id", tx.file_size(F.col("event_id") * 700).alias("size"), tx.safe_filename(F.col("props")).alias("file"), tx.parsed_bool(flag).alias("flag"), zoom.alias("zoom"))


@query("f49_domains", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS domain FROM pages")
def f49_domains(spark, sf):
    """source domains."""
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "").alias("domain"))


@query("f53_json_in_text", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f53_json_in_text(spark, sf):
    """the JSON object in a model's answer, fences and trailing commas forgiven."""
    answer = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.try_variant_get(tx.json_object(answer), "$.k", "bigint").alias("k"))


@query("v11_unknown_keys", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'extra' ELSE '' END AS unexpected, CASE WHEN event_id % 3 = 0 THEN 'k' ELSE '' END AS missing FROM events")
def v11_unknown_keys(spark, sf):
    """Keys that a configuration has too many or too few."""
    from spanloom.operators import checks

    keys = F.filter(F.array(F.when(F.col("event_id") % 3 != 0, "k"), F.when(F.col("event_id") % 2 == 0, "extra")), lambda x: x.isNotNull())
    d = checks.key_differences(keys, ("k",))
    return table(spark, sf, "events").select("event_id", F.array_join(d["unexpected"], ",").alias("unexpected"), F.array_join(d["missing"], ",").alias("missing"))


@query("g8_rebalanced")
def g8_rebalanced(spark, sf):
    """Cues without lone connectors or short tails, capitalized after full stops (checked in the tests)."""
    from spanloom.operators import cutting

    w = views.words(spark, sf)
    c = cutting.cues(w).select("doc_id", "seg_idx", "cue", F.col("start_cs").alias("cs"), F.col("end_cs").alias("ce"))
    each = w.join(c, ["doc_id", "seg_idx"]).where("start_cs >= cs and end_cs <= ce").drop("cs", "ce")
    return cutting.capitalized(cutting.rebalanced(each))


@query("w10_capitalized", r"""WITH s AS (SELECT doc_id, idx, idx // 3 AS seg, regexp_replace(regexp_replace(text, '[^\p{L} .]', '', 'g'), ' +([.])', '\1', 'g') AS t FROM segments),
  n AS (SELECT doc_id, seg, idx, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM s), l AS (SELECT *, lag(t) OVER (PARTITION BY doc_id, seg ORDER BY idx) AS b FROM n)
  SELECT doc_id, seg AS seg_idx, idx AS cue, CASE WHEN coalesce(regexp_matches(b, '[.!?…]["''”’)]*$'), false) THEN upper(left(t, 1)) || substr(t, 2) ELSE t END AS text FROM l""", "segments")
def w10_capitalized(spark, sf):
    """A text after a full stop starts with a capital."""
    from spanloom.operators import cutting

    s = views.segments(spark, sf)
    t = F.regexp_replace(F.regexp_replace("text", r"[^\p{L} .]", ""), " +([.])", "$1")
    return cutting.capitalized(s.select("doc_id", F.expr("idx div 3").alias("seg_idx"), F.col("idx").alias("cue"), F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text")))


@query("f41_word_offsets", r"""WITH w AS (SELECT doc_id, idx, text, regexp_extract_all(text, '\S+') AS l FROM segments), u AS (SELECT doc_id, idx, unnest(l) AS word, unnest(range(0, len(l))) AS i, regexp_extract_all(text, '\s+') AS g, regexp_matches(text, '^\s') AS lead FROM w),
  p AS (SELECT *, coalesce(sum(length(word)) OVER (PARTITION BY doc_id, idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, list_sum(list_transform(g[1:CASE WHEN lead THEN i + 1 ELSE i END], lambda x: length(x))) AS blanks FROM u)
  SELECT doc_id, idx AS seg_idx, i AS word_idx, CAST(before + coalesce(blanks, 0) AS BIGINT) AS at, CAST(before + coalesce(blanks, 0) + length(word) AS BIGINT) AS until, true AS ok FROM p""", "segments")
def f41_word_offsets(spark, sf):
    """character ranges of words, matched one behind the other."""
    from spanloom.operators import speakers

    return speakers.word_offsets(views.segments(spark, sf), views.words(spark, sf))


@query("f10_names_and_instants", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 * 60 + 7.25 AS DOUBLE) END AS start, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 * 60 + 67.5 AS DOUBLE) END AS "end",
  CASE event_id % 3 WHEN 0 THEN 1704103200 WHEN 1 THEN 1704099600 END AS instant FROM events""")
def f10_names_and_instants(spark, sf):
    """Times in file names, ISO instants."""
    from spanloom.functions import timecode as tc

    m = (F.col("event_id") % 50).cast("string")
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("out/segment_3_"), m, F.lit("-07_25_"), (F.col("event_id") % 50 + 1).cast("string"), F.lit("-07_5.mp4"))).otherwise("other.mp4")
    iso = F.when(F.col("event_id") % 3 == 0, "2024-01-01T10:00:00Z").when(F.col("event_id") % 3 == 1, "2024-01-01T10:00:00+01:00").otherwise("soon")
    made = table(spark, sf, "events").select("event_id", tc.filename_range(name).alias("r"), F.unix_seconds(tc.iso_instant(iso)).alias("instant"))
    return made.select("event_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), "instant")


@query("f21_geometry", """WITH p AS (SELECT p_partkey, p_size, 640 + p_size * 10 AS w, 720 AS h, CAST(p_partkey % 700 AS DOUBLE) AS cx FROM part), b AS (SELECT *, 405 AS bw, 720 AS bh FROM p)
  SELECT p_partkey, CAST(greatest(0, least(round_even(greatest(bw / 2, least(cx, w - bw / 2)) - bw / 2, 0), w - bw)) AS INTEGER) AS x1, bw AS w, bh AS h, w * 16 = h * 9 AS vertical, p_size % 8 AS style FROM b""")
def f21_geometry(spark, sf):
    """Crop boxes, the 9:16 test, palette by modulo (parts as frames)."""
    from spanloom.operators import cutting

    w, h = 640 + F.col("p_size") * 10, F.lit(720)
    box = cutting.crop_box(w, h, (F.col("p_partkey") % 700).cast("double"), F.lit(360.0), F.lit(1.0))
    made = table(spark, sf, "part").select("p_partkey", box.alias("b"), cutting.vertical(w, h).alias("vertical"), F.pmod("p_size", F.lit(8)).alias("style"))
    return made.select("p_partkey", F.col("b.x1").alias("x1"), F.col("b.w").alias("w"), F.col("b.h").alias("h"), "vertical", "style")
