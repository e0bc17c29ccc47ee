"""Transcripts: normalization, rule-based segmentation, quality issues and scores, speaker statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx
from spanloom.functions import timecode as tc
from spanloom.operators.heatmap import unrolled
from spanloom.operators.scan import scan


def normalized(segments: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, segment_id, start_cs, end_cs, speaker, text, importance) in time order.

    Strict: a bad row or a repeated id raises. Tolerant: bad rows go; repeats raise all the same.
    """
    bad = F.col("start_cs").isNull() | F.col("end_cs").isNull() | (F.col("end_cs") <= F.col("start_cs")) | (F.col("start_cs") < 0)
    made = segments.withColumn("segment_id", tc.segment_id(F.col("start_cs"), F.col("end_cs")))
    made = made.withColumn("bad", F.when(bad, F.raise_error(F.lit("invalid segment")) if strict else F.lit(True)).otherwise(False)).where("not bad")
    again = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "segment_id")) > 1
    made = made.withColumn("n", F.when(again, F.raise_error(F.concat(F.lit("repeated segment "), "segment_id"))).otherwise(F.lit(0)).cast("int")).where("n = 0")
    rank = F.coalesce(F.nullif(F.col("importance"), F.lit(0)), F.lit(3)) if "importance" in segments.columns else F.lit(3)
    return made.select("doc_id", "segment_id", "start_cs", "end_cs", "speaker", tx.compact(F.col("text")).alias("text"), rank.alias("importance"))


def segmented(words: DataFrame, gap_cs: int = 65, max_cs: int = 750, max_words: int = 18, max_chars: int = 180) -> DataFrame:
    """(doc_id, seg, start_cs, end_cs, text, n_words): words to segments.

    After each word a segment closes if the word ends a sentence, the next is ``gap_cs`` away, or
    the segment has reached its longest duration, words or characters. What is kept since the last
    break decides, so a recording's words are folded in order, with a small state.
    """
    w = words.select("doc_id", F.struct("start_cs", "seg_idx", "word_idx", "end_cs", "text").alias("w"))
    made = w.groupBy("doc_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    begin, chars = "if(a.n = 0, w[i].start_cs, a.s)", "a.c + if(a.n = 0, 0, 1) + length(w[i].text)"
    stop = f"""w[i].text rlike '[.!?…]$' or (i + 1 < size(w) and w[i + 1].start_cs - w[i].end_cs >= {gap_cs})
      or w[i].end_cs - {begin} >= {max_cs} or a.n + 1 >= {max_words} or {chars} >= {max_chars}"""
    state = {"k": ("0", "if(z, a.k + 1, a.k)"), "n": ("0", "if(z, 0, a.n + 1)"), "s": ("0L", f"if(z, 0L, {begin})"), "c": ("0", f"if(z, 0, {chars})")}
    made = made.withColumn("g", F.expr(scan("w", "int", "a.k", state, stop))).select("doc_id", F.arrays_zip("g", "w").alias("w"))
    rows = unrolled(made, "w", "doc_id").select("doc_id", F.col("x.g").alias("seg"), F.col("i"), F.col("x.w.start_cs"), F.col("x.w.end_cs"), F.col("x.w.text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", F.col("seg").cast("long").alias("seg")).agg(F.min("start_cs").alias("start_cs"), F.max("end_cs").alias("end_cs"), text.alias("text"), F.count(F.lit(1)).alias("n_words"))


def merge_short(segments: DataFrame, least_cs: int = 8, reach_cs: int = 25) -> DataFrame:
    """Segments (doc_id, start_cs, end_cs, text, importance, chaos) under ``least_cs`` joined to the left one within reach, else the right one, else padded.

    The last segment is held until the next one shows that nothing joins it; one that joins the
    next is carried there.
    """
    kind = "struct<start_cs:bigint,end_cs:bigint,text:string,importance:int,chaos:boolean>"
    row = F.struct(F.col("start_cs").cast("long").alias("start_cs"), F.col("end_cs").cast("long").alias("end_cs"), "text", F.col("importance").cast("int").alias("importance"), "chaos")
    s = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    join = lambda l, r: f"named_struct('start_cs', least({l}.start_cs, {r}.start_cs), 'end_cs', greatest({l}.end_cs, {r}.end_cs), 'text', trim(concat({l}.text, ' ', {r}.text)), 'importance', greatest({l}.importance, {r}.importance), 'chaos', {l}.chaos or {r}.chaos)"  # noqa: E731, E741
    none = f"cast(null as {kind})"
    short = f"c.end_cs - c.start_cs < {least_cs}"
    left, right = f"({short} and a.h is not null and c.start_cs - a.h.end_cs <= {reach_cs})", f"(i + 1 < size(s) and s[i + 1].start_cs - c.end_cs <= {reach_cs})"
    padded = f"if({short}, named_struct('start_cs', c.start_cs, 'end_cs', c.start_cs + {least_cs}, 'text', c.text, 'importance', c.importance, 'chaos', c.chaos), c)"
    step = f"""transform(array(if(a.c is null, s[i], {join("a.c", "s[i]")})), c -> case
      when {left} then named_struct('out', cast(array() as array<{kind}>), 'h', {join("a.h", "c")}, 'c', {none})
      when {short} and {right} then named_struct('out', cast(array() as array<{kind}>), 'h', a.h, 'c', c)
      else named_struct('out', if(a.h is null, cast(array() as array<{kind}>), array(a.h)), 'h', {padded}, 'c', {none}) end)[0]"""
    fold = scan("s", f"array<{kind}>", "z.out", {"h": (none, "z.h"), "c": (none, "z.c")}, step, "concat(flatten(made), array(a.h))")
    return unrolled(s.withColumn("s", F.expr(fold)), "s", "doc_id").select("doc_id", F.col("i").cast("long").alias("seg"), "x.*")


ERRORS = ("EMPTY_TRANSCRIPT", "INVALID_TIME", "NEGATIVE_DURATION", "ZERO_DURATION", "NEGATIVE_TIME", "OUT_OF_AUDIO_RANGE")


def issues(segments: DataFrame, audio: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx, code, severity) of rows (doc_id, idx, start_cs, end_cs, text) by the quality rules.

    ``audio``: (doc_id, audio_cs). Neighbours are the valid rows before, in input order. idx is null
    for what concerns the whole transcript.
    """
    rows = segments.join(audio, "doc_id", "left") if audio is not None else segments.withColumn("audio_cs", F.lit(None).cast("long"))
    s, e = F.col("start_cs"), F.col("end_cs")
    rows = rows.withColumn("fault", F.when(s.isNull() | e.isNull(), "INVALID_TIME").when(e < s - 5, "NEGATIVE_DURATION"))
    bad = rows.where("fault is not null").select("doc_id", "idx", F.col("fault").alias("code"))
    ok = rows.where("fault is null").withColumn("zero", e <= s + 5).withColumn("end_cs", F.when(e <= s + 5, s + 50).otherwise(e))
    line = Window.partitionBy("doc_id").orderBy("idx")
    text, seconds = F.coalesce(F.col("text"), F.lit("")), (e - s) / 100
    ok = ok.withColumn("t", tx.compact(text)).withColumn("k", tx.tokens(text, tx.CHECKER_WORD)).withColumn("n", F.size("k")).withColumn("uniq", F.size(F.array_distinct("k")))
    ok = ok.withColumn("prev_end", F.lag("end_cs").over(line)).withColumn("prev_text", F.lag(F.lower("t")).over(line))
    n, t, wps = F.col("n"), F.col("t"), F.col("n") / F.greatest(seconds, F.lit(0.01))
    odd = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,!?;:'\"()…%/-]", ""))
    spoken = (t != "") & (n > 0)
    rules = F.array(
        F.when(F.col("zero"), "ZERO_DURATION"), F.when(s < -5, "NEGATIVE_TIME"), F.when(e > F.col("audio_cs") + 200, "OUT_OF_AUDIO_RANGE"),
        F.when(s < F.col("prev_end") - 25, "OVERLAPPING_SEGMENTS"), F.when(t == "", "EMPTY_TEXT"), F.when((t != "") & (n == 0), "NO_WORDS"),
        F.when(spoken & (wps > 7), "TOO_MANY_WORDS_FOR_DURATION"), F.when(spoken & (n >= 8) & (wps < 0.35), "TEXT_TOO_SLOW_FOR_DURATION"),
        F.when((n >= 6) & (F.col("uniq") / n <= 0.34), "REPEATED_WORDS"), F.when(t.rlike(r"(.)\1{7,}"), "REPEATED_CHARACTERS"),
        F.when(t.rlike(tx.ARTIFACT), "MODEL_ARTIFACT"), F.when((t != "") & (odd / F.length(t) > 0.18), "SUSPICIOUS_CHARACTERS"),
        F.when((t != "") & (F.lower(t) == F.col("prev_text")) & (seconds > 1.0), "DUPLICATED_ADJACENT_TEXT"),
    )
    found = ok.select("doc_id", "idx", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("code"))
    ends = ok.groupBy("doc_id").agg(F.min("start_cs").alias("first"), F.max("end_cs").alias("last"), F.max("audio_cs").alias("audio_cs"))
    whole = F.array(F.when(F.col("first") > 1500, "LATE_TRANSCRIPT_START"), F.when(F.col("audio_cs") - F.col("last") > 3000, "EARLY_TRANSCRIPT_END"))
    edges = ends.select("doc_id", F.lit(None).cast("long").alias("idx"), F.explode(F.filter(whole, lambda x: x.isNotNull())).alias("code"))
    out = bad.unionByName(found).unionByName(edges)
    if audio is not None:
        empty = audio.join(segments.select("doc_id").distinct(), "doc_id", "left_anti")
        out = out.unionByName(empty.select("doc_id", F.lit(None).cast("long").alias("idx"), F.lit("EMPTY_TRANSCRIPT").alias("code")))
    return out.withColumn("severity", F.when(F.col("code").isin(*ERRORS), "error").otherwise("warning"))


def summary(found: DataFrame, docs: DataFrame, pass_score: int = 65) -> DataFrame:
    """(doc_id, errors, warnings, score, status) for all of ``docs``: capped penalties, clamped."""
    counts = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    made = docs.select("doc_id").distinct().join(counts, "doc_id", "left").na.fill(0, ["errors", "warnings"])
    score = F.greatest(F.lit(0), F.lit(100) - F.least(F.lit(45), 15 * F.col("errors")) - F.least(F.lit(30), 4 * F.col("warnings")))
    status = F.when((F.col("errors") > 0) | (F.col("score") < pass_score), "fail").when(F.col("warnings") > 0, "warning").otherwise("pass")
    return made.withColumn("score", score.cast("long")).withColumn("status", status)


def overlaps_fixed(segments: DataFrame) -> DataFrame:
    """(doc_id, idx, start_cs, end_cs): a start more than 25 cs before the fixed end before it moves there; an end not behind its start to 50 cs after it.

    Each row sees what the one before has become, so a recording's rows are folded in order.
    """
    s = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start_cs", "end_cs"))).alias("s"))
    start = "if(a.e is not null and s[i].start_cs < a.e - 25, a.e, s[i].start_cs)"
    row = f"transform(array({start}), b -> named_struct('idx', s[i].idx, 'start_cs', b, 'end_cs', if(s[i].end_cs <= b, b + 50, s[i].end_cs)))[0]"
    made = s.withColumn("s", F.expr(scan("s", "struct<idx:bigint,start_cs:bigint,end_cs:bigint>", "z", {"e": ("cast(null as bigint)", "z.end_cs")}, row)))
    return unrolled(made, "s", "doc_id").select("doc_id", "x.*")


def smoothed_speakers(segments: DataFrame, longest_cs: int = 120) -> DataFrame:
    """(doc_id, idx, speaker): A-B-A flips no longer than ``longest_cs`` become A, left to right; a changed row counts for the next."""
    s = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start_cs", "end_cs", "speaker"))).alias("s"))
    flip = f"i > 0 and i < size(s) - 1 and a.p = s[i + 1].speaker and s[i].speaker <> a.p and s[i].end_cs - s[i].start_cs <= {longest_cs}"
    made = s.withColumn("n", F.expr(scan("s", "string", "z", {"p": ("cast(null as string)", "z")}, f"if({flip}, a.p, s[i].speaker)")))
    return unrolled(made, F.arrays_zip("s", "n"), "doc_id").select("doc_id", F.col("x.s.idx").alias("idx"), F.col("x.n").alias("speaker"))


def speaker_stats(segments: DataFrame) -> DataFrame:
    """(doc_id, speaker, total_cs, segments, short_segments, share_bp, dominant)."""
    length = F.col("end_cs") - F.col("start_cs")
    by = segments.groupBy("doc_id", "speaker").agg(F.sum(length).alias("total_cs"), F.count(F.lit(1)).alias("segments"), F.count_if(length < 100).alias("short_segments"))
    line = Window.partitionBy("doc_id")
    best = F.row_number().over(line.orderBy(F.desc("total_cs"), "speaker")) == 1
    return by.withColumn("share_bp", F.floor(F.col("total_cs") * 10000 / F.sum("total_cs").over(line)).cast("long")).withColumn("dominant", best)


def speaker_switches(segments: DataFrame) -> DataFrame:
    """(doc_id, switches, pairs): neighbours with different speakers."""
    prev = F.lag("speaker").over(Window.partitionBy("doc_id").orderBy("idx"))
    return segments.withColumn("prev", prev).groupBy("doc_id").agg(F.count_if(F.col("prev") != F.col("speaker")).alias("switches"), F.count("prev").alias("pairs"))
