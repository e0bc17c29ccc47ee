"""Speaker merge: words meet turns by overlap, else by distance; runs, labels and split times.

Joins are equi-joins on the recording with the interval condition behind; a long recording can be
cut into time buckets by ``bucket_cs`` so that its words and turns do not all meet in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.heatmap import unrolled
from spanloom.operators.scan import scan


def overlap_turn(words: DataFrame, turns: DataFrame, bucket_cs: int = 6000) -> DataFrame:
    """words with raw_speaker, overlap_cs: the turn with the largest overlap.

    Ties: a turn that holds the word's middle, the nearer middle, the earlier start, the earlier
    end, the label. Words that no turn overlaps have null. Both sides are listed under every
    bucket they touch; each word is then settled by one aggregation.
    """
    span = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket_cs), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / bucket_cs)))
    key = ["doc_id", "seg_idx", "word_idx"]
    w = words.select(*key, F.col("start_cs").alias("ws"), F.col("end_cs").alias("we")).withColumn("bucket", span("ws", "we"))
    t = turns.select("doc_id", F.col("start_cs").alias("ts"), F.col("end_cs").alias("te"), "raw_speaker").withColumn("bucket", span("ts", "te"))
    met = w.join(t, ["doc_id", "bucket"]).where((F.col("ts") < F.col("we")) & (F.col("te") > F.col("ws")))
    length = F.least("we", "te") - F.greatest("ws", "ts")
    twice = F.col("ws") + F.col("we")
    outside = F.when((twice >= 2 * F.col("ts")) & (twice < 2 * F.col("te")), 0).otherwise(1)
    rank = F.struct((-length).alias("o"), outside.alias("out"), F.abs(twice - F.col("ts") - F.col("te")).alias("d"), "ts", "te", "raw_speaker")
    best = met.groupBy(*key).agg(F.min(rank).alias("b"))
    return words.join(best, key, "left").select(words["*"], F.col("b.raw_speaker").alias("raw_speaker"), (-F.col("b.o")).alias("overlap_cs"))


def nearest_turn(words: DataFrame, turns: DataFrame) -> DataFrame:
    """words (without overlap) with near_speaker, distance_cs: the nearer of the turn that ended last before and the one that starts first after.

    Ties go to the one before. A two-sided as-of join: turns and words are put in one time line
    for each recording, and each word looks back and ahead along it.
    """
    ends = turns.select("doc_id", F.col("end_cs").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("end_cs").alias("x"), (-F.col("start_cs")).alias("s"), "raw_speaker").alias("turn"))
    starts = turns.select("doc_id", F.col("start_cs").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("start_cs").alias("x"), F.col("end_cs").alias("s"), "raw_speaker").alias("turn"))
    key = ["doc_id", "seg_idx", "word_idx"]
    none = F.lit(None)
    w = words.select(*key, "start_cs", "end_cs")
    back = ends.select("doc_id", "at", "kind", "turn", *[none.cast("long").alias(c) for c in key[1:]])
    back = back.unionByName(w.select("doc_id", F.col("start_cs").alias("at"), F.lit(1).alias("kind"), none.cast(ends.schema["turn"].dataType).alias("turn"), *key[1:]))
    before = F.max("turn").over(Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    back = back.withColumn("before", before).where("kind = 1").select(*key, "before")
    ahead = starts.select("doc_id", "at", "kind", "turn", *[none.cast("long").alias(c) for c in key[1:]])
    ahead = ahead.unionByName(w.select("doc_id", F.col("end_cs").alias("at"), F.lit(-1).alias("kind"), none.cast(starts.schema["turn"].dataType).alias("turn"), *key[1:]))
    after = F.min("turn").over(Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing))
    ahead = ahead.withColumn("after", after).where("kind = -1").select(*key, "after")
    both = words.join(back, key).join(ahead, key)
    left, right = F.col("start_cs") - F.col("before.x"), F.col("after.x") - F.col("end_cs")
    use_left = F.coalesce(left <= right, F.col("before").isNotNull())
    return both.select(words["*"], F.when(use_left, F.col("before.raw_speaker")).otherwise(F.col("after.raw_speaker")).alias("near_speaker"), F.when(use_left, left).otherwise(right).alias("distance_cs"))


def merged(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Every word with its raw speaker: by overlap, else by distance (distance_cs set)."""
    found = overlap_turn(words, turns)
    left = found.where("raw_speaker is null").drop("raw_speaker", "overlap_cs")
    near = nearest_turn(left, turns).withColumn("overlap_cs", F.lit(None).cast("long")).withColumnRenamed("near_speaker", "raw_speaker")
    return found.where("raw_speaker is not null").withColumn("distance_cs", F.lit(None).cast("long")).unionByName(near)


def labels(spoken: DataFrame) -> DataFrame:
    """(doc_id, raw_speaker, speaker): 'Speaker n' by first start, then label."""
    first = spoken.groupBy("doc_id", "raw_speaker").agg(F.min("start_cs").alias("first"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "raw_speaker")) - 1
    return first.select("doc_id", "raw_speaker", F.concat(F.lit("Speaker "), n.cast("string")).alias("speaker"))


def runs(spoken: DataFrame) -> DataFrame:
    """(doc_id, seg_idx, run, raw_speaker, start_cs, end_cs, text, n_words): same-speaker runs inside segments.

    A run's inner boundary is the half-up middle of the gap to its neighbour, or of the two words'
    middles if they overlap; the outer ones are the segment's first and last word's.
    """
    line = Window.partitionBy("doc_id", "seg_idx").orderBy("word_idx")
    fresh = F.when(F.lag("raw_speaker").over(line).eqNullSafe(F.col("raw_speaker")), 0).otherwise(1)
    marked = spoken.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    by_run = marked.groupBy("doc_id", "seg_idx", "run").agg(
        F.first("raw_speaker").alias("raw_speaker"), F.min("start_cs").alias("s"), F.max("end_cs").alias("e"),
        F.min(F.struct("word_idx", "start_cs", "end_cs")).alias("a"), F.max(F.struct("word_idx", "start_cs", "end_cs")).alias("z"), F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_words"),
    )
    seq = Window.partitionBy("doc_id", "seg_idx").orderBy("run")

    def middle(left, right):
        gap = left["end_cs"] + right["start_cs"]
        mids = left["start_cs"] + left["end_cs"] + right["start_cs"] + right["end_cs"]
        return F.when(left["end_cs"] <= right["start_cs"], F.floor((gap + 1) / 2)).otherwise(F.floor((mids + 2) / 4))

    start = F.coalesce(middle(F.lag("z").over(seq), F.col("a")), F.col("s"))
    end = F.coalesce(middle(F.col("z"), F.lead("a").over(seq)), F.col("e"))
    return by_run.select("doc_id", "seg_idx", F.col("run").cast("long").alias("run"), "raw_speaker", start.cast("long").alias("start_cs"), end.cast("long").alias("end_cs"), "text", "n_words")


def word_offsets(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, seg_idx, word_idx, at, until, ok): character ranges of a segment's words in its text.

    Every word is looked for behind the one before it; ok is false in segments where one is not
    found or something but white space is left over. A segment's words are folded in order.
    """
    w = words.groupBy("doc_id", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text"))).alias("w"))
    made = segments.select("doc_id", F.col("idx").alias("seg_idx"), F.col("text").alias("t")).join(w, ["doc_id", "seg_idx"])
    # z: where the word is found behind the last one, from 1; 0 if it is not.
    gap = "regexp_replace(substring(t, a.cur + 1, z - 1 - a.cur), '\\\\s', '') = ''"
    found = "a.ok and z > 0"
    state = {"cur": ("0", f"if({found}, z - 1 + length(w[i].text), a.cur)"), "ok": ("true", f"{found} and {gap}")}
    place = f"if({found}, named_struct('at', z - 1, 'until', z - 1 + length(w[i].text)), cast(null as struct<at:int,until:int>))"
    made = made.withColumn("f", F.expr(scan("w", "struct<at:int,until:int>", place, state, "locate(w[i].text, t, a.cur + 1)", "named_struct('r', made, 'cur', a.cur, 'ok', a.ok)")))
    made = made.withColumn("ok", F.expr("f.ok and regexp_replace(substring(t, f.cur + 1, length(t)), '\\\\s', '') = ''")).withColumn("z", F.arrays_zip("w", F.col("f.r").alias("r")))
    return unrolled(made, "z", "doc_id", "seg_idx", "ok").select("doc_id", "seg_idx", F.col("x.w.word_idx").alias("word_idx"), F.col("x.r.at").cast("long").alias("at"), F.col("x.r.until").cast("long").alias("until"), "ok")


def stabilized(segments: DataFrame, cap: int = 2, default: str = "Default", many: int = 6, least_cs: int = 150, least_share: float = 0.12) -> DataFrame:
    """(doc_id, idx, speaker, changed) of (doc_id, idx, start_cs, end_cs, speaker): speakers beyond the cap that say little become the nearest one that is kept.

    Kept are the ``cap`` speakers with most time, the earlier one of equals. Any other is replaced
    if there are ``many`` speakers, or it has at most ``least_cs`` or the least share of the time,
    row by row: by the kept speaker the fewest rows away, the one before first. Rows before count
    as they have become, so a replaced row stands for its new speaker; that is a fold over the rows.
    Rows of the default label stay and keep nobody.
    """
    length = F.greatest(F.lit(0).cast("long"), F.col("end_cs") - F.col("start_cs"))
    rows = segments.withColumn("own", F.col("speaker") != default)
    by = rows.where("own").groupBy("doc_id", "speaker").agg(F.sum(length).alias("time"), F.min("idx").alias("first"))
    doc = Window.partitionBy("doc_id")
    by = by.withColumn("rank", F.row_number().over(doc.orderBy(F.desc("time"), "first"))).withColumn("n", F.count(F.lit(1)).over(doc)).withColumn("total", F.sum("time").over(doc))
    total = F.when(F.col("total") == 0, F.lit(100)).otherwise(F.col("total"))
    little = (F.col("n") >= many) | (F.col("time") <= least_cs) | (F.col("time") / total <= least_share)
    by = by.select("doc_id", "speaker", (F.col("rank") <= cap).alias("kept"), ((F.col("n") > cap) & (F.col("rank") > cap) & little).alias("goes"), F.max(F.when(F.col("rank") == 1, F.col("speaker"))).over(doc).alias("main"))
    r = rows.join(by, ["doc_id", "speaker"], "left").withColumn("goes", F.coalesce("goes", F.lit(False))).withColumn("kept", F.coalesce("kept", F.lit(False)))
    line = doc.orderBy("idx")
    r = r.withColumn("pos", F.row_number().over(line))
    mark = F.struct("pos", "speaker")
    r = r.withColumn("ahead", F.first(F.when(F.col("kept"), mark), True).over(line.rowsBetween(1, Window.unboundedFollowing)))
    state = F.struct("idx", "speaker", "kept", "goes", "pos", "ahead", "main")
    made = r.groupBy("doc_id").agg(F.array_sort(F.collect_list(state)).alias("s"))
    # z: the speaker that the row ends with; a.at and a.who: the last row that is or has become a kept one.
    left = "a.at is not null and (s[i].ahead is null or s[i].pos - a.at <= s[i].ahead.pos - s[i].pos)"
    new = f"if(not s[i].goes, s[i].speaker, if({left}, a.who, coalesce(s[i].ahead.speaker, s[i].main)))"
    stands = "s[i].kept or s[i].goes"
    fold = scan("s", "string", "z", {"at": ("cast(null as int)", f"if({stands}, s[i].pos, a.at)"), "who": ("cast(null as string)", f"if({stands}, z, a.who)")}, new)
    out = unrolled(made.withColumn("n", F.expr(fold)), F.arrays_zip("s", "n"), "doc_id")
    return out.select("doc_id", F.col("x.s.idx").alias("idx"), F.col("x.n").alias("speaker"), (F.col("x.n") != F.col("x.s.speaker")).alias("changed"))


def colour_policy(events: DataFrame, default: str = "Default") -> DataFrame:
    """(doc_id, switches, pairs, speakers, short_segments, mode) of (doc_id, idx, start_cs, end_cs, speaker): whether each speaker gets a colour.

    One style serves all if there are not exactly two speakers, a quarter of the events (two at
    least) are short, speakers switch at 0.7 of the borders with short ones among them, or one
    speaker has under two seconds. Rows of the default label do not count as speech.
    """
    own = events.where(F.col("speaker") != default).withColumn("len", F.greatest(F.lit(0).cast("long"), F.col("end_cs") - F.col("start_cs")))
    turn = F.lag("speaker").over(Window.partitionBy("doc_id").orderBy("idx"))
    by = own.groupBy("doc_id", "speaker").agg(F.sum("len").alias("time")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("speakers"), F.min("time").alias("least"))
    seq = own.withColumn("before", turn).groupBy("doc_id").agg(F.count_if(F.col("before") != F.col("speaker")).alias("switches"), F.count("before").alias("pairs"), F.count_if(F.col("len") <= 100).alias("short_segments"))
    made = events.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(by, "doc_id", "left").join(seq, "doc_id", "left").na.fill(0, ["speakers", "switches", "pairs", "short_segments"])
    short = F.col("short_segments")
    fallback = (F.col("speakers") != 2) | ((short > 0) & (short >= F.greatest(F.lit(2), F.floor(F.col("n") / 4)))) | ((10 * F.col("switches") >= 7 * F.greatest(F.lit(1), F.col("pairs"))) & (short > 0)) | ((F.col("speakers") > 1) & (F.col("least") < 200))
    return made.select("doc_id", "switches", "pairs", "speakers", "short_segments", F.when(fallback, "single_style_fallback").otherwise("stable_per_speaker").alias("mode"))


def merge_summary(spoken: DataFrame) -> DataFrame:
    """(doc_id, words, outside_words, outside_cs) of ``merged`` words: how many no turn overlaps, and the greatest distance to the turn they took."""
    return spoken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count("distance_cs").alias("outside_words"), F.coalesce(F.max("distance_cs"), F.lit(0)).alias("outside_cs"))


def nearest_kept(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, idx, kept) with nearest: the value of kept the fewest rows away, that before first; one look back and one ahead."""
    line = Window.partitionBy("doc_id").orderBy("idx")
    mark = F.when(F.col("kept").isNotNull(), F.struct("idx", "kept"))
    k = rows.withColumn("l", F.last(mark, True).over(line.rowsBetween(Window.unboundedPreceding, -1))).withColumn("r", F.first(mark, True).over(line.rowsBetween(1, Window.unboundedFollowing)))
    left = F.coalesce(F.col("idx") - F.col("l.idx") <= F.col("r.idx") - F.col("idx"), F.col("l").isNotNull())
    return k.withColumn("nearest", F.when(left, F.col("l.kept")).otherwise(F.col("r.kept"))).drop("l", "r")


def distinct_speakers(segments: DataFrame) -> DataFrame:
    """(doc_id, speakers): each transcript's labels, sorted, once each."""
    return segments.groupBy("doc_id").agg(F.sort_array(F.collect_set("speaker")).alias("speakers"))
