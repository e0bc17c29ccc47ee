import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import sensitive
from spanloom.functions import text as tx
from spanloom.functions import timecode as tc
from spanloom.operators import cutting, review, speakers, store, transcripts
from spanloom.sources import documents


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_time_parsers_differ(spark):
    texts = ["90", "1:30", "1:02:03,5", "::7", "1.5:30", "-4", "", "x", "1:2:3:4", None]
    assert values(spark, texts, tc.parse_checker) == [90, 90, 3723.5, None, None, -4, None, None, None, None]
    assert values(spark, texts, tc.parse_cutter) == [90, 90, 3723.5, 7, None, -4, None, None, None, None]
    assert values(spark, texts, tc.parse_base) == [90, 90, 3723.5, None, 120, -4, None, None, 1, None]
    assert values(spark, texts, tc.parse_subtitler) == [None, 90, 3723.5, None, None, None, None, None, None, None]
    assert values(spark, texts, tc.parse_strict) == [90, 90, 3723.5, None, None, None, None, None, None, None]


def test_rounding_is_half_up_on_the_decimal_form(spark):
    df = spark.createDataFrame([(2.675,), (1.005,), (0.125,), (59.999,)], "v double")
    assert [r[0] for r in df.select(tc.centiseconds(F.col("v"))).collect()] == [268, 101, 13, 6000]


def test_speaker_labels(spark):
    assert values(spark, ["SPEAKER_07", "speaker b", "", None, "Anna", "Speaker Z"], tx.speaker_label) == ["Speaker 7", "Speaker 1", "Speaker 0", "Speaker 0", "Speaker Anna", "Speaker 25"]


def test_subtitle_text(spark):
    texts = ["  5 -  6 ,yes ! ( ok )", "„ tak” nie ;no", "", "123 éa"]
    assert values(spark, texts, lambda c: tx.subtitle_text(c, True)) == ["5–6, Yes! (ok)", "„Tak” nie; no", "", "123 Éa"]
    assert values(spark, ["short", "this line is too long for one row"], tx.wrapped) == ["short", "this line is too\nlong for one row"]


def plain_wrapped(text, width=24):
    """The split rule of ``tx.wrapped`` for a text without signs, split by split."""
    words = text.split()
    joins = [w in tx.CONNECTORS for w in words]
    best = []
    for i in range(1, len(words)):
        left, right = " ".join(words[:i]), " ".join(words[i:])
        cost = 20 * (max(0, len(left) - width) + max(0, len(right) - width)) + 12 * joins[i - 1] + abs(len(left) - len(right))
        if not (i == 1 and joins[0] or i == len(words) - 1 and joins[-1]):
            best.append((cost, i, f"{left}\n{right}"))
    return min(best)[2] if best and len(" ".join(words)) > width else " ".join(words)


def test_wrapped_against_a_model_and_each_part_once(spark):
    rnd = random.Random(5)
    words = [*tx.CONNECTORS, "ż" * 9, "słowo", "word", "x" * 30, "tree", "🌳🌳"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice((0, 1, 2, 3, 4, 8, 40, 300)))) for _ in range(300)]
    texts += ["a " + "b" * 40, "b" * 40 + " a", "a " * 200, "x" * 300 + " a" * 90, "a " * 90 + "x" * 300, " ".join(f"w{i}" for i in range(5000))]
    assert values(spark, texts, tx.wrapped) == [plain_wrapped(t) for t in texts]
    # Each use of the normalized text in a lambda ran its expressions again, for every split.
    plan = spark.range(1).select(tx.wrapped(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 7


def test_repairs(spark):
    got = values(spark, ["the  the cat", "hello", "i met ania Ania", "Done.", ""], tx.repaired)
    assert [(r.text, list(r.fixes)) for r in got] == [
        ("The cat.", ["whitespace", "duplicate_words", "sentence_capitalization", "terminal_punctuation"]), ("Hello.", ["sentence_capitalization", "terminal_punctuation"]),
        ("I met Ania.", ["duplicate_words", "sentence_capitalization", "name_capitalization", "terminal_punctuation"]), ("Done.", []), ("", []),
    ]


def test_repairs_once_each(spark):
    rnd = random.Random(6)
    words = ["the", "The,", "the!", "Ania", "ania", "-", "...", "Olaf;", "maciek", "x_1", "łza"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice((0, 1, 2, 5, 30)))) for _ in range(200)]
    texts.append("the cat sat " * 3000)

    def kept(text):
        out, last = [], ""
        for w in text.split():
            plain = re.sub(r"[^\w]+", "", w).lower()
            if not plain or plain != last:
                out, last = [*out, w], plain
        return " ".join(out)

    assert values(spark, texts, tx.without_repeats) == [kept(t) for t in texts]
    got = values(spark, ["ANIA and  olaf, (jan) Marek's xjan", "- - ok ok"], tx.repaired)
    assert [(r.text, list(r.fixes)) for r in got] == [
        ("Ania and Olaf, (Jan) Marek's xjan.", ["whitespace", "name_capitalization", "terminal_punctuation"]),
        ("- - ok.", ["duplicate_words", "terminal_punctuation"]),
    ]
    # Each step stood in the plan as often as later steps used it, and a doubled word's test in each of those.
    plan = spark.range(1).select(tx.repaired(F.col("id").cast("string")).alias("r")).select("r.text", "r.fixes")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3 + len(tx.NAMES)


def test_sensitive_patterns(spark):
    texts = ["mail ann.lee@mail.example.com", "card 4111 1111 1111 1111", "44051401359", "call +48 600 700 800 now", "ul. Prosta 5, debt, lawyer", "nothing", None]
    got = values(spark, texts, sensitive.matches)
    kinds = [[m["type"] for m in r] for r in got]
    assert kinds[0] == ["email"] and got[0][0]["text"] == "an***@ma***.example.com" and "credit_card_like" in kinds[1] and kinds[2] == ["pesel_like", "phone"]
    assert kinds[3] == ["phone"] and got[3][0]["text"] == "48***00" and kinds[4][-2:] == ["sensitive_keyword"] * 2 and kinds[5] == kinds[6] == []
    risks = values(spark, texts, lambda c: sensitive.risk(sensitive.matches(c)))
    assert risks == ["medium", "high", "high", "medium", "high", "low", "low"] or risks == ["medium", "high", "high", "medium", "medium", "low", "low"]


def test_json_in_text(spark):
    got = values(spark, ['x ```json\n{"a": 1,}\n``` y', '{"a": 2}', "none", None], lambda c: F.try_variant_get(tx.json_object(c), "$.a", "int"))
    assert got == [1, 2, None, None]


WORDS = "doc_id long, seg_idx long, word_idx long, start_cs long, end_cs long, text string"
TURNS = "doc_id long, start_cs long, end_cs long, raw_speaker string"


def test_overlap_and_nearest_turn_against_a_model(spark):
    rnd = random.Random(9)
    words = [(d, 0, i, i * 40 + rnd.randint(0, 20), i * 40 + 40) for d in range(4) for i in range(120)]
    turns = [(d, s, s + rnd.randint(5, 400), f"S{rnd.randint(0, 3)}") for d in range(4) for s in rnd.sample(range(0, 5000), 14)]
    w = spark.createDataFrame([(*x, "w") for x in words], WORDS)
    t = spark.createDataFrame(turns, TURNS)
    got = {(r.doc_id, r.word_idx): r.raw_speaker for r in speakers.merged(w, t).collect()}
    assert len(got) == len(words)
    for d, _, i, s, e in words:
        mine = [x for x in turns if x[0] == d]
        over = [x for x in mine if x[1] < e and x[2] > s]
        if over:
            want = min(over, key=lambda x: (-(min(e, x[2]) - max(s, x[1])), not 2 * x[1] <= s + e < 2 * x[2], abs(s + e - x[1] - x[2]), x[1], x[2], x[3]))[3]
            assert got[d, i] == want
        else:
            near = min([s - x[2] for x in mine if x[2] <= s] + [x[1] - e for x in mine if x[1] >= e])
            assert any(x[3] == got[d, i] and near in (s - x[2], x[1] - e) for x in mine)


def test_buckets_do_not_change_the_merge(spark):
    w = spark.createDataFrame([(1, 0, i, i * 30, i * 30 + 45, "w") for i in range(60)], WORDS)
    t = spark.createDataFrame([(1, i * 170, i * 170 + 200, f"S{i % 3}") for i in range(12)], TURNS)
    rows = [sorted(map(tuple, speakers.overlap_turn(w, t, b).collect())) for b in (50, 6000)]
    assert rows[0] == rows[1]


def test_runs_split_in_the_middle(spark):
    spoken = spark.createDataFrame([(1, 0, 0, 0, 40, "a", "A"), (1, 0, 1, 51, 90, "b", "B"), (1, 0, 2, 80, 130, "c", "A")], WORDS + ", raw_speaker string")
    got = sorted((r.run, r.raw_speaker, r.start_cs, r.end_cs, r.text) for r in speakers.runs(spoken).collect())
    assert got == [(1, "A", 0, 46, "a"), (2, "B", 46, 88, "b"), (3, "A", 88, 130, "c")]


def test_strict_and_tolerant_transcripts(spark):
    s = spark.createDataFrame([(1, 0, 10, "a", " x  y ", 0), (1, 10, 10, "a", "bad", 4), (1, None, 9, "b", "bad", 4)], "doc_id long, start_cs long, end_cs long, speaker string, text string, importance int")
    got = transcripts.normalized(s).collect()
    assert [(r.text, r.importance) for r in got] == [("x y", 3)] and got[0].segment_id.startswith("seg_v1_")
    with pytest.raises(Exception, match="invalid segment"):
        transcripts.normalized(s, strict=True).collect()
    with pytest.raises(Exception, match="repeated segment"):
        transcripts.normalized(s.limit(1).unionByName(s.limit(1))).collect()


def test_short_segments_merge_left_right_or_pad(spark):
    rows = [(1, 0, 4, "a"), (1, 10, 100, "b"), (1, 110, 115, "c"), (1, 400, 403, "d")]
    s = spark.createDataFrame([(*r, 3, False) for r in rows], "doc_id long, start_cs long, end_cs long, text string, importance int, chaos boolean")
    got = [(r.start_cs, r.end_cs, r.text) for r in transcripts.merge_short(s).orderBy("seg").collect()]
    assert got == [(0, 115, "a b c"), (400, 408, "d")]


def test_tracking_states(spark):
    faces = [True, True, False, True, True, False, False, False, False, True]
    got = [r["mode"] for r in cutting.tracking(spark.createDataFrame([(1, i, f) for i, f in enumerate(faces)], "track_id long, idx long, face boolean")).orderBy("idx").collect()]
    assert got == ["safe", "active", "hold", "hold", "active", "hold", "hold", "hold", "safe", "safe"]


def test_follower_is_clamped(spark):
    got = [r.center for r in cutting.follower(spark.createDataFrame([(1, 0, 900.0), (1, 1, 900.0), (1, 2, 520.0)], "track_id long, idx long, target double")).orderBy("idx").collect()]
    assert got == [525.0, 550.0, 535.0]


def test_cues_and_orphans(spark):
    w = [("One", 0, 40), ("two.", 40, 80), ("three", 80, 120), ("four", 200, 240), ("five,", 240, 280)]
    words = spark.createDataFrame([(1, 0, i, s, e, t) for i, (t, s, e) in enumerate(w)], WORDS)
    got = cutting.cues(words).orderBy("cue")
    assert [r.text for r in got.collect()] == ["One two. three", "four five,"]
    cues = spark.createDataFrame([(1, 0, 40, "A", "well,"), (1, 50, 90, "A", "yes"), (1, 95, 120, "A", "indeed."), (1, 125, 160, "B", "no")], "doc_id long, start_cs long, end_cs long, speaker string, text string")
    assert [(r.start_cs, r.end_cs, r.text) for r in cutting.orphans_merged(cues).orderBy("start_cs").collect()] == [(0, 120, "well, yes indeed."), (125, 160, "no")]


def test_orphans_join_by_the_rules(spark):
    rows = [
        (1, 0, 40, "A", 'one two three,"', 2, False), (1, 45, 90, "B", "four five six", 5, False),  # both are the default speaker
        (2, 0, 40, "x", 'one two three,"', 2, False), (2, 45, 90, "x", "four five six", 5, True),  # comma before a sign
        (3, 0, 40, "x", "and", 3, False), (3, 45, 90, "x", "abcdefghijklmnopqrstuvwx", 3, False),  # only a lone connector could wrap it
        (4, 0, 40, "x", "a b", 3, False), (4, 95, 120, "x", "c d", 3, False),  # a pause between
        (5, 0, 40, "x", "one two", 3, False), (5, 40, 80, "x", "three", 3, False), (5, 80, 120, "x", "four five six seven eight", 3, False),
        (6, 0, 40, "x", " ", 3, False), (6, 40, 80, "x", "Done.", 3, False),
    ]
    cues = spark.createDataFrame(rows, "doc_id long, start_cs long, end_cs long, speaker string, text string, importance int, chaos boolean")
    got = sorted((r.doc_id, r.start_cs, r.end_cs, r.text, r.importance, r.chaos) for r in cutting.orphans_merged(cues).collect())
    assert got == [
        (1, 0, 90, got[0][3], 5, False), (2, 0, 90, got[1][3], 5, True), (3, 0, 40, "and", 3, False), (3, 45, 90, "abcdefghijklmnopqrstuvwx", 3, False),
        (4, 0, 40, "a b", 3, False), (4, 95, 120, "c d", 3, False), (5, 0, 80, "one two three", 3, False), (5, 80, 120, "four five six seven eight", 3, False), (6, 40, 80, "Done.", 3, False),
    ]
    assert got[0][3].replace("\n", " ") == got[1][3].replace("\n", " ") == 'one two three," four five six' and "\n" in got[0][3]


def test_joined_cues_step_back(spark):
    rows = [(1, 0, 40, "x", "one two three"), (1, 40, 80, "x", "four"), (1, 80, 120, "x", "five six,"), (1, 120, 160, "x", "seven"), (1, 160, 200, "x", "eight.")]
    cues = spark.createDataFrame(rows, "doc_id long, start_cs long, end_cs long, speaker string, text string")
    got = [(r.start_cs, r.end_cs, r.text.replace("\n", " ")) for r in cutting.orphans_merged(cues).orderBy("start_cs").collect()]
    assert got == [(0, 160, "one two three four five six, seven"), (160, 200, "eight.")]


def test_rebalancing_gives_words_to_short_cues(spark):
    schema = "doc_id long, seg_idx long, cue long, word_idx long, start_cs long, end_cs long, text string"

    def rows(doc, texts, gap=0):
        out, at = [], 0
        for c, cue in enumerate(texts):
            at += gap if c else 0
            for w in cue.split():
                out.append((doc, 0, c, len(out), at, at + 40, w))
                at += 40
        return out

    data = rows(1, ["one two three four five", "six"]) + rows(2, ["one two three four", "five"], 60) + rows(3, ["one two three four.", "five"]) + rows(4, ["one two", "and"]) + rows(5, ["and", "abcdefghijklmnopqrstuvwx"])
    got = {}
    for r in cutting.rebalanced(spark.createDataFrame(data, schema)).orderBy("doc_id", "cue").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: ["one two three", "four five six"], 2: ["one two three four", "five"], 3: ["one two three four.", "five"], 4: ["one two and"], 5: ["and", "abcdefghijklmnopqrstuvwx"]}


def test_overlap_is_settled_in_the_order_before_cutting(spark):
    events = spark.createDataFrame([(1, -50, 300, "a"), (1, -20, 100, "b"), (2, 10, 50, "a"), (2, 20, 20, "b"), (2, 30, 60, "c"), (2, 40, 500, "d")], "doc_id long, start_cs long, end_cs long, text string")
    got = sorted((r.doc_id, r.start_cs, r.end_cs, r.text) for r in cutting.without_overlap(events, 100).collect())
    assert got == [(1, 0, 100, "b"), (2, 10, 20, "a"), (2, 30, 40, "c"), (2, 40, 100, "d")]


def test_long_recordings_take_linear_time(spark):
    """Folds and interval joins over one recording, at one and four times its length."""
    import time

    def track(n):
        return spark.range(n).selectExpr("1L as track_id", "id as idx", "id % 7 < 4 as face", "double(id % 1000) as target")

    def segs(n):
        return spark.range(n).selectExpr("1L as doc_id", "id as idx", "id * 100 as start_cs", "id * 100 + 90 as end_cs", "if(id % 5 = 2, 'b', 'a') as speaker", "'w' as text")

    def words(n):
        return spark.range(n).selectExpr("1L as doc_id", "0L as seg_idx", "id as word_idx", "id * 40 as start_cs", "id * 40 + 40 as end_cs", "concat('w', id, if(id % 9 = 0, '.', '')) as text")

    def times(n):
        return segs(n).selectExpr("doc_id", "end_cs + 5 as at_cs", "0.5D as energy")

    runs = {
        "tracking": lambda n: cutting.tracking(track(n)), "follower": lambda n: cutting.follower(track(n)), "smoothed": lambda n: transcripts.smoothed_speakers(segs(n)), "fixed": lambda n: transcripts.overlaps_fixed(segs(n)),
        "segmented": lambda n: transcripts.segmented(words(n)), "cues": lambda n: cutting.cues(words(n)), "activity": lambda n: cutting.activity(times(n), segs(n)),
    }
    for name, run in runs.items():
        took = []
        for n in (500, 10_000, 40_000):
            begin = time.perf_counter()
            assert run(n).count() > 0
            took.append(time.perf_counter() - begin)
        assert took[2] < 8 * max(took[1], 0.7), (name, took)


def test_upserts_take_one_row_a_key(spark):
    t = spark.createDataFrame([(1, "a", 1.0)], "k long, status string, price double")
    i = spark.createDataFrame([(1, "b", 2.0), (1, "c", 1.5), (2, "x", 1.0), (None, "y", 1.0)], "k long, status string, price double")
    assert sorted(map(tuple, store.upserted(t, i, "k", ["status", "price"]).collect())) == [(1, "c", 1.5), (2, "x", 1.0)]
    assert sorted(map(tuple, store.upserted(t, i, "k", ["status", "price"], order=("price",)).collect())) == [(1, "b", 2.0), (2, "x", 1.0)]
    with pytest.raises(Exception, match="repeated key 1"):
        store.appended(t, i, "k").collect()


def test_tables_and_logs_are_written(spark, tmp_path):
    folder = str(tmp_path / "store")
    first = documents.save_table(spark.range(3).toDF("k"), folder, "jobs")
    second = documents.save_table(first.where("k > 0"), folder, "jobs")
    assert sorted(r.k for r in second.collect()) == sorted(r.k for r in documents.load_table(spark, folder, "jobs").collect()) == [1, 2]
    lines = spark.createDataFrame([("token=abc ok",), ("plain",)], "value string")
    documents.append_lines(lines, str(tmp_path / "log"))
    documents.append_lines(lines.limit(1), str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["plain", "token=<redacted> ok", "token=<redacted> ok"]
    (tmp_path / "old.json").write_text('{"schema_version": 2, "video_id": "v", "duration_seconds": 9, "points": []}')
    with pytest.raises(Exception, match="unsupported schema version 2"):
        documents.read_heatmaps(spark, str(tmp_path / "old.json")).collect()
    (tmp_path / "p.json").write_text('{"schema_version": 1, "video_id": "v", "duration_seconds": 9, "peaks": [{"rank": 1, "peak_time": 3, "start_time": 2, "end_time": 4, "prominence": 0.5}]}')
    assert documents.read_peaks(spark, str(tmp_path / "p.json")).first().peak_time == 3.0
    (tmp_path / "t.json").write_text('[{"start": "0", "end": "1", "text": "x", "speakerId": "S"}, {"start": "1", "end": "2", "text": "y", "speaker": "A", "speaker_id": "B"}]')
    assert [r.speaker for r in documents.read_transcripts(spark, str(tmp_path / "t.json")).orderBy("idx").collect()] == ["S", "A"]
    script = documents.full_script(spark.createDataFrame([(1, 0, 100, "a {b}")], "doc_id long, start_cs long, end_cs long, text string"), [documents.style_line("Default", "&H00FFFFFF")]).first().script
    assert script.startswith("[Script Info]") and script.endswith(r"Dialogue: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,a \{b\}")


def test_more_time_parsers(spark):
    texts = ["90", "1:30,5", "1.5:30", "1:02:03", "-4", "", "x", ":30", "1:2:3:4", None]
    assert values(spark, texts, tc.parse_api) == [90, 90.5, 120, 3723, None, None, None, None, None, None]
    assert values(spark, texts, tc.parse_web) == [90, 90.5, 120, 3723, None, 0, None, 30, None, None]
    marked = values(spark, ["It is super cheap", "10 zl"], lambda c: tx.emphasized(c, F.lit("Speaker 1")))
    assert marked[1] == "{\\b1\\c&H0000FF00&}10 zl{\\rSpeaker 1}" and marked[0].count("{") > 0


def test_speakers_beyond_the_cap(spark):
    rows = [(0, 1000, "A"), (1, 900, "B"), (2, 20, "C"), (3, 30, "C"), (4, 40, "D"), (5, 600, "A"), (6, 10, "Default"), (7, 50, "C")]
    s = spark.createDataFrame([(1, i, 0, d, w) for i, d, w in rows], "doc_id long, idx long, start_cs long, end_cs long, speaker string")
    assert [r.speaker for r in speakers.stabilized(s, 2).orderBy("idx").collect()] == ["A", "B", "B", "B", "B", "A", "Default", "A"]
    assert [r.speaker for r in speakers.stabilized(s, 4).orderBy("idx").collect()] == [w for _, _, w in rows]


def test_found_or_error(spark):
    from spanloom.operators import projections

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert projections.found_or_error(rows, "k", 2).first().v == "b"
    with pytest.raises(Exception, match="unknown k: 3"):
        projections.found_or_error(rows, "k", 3).collect()


def test_without_overlap(spark):
    rows = [(1, 0, 50, "a"), (1, 30, 80, "b"), (1, 30, 90, "c"), (1, 95, 400, "d")]
    got = [(r.start_cs, r.end_cs, r.text) for r in cutting.without_overlap(spark.createDataFrame(rows, "doc_id long, start_cs long, end_cs long, text string"), 100).orderBy("start_cs").collect()]
    assert got == [(0, 30, "a"), (30, 90, "c"), (95, 100, "d")]


def test_snapping_without_words_and_recovery(spark):
    clips = spark.createDataFrame([(1, 0, 20000), (2, 15, 18)], "doc_id long, start_cs long, end_cs long")
    words = spark.createDataFrame([(2, 0, 0, 10, 20, "w"), (2, 0, 1, 20, 30, "x")], WORDS)
    got = {r.doc_id: (r.start_cs, r.end_cs, r.source) for r in cutting.snapped(clips, words).collect()}
    assert got == {1: (0, 9000, "none"), 2: (10, 20, "transcript")}


def test_rule_review_extends_unfinished_clips(spark):
    seg = spark.createDataFrame([(1, 0, 0, 1000, "Intro."), (1, 1, 1000, 3000, "and so on"), (1, 2, 3000, 5000, "it ends, but"), (1, 3, 5000, 6000, "here.")], "doc_id long, idx long, start_cs long, end_cs long, text string")
    clip = spark.createDataFrame([(1, 1000, 5000, 0, 3000, 3000, 7000)], "doc_id long, start_cs long, end_cs long, min_start_cs long, max_start_cs long, min_end_cs long, max_end_cs long")
    r = review.rule_review(clip, seg).first()
    assert (r.s_cs, r.e_cs, r.extended) == (0, 6000, True)


def test_export_pairs_do_not_chain(spark):
    a = spark.createDataFrame([(1, 7, "raw", 100), (2, 7, "subtitled", 110), (3, 7, "raw", 120), (4, 7, "raw", 500)], "artifact_id long, project_id long, artifact_type string, at_s long")
    got = sorted((r.raw_id or 0, r.subtitled_id or 0) for r in store.export_pairs(a).collect())
    assert got == [(1, 0), (3, 2), (4, 0)]


def test_state_fold_batch_and_stream(spark, tmp_path):
    from spanloom.streaming import events

    rows = [(1, 1, "running", 10.0), (1, 2, "ready", 100.0), (2, 1, "running", 50.0), (2, 2, "cancelled", 20.0), (2, 3, "running", 90.0)]
    schema = "project_id long, seq long, event string, progress double"
    df = spark.createDataFrame(rows, schema)
    want = {(1, "ready", 100.0, 2), (2, "cancelled", 50.0, 2)}
    assert {tuple(r) for r in store.folded_state(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.project_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("select * from states").collect()} == want


def test_event_lines(spark):
    from spanloom.streaming.events import event_lines

    rows = spark.createDataFrame([('@@PIPELINE_EVENT@@ {"event":"stage_started","stage":"transcribing","message":"password=abc"}',), ("@@PIPELINE_EVENT@@ [1",), ("yt-dlp started",), ("hello",)], "value string")
    got = [(r.event, r.stage, r.progress, r.message) for r in event_lines(rows).collect()]
    assert got == [("stage_started", "transcribing", 30.0, "password=<redacted>"), (None, None, None, None), ("stage_started", "downloading", 10.0, "yt-dlp started"), (None, None, None, "hello")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"schema_version": 1, "video_id": "v", "duration_seconds": 9, "points": [{"start_time": 0, "end_time": 4, "value": 0.5}]}')
    assert [tuple(r) for r in documents.read_heatmaps(spark, str(tmp_path / "h.json")).collect()] == [("v", 0, 0.0, 4.0, 0.5, 9.0)]
    (tmp_path / "a.json").write_text('﻿[{"start": "0:01", "end": "2", "text": "x"}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"segments": [{"start": "3", "end": "4", "text": "y", "importance": 5}]}')
    got = documents.read_transcripts(spark, str(tmp_path / "[ab].json")).orderBy("text").collect()
    assert [(r.start, r.text, r.importance) for r in got] == [("0:01", "x", None), ("3", "y", 5)]
    documents.write_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.schema("id long").json(str(tmp_path / "out")).count() == 3


def test_registry_is_consistent():
    from spanloom import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 60
    assert all(re.fullmatch(r"[a-z0-9_]+", k) for k in catalog.queries())


def test_cues_are_rebalanced_and_capitalized(spark):
    schema = "doc_id long, seg_idx long, cue long, word_idx long, start_cs long, end_cs long, text string"
    texts = [[("one", 0), ("two", 1), ("three", 2), ("four", 3)], [("five", 4)], [("and", 5)], [("six", 6), ("end.", 7)]]
    rows = [(1, 0, c, i, i * 40, i * 40 + 40, t) for c, cue in enumerate(texts) for t, i in cue] + [(2, 0, 0, 0, 0, 40, "done."), (2, 0, 1, 1, 200, 240, "next")]
    got = {(r.doc_id, r.cue): r.text for r in cutting.capitalized(cutting.rebalanced(spark.createDataFrame(rows, schema))).collect()}
    assert got == {(1, 0): "one two three", (1, 1): "four five", (1, 2): "and six end.", (2, 0): "done.", (2, 1): "Next"}


def test_word_offsets_and_uncovered_text(spark):
    s = spark.createDataFrame([(1, 0, " the cat  the"), (2, 0, "a b c"), (3, 0, "x y")], "doc_id long, idx long, text string")
    w = spark.createDataFrame([(1, 0, 0, 0, 1, "the"), (1, 0, 1, 1, 2, "cat"), (1, 0, 2, 2, 3, "the"), (2, 0, 0, 0, 1, "a"), (2, 0, 1, 1, 2, "c"), (3, 0, 0, 0, 1, "z")], WORDS)
    got = sorted(((r.doc_id, r.word_idx, r["at"], r.until, r.ok) for r in speakers.word_offsets(s, w).collect()), key=str)
    assert got == [(1, 0, 1, 4, True), (1, 1, 5, 8, True), (1, 2, 10, 13, True), (2, 0, 0, 1, False), (2, 1, 4, 5, False), (3, 0, None, None, False)]
