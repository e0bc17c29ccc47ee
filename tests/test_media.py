import random

import duckdb
import pytest

from spanloom.operators import candidates, heatmap
from spanloom.plans import oracle_k12


def frame(spark, videos):
    rows = [(v, i, float(s), float(e), float(x), float(d)) for v, (points, d) in videos.items() for i, (s, e, x) in enumerate(points)]
    return spark.createDataFrame(rows, "video_id string, idx long, start_time double, end_time double, value double, duration_seconds double")


def evenly(values, width=40.0):
    return [(i * width, (i + 1) * width, v) for i, v in enumerate(values)], len(values) * width


def peaks_by_sql(videos):
    """(video, rank, time, prominence) as the registered SQL finds them, over a table of the recordings."""
    con = duckdb.connect()
    con.execute("create table heatmap_points (video_id varchar, idx bigint, start_time double, end_time double, value double, duration_seconds double)")
    con.executemany("insert into heatmap_points values (?, ?, ?, ?, ?, ?)", [(v, i, float(s), float(e), float(x), float(d)) for v, (points, d) in videos.items() for i, (s, e, x) in enumerate(points)])
    return sorted(con.execute(f"WITH RECURSIVE {oracle_k12.PEAKS} SELECT video_id, rank, peak_time, round(prominence, 9) FROM peaks").fetchall())


def test_reported_peaks_are_peaks(spark):
    """Whatever is reported is higher than its neighbours, stands out of both sides, and is apart from the others."""
    rnd = random.Random(11)
    videos = {f"v{i}": evenly([rnd.randint(0, 40) / 40 for _ in range(80)], 12.0) for i in range(10)}  # wider than the smoothing
    got = {}
    for r in heatmap.peaks(frame(spark, videos)).collect():
        got.setdefault(r.video_id, []).append(r)
    for v, (points, _) in videos.items():
        found = sorted(got.get(v, []), key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, len(found) + 1)) and [-r.prominence for r in found] == sorted(-r.prominence for r in found)
        assert all(abs(a.peak_time - b.peak_time) >= 30 for a in found for b in found if a is not b)
        for r in found:
            around = [x for s, e, x in points if abs((s + e) / 2 - r.peak_time) <= 30]
            assert r.raw_value == max(x for s, e, x in points if s <= r.peak_time < e) and min(around) < r.raw_value
            assert 0.05 <= r.prominence <= r.raw_value - min(around) + 1e-9


def test_literal_cases(spark):
    videos = {
        "single": evenly([0.1, 0.8, 0.2]), "flat": evenly([0.5] * 5), "rising": evenly([0.1, 0.2, 0.3, 0.4]), "plateau": evenly([0.0, 0.9, 0.9, 0.0]), "short": evenly([0.1, 0.9]),
        "close": evenly([0, 0.9, 0, 0.8, 0], 10.0), "distant": evenly([0, 0.9, 0, 0.8, 0], 40.0), "uneven": ([(0, 1, 0.1), (1, 11, 0.9), (11, 12, 0.1)], 12.0), "ties": evenly([0, 0.7, 0, 0.7, 0, 0.7, 0]),
    }
    got = {}
    rows = sorted((r.video_id, r.rank, r.peak_time, round(r.prominence, 9)) for r in heatmap.peaks(frame(spark, videos)).collect())
    assert rows == peaks_by_sql(videos)
    for v, *rest in rows:
        got.setdefault(v, []).append(tuple(rest))
    assert "flat" not in got and "rising" not in got and "short" not in got and len(got["single"]) == len(got["plateau"]) == 1 and len(got["close"]) == 1 and len(got["distant"]) == 2 and [t for _, t, _ in got["ties"]] == sorted(t for _, t, _ in got["ties"])


def test_random_recordings_and_row_order(spark):
    rnd = random.Random(3)
    videos = {f"v{i}": evenly([rnd.randint(0, 20) / 20 for _ in range(rnd.randint(1, 60))], 4.0) for i in range(25)}
    df = frame(spark, videos)
    collect = lambda d: sorted((r.video_id, r.rank, r.peak_time, round(r.prominence, 9)) for r in heatmap.peaks(d).collect())
    want = peaks_by_sql(videos)
    assert collect(df) == want and collect(df.orderBy("value")) == want


def test_contract(spark):
    bad = {"a": ([(-1, 1, 0.5), (1, 1, 0.5), (0.5, 2, 1.5), (2, 9, float("nan"))], 5.0), "ok": evenly([0.0, 1.0, 0.5])}
    got = {(r.video_id, r.idx, r.code) for r in heatmap.violations(frame(spark, bad)).collect()}
    assert got == {("a", 0, "negative_start"), ("a", 1, "empty_interval"), ("a", 2, "value_range"), ("a", 2, "unsorted"), ("a", 3, "not_finite"), ("a", 3, "past_end"), ("a", 3, "value_range")} or got == {("a", 0, "negative_start"), ("a", 1, "empty_interval"), ("a", 2, "value_range"), ("a", 2, "unsorted"), ("a", 3, "not_finite"), ("a", 3, "past_end")}
    with pytest.raises(ValueError):
        heatmap.PeakConfig(radius=-1)
    with pytest.raises(ValueError):
        candidates.WindowConfig(min_duration=70)


def peak_rows(spark, rows):
    return spark.createDataFrame([(v, r, t, t - 1, t + 1, 0.5, 0.5, 0.4, d) for v, r, t, d in rows], "video_id string, rank int, peak_time double, start_time double, end_time double, raw_value double, smoothed_value double, prominence double, duration_seconds double")


def test_windows_are_shifted_deduplicated_and_apart(spark):
    got = candidates.candidates(peak_rows(spark, [("v", 1, 100.0, 400.0), ("v", 2, 5.0, 400.0), ("v", 3, 10.0, 400.0), ("v", 4, 121.0, 400.0), ("v", 5, 120.9, 400.0), ("v", 6, 398.0, 400.0), ("s", 1, 10.0, 45.0), ("t", 1, 9.0, 29.9)])).orderBy("video_id", "rank").collect()
    assert [(r.video_id, r.source_peak_rank, r.start_time, r.end_time) for r in got] == [("s", 1, 0.0, 45.0), ("v", 1, 70.0, 130.0), ("v", 2, 0.0, 60.0), ("v", 4, 91.0, 151.0), ("v", 6, 340.0, 400.0)]


def test_candidate_id_is_the_hash_of_its_identity(spark):
    import hashlib
    import json

    r = candidates.candidates(peak_rows(spark, [("video-123", 1, 100.25, 400.0)])).first()
    payload = {"candidate_id_version": 1, "video_id": "video-123", "generator": "peak_centered_candidate_windows", "generator_version": 1, "start_microseconds": 70250000, "end_microseconds": 130250000}
    assert r.candidate_id == "cand_v1_" + hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("video", ["żółć-1", 'a"b\\c', "tab\there", "😀 x", "\x01\x7f"])
def test_candidate_id_of_any_name(spark, video):
    import hashlib
    import json

    r = candidates.candidates(peak_rows(spark, [(video, 1, 100.25, 400.0)])).first()
    payload = {"candidate_id_version": 1, "video_id": video, "generator": "peak_centered_candidate_windows", "generator_version": 1, "start_microseconds": 70250000, "end_microseconds": 130250000}
    assert r.candidate_id == "cand_v1_" + hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
