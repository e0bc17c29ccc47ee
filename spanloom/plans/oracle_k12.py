"""DuckDB SQL for the heatmap and candidate queries."""

from spanloom.plans.views import with_views

#: Smoothed values as table sm(video_id, idx, s, e, mid, value, m, dur).
SMOOTH = """
  sm0 AS (SELECT a.video_id, a.idx, a.start_time AS s, a.end_time AS e, (a.start_time + a.end_time) / 2 AS mid, a.value, a.duration_seconds AS dur FROM heatmap_points a),
  sm AS MATERIALIZED (SELECT a.video_id, a.idx, a.s, a.e, a.mid, a.value, a.dur,
      sum(b.value * (least(b.e, a.mid + 5) - greatest(b.s, a.mid - 5)) ORDER BY b.idx) / sum(least(b.e, a.mid + 5) - greatest(b.s, a.mid - 5) ORDER BY b.idx) AS m
    FROM sm0 a JOIN sm0 b ON b.video_id = a.video_id AND b.e > a.mid - 5 AND b.s < a.mid + 5 GROUP BY ALL)"""

PEAKS = SMOOTH + """,
  big AS (SELECT video_id FROM sm GROUP BY video_id HAVING count(*) >= 3),
  st AS (SELECT *, CASE WHEN abs(m - lag(m) OVER w) <= 1e-9 THEN 0 ELSE 1 END AS fresh FROM sm WHERE video_id IN (SELECT video_id FROM big) WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
  gr AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY idx) AS g FROM st),
  pl AS (SELECT video_id, g, min(idx) AS f, max(idx) AS l, arg_min(m, idx) AS v, (arg_min(mid, idx) + arg_max(mid, idx)) / 2 AS center FROM gr GROUP BY video_id, g),
  tp AS (SELECT * FROM (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM pl WINDOW w AS (PARTITION BY video_id ORDER BY f)) WHERE before < v - 1e-9 AND after < v - 1e-9),
  rp AS (SELECT t.*, r.idx AS r, r.mid AS t, r.s, r.e, r.value AS raw, r.m AS smo, r.dur FROM tp t JOIN gr r ON r.video_id = t.video_id AND r.g = t.g QUALIFY row_number() OVER (PARTITION BY t.video_id, t.g ORDER BY abs(r.mid - t.center), r.idx) = 1),
  sd AS (SELECT p.video_id, p.g, min(a.m) FILTER (WHERE a.idx < p.f AND a.mid >= p.t - 30) AS lo, min(a.m) FILTER (WHERE a.idx > p.l AND a.mid <= p.t + 30) AS hi, min(a.m) FILTER (WHERE a.idx = p.f - 1) AS lo1, min(a.m) FILTER (WHERE a.idx = p.l + 1) AS hi1 FROM rp p JOIN sm a ON a.video_id = p.video_id GROUP BY ALL),
  cd AS (SELECT p.*, least(1.0, greatest(0.0, p.v - greatest(coalesce(lo, lo1), coalesce(hi, hi1)))) AS prom FROM rp p JOIN sd USING (video_id, g)),
  od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY prom DESC, smo DESC, raw DESC, t) AS o FROM cd WHERE prom >= 0.05),
  nms AS (SELECT video_id, CAST(0 AS BIGINT) AS o, CAST([] AS DOUBLE[]) AS kept, CAST(0 AS BIGINT) AS took FROM (SELECT DISTINCT video_id FROM od)
    UNION ALL SELECT n.video_id, d.o, CASE WHEN len(n.kept) < 20 AND len(list_filter(n.kept, lambda k: abs(k - d.t) < 30)) = 0 THEN list_append(n.kept, d.t) ELSE n.kept END,
      CASE WHEN len(n.kept) < 20 AND len(list_filter(n.kept, lambda k: abs(k - d.t) < 30)) = 0 THEN 1 ELSE 0 END FROM nms n JOIN od d ON d.video_id = n.video_id AND d.o = n.o + 1),
  peaks AS (SELECT d.video_id, row_number() OVER (PARTITION BY d.video_id ORDER BY d.o) AS rank, d.t AS peak_time, d.s AS start_time, d.e AS end_time, d.raw AS raw_value, d.smo AS smoothed_value, d.prom AS prominence, d.dur AS duration_seconds
    FROM od d JOIN nms n ON n.video_id = d.video_id AND n.o = d.o AND n.took = 1)"""

CANDS = PEAKS + """,
  wn AS (SELECT *, least(60.0, duration_seconds) AS ln, greatest(0.0, least(peak_time - least(60.0, duration_seconds) / 2, duration_seconds - least(60.0, duration_seconds))) AS ws FROM peaks WHERE duration_seconds >= 30),
  wo AS MATERIALIZED (SELECT *, ws + ln AS we, row_number() OVER (PARTITION BY video_id ORDER BY rank) AS o FROM wn),
  ov AS (SELECT video_id, CAST(0 AS BIGINT) AS o, CAST([] AS DOUBLE[]) AS ks, CAST(0 AS BIGINT) AS took FROM (SELECT DISTINCT video_id FROM wo)
    UNION ALL SELECT n.video_id, d.o, CASE WHEN len(n.ks) < 12 AND len(list_filter(n.ks, lambda k: greatest(0, least(k, d.ws) + d.ln - greatest(k, d.ws)) / d.ln > 0.65)) = 0 THEN list_append(n.ks, d.ws) ELSE n.ks END,
      CASE WHEN len(n.ks) < 12 AND len(list_filter(n.ks, lambda k: greatest(0, least(k, d.ws) + d.ln - greatest(k, d.ws)) / d.ln > 0.65)) = 0 THEN 1 ELSE 0 END FROM ov n JOIN wo d ON d.video_id = n.video_id AND d.o = n.o + 1),
  cands AS (SELECT d.video_id, row_number() OVER (PARTITION BY d.video_id ORDER BY d.o) AS rank, d.rank AS source_peak_rank, d.peak_time, d.ws AS start_time, d.we AS end_time, d.we - d.ws AS duration_seconds,
      'cand_v1_' || sha256('{"candidate_id_version":1,"end_microseconds":' || CAST(CAST(round(d.we * 1000000) AS BIGINT) AS VARCHAR) || ',"generator":"GENERATOR","generator_version":GENVER,"start_microseconds":' || CAST(CAST(round(d.ws * 1000000) AS BIGINT) AS VARCHAR) || ',"video_id":"' || d.video_id || '"}') AS candidate_id
    FROM wo d JOIN ov n ON n.video_id = d.video_id AND n.o = d.o AND n.took = 1)"""

SQL = {
    "j1_smoothing": with_views("heatmap_points", f"WITH {SMOOTH} SELECT video_id, idx, value, round(m, 9) AS smoothed FROM sm"),
    "k1_heatmap_peaks": with_views("heatmap_points", f"WITH {PEAKS} SELECT video_id, CAST(rank AS INTEGER) AS rank, peak_time, start_time, end_time, raw_value, round(smoothed_value, 9) AS smoothed_value, round(prominence, 9) AS prominence, duration_seconds FROM peaks"),
}


def candidates(generator: str, version: int) -> str:
    made = CANDS.replace("GENERATOR", generator).replace("GENVER", str(version))
    return with_views("heatmap_points", f"WITH {made} SELECT video_id, CAST(rank AS INTEGER) AS rank, CAST(source_peak_rank AS INTEGER) AS source_peak_rank, peak_time, start_time, end_time, duration_seconds, candidate_id FROM cands")
