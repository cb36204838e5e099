"""Ordered-series operators on the events table (one video per user)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinolake.operators import changepoints as cp
from kinolake.operators import ordering as o
from kinolake.operators import signal as sg
from kinolake.registry import partition_sql as ps
from kinolake.registry.base import EVENTS_SQL, NUMBERED_SQL, events, longest, query, r6, rounded, signal, table

CHANNELS = ["pan", "tilt", "zoom", "camera_magnitude"]


def numbered(spark, sf, size=None):
    return sg.numbered(signal(spark, sf), longest=size if size is not None else longest(spark, sf))


@query("pr02_signal_rows", f"""WITH {EVENTS_SQL} SELECT video_id, idx, round("timestamp", 6) AS "timestamp", round(pan, 6) AS pan,
  round(tilt, 6) AS tilt, round(zoom, 6) + 0.0 AS zoom, round(camera_magnitude, 6) AS camera_magnitude FROM ev WHERE event_type <> 'error'""")
def signal_rows(spark, sf):
    rows = sg.signal_rows(events(spark, sf), CHANNELS, F.col("event_type") != "error")
    return rounded(rows, "timestamp", *CHANNELS)


@query("pr02_rejected_videos", f"""WITH {EVENTS_SQL} SELECT video_id, count(*) AS samples, 'no motion samples' AS reason
  FROM ev GROUP BY video_id HAVING NOT bool_or(event_type = 'purchase' AND pan > 150)""")
def rejected_videos(spark, sf):
    return sg.videos_without_signal(events(spark, sf), (F.col("event_type") == "purchase") & (F.col("pan") > 150))


@query("pr04_time_slice", f"""WITH {EVENTS_SQL} SELECT idx, 'half-open' AS kind FROM ev WHERE "timestamp" >= 1704672000 AND "timestamp" < 1705276800
  UNION ALL SELECT idx, 'closed' FROM ev WHERE "timestamp" >= 1704672000 AND "timestamp" <= 1705276800
  UNION ALL SELECT idx, 'open end' FROM ev WHERE "timestamp" >= 1706000000""")
def time_slice(spark, sf):
    e = events(spark, sf)
    parts = [(sg.time_slice(e, 1704672000.0, 1705276800.0), "half-open"),
             (sg.time_slice(e, 1704672000.0, 1705276800.0, closed=True), "closed"),
             (sg.time_slice(e, 1706000000.0, None), "open end")]
    out = [p.select("idx", F.lit(k).alias("kind")) for p, k in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def savgol_sql(source: str = "sig") -> str:
    """CTE ``smooth`` from numbered samples, with weights in closed form: the fit on 1, x and x * x - mean, which are orthogonal."""
    return f"""sizes AS (SELECT w, sum((j - (w - 1) / 2) ** 2) AS s2, sum((j - (w - 1) / 2) ** 4) AS s4
    FROM range(3, 12, 2) a(w), range(0, 11) b(j) WHERE j < w GROUP BY w),
  weights AS (SELECT w, r, j, 1 / w + (r - (w - 1) / 2) * (j - (w - 1) / 2) / s2
      + ((r - (w - 1) / 2) ** 2 - s2 / w) * ((j - (w - 1) / 2) ** 2 - s2 / w) / (s4 - s2 * s2 / w) AS c
    FROM sizes, range(0, 11) a(r), range(0, 11) b(j) WHERE r < w AND j < w),
  placed AS (SELECT *, greatest(least(pos - (w - 1) // 2, n - w), 0) AS first FROM
    (SELECT *, greatest(least(11, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END), 3) AS w FROM {source})),
  smooth AS (SELECT p.video_id, p.idx, p."timestamp", p.pos, p.n,
    {", ".join(f"sum(q.{c} * k.c) AS {c}" for c in CHANNELS)}
    FROM placed p JOIN weights k ON k.w = p.w AND k.r = p.pos - p.first
    JOIN {source} q ON q.video_id = p.video_id AND q.pos = p.first + k.j WHERE p.n >= p.w GROUP BY ALL
    UNION ALL SELECT video_id, idx, "timestamp", pos, n, {", ".join(CHANNELS)} FROM placed WHERE n < w)"""


def round_sql(names, prefix="") -> str:
    return ", ".join(f"round({prefix}{c}, 6) + 0.0 AS {c}" for c in names)


@query("wn01_savgol", f"WITH {NUMBERED_SQL}, {savgol_sql()} SELECT idx, {round_sql(CHANNELS)} FROM smooth")
def savgol(spark, sf):
    size = longest(spark, sf)
    return rounded(sg.savgol(numbered(spark, sf, size), CHANNELS, longest=size), *CHANNELS).select("idx", *CHANNELS)


def scaled_sql(source, mode):
    lo, hi = "min({0}) OVER v", "max({0}) OVER v"
    parts = []
    for c in CHANNELS:
        width = f"({hi.format(c)} - {lo.format(c)})"
        shift = f"({c} - {lo.format(c)})"
        parts.append({
            "guarded": f"CASE WHEN {width} > 1e-8 THEN {shift} / {width} ELSE {c} END",
            "zero": f"{shift} / CASE WHEN {width} > 0 THEN {width} ELSE 1.0 END",
            "epsilon": f"{shift} / ({width} + 1e-12)"}[mode])
    return f"""SELECT idx, {", ".join(f"round({x}, 6) + 0.0 AS {c}" for x, c in zip(parts, CHANNELS))}
      FROM {source} WINDOW v AS (PARTITION BY video_id)"""


@query("wn02_minmax", f"WITH {EVENTS_SQL} {scaled_sql('ev', 'guarded')}")
def minmax(spark, sf):
    return rounded(sg.minmax(signal(spark, sf), CHANNELS, longest=longest(spark, sf)), *CHANNELS).select("idx", *CHANNELS)


@query("wn02b_minmax_variants", f"""WITH {EVENTS_SQL} SELECT *, 'zero' AS mode FROM ({scaled_sql('ev', 'zero')})
  UNION ALL SELECT *, 'epsilon' AS mode FROM ({scaled_sql('ev', 'epsilon')})""")
def minmax_variants(spark, sf):
    s = signal(spark, sf)
    out = [rounded(sg.minmax(s, CHANNELS, m), *CHANNELS).select("idx", *CHANNELS, F.lit(m).alias("mode"))
           for m in ("zero", "epsilon")]
    return out[0].unionByName(out[1])


@query("wn03_median_filter", f"""WITH {NUMBERED_SQL}, near AS (SELECT p.idx, p.pan AS x, q.pan, q.tilt FROM sig p
   JOIN (SELECT video_id, pos, pan, tilt FROM sig UNION ALL SELECT DISTINCT video_id, unnest([-2, -1, n, n + 1]), 0.0, 0.0 FROM sig) q
   ON q.video_id = p.video_id AND q.pos BETWEEN p.pos - 2 AND p.pos + 2)
  SELECT idx, round(median(pan), 6) + 0.0 AS pan, round(median(tilt), 6) + 0.0 AS tilt FROM near GROUP BY idx""")
def median_filter(spark, sf):
    size = longest(spark, sf)
    return rounded(sg.median_filter(numbered(spark, sf, size), ["pan", "tilt"], longest=size), "pan", "tilt").select("idx", "pan", "tilt")


@query("wn04_interpolate_bad", f"""WITH {NUMBERED_SQL}, g AS (SELECT *, pan >= 20 AS ok, sum((pan >= 20)::INT) OVER (PARTITION BY video_id) AS goods,
    max(CASE WHEN pan >= 20 THEN pos END) OVER (PARTITION BY video_id ORDER BY pos) AS p,
    min(CASE WHEN pan >= 20 THEN pos END) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM sig)
  SELECT g.idx, round(CASE WHEN ok OR goods < 2 THEN g.pan WHEN p IS NULL THEN b.pan WHEN q IS NULL THEN a.pan
      ELSE a.pan + (b.pan - a.pan) * ((g.pos - p) / (q - p)) END, 6) + 0.0 AS pan,
    round(CASE WHEN ok OR goods < 2 THEN g.tilt WHEN p IS NULL THEN b.tilt WHEN q IS NULL THEN a.tilt
      ELSE a.tilt + (b.tilt - a.tilt) * ((g.pos - p) / (q - p)) END, 6) + 0.0 AS tilt
  FROM g LEFT JOIN sig a ON a.video_id = g.video_id AND a.pos = g.p LEFT JOIN sig b ON b.video_id = g.video_id AND b.pos = g.q""")
def interpolate_bad(spark, sf):
    size = longest(spark, sf)
    rows = sg.interpolate_bad(numbered(spark, sf, size), ["pan", "tilt"], F.col("pan") < 20, longest=size)
    return rounded(rows, "pan", "tilt").select("idx", "pan", "tilt")


DERIVATIVE_SQL = """step AS (SELECT *, "timestamp" - lag("timestamp") OVER v AS step,
    CASE WHEN n = 1 THEN 0.0 WHEN pos = 0 THEN lead(pan) OVER v - pan WHEN pos = n - 1 THEN pan - lag(pan) OVER v ELSE (lead(pan) OVER v - lag(pan) OVER v) / 2 END AS d_pan,
    CASE WHEN n = 1 THEN 0.0 WHEN pos = 0 THEN lead(tilt) OVER v - tilt WHEN pos = n - 1 THEN tilt - lag(tilt) OVER v ELSE (lead(tilt) OVER v - lag(tilt) OVER v) / 2 END AS d_tilt,
    CASE WHEN n = 1 THEN 0.0 WHEN pos = 0 THEN lead(zoom) OVER v - zoom WHEN pos = n - 1 THEN zoom - lag(zoom) OVER v ELSE (lead(zoom) OVER v - lag(zoom) OVER v) / 2 END AS d_zoom
  FROM sig WINDOW v AS (PARTITION BY video_id ORDER BY pos))"""


@query("wn05_gradient", f"""WITH {NUMBERED_SQL}, {DERIVATIVE_SQL}, dt AS (SELECT video_id, coalesce(median(step), 1.0) AS dt FROM step GROUP BY video_id)
  SELECT idx, round(d_pan / dt * 3600, 6) + 0.0 AS v_pan, round(d_tilt / dt * 3600, 6) + 0.0 AS v_tilt FROM step JOIN dt USING (video_id)""")
def gradient(spark, sf):
    size = longest(spark, sf)
    g = sg.gradient(numbered(spark, sf, size), ["pan", "tilt"], longest=size)
    return g.select("idx", r6(F.col("v_pan") * 3600).alias("v_pan"), r6(F.col("v_tilt") * 3600).alias("v_tilt"))


@query("wn06_monotonicity", f"""WITH {NUMBERED_SQL}, r AS (SELECT video_id, n, pos,
    rank() OVER (PARTITION BY video_id ORDER BY pan) + (count(*) OVER (PARTITION BY video_id, pan) - 1) / 2 AS rp,
    rank() OVER (PARTITION BY video_id ORDER BY tilt) + (count(*) OVER (PARTITION BY video_id, tilt) - 1) / 2 AS rt FROM sig)
  SELECT video_id, c.channel, round(CASE WHEN max(n) <= 2 THEN 0.0 ELSE coalesce(corr(pos, CASE c.channel WHEN 'pan' THEN rp ELSE rt END), 0.0) END, 6) + 0.0 AS monotonicity
  FROM r, (VALUES ('pan'), ('tilt')) c(channel) GROUP BY video_id, c.channel""")
def monotonicity(spark, sf):
    size = longest(spark, sf)
    return rounded(sg.rank_correlation(numbered(spark, sf, size), ["pan", "tilt"], longest=size), "monotonicity")


def end_positions(df):
    """Interval ends every ten rows and at the series end, to bind index look-ups."""
    last = df.groupBy("video_id").agg(F.max("n").alias("end_pos"))
    inner = df.filter((F.col("pos") % 10 == 0) & (F.col("pos") > 0)).select("video_id", F.col("pos").alias("end_pos"))
    return inner.unionByName(last)


@query("wn14_boundary_times", f"""WITH {NUMBERED_SQL}, cut AS (SELECT DISTINCT video_id, pos AS e FROM sig WHERE pos % 10 = 0 AND pos > 0)
  SELECT cut.video_id, e AS end_pos, round("timestamp", 6) AS "time", 'before' AS edge FROM cut JOIN sig s ON s.video_id = cut.video_id AND s.pos = e - 1 AND e < n
  UNION ALL SELECT cut.video_id, e, round("timestamp", 6), 'at' FROM cut JOIN sig s ON s.video_id = cut.video_id AND s.pos = e AND e < n""")
def boundary_times(spark, sf):
    s = numbered(spark, sf)
    out = [sg.boundaries_to_times(end_positions(s), s, e).withColumn("edge", F.lit(e)) for e in ("before", "at")]
    return rounded(out[0].unionByName(out[1]), "time")


@query("wn16_direction_encode", f"""WITH {EVENTS_SQL}, d AS (SELECT idx, video_id, pan, tilt, sin(pan) AS ds, cos(pan) AS dc FROM ev)
  SELECT idx, {", ".join(f"round(({a} - min({a}) OVER v) / CASE WHEN max({a}) OVER v - min({a}) OVER v > 0 THEN max({a}) OVER v - min({a}) OVER v ELSE 1.0 END, 6) + 0.0 AS {b}"
                        for a, b in (("pan", "pan"), ("tilt", "tilt"), ("ds", "dir_sin"), ("dc", "dir_cos")))}
  FROM d WINDOW v AS (PARTITION BY video_id)""")
def direction_encode(spark, sf):
    e = signal(spark, sf).withColumn("direction", F.col("pan"))
    names = ["pan", "tilt", "dir_sin", "dir_cos"]
    return rounded(sg.direction_encode(e, "pan", "tilt", "direction", longest(spark, sf)), *names).select("idx", *names)


@query("wn20_cumulative_path", f"""WITH {NUMBERED_SQL} SELECT idx, round(sum(pan) OVER v, 4) + 0.0 AS cum_pan, round(sum(zoom) OVER v, 4) + 0.0 AS cum_zoom
  FROM sig WINDOW v AS (PARTITION BY video_id ORDER BY pos)""")
def cumulative_path(spark, sf):
    size = longest(spark, sf)
    c = sg.cumulative_path(numbered(spark, sf, size), ["pan", "zoom"], longest=size)
    return c.select("idx", *[(F.round(x, 4) + 0.0).alias(x) for x in ("cum_pan", "cum_zoom")])


@query("wn21_subsample", f"""WITH {NUMBERED_SQL}, d AS (SELECT *, max("timestamp") OVER v - min("timestamp") OVER v AS span FROM sig WINDOW v AS (PARTITION BY video_id))
  SELECT idx, pos FROM d WHERE pos % greatest(1, CAST(round_even(n / (span / 200000), 0) AS BIGINT)) = 0""")
def subsample(spark, sf):
    s = numbered(spark, sf)
    span = s.groupBy("video_id").agg((F.max("timestamp") - F.min("timestamp")).alias("span"))
    return sg.subsample(s.join(span, "video_id"), F.col("span") / 200000).select("idx", "pos")


@query("wn22_flow_vectors", f"""WITH {EVENTS_SQL} SELECT idx, round(cos(tilt) * pan * 0.35, 6) + 0.0 AS dx, round(sin(tilt) * pan * 0.35, 6) + 0.0 AS dy FROM ev""")
def flow_vectors(spark, sf):
    dx, dy = sg.flow_vectors(F.col("tilt"), F.col("pan"))
    return signal(spark, sf).select("idx", r6(dx).alias("dx"), r6(dy).alias("dy"))


@query("wn23_frame_pairs", f"""WITH {NUMBERED_SQL} SELECT idx, pan, lag(idx) OVER v AS prev_idx, lag(pan) OVER v AS prev_pan FROM sig
  WINDOW v AS (PARTITION BY video_id ORDER BY pos)""")
def frame_pairs(spark, sf):
    size = longest(spark, sf)
    return sg.frame_pairs(numbered(spark, sf, size), ["idx", "pan"], longest=size).select("idx", "pan", "prev_idx", "prev_pan")


# boundaries of a video: the times of its "signup" events
BOUNDS_SQL = """bounds AS (SELECT video_id, "timestamp" AS "time" FROM ev WHERE event_type = 'signup'),
  extent AS (SELECT video_id, min("timestamp") AS s, max("timestamp") AS e FROM ev GROUP BY video_id)"""
EDGE_STEPS_SQL = """edges AS (SELECT video_id, s AS edge, 0 AS kind FROM extent UNION ALL SELECT video_id, "time", 1 FROM bounds
   UNION ALL SELECT video_id, e, 2 FROM extent),
  intervals AS (SELECT * FROM (SELECT video_id, row_number() OVER v - 1 AS scene_id, edge AS start_time, lead(edge) OVER v AS end_time
   FROM edges WINDOW v AS (PARTITION BY video_id ORDER BY edge, kind)) WHERE end_time IS NOT NULL)"""
EDGES_SQL = f"{BOUNDS_SQL}, {EDGE_STEPS_SQL}"


def bounds(e):
    return e.filter(F.col("event_type") == "signup").select("video_id", F.col("timestamp").alias("time"))


def extent(e):
    return e.groupBy("video_id").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))


def intervals(e, size=None):
    return sg.scene_edges(bounds(e), extent(e), longest=size)


@query("wn24_scene_edges", f"""WITH {EVENTS_SQL}, {EDGES_SQL} SELECT video_id, scene_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM intervals""")
def scene_edges(spark, sf):
    return rounded(intervals(events(spark, sf), longest(spark, sf)), "start_time", "end_time")


@query("jn06_frames_to_intervals", f"""WITH {EVENTS_SQL}, {EDGES_SQL} SELECT ev.idx, i.scene_id, false AS closed FROM ev JOIN intervals i
    ON i.video_id = ev.video_id AND "timestamp" >= start_time AND "timestamp" < end_time
  UNION ALL SELECT ev.idx, i.scene_id, true FROM ev JOIN intervals i ON i.video_id = ev.video_id AND "timestamp" >= start_time
    AND ("timestamp" < end_time OR ("timestamp" = end_time AND end_time = (SELECT e FROM extent x WHERE x.video_id = ev.video_id)))""")
def frames_to_intervals(spark, sf):
    e = events(spark, sf)
    scenes = intervals(e, longest(spark, sf))
    out = [sg.frames_to_intervals(e, scenes, closed_last=c).select("idx", "scene_id", F.lit(c).alias("closed"))
           for c in (False, True)]
    return out[0].unionByName(out[1])


@query("jn07_assign_by_boundaries", f"""WITH {EVENTS_SQL}, {BOUNDS_SQL} SELECT ev.idx, count(b."time") AS segment FROM ev LEFT JOIN bounds b
   ON b.video_id = ev.video_id AND b."time" < ev."timestamp" GROUP BY ev.idx""")
def assign_by_boundaries(spark, sf):
    e = events(spark, sf)
    return sg.assign_by_boundaries(e.select("video_id", "idx", "timestamp"), bounds(e),
                                   longest=2 * longest(spark, sf)).select("idx", "segment")


@query("jn08_nearest_sample", f"""WITH {EVENTS_SQL}, b AS (SELECT video_id, "timestamp" + 1800.5 AS "time" FROM ev WHERE event_type = 'signup')
  SELECT b.video_id, round(b."time", 6) AS "time", arg_min(s.idx, struct_pack(gap := abs(s."timestamp" - b."time"), t := s."timestamp", i := s.idx)) AS nearest_idx
  FROM b JOIN ev s ON s.video_id = b.video_id AND s.event_type <> 'signup' GROUP BY b.video_id, b."time" """)
def nearest_sample(spark, sf):
    e = events(spark, sf)
    shifted = bounds(e).withColumn("time", F.col("time") + 1800.5)
    near = sg.nearest_sample(shifted, e.filter(F.col("event_type") != "signup"),
                             longest=2 * longest(spark, sf))
    return rounded(near, "time").select("video_id", "time", "nearest_idx")


def scaled_signal(spark, sf, size):
    return sg.minmax(sg.savgol(numbered(spark, sf, size), CHANNELS, longest=size), CHANNELS, longest=size)


SCALED_SQL = f"{NUMBERED_SQL}, {savgol_sql()}, scaled AS ({ps.scaled('smooth', CHANNELS)})"
MEDIAN_SQL = f"{ps.median_of_five('med', 'sig', CHANNELS)}, scaled_med AS ({ps.scaled('med', CHANNELS)})"


@query("wn10_change_points_l2", f"""WITH RECURSIVE {SCALED_SQL}, {ps.partition_sql('cut', 'scaled', ps.squared(CHANNELS), [3.0])}
  SELECT video_id, start_pos, end_pos FROM cut""")
def change_points_l2(spark, sf):
    size = longest(spark, sf)
    return cp.change_points(scaled_signal(spark, sf, size), ["video_id"], CHANNELS, "l2", 3.0, longest=size)


@query("wn10_change_points_l1", f"""WITH RECURSIVE {SCALED_SQL}, {ps.partition_sql('cut', 'scaled', ps.absolute(CHANNELS), [2.0])}
  SELECT video_id, start_pos, end_pos FROM cut""")
def change_points_l1(spark, sf):
    size = longest(spark, sf)
    return cp.change_points(scaled_signal(spark, sf, size), ["video_id"], CHANNELS, "l1", 2.0, longest=size)


def zero_range_sql(expression):
    width = f"(max({expression}) OVER v - min({expression}) OVER v)"
    return f"({expression} - min({expression}) OVER v) / CASE WHEN {width} > 0 THEN {width} ELSE 1.0 END"


@query("wn10_change_points_rbf", f"""WITH RECURSIVE {NUMBERED_SQL}, turned AS (SELECT video_id, pos, n,
    [{", ".join(zero_range_sql(x) for x in ("pan", "tilt", "sin(zoom)", "cos(zoom)"))}] AS v FROM sig WINDOW v AS (PARTITION BY video_id)),
  {ps.partition_sql('cut', 'turned', ps.kernel('v'), [3.0], min_rows=3)} SELECT video_id, start_pos, end_pos FROM cut""")
def change_points_rbf(spark, sf):
    size = longest(spark, sf)
    rows = numbered(spark, sf, size).withColumn("direction", F.col("zoom"))
    e = sg.direction_encode(rows, "pan", "tilt", "direction", longest=size)
    return cp.change_points(e, ["video_id"], ["pan", "tilt", "dir_sin", "dir_cos"], "rbf", 3.0, min_rows=3)


@query("wn12_trajectory_boundaries", f"""WITH RECURSIVE {NUMBERED_SQL}, {ps.median_of_five('med', 'sig', ("pan", "tilt", "zoom"))},
  clean AS ({ps.scaled('med', ("pan", "tilt", "zoom"))}), {ps.partition_sql('cut', 'clean', ps.absolute(("pan", "tilt", "zoom")), [3.0], min_rows=4)}
  SELECT cut.video_id, end_pos, round("timestamp", 6) AS "time" FROM cut JOIN sig s ON s.video_id = cut.video_id AND s.pos = end_pos - 1 WHERE end_pos < n""")
def trajectory_boundaries(spark, sf):
    from kinolake.plans.trajectory import trajectory_boundaries as run
    size = longest(spark, sf)
    return rounded(run(numbered(spark, sf, size), ["pan", "tilt", "zoom"], longest=size), "time")


@query("ag17_penalty_sweep", f"""WITH RECURSIVE {SCALED_SQL}, {MEDIAN_SQL}, variants AS (SELECT 'savgol' AS variant, * FROM scaled
    UNION ALL BY NAME SELECT 'median' AS variant, * FROM scaled_med),
  {ps.partition_sql('cut', 'variants', ps.squared(CHANNELS), [0.5 * i for i in range(1, 41)], ("video_id", "variant"))}
  SELECT video_id, variant, pen AS penalty, count(*) AS segments FROM cut GROUP BY ALL""")
def penalty_sweep(spark, sf):
    size = longest(spark, sf)
    s = numbered(spark, sf, size)
    penalties = np.linspace(0.5, 20.0, 40).tolist()
    smooth = sg.minmax(sg.savgol(s, CHANNELS, longest=size), CHANNELS, longest=size).withColumn("variant", F.lit("savgol"))
    median = sg.minmax(sg.median_filter(s, CHANNELS, longest=size), CHANNELS, longest=size).withColumn("variant", F.lit("median"))
    return cp.penalty_sweep(smooth.unionByName(median), ["video_id", "variant"], CHANNELS, penalties, longest=size).drop("searches")
