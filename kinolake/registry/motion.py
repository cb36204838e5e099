"""Motion and quality statistics bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolake.operators import motion as m
from kinolake.operators import signal as sg
from kinolake.plans import segmentation, trajectory
from kinolake.registry.base import EVENTS_SQL, NUMBERED_SQL, SEGMENTS_SQL, events, longest, query, r6, rounded, segments, signal, table
from kinolake.registry import partition_sql as ps
from kinolake.registry.retrieval import PEAKS_SQL, SCORE_STEPS_SQL
from kinolake.registry.signals import CHANNELS, EDGE_STEPS_SQL, EDGES_SQL, SCALED_SQL, intervals, round_sql, zero_range_sql
from kinolake.settings import VELOCITY_CHANNELS


@query("pr01_frame_metrics", """WITH m AS (SELECT *, l_returnflag <> 'A' AS ok FROM lineitem),
  long AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['flow_magnitude', 'flow_coherence']) AS metric, unnest([l_quantity, l_discount]) AS v FROM m
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['pan', 'tilt', 'roll', 'zoom', 'scene_activity']),
      unnest([l_tax, l_discount, l_tax * 2, l_quantity / 50, l_extendedprice]) FROM m WHERE ok)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, metric, round(v, 6) + 0.0 AS v FROM long""")
def frame_metrics(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({
        "flow_magnitude": F.col("l_quantity"), "flow_coherence": F.col("l_discount"), "pan": F.col("l_tax"),
        "tilt": F.col("l_discount"), "roll": F.col("l_tax") * 2, "zoom": F.col("l_quantity") / 50,
        "scene_activity": F.col("l_extendedprice")})
    rows = m.frame_metrics(li, F.col("l_returnflag") != "A")
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                               F.explode("metrics").alias("metric", "v")), "v")


@query("pr05_metrics_pivot", """SELECT event_id, value AS pan, k AS tilt, k AS zoom, NULL::DOUBLE AS flow_magnitude
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE event_type <> 'view'""")
def metrics_pivot(spark, sf):
    e = table(spark, sf, "events")
    k = F.from_json("props", "map<string,double>")["k"]
    full = F.create_map(F.lit("pan"), F.col("value"), F.lit("tilt"), k, F.lit("zoom"), k)
    part = F.create_map(F.lit("pan"), F.col("value"), F.lit("tilt"), k)
    rows = e.withColumn("metrics", F.when(F.col("event_type") != "view", full).otherwise(part))
    return m.metrics_pivot(rows.select("event_id", "metrics"))


@query("ag01_flow_statistics", """WITH v AS (SELECT l_suppkey AS frame, l_discount - 0.05 AS dx, l_tax - 0.04 AS dy FROM lineitem),
  s AS (SELECT frame, avg(sqrt(dx * dx + dy * dy)) AS mag, avg(cos(atan2(dy, dx))) AS c, avg(sin(atan2(dy, dx))) AS s FROM v GROUP BY frame)
  SELECT frame, round(mag, 6) + 0.0 AS mean_magnitude, round(atan2(s, c), 6) + 0.0 AS dominant_direction, round(sqrt(c * c + s * s), 6) + 0.0 AS coherence FROM s""")
def flow_statistics(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_discount") - 0.05).alias("dx"),
                                            (F.col("l_tax") - 0.04).alias("dy"))
    return rounded(m.flow_statistics(v, ["frame"]), "mean_magnitude", "dominant_direction", "coherence")


@query("ag02_camera_motion_residual", """WITH v AS (SELECT l_suppkey AS frame, l_quantity * 10 AS x, (l_partkey % 480)::DOUBLE AS y, l_discount * 20 AS dx, l_tax * 20 AS dy,
    l_returnflag <> 'A' AS ok, 1 + (l_suppkey % 7) / 1000 AS a, (l_suppkey % 5) / 100 AS b, (l_suppkey % 3)::DOUBLE AS t, (l_suppkey % 4) / 100000 AS g FROM lineitem),
  p AS (SELECT *, (a * x - b * y + t) / (g * x + 1) - x AS cx, (b * x + a * y - t) / (g * x + 1) - y AS cy FROM v)
  SELECT frame, round(avg(sqrt(cx * cx + cy * cy)), 6) + 0.0 AS camera_magnitude, round(avg(sqrt((dx - cx) ** 2 + (dy - cy) ** 2)), 6) + 0.0 AS scene_activity,
    round(1 - avg(ok::INT), 6) + 0.0 AS moving_object_ratio FROM p GROUP BY frame""")
def camera_motion_residual(spark, sf):
    k = F.col("l_suppkey")
    a, b, t, g = 1 + k % 7 / 1000, k % 5 / 100, (k % 3).cast("double"), k % 4 / 100000
    zero, one = F.lit(0.0), F.lit(1.0)
    v = table(spark, sf, "lineitem").select(
        k.alias("frame"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_partkey") % 480).cast("double").alias("y"),
        (F.col("l_discount") * 20).alias("dx"), (F.col("l_tax") * 20).alias("dy"),
        (F.col("l_returnflag") != "A").alias("inlier"), F.array(a, -b, t, b, a, -t, g, zero, one).alias("matrix"))
    return rounded(m.camera_motion_residual(v, ["frame"]), "camera_magnitude", "scene_activity", "moving_object_ratio")


def quality_frames(e):
    return e.select("video_id", "idx", "timestamp", (F.sqrt("pan") * 100).alias("sharpness"),
                    (F.sqrt("tilt") * 25).alias("mean_brightness"), (F.col("tilt") / 50).alias("highlight_clip_pct"),
                    (F.col("pan") / 100).alias("shadow_clip_pct"),
                    F.when(F.col("event_type") == "purchase", F.sqrt("tilt") * 9).alias("brisque"))


def flow_frames(e):
    return e.filter(F.col("event_type") != "view").select(
        "video_id", "idx", "timestamp", F.sqrt("pan").alias("mean_magnitude"), (F.sqrt("tilt") / 11).alias("coherence"))


SCENE_SQL = f"""{EVENTS_SQL}, {EDGES_SQL}, inside AS (SELECT ev.*, i.scene_id, i.start_time, i.end_time FROM ev JOIN intervals i
    ON i.video_id = ev.video_id AND "timestamp" >= start_time AND "timestamp" < end_time)"""
AVERAGE_STEPS_SQL = """a AS (SELECT video_id, scene_id, avg(sqrt(pan) * 100) AS sharp, avg(sqrt(tilt) * 25) AS bright,
    avg(CASE WHEN event_type = 'purchase' THEN sqrt(tilt) * 9 END) AS brisque, avg(tilt / 50 + pan / 100) AS clip,
    coalesce(avg(CASE WHEN event_type <> 'view' THEN sqrt(pan) END), 0.0) AS mag,
    coalesce(avg(CASE WHEN event_type <> 'view' THEN sqrt(tilt) / 11 END), 0.0) AS coh FROM inside GROUP BY video_id, scene_id),
  parts AS (SELECT *, least(ln(1 + sharp) / ln(1501), 1.0) AS s1, greatest(1 - abs(bright - 127) / 127 - least(clip / 10, 1.0), 0.0) AS s2,
    greatest(1 - brisque / 80, 0.0) AS s3 FROM a),
  scored AS (SELECT *, greatest(least(CASE WHEN brisque IS NULL THEN (s1 * 0.5 + s2 * 0.2 + coh * 0.2) / 0.9
     ELSE s1 * 0.3 + s2 * 0.2 + coh * 0.2 + s3 * 0.3 END, 1.0), 0.0) AS q FROM parts)"""
AVERAGES_SQL = f"{SCENE_SQL}, {AVERAGE_STEPS_SQL}"


def averages(spark, sf):
    e = events(spark, sf)
    return m.scene_averages(quality_frames(e), flow_frames(e), intervals(e, longest(spark, sf)))


@query("ag03_scene_averages", f"""WITH {AVERAGES_SQL} SELECT video_id, scene_id, round(sharp, 2) AS avg_sharpness, round(bright, 2) AS avg_brightness,
  CASE WHEN brisque <> 0 THEN round(brisque, 2) END AS avg_brisque, round(mag, 4) AS avg_flow_magnitude, round(coh, 4) AS avg_flow_coherence FROM scored""")
def scene_averages(spark, sf):
    return averages(spark, sf).drop("quality_score", "start_time", "end_time")


@query("ag04_composite_quality", f"WITH {AVERAGES_SQL} SELECT video_id, scene_id, round(q, 6) + 0.0 AS quality FROM scored")
def composite_quality(spark, sf):
    e = events(spark, sf)
    scenes = intervals(e, longest(spark, sf))
    keys = ["video_id", "scene_id"]
    q = sg.frames_to_intervals(quality_frames(e), scenes).groupBy(*keys).agg(
        F.avg("sharpness").alias("a"), F.avg("mean_brightness").alias("b"), F.avg("brisque").alias("k"),
        F.avg(F.col("highlight_clip_pct") + F.col("shadow_clip_pct")).alias("c"))
    f = sg.frames_to_intervals(flow_frames(e), scenes).groupBy(*keys).agg(F.avg("coherence").alias("h"))
    score = m.composite_quality(F.col("a"), F.col("b"), F.col("c"), F.coalesce("h", F.lit(0.0)), F.col("k"))
    return q.join(f, keys, "left").select(*keys, r6(score).alias("quality"))


@query("tk07_rank_scenes", f"""WITH {AVERAGES_SQL} SELECT video_id, scene_id,
  row_number() OVER (PARTITION BY video_id ORDER BY round(q, 3) DESC, scene_id) AS rank FROM scored""")
def rank_scenes(spark, sf):
    return m.rank_scenes(averages(spark, sf)).select("video_id", "scene_id", "rank")


def numbered_intervals(spark, sf, size):
    e = events(spark, sf)
    rows = sg.frames_to_intervals(e, intervals(e, size)).drop("start_time", "end_time")
    return sg.numbered(rows, ["video_id", "scene_id"], longest=size)


def interval_stats_sql(edge: str, columns=VELOCITY_CHANNELS, extra: bool = False, inside: str = SCENE_SQL) -> str:
    """CTEs up to ``stats`` per (video_id, scene_id) of the rows that ``inside`` defines."""
    v = "OVER v"
    diffs = ", ".join(f"""CASE WHEN pos = 0 THEN lead({c}) {v} - {c} WHEN pos = n - 1 THEN {c} - lag({c}) {v}
        ELSE (lead({c}) {v} - lag({c}) {v}) / 2 END AS d_{c},
        rank() OVER (PARTITION BY video_id, scene_id ORDER BY {c}) + (count(*) OVER (PARTITION BY video_id, scene_id, {c}) - 1) / 2 AS r_{c}""" for c in columns)
    out = []
    for c in columns:
        out += [f"avg(CASE WHEN pos < w THEN d_{c} END) / max(dt) AS {c}_entry_vel", f"avg(CASE WHEN pos >= n - w THEN d_{c} END) / max(dt) AS {c}_exit_vel",
                f"avg(abs(d_{c})) / max(dt) AS {c}_mean_abs_deriv", f"stddev_pop(d_{c}) / max(dt) AS {c}_std_deriv",
                f"CASE WHEN max(n) <= 2 THEN 0.0 ELSE coalesce(corr(pos, r_{c}), 0.0) END AS {c}_monotonicity"]
        if extra:
            out += [f"avg(abs({c})) AS {c}_mean_abs", f"sqrt(avg({c} * {c})) AS {c}_rms"]
    return f"""{inside}, num AS (SELECT *, row_number() OVER (PARTITION BY video_id, scene_id ORDER BY "timestamp", idx) - 1 AS pos,
      count(*) OVER (PARTITION BY video_id, scene_id) AS n FROM inside),
    dif AS (SELECT *, "timestamp" - lag("timestamp") {v} AS step, {diffs} FROM num WHERE n >= 2
      WINDOW v AS (PARTITION BY video_id, scene_id ORDER BY pos)),
    dts AS (SELECT video_id, scene_id, median(step) AS dt FROM dif GROUP BY video_id, scene_id),
    stats AS (SELECT video_id, scene_id, {", ".join(out)} FROM (SELECT dif.*, dt, greatest(1, {edge}) AS w FROM dif JOIN dts USING (video_id, scene_id))
      GROUP BY video_id, scene_id)"""


# velocities are per hour here: samples lie hours apart and six digits are compared
SCALED = [f"{c}_{k}" for c in VELOCITY_CHANNELS for k in ("entry_vel", "exit_vel", "mean_abs_deriv", "std_deriv")]


@query("ag05_movement_stats", f"""WITH {interval_stats_sql('ceil(n * 0.05)')} SELECT video_id, scene_id,
  {", ".join(f"round({c} * 3600, 5) + 0.0 AS {c}" for c in SCALED)}, {round_sql([f"{c}_monotonicity" for c in VELOCITY_CHANNELS])} FROM stats""")
def movement_stats(spark, sf):
    size = longest(spark, sf)
    stats = m.interval_motion(numbered_intervals(spark, sf, size), ["video_id", "scene_id"], longest=size)
    return stats.select("video_id", "scene_id", *[(F.round(F.col(c) * 3600, 5) + 0.0).alias(c) for c in SCALED],
                        *[r6(f"{c}_monotonicity").alias(f"{c}_monotonicity") for c in VELOCITY_CHANNELS])


@query("ag06_channel_metrics", f"""WITH {interval_stats_sql('n // 10', extra=True)}, long AS ({" UNION ALL ".join(
    f"SELECT video_id, scene_id, '{c}' AS channel, {c}_mean_abs AS mean_abs, {c}_rms AS rms, {c}_entry_vel AS entry_vel, {c}_exit_vel AS exit_vel, "
    f"{c}_monotonicity AS monotonicity, {c}_mean_abs_deriv AS mean_abs_deriv, {c}_std_deriv AS std_deriv FROM stats" for c in VELOCITY_CHANNELS)})
  SELECT video_id, scene_id, channel, {round_sql(["mean_abs", "rms", "monotonicity"])}, {", ".join(f"round({c} * 3600, 5) + 0.0 AS {c}" for c in
    ("entry_vel", "exit_vel", "mean_abs_deriv", "std_deriv"))}, round(CASE WHEN mean_abs_deriv > 1e-9 THEN std_deriv / mean_abs_deriv END, 5) + 0.0 AS cv FROM long""")
def channel_metrics(spark, sf):
    size = longest(spark, sf)
    long = m.channel_metrics(numbered_intervals(spark, sf, size), ["video_id", "scene_id"], longest=size)
    return long.select("video_id", "scene_id", "channel", *[r6(c).alias(c) for c in ("mean_abs", "rms", "monotonicity")],
                       *[(F.round(F.col(c) * 3600, 5) + 0.0).alias(c) for c in
                         ("entry_vel", "exit_vel", "mean_abs_deriv", "std_deriv")],
                       (F.round("cv", 5) + 0.0).alias("cv"))


@query("ag07_cross_channel", f"""WITH {SCENE_SQL}, q AS (SELECT video_id, scene_id, sqrt(avg(pan * pan)) AS a, sqrt(avg(tilt * tilt)) AS b, sqrt(avg(zoom * zoom)) AS c,
    sqrt(avg(camera_magnitude * camera_magnitude)) AS d, count(*) AS n, corr(pan, tilt) AS r FROM inside GROUP BY video_id, scene_id)
  SELECT video_id, scene_id, CASE greatest(a, b, c, d) WHEN a THEN 'pan' WHEN b THEN 'tilt' WHEN c THEN 'zoom' ELSE 'camera_magnitude' END AS dominant_axis,
    CASE WHEN n > 2 AND NOT isnan(r) THEN round(r, 6) + 0.0 END AS pan_tilt_corr FROM q""")
def cross_channel(spark, sf):
    e = events(spark, sf)
    return rounded(m.cross_channel(sg.frames_to_intervals(e, intervals(e, longest(spark, sf))), ["video_id", "scene_id"]), "pan_tilt_corr")


def poses(spark, sf):
    return signal(spark, sf).select(
        "video_id", "idx", "timestamp", (F.col("pan") - 50).alias("pan"), (F.col("tilt") - 50).alias("tilt"),
        F.col("zoom").alias("roll"), (F.col("pan") / 100).alias("tx"), (F.col("tilt") / 100).alias("ty"),
        (F.col("zoom") / 100).alias("tz"), (F.col("tilt") / 100).alias("inlier_ratio"))


@query("ag08_trajectory_means", f"""WITH {SCENE_SQL}, q AS (SELECT video_id, scene_id, count(*) AS frames, avg(pan - 50) AS p, avg(tilt - 50) AS t, avg(zoom) AS r,
    avg(tilt / 100) AS m FROM inside GROUP BY video_id, scene_id)
  SELECT video_id, scene_id, frames, round(p, 6) + 0.0 AS mean_pan, round(t, 6) + 0.0 AS mean_tilt, round(r, 6) + 0.0 AS mean_roll, round(m, 6) + 0.0 AS mean_inlier_ratio,
    CASE greatest(abs(p), abs(t), abs(r)) WHEN abs(p) THEN 'pan' WHEN abs(t) THEN 'tilt' ELSE 'roll' END AS dominant_axis FROM q""")
def trajectory_means(spark, sf):
    rows = m.trajectory_segment_means(poses(spark, sf), intervals(events(spark, sf), longest(spark, sf)))
    return rounded(rows.drop("start_time", "end_time"), "mean_pan", "mean_tilt", "mean_roll", "mean_inlier_ratio")


@query("ag09_direction_histogram", f"""WITH {SCENE_SQL}, d AS (SELECT video_id, scene_id, pan,
    least(floor((atan2(sin(tilt), cos(tilt)) + pi()) / (2 * pi() / 24)), 23)::INT AS b FROM inside)
  SELECT s.video_id, s.scene_id, g.bin::INT AS bin, round(coalesce(sum(d.pan), 0.0), 4) + 0.0 AS weight
  FROM (SELECT DISTINCT video_id, scene_id FROM inside) s CROSS JOIN range(24) g(bin)
  LEFT JOIN d ON d.video_id = s.video_id AND d.scene_id = s.scene_id AND d.b = g.bin GROUP BY ALL""")
def direction_histogram(spark, sf):
    e = events(spark, sf)
    rows = sg.frames_to_intervals(e, intervals(e, longest(spark, sf))).withColumn("direction", F.atan2(F.sin("tilt"), F.cos("tilt")))
    h = m.direction_histogram(rows, ["video_id", "scene_id"], "direction", "pan")
    return h.withColumn("weight", F.round("weight", 4) + 0.0)


def gray_planes(spark, sf):
    pixel = lambda x: F.least(F.greatest(F.floor(x.cast("double") * 500 + 128), F.lit(0)), F.lit(255))
    hexed = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(pixel(x)), 2, "0")), "")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("h"),
                                                 F.lit(8).alias("w"), F.unhex(hexed).alias("plane"))


@query("ag16_frame_quality", """WITH px AS (SELECT vec_id AS frame_id, i // 8 AS y, i % 8 AS x,
    least(greatest(floor(embedding[i + 1]::DOUBLE * 500 + 128), 0), 255) AS g FROM embeddings, range(64) r(i)),
  lap AS (SELECT p.frame_id, p.y, p.x, p.g, sum(q.g - p.g) AS l FROM px p, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dy, dx), px q
    WHERE q.frame_id = p.frame_id AND q.y = CASE p.y + dy WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE p.y + dy END
      AND q.x = CASE p.x + dx WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE p.x + dx END GROUP BY ALL)
  SELECT frame_id, round(var_pop(l), 6) + 0.0 AS sharpness, round(avg(g), 6) + 0.0 AS mean_brightness,
    round(avg((g > 250)::INT) * 100, 6) + 0.0 AS highlight_clip_pct, round(avg((g < 5)::INT) * 100, 6) + 0.0 AS shadow_clip_pct FROM lap GROUP BY frame_id""")
def frame_quality(spark, sf):
    return rounded(m.frame_quality(gray_planes(spark, sf)), "sharpness", "mean_brightness", "highlight_clip_pct",
                   "shadow_clip_pct")


# Bands of each metric, upper limits excluded.
BANDS_SQL = {
    "sharpness": "CASE WHEN {0} < 500 THEN 'blurry' WHEN {0} < 2000 THEN 'soft' WHEN {0} < 5000 THEN 'good' WHEN {0} >= 5000 THEN 'excellent' END",
    "brightness": "CASE WHEN {0} < 50 THEN 'very dark' WHEN {0} < 100 THEN 'underexposed' WHEN {0} < 140 THEN 'well exposed' "
                  "WHEN {0} < 180 THEN 'bright' WHEN {0} >= 200 THEN 'overexposed' END",
    "highlight_clip": "CASE WHEN {0} < 0 THEN NULL WHEN {0} < 0.5 THEN 'excellent' WHEN {0} < 2 THEN 'acceptable' WHEN {0} < 5 THEN 'caution' "
                      "WHEN {0} >= 5 THEN 'reject' END",
    "shadow_clip": "CASE WHEN {0} < 0 THEN NULL WHEN {0} < 1 THEN 'very clean' WHEN {0} < 3 THEN 'normal' WHEN {0} < 8 THEN 'high contrast' "
                   "WHEN {0} >= 8 THEN 'underexposed' END",
    "flow_magnitude": "CASE WHEN {0} < 0 THEN NULL WHEN {0} < 2 THEN 'hovering' WHEN {0} < 10 THEN 'slow' WHEN {0} < 25 THEN 'active' "
                      "WHEN {0} < 60 THEN 'fast' WHEN {0} >= 60 THEN 'extreme' END",
    "flow_coherence": "CASE WHEN {0} < 0.2 THEN 'incoherent' WHEN {0} < 0.4 THEN 'chaotic' WHEN {0} < 0.65 THEN 'mixed' "
                      "WHEN {0} < 0.85 THEN 'mostly uniform' WHEN {0} >= 0.85 THEN 'pure translation' END",
}


def bands_sql(metric, value):
    return BANDS_SQL[metric].format(f"({value})")


BANDED = {"sharpness": "pan * 25", "brightness": "tilt * 2.5", "highlight_clip": "tilt / 12", "shadow_clip": "tilt / 10",
          "flow_magnitude": "pan", "flow_coherence": "tilt / 100"}


@query("sc29_quality_bands", f"""WITH {EVENTS_SQL} SELECT idx, {", ".join(f"{bands_sql(k, v)} AS {k}" for k, v in BANDED.items())} FROM ev""")
def quality_bands(spark, sf):
    return events(spark, sf).select("idx", *[m.quality_band(k, F.expr(v)).alias(k) for k, v in BANDED.items()])


@query("jn12_velocity_match", f"""WITH {SEGMENTS_SQL}, ref AS (SELECT source_video, pan_exit_vel AS a, tilt_exit_vel AS b, zoom_exit_vel AS c FROM (SELECT *,
     row_number() OVER (PARTITION BY source_video ORDER BY segment_id) AS rn FROM segs) WHERE rn = 1),
  n AS (SELECT segment_id, source_video, sqrt(a * a + b * b + c * c) AS na, sqrt(pan_entry_vel ** 2 + tilt_entry_vel ** 2 + zoom_entry_vel ** 2) AS nb,
     a * pan_entry_vel + b * tilt_entry_vel + c * zoom_entry_vel AS d FROM segs JOIN ref USING (source_video)),
  s AS (SELECT segment_id, source_video, CASE WHEN na * nb >= 1e-9 THEN d / (na * nb) END AS cs, CASE WHEN na >= 1e-9 AND nb >= 1e-9 THEN exp(-abs(ln(nb / na))) END AS mp FROM n)
  SELECT segment_id, round(cs, 6) + 0.0 AS cosine_sim, round(mp, 6) + 0.0 AS mag_penalty, round(cs * mp, 6) + 0.0 AS combined_score,
     row_number() OVER (PARTITION BY source_video ORDER BY round(cs * mp, 9) DESC NULLS LAST, segment_id) AS rank FROM s""")
def velocity_match(spark, sf):
    g = segments(spark, sf)
    out = F.struct(*[f"{c}_exit_vel" for c in VELOCITY_CHANNELS])
    ref = g.groupBy("source_video").agg(F.min_by(out, "segment_id").alias("r")).select("source_video", "r.*")
    rows = m.velocity_match(g, ref, ["source_video"])
    return rounded(rows.select("segment_id", "cosine_sim", "mag_penalty", "combined_score", "rank"),
                   "cosine_sim", "mag_penalty", "combined_score")


# segments by squared cost, movements inside each by absolute cost; a movement's key is made of both numbers
MOVES_SQL = f"""{SCALED_SQL}, two AS (SELECT * FROM scaled WHERE n >= 2), {ps.partition_sql('scene', 'two', ps.squared(CHANNELS), [3.0])},
  seg AS (SELECT video_id, start_pos AS s0, end_pos AS e0, row_number() OVER (PARTITION BY video_id ORDER BY start_pos) - 1 AS segment_idx FROM scene),
  part AS (SELECT t.* REPLACE (t.pos - s0 AS pos, e0 - s0 AS n), segment_idx, s0 FROM two t JOIN seg g ON g.video_id = t.video_id AND t.pos >= s0 AND t.pos < e0),
  {ps.partition_sql('cut', 'part', ps.absolute(CHANNELS), [2.0], ("video_id", "segment_idx"), min_rows=3)},
  inside AS (SELECT g.video_id, idx, "timestamp", pan, tilt, zoom, g.segment_idx,
      g.segment_idx * 100000 + dense_rank() OVER (PARTITION BY g.video_id, g.segment_idx ORDER BY c.start_pos) - 1 AS scene_id
    FROM cut c JOIN seg g ON g.video_id = c.video_id AND g.segment_idx = c.segment_idx
    JOIN sig s ON s.video_id = c.video_id AND s.pos >= s0 + c.start_pos AND s.pos < s0 + c.end_pos),
  extents AS (SELECT video_id, segment_idx, min("timestamp") AS "start", max("timestamp") AS "end", count(*) AS samples,
    substr(sha256(video_id || ':' || segment_idx), 1, 8) AS segment_id FROM inside GROUP BY video_id, segment_idx)"""
KEPT_SQL = """kept AS (SELECT video_id, segment_idx, scene_id, min("timestamp") AS start_time, max("timestamp") AS end_time
    FROM inside GROUP BY ALL HAVING count(*) >= 2)"""


@query("wn13_build_segments", f"""WITH RECURSIVE {MOVES_SQL}, {KEPT_SQL}, m AS (SELECT video_id, segment_idx, count(*) AS movements FROM kept GROUP BY ALL)
  SELECT e.*, movements FROM extents e LEFT JOIN m USING (video_id, segment_idx)""")
def build_segments(spark, sf):
    size = longest(spark, sf)
    prepared = segmentation.prepare(signal(spark, sf), longest=size)
    segs, moves = segmentation.build_segments(prepared, longest=size)
    return segs.join(moves.groupBy("video_id", "segment_idx").agg(F.count("*").alias("movements")),
                     ["video_id", "segment_idx"], "left")


@query("wn13_nested_documents", f"""WITH RECURSIVE {MOVES_SQL}, {KEPT_SQL}
  SELECT e.video_id, e.segment_idx, segment_id, count(scene_id) AS movements,
    string_agg(start_time::BIGINT || '-' || end_time::BIGINT, ' ' ORDER BY scene_id) AS spans
  FROM extents e LEFT JOIN kept k ON k.video_id = e.video_id AND k.segment_idx = e.segment_idx GROUP BY ALL""")
def nested_documents(spark, sf):
    size = longest(spark, sf)
    segs, moves = segmentation.build_segments(segmentation.prepare(signal(spark, sf), longest=size), longest=size)
    docs = segmentation.nest_movements(segs, moves)
    spans = F.transform("camera_movements", lambda x: F.concat_ws("-", *[
        F.bround(x[c]).cast("long").cast("string") for c in ("start_time", "end_time")]))
    return docs.select("video_id", "segment_idx", "segment_id", F.size("camera_movements").cast("long").alias("movements"),
                       F.nullif(F.array_join(spans, " "), F.lit("")).alias("spans"))


SUBSEGMENT_STEPS_SQL = f"""near AS (SELECT c.video_id, i.scene_id, c.pos, {", ".join(f"c.{x}" for x in CHANNELS)}
    FROM scaled c JOIN sig s ON s.video_id = c.video_id AND s.pos = c.pos JOIN intervals i ON i.video_id = c.video_id AND "timestamp" >= start_time AND "timestamp" < end_time),
  placed_in AS (SELECT * REPLACE (row_number() OVER v - 1 AS pos), pos AS at, count(*) OVER (PARTITION BY video_id, scene_id) AS n
    FROM near WINDOW v AS (PARTITION BY video_id, scene_id ORDER BY pos)),
  three AS (SELECT * FROM placed_in WHERE n >= 3),
  {ps.partition_sql('cut', 'three', ps.absolute(CHANNELS), [2.0], ("video_id", "scene_id"))},
  moved AS (SELECT video_id, scene_id, greatest(start_pos - 1, 0) AS a, end_pos - 1 AS b,
    row_number() OVER (PARTITION BY video_id, scene_id ORDER BY end_pos) - 1 AS subsegment_id FROM cut),
  inside AS (SELECT t.video_id, s.idx, s."timestamp", s.pan, s.tilt, s.zoom, t.scene_id * 100000 + subsegment_id AS scene_id
    FROM three t JOIN moved m ON m.video_id = t.video_id AND m.scene_id = t.scene_id AND t.pos >= a AND t.pos < b
    JOIN sig s ON s.video_id = t.video_id AND s.pos = t.at)"""
SUBSEGMENTS_SQL = f"{SCALED_SQL}, {EDGES_SQL}, {SUBSEGMENT_STEPS_SQL}"


@query("wn15_subsegments", f"""WITH RECURSIVE {interval_stats_sql('n // 10', extra=True, inside=SUBSEGMENTS_SQL)}, long AS ({" UNION ALL ".join(
    f"SELECT video_id, scene_id, '{c}' AS channel, {c}_mean_abs AS mean_abs, {c}_rms AS rms, {c}_entry_vel AS entry_vel, {c}_exit_vel AS exit_vel, "
    f"{c}_monotonicity AS monotonicity, {c}_mean_abs_deriv AS mean_abs_deriv, {c}_std_deriv AS std_deriv FROM stats" for c in VELOCITY_CHANNELS)})
  SELECT video_id, scene_id // 100000 AS scene_id, scene_id % 100000 AS subsegment_id, channel, {round_sql(["mean_abs", "rms", "monotonicity"])},
    {", ".join(f"round({c} * 3600, 5) + 0.0 AS {c}" for c in ("entry_vel", "exit_vel", "mean_abs_deriv", "std_deriv"))},
    round(CASE WHEN mean_abs_deriv > 1e-9 THEN std_deriv / mean_abs_deriv END, 5) + 0.0 AS cv FROM long""")
def subsegments(spark, sf):
    size = longest(spark, sf)
    prepared = segmentation.prepare(signal(spark, sf), longest=size)
    found = segmentation.subsegments(prepared, intervals(events(spark, sf), size), longest=size)
    return found.select("video_id", "scene_id", "subsegment_id", "channel", *[r6(c).alias(c) for c in ("mean_abs", "rms", "monotonicity")],
                        *[(F.round(F.col(c) * 3600, 5) + 0.0).alias(c) for c in ("entry_vel", "exit_vel", "mean_abs_deriv", "std_deriv")],
                        (F.round("cv", 5) + 0.0).alias("cv"))


@query("pl01_segment_videos", f"""WITH RECURSIVE {interval_stats_sql('ceil(n * 0.05)', inside=MOVES_SQL)}, {KEPT_SQL}
  SELECT e.*, scene_id % 100000 AS movement_idx, start_time, end_time, {", ".join(f"round({c} * 3600, 5) + 0.0 AS {c}" for c in SCALED)},
    {round_sql([f"{c}_monotonicity" for c in VELOCITY_CHANNELS])}
  FROM extents e LEFT JOIN (kept JOIN stats USING (video_id, scene_id)) k USING (video_id, segment_idx)""")
def segment_videos(spark, sf):
    found = segmentation.segment_videos(signal(spark, sf))
    return found.withColumns({c: F.round(F.col(c) * 3600, 5) + 0.0 for c in SCALED} | {
        f"{c}_monotonicity": r6(f"{c}_monotonicity") for c in VELOCITY_CHANNELS})


FIRST_SECOND = 1704067200.0
POSES_SQL = f"""{NUMBERED_SQL}, pose AS (SELECT video_id, "timestamp" - {FIRST_SECOND} AS "timestamp", pos, n, pan - 50 AS pan, tilt - 50 AS tilt,
    zoom AS roll, pan / 100 AS tx, tilt / 100 AS ty, zoom / 100 AS tz, tilt / 100 AS inlier_ratio FROM sig)"""


def filled_sql(columns) -> str:
    """``filled``: poses whose match ratio is too low replaced by a line between good neighbours."""
    lines = ", ".join(f"CASE WHEN g.ok OR goods < 2 THEN g.{c} WHEN p IS NULL THEN b.{c} WHEN q IS NULL THEN a.{c} "
                      f"ELSE a.{c} + (b.{c} - a.{c}) * ((g.pos - p) / (q - p)) END AS {c}" for c in columns)
    return f"""good AS (SELECT *, inlier_ratio >= 0.1 AS ok FROM pose),
  sides AS (SELECT *, sum(ok::INT) OVER (PARTITION BY video_id) AS goods, max(CASE WHEN ok THEN pos END) OVER (PARTITION BY video_id ORDER BY pos) AS p,
    min(CASE WHEN ok THEN pos END) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM good),
  filled AS (SELECT g.video_id, g.pos, g.n, {lines} FROM sides g LEFT JOIN pose a ON a.video_id = g.video_id AND a.pos = g.p
    LEFT JOIN pose b ON b.video_id = g.video_id AND b.pos = g.q)"""


@query("pl03_analyse_trajectory", f"""WITH RECURSIVE {POSES_SQL}, {filled_sql(trajectory.POSE_CHANNELS)},
  {ps.median_of_five('med', 'filled', trajectory.POSE_CHANNELS)}, clean AS ({ps.scaled('med', trajectory.POSE_CHANNELS)}),
  {ps.partition_sql('cut', 'clean', ps.absolute(trajectory.POSE_CHANNELS), [3.0], min_rows=4)},
  bounds AS (SELECT cut.video_id, "timestamp" AS "time" FROM cut JOIN pose s ON s.video_id = cut.video_id AND s.pos = end_pos - 1 WHERE end_pos < n),
  extent AS (SELECT video_id, 0.0::DOUBLE AS s, max("timestamp") AS e FROM pose GROUP BY video_id), {EDGE_STEPS_SQL},
  q AS (SELECT p.video_id, scene_id, any_value(start_time) AS s, any_value(end_time) AS e, count(*) AS frames, avg(pan) AS p, avg(tilt) AS t, avg(roll) AS r,
    avg(inlier_ratio) AS m FROM pose p JOIN intervals i ON i.video_id = p.video_id AND "timestamp" >= start_time AND "timestamp" < end_time GROUP BY ALL)
  SELECT video_id, scene_id, round(s, 6) + 0.0 AS start_time, round(e, 6) + 0.0 AS end_time, frames, round(p, 6) + 0.0 AS mean_pan, round(t, 6) + 0.0 AS mean_tilt,
    round(r, 6) + 0.0 AS mean_roll, round(m, 6) + 0.0 AS mean_inlier_ratio,
    CASE greatest(abs(p), abs(t), abs(r)) WHEN abs(p) THEN 'pan' WHEN abs(t) THEN 'tilt' ELSE 'roll' END AS dominant_axis FROM q""")
def analyse_trajectory(spark, sf):
    p = poses(spark, sf)
    shifted = p.withColumn("timestamp", F.col("timestamp") - FIRST_SECOND)
    durations = shifted.groupBy("video_id").agg(F.max("timestamp").alias("duration"))
    return rounded(trajectory.analyse_trajectory(shifted, durations), "start_time", "end_time", "mean_pan", "mean_tilt",
                   "mean_roll", "mean_inlier_ratio")


def scene_analysis(spark, sf):
    from kinolake.plans.scenes import analyse_scenes
    shift = lambda df: df.withColumn("timestamp", F.col("timestamp") - FIRST_SECOND)
    e = shift(events(spark, sf))
    v = table(spark, sf, "embeddings")
    vectors = e.select("video_id", "idx", "timestamp", (F.col("idx") % v.count()).alias("vec_id")).join(
        v.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")
    flow = flow_frames(e).join(e.select("idx", (F.col("zoom") / 10).alias("dominant_direction")), "idx")
    return analyse_scenes(e.drop("event_type"), quality_frames(e), flow, vectors)


# every sample has a vector, so a video ends at its last sample and vectors are numbered like samples
SCENES_SQL = f"""{SCALED_SQL}, {ps.partition_sql('big', 'scaled', ps.squared(CHANNELS), [3.0], min_rows=3)},
  bounds AS (SELECT big.video_id, "timestamp" AS "time" FROM big JOIN sig s ON s.video_id = big.video_id AND s.pos = end_pos - 1 WHERE end_pos < n),
  extent AS (SELECT video_id, {FIRST_SECOND}::DOUBLE AS s, max("timestamp") AS e FROM sig GROUP BY video_id), {EDGE_STEPS_SQL}"""


@query("pl02_analyse_scenes", f"""WITH RECURSIVE {SCENES_SQL}, {SUBSEGMENT_STEPS_SQL},
  subs AS (SELECT video_id, scene_id // 100000 AS scene_id, count(*) AS subsegments
    FROM (SELECT video_id, scene_id FROM inside GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
  held AS (SELECT sig.*, i.scene_id, start_time, end_time FROM sig JOIN intervals i
    ON i.video_id = sig.video_id AND "timestamp" >= start_time AND "timestamp" < end_time),
  ranges AS (SELECT video_id, scene_id, any_value(start_time) - {FIRST_SECOND} AS s, any_value(end_time) - {FIRST_SECOND} AS e, min(pos) AS emb_start,
    max(pos) + 1 AS emb_end, least(count(*), 3) AS keyframes FROM held GROUP BY ALL), {AVERAGE_STEPS_SQL.replace("FROM inside", "FROM held")}
  SELECT video_id, scene_id, round(s, 2) + 0.0 AS start_time, round(e, 2) + 0.0 AS end_time, round(e - s, 2) + 0.0 AS duration,
    round(sharp, 2) AS avg_sharpness, round(bright, 2) AS avg_brightness, CASE WHEN brisque <> 0 THEN round(brisque, 2) END AS avg_brisque,
    round(mag, 4) AS avg_flow_magnitude, round(coh, 4) AS avg_flow_coherence, round(q, 3) AS quality_score,
    row_number() OVER (PARTITION BY video_id ORDER BY round(q, 3) DESC, scene_id) AS rank, emb_start, emb_end, keyframes, subsegments
  FROM scored JOIN ranges USING (video_id, scene_id) LEFT JOIN subs USING (video_id, scene_id)""")
def analyse_scenes(spark, sf):
    a = scene_analysis(spark, sf)
    keys = ["video_id", "scene_id"]
    frames = a.keyframes.groupBy(*keys).agg(F.count("*").alias("keyframes"))
    subs = a.subsegments.groupBy(*keys).agg(F.count_distinct("subsegment_id").alias("subsegments"))
    return a.scenes.join(frames, keys, "left").join(subs, keys, "left")


@query("pl02_secondary_boundaries", f"""WITH RECURSIVE {NUMBERED_SQL},
  flow AS (SELECT video_id, "timestamp", sqrt(pan) AS m, sqrt(tilt) / 11 AS c, sin(zoom / 10) AS s, cos(zoom / 10) AS o,
    row_number() OVER (PARTITION BY video_id ORDER BY "timestamp", idx) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM ev WHERE event_type <> 'view'),
  turned AS (SELECT video_id, pos, n, [{", ".join(zero_range_sql(x) for x in "mcso")}] AS v FROM flow WINDOW v AS (PARTITION BY video_id)),
  {ps.partition_sql('cut', 'turned', ps.kernel('v'), [3.0], min_rows=3)},
  ser AS (SELECT video_id, pos, n, embedding::DOUBLE[] AS v FROM sig JOIN embeddings ON vec_id = idx % (SELECT count(*) FROM embeddings)),
  {SCORE_STEPS_SQL}, {PEAKS_SQL}
  SELECT cut.video_id, round("timestamp" - {FIRST_SECOND}, 6) + 0.0 AS "time", 'flow' AS kind FROM cut JOIN flow f ON f.video_id = cut.video_id AND f.pos = end_pos
  UNION ALL SELECT r.video_id, round("timestamp" - {FIRST_SECOND}, 6) + 0.0, 'embedding' FROM rise r JOIN sig s ON s.video_id = r.video_id AND s.pos = r.pos
    WHERE score - greatest(before, after) >= 0.05""")
def secondary_boundaries(spark, sf):
    a = scene_analysis(spark, sf)
    flow = a.flow_boundaries.select("video_id", "time", F.lit("flow").alias("kind"))
    return rounded(flow.unionByName(a.embedding_boundaries.select("video_id", "time", F.lit("embedding").alias("kind"))), "time")
