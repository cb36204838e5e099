"""Motion and quality statistics per frame, per interval and per segment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions import scalars as s
from kinolake.functions.vectors import norm
from kinolake.operators import ordering as o
from kinolake.operators import signal as sg
from kinolake.settings import SIGNAL_CHANNELS, VELOCITY_CHANNELS

# -- per frame ------------------------------------------------------------


def frame_metrics(df: DataFrame, fitted: Column, keys: Sequence[str] = ("pan", "tilt", "roll", "zoom", "scene_activity"),
                  magnitude: str = "flow_magnitude", coherence: str = "flow_coherence") -> DataFrame:
    """Metric map per frame; the motion entries exist only when the motion fit does."""
    base = F.create_map(F.lit("flow_magnitude"), F.col(magnitude), F.lit("flow_coherence"), F.col(coherence))
    motion = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))])
    return df.withColumn("metrics", F.when(fitted, F.map_concat(base, motion)).otherwise(base))


def metrics_pivot(df: DataFrame, names: Sequence[str] = ("pan", "tilt", "zoom", "flow_magnitude"),
                  required: Sequence[str] = ("pan", "tilt", "zoom")) -> DataFrame:
    """Metric map as columns, without rows that lack a required metric."""
    wide = df.withColumns({k: F.try_element_at("metrics", F.lit(k)) for k in names})
    return wide.dropna(subset=list(required)).drop("metrics")


def flow_statistics(vectors: DataFrame, keys: Sequence[str], dx: str = "dx", dy: str = "dy") -> DataFrame:
    """Mean magnitude, circular mean direction and coherence of a frame's flow vectors."""
    angle = F.atan2(F.col(dy), F.col(dx))
    means = vectors.groupBy(*keys).agg(
        F.avg(norm([F.col(dx), F.col(dy)])).alias("mean_magnitude"),
        F.avg(F.cos(angle)).alias("_c"), F.avg(F.sin(angle)).alias("_s"))
    return means.select(*keys, "mean_magnitude", F.atan2("_s", "_c").alias("dominant_direction"),
                        F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")).alias("coherence"))


def camera_motion_residual(vectors: DataFrame, keys: Sequence[str], matrix: str = "matrix",
                           inlier: str = "inlier") -> DataFrame:
    """Flow explained by a row-major 3x3 matrix, and what remains, per frame."""
    h = [F.element_at(matrix, i) for i in range(1, 10)]
    x, y = F.col("x"), F.col("y")
    scale = h[6] * x + h[7] * y + h[8]
    cx = (h[0] * x + h[1] * y + h[2]) / scale - x
    cy = (h[3] * x + h[4] * y + h[5]) / scale - y
    rest = [F.col("dx") - cx, F.col("dy") - cy]
    return vectors.groupBy(*keys).agg(
        F.avg(norm([cx, cy])).alias("camera_magnitude"), F.avg(norm(rest)).alias("scene_activity"),
        (1.0 - F.avg(F.col(inlier).cast("double"))).alias("moving_object_ratio"))


def frame_quality(frames: DataFrame) -> DataFrame:
    """Sharpness, brightness and clipping of gray planes (``frame_id, h, w, plane``).

    Planes stream through in Arrow batches; borders are mirrored without the edge pixel.
    """
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for frame_id, h, w, plane in batch[["frame_id", "h", "w", "plane"]].itertuples(index=False):
                gray = np.frombuffer(plane, dtype=np.uint8).reshape(h, w).astype(np.float64)
                p = np.pad(gray, 1, mode="reflect")
                edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray
                out.append((frame_id, edges.var(), gray.mean(),
                            (gray > 250).mean() * 100, (gray < 5).mean() * 100))
            yield pd.DataFrame(out, columns=["frame_id", "sharpness", "mean_brightness",
                                             "highlight_clip_pct", "shadow_clip_pct"])
    schema = ("frame_id long, sharpness double, mean_brightness double, "
              "highlight_clip_pct double, shadow_clip_pct double")
    return frames.select("frame_id", "h", "w", "plane").mapInPandas(measure, schema)


# Interpretation bands [low, high) per metric.
QUALITY_BANDS = {
    "sharpness": [(None, 500, "blurry"), (500, 2000, "soft"), (2000, 5000, "good"), (5000, None, "excellent")],
    "brightness": [(None, 50, "very dark"), (50, 100, "underexposed"), (100, 140, "well exposed"),
                   (140, 180, "bright"), (200, None, "overexposed")],
    "highlight_clip": [(0, 0.5, "excellent"), (0.5, 2, "acceptable"), (2, 5, "caution"), (5, None, "reject")],
    "shadow_clip": [(0, 1, "very clean"), (1, 3, "normal"), (3, 8, "high contrast"), (8, None, "underexposed")],
    "flow_magnitude": [(0, 2, "hovering"), (2, 10, "slow"), (10, 25, "active"), (25, 60, "fast"),
                       (60, None, "extreme")],
    "flow_coherence": [(None, 0.2, "incoherent"), (0.2, 0.4, "chaotic"), (0.4, 0.65, "mixed"),
                       (0.65, 0.85, "mostly uniform"), (0.85, None, "pure translation")],
}


def quality_band(metric: str, value: Column) -> Column:
    """Label of the band that holds the value; null between bands."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(QUALITY_BANDS[metric]):
        inside = F.lit(True)
        inside = inside & (value >= low) if low is not None else inside
        inside = inside & (value < high) if high is not None else inside
        label = F.when(inside, F.lit(name)).otherwise(label)
    return label


# -- per interval ---------------------------------------------------------

def edge_rows_movement(n: Column) -> Column:
    """First or last 5 %, rounded up."""
    return F.greatest(F.lit(1), F.ceil(n * 0.05))


def edge_rows_channel(n: Column) -> Column:
    """First or last tenth, rounded down."""
    return F.greatest(F.lit(1), F.floor(n / 10))


def interval_motion(rows: DataFrame, keys: Sequence[str], columns: Sequence[str] = VELOCITY_CHANNELS,
                    edge_rows: Callable[[Column], Column] = edge_rows_movement,
                    longest: int | None = None) -> DataFrame:
    """Motion statistics of numbered intervals of at least two samples.

    Per channel: entry and exit velocity, monotonicity, mean absolute derivative and its
    standard deviation, mean absolute value and root mean square; plus the time span.
    ``pos`` and ``n`` count inside the interval. Changes are aggregated before they are
    divided by the interval's median time step, and ranks are summed over distinct values,
    so rows cross the network once for their neighbours and are reduced from then on.
    """
    keys = list(keys)
    changes = sg.difference(rows.filter("n >= 2"), columns, keys, longest=longest)
    small = o.fits_one_task(longest)
    if small:  # ranks by windows: no second pass over the rows
        series = Window.partitionBy(*keys)
        def average_rank(c: str) -> Column:
            ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
            return F.rank().over(series.orderBy(c)) + (ties - 1) / 2.0 - 1.0
        changes = changes.withColumns({f"_rank_{c}": average_rank(c) for c in columns})
    edge = edge_rows(F.col("n"))
    first, last = F.col("pos") < edge, F.col("pos") >= F.col("n") - edge
    aggregates = [F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
                  F.max("n").alias("samples")]
    for c in columns:
        d = F.col(f"d_{c}")
        aggregates += [
            F.avg(F.when(first, d)).alias(f"{c}_entry_vel"), F.avg(F.when(last, d)).alias(f"{c}_exit_vel"),
            F.avg(F.abs(d)).alias(f"{c}_mean_abs_deriv"), F.stddev_pop(d).alias(f"{c}_std_deriv"),
            F.avg(F.abs(F.col(c))).alias(f"{c}_mean_abs"),
            F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"{c}_rms")]
    if small:
        aggregates += [F.max("n").alias("_n"), F.median("step").alias("_dt")]
        for c in columns:
            r = F.col(f"_rank_{c}")
            aggregates += [F.sum(r * F.col("pos")).alias(f"_xy_{c}"), F.sum(r * r).alias(f"_yy_{c}")]
    moments = changes.groupBy(*keys).agg(*aggregates)
    if small:
        return _finish_motion(moments, keys, columns)

    entries = [F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in columns]
    entries.append(F.when(F.col("step").isNotNull(), F.struct(F.lit("step").alias("channel"), F.col("step").alias("value"))))
    long = changes.select(*keys, "pos", F.explode(F.array_compact(F.array(*entries))).alias("e"))
    groups = o.rank_groups(long.select(*keys, "pos", "e.channel", "e.value"), [*keys, "channel"], "value",
                           [F.sum("pos").alias("pos_sum")])
    rank = F.col("before") + (F.col("cnt") - 1) / 2.0
    is_step = F.col("channel") == "step"
    sums = [F.max(F.when(~is_step, F.col("total"))).alias("_n")]
    for c in columns:
        here = F.col("channel") == c
        sums += [F.sum(F.when(here, rank * F.col("pos_sum"))).alias(f"_xy_{c}"),
                 F.sum(F.when(here, rank * rank * F.col("cnt"))).alias(f"_yy_{c}")]
    step_groups = F.when(is_step, F.col("value"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    def at(place: Column) -> Column:
        hit = (F.col("before") <= place) & (place < F.col("before") + F.col("cnt"))
        return F.max(F.when(hit, step_groups))
    sums.append(((at(low) + at(high)) / 2.0).alias("_dt"))
    ranks = groups.groupBy(*keys).agg(*sums)

    return _finish_motion(moments.join(ranks, keys), keys, columns)


def _finish_motion(sums: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    n = F.col("_n").cast("double")
    mean, xx = (n - 1) / 2, n * (n * n - 1) / 12
    out = []
    for c in columns:
        cov, var = F.col(f"_xy_{c}") - n * mean * mean, F.col(f"_yy_{c}") - n * mean * mean
        out += [F.try_divide(F.col(f"{c}_{m}"), F.col("_dt")).alias(f"{c}_{m}")
                for m in ("entry_vel", "exit_vel", "mean_abs_deriv", "std_deriv")]
        out.append(F.when((n > 2) & (var > 1e-9), cov / F.sqrt(xx * var)).otherwise(F.lit(0.0))
                   .alias(f"{c}_monotonicity"))
        out += [F.col(f"{c}_mean_abs"), F.col(f"{c}_rms")]
    return sums.select(*keys, "start_time", "end_time", "samples", *out)


def channel_metrics(rows: DataFrame, keys: Sequence[str], columns: Sequence[str] = VELOCITY_CHANNELS,
                    longest: int | None = None) -> DataFrame:
    """Seven metrics per interval and channel in long form, with the variability ratio ``cv``."""
    wide = interval_motion(rows, keys, columns, edge_rows_channel, longest)
    names = ("mean_abs", "rms", "entry_vel", "exit_vel", "monotonicity", "mean_abs_deriv", "std_deriv")
    per_channel = F.array(*[F.struct(F.lit(c).alias("channel"), *[F.col(f"{c}_{m}").alias(m) for m in names])
                            for c in columns])
    long = wide.select(*keys, F.inline(per_channel))
    return long.withColumn("cv", F.when(F.col("mean_abs_deriv") > 1e-9,
                                        F.col("std_deriv") / F.col("mean_abs_deriv")))


def cross_channel(rows: DataFrame, keys: Sequence[str], columns: Sequence[str] = SIGNAL_CHANNELS) -> DataFrame:
    """Channel with the highest root mean square, and the pan-tilt correlation."""
    squares = [F.avg(F.col(c) * F.col(c)) for c in columns]
    stats = rows.groupBy(*keys).agg(*[q.alias(f"_q{i}") for i, q in enumerate(squares)],
                                    F.covar_pop("pan", "tilt").alias("_cov"),
                                    (F.stddev_pop("pan") * F.stddev_pop("tilt")).alias("_dev"),
                                    F.count(F.lit(1)).alias("samples"))
    top = F.greatest(*[F.col(f"_q{i}") for i in range(len(columns))])
    name = F.coalesce(*[F.when(F.col(f"_q{i}") == top, F.lit(c)) for i, c in enumerate(columns)])
    return stats.select(*keys, name.alias("dominant_axis"),
                        F.when(F.col("samples") > 2, F.try_divide("_cov", "_dev")).alias("pan_tilt_corr"))


def scene_averages(quality: DataFrame, flow: DataFrame, scenes: DataFrame) -> DataFrame:
    """Mean quality and flow metrics of each scene that holds quality samples.

    A mean quality-model score of exactly 0 is reported as null.
    """
    keys = ["video_id", "scene_id"]
    q = sg.frames_to_intervals(quality, scenes).groupBy(*keys).agg(
        F.first("start_time").alias("start_time"), F.first("end_time").alias("end_time"),
        F.avg("sharpness").alias("_sharp"), F.avg("mean_brightness").alias("_bright"),
        F.avg("brisque").alias("_brisque"),
        F.avg(F.col("highlight_clip_pct") + F.col("shadow_clip_pct")).alias("_clip"))
    f = sg.frames_to_intervals(flow, scenes).groupBy(*keys).agg(
        F.avg("mean_magnitude").alias("_mag"), F.avg("coherence").alias("_coh"))
    both = q.join(f, keys, "left")
    coherence = F.coalesce("_coh", F.lit(0.0))
    return both.select(
        *keys, "start_time", "end_time",
        F.round("_sharp", 2).alias("avg_sharpness"), F.round("_bright", 2).alias("avg_brightness"),
        F.when(F.col("_brisque") != 0, F.round("_brisque", 2)).alias("avg_brisque"),
        F.round(F.coalesce("_mag", F.lit(0.0)), 4).alias("avg_flow_magnitude"),
        F.round(coherence, 4).alias("avg_flow_coherence"),
        F.round(composite_quality(F.col("_sharp"), F.col("_bright"), F.col("_clip"), coherence,
                                  F.col("_brisque")), 3).alias("quality_score"))


def composite_quality(sharpness: Column, brightness: Column, clipping: Column, coherence: Column,
                      brisque: Column) -> Column:
    """Weighted score in [0, 1]; without a model score its weight moves to sharpness."""
    # Weights .3/.2/.2/.3 (.5/.2/.2 without a model score), scales 1500, 127, 10, 80.
    sharp = F.least(F.log1p(sharpness) / F.log1p(F.lit(1500.0)), F.lit(1.0))
    exposure = F.greatest(1.0 - F.abs(brightness - 127) / 127 - F.least(clipping / 10.0, F.lit(1.0)), F.lit(0.0))
    model = F.greatest(1.0 - brisque / 80.0, F.lit(0.0))
    score = (F.when(brisque.isNull(), (sharp * 0.5 + exposure * 0.2 + coherence * 0.2) / 0.9)
             .otherwise(sharp * 0.3 + exposure * 0.2 + coherence * 0.2 + model * 0.3))
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def rank_scenes(scenes: DataFrame, score: str = "quality_score", keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """One-based rank by descending quality, earlier scenes first among equals."""
    down = scenes.withColumn("_down", -F.col(score))
    ranked = o.number_rows(down, keys, ["_down", "scene_id"], o.value_bucket(F.col("_down")), "rank", None)
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_down")


def trajectory_segment_means(poses: DataFrame, segments: DataFrame) -> DataFrame:
    """Count, mean rotations, mean match ratio and dominant rotation axis per segment."""
    rows = sg.frames_to_intervals(poses, segments)
    means = rows.groupBy("video_id", "scene_id").agg(
        F.first("start_time").alias("start_time"), F.first("end_time").alias("end_time"),
        F.count(F.lit(1)).alias("frames"), *[F.avg(c).alias(f"mean_{c}") for c in ("pan", "tilt", "roll")],
        F.coalesce(F.avg("inlier_ratio"), F.lit(0.0)).alias("mean_inlier_ratio"))
    sizes = {c: F.abs(F.col(f"mean_{c}")) for c in ("pan", "tilt", "roll")}
    top = F.greatest(*sizes.values())
    return means.withColumn("dominant_axis", F.coalesce(*[F.when(v == top, F.lit(c)) for c, v in sizes.items()]))


def direction_histogram(flow: DataFrame, keys: Sequence[str], direction: str, magnitude: str,
                        bins: int = 24) -> DataFrame:
    """Magnitude per equal direction bin on [-pi, pi]; empty bins of a scene are kept."""
    width = 2 * np.pi / bins
    place = F.least(F.floor((F.col(direction) + np.pi) / width), F.lit(bins - 1)).cast("int")
    sums = flow.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(place == b, F.col(magnitude))), F.lit(0.0)).alias(f"_b{b}") for b in range(bins)])
    return sums.select(*keys, F.posexplode(F.array(*[F.col(f"_b{b}") for b in range(bins)])).alias("bin", "weight"))


# -- per segment ----------------------------------------------------------

def velocity_match(segments: DataFrame, reference: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Segments scored by how their entry velocity continues the reference exit velocity.

    ``reference`` has one row per series with ``*_exit_vel``. ``rank`` counts from 1 for the best
    score (rounded to nine places, ties by segment id); null scores come last.
    """
    ref = reference.select(*keys, *[F.col(f"{c}_exit_vel").alias(f"_ref_{c}") for c in VELOCITY_CHANNELS])
    rows = segments.join(ref, list(keys), "left")
    a = [F.col(f"_ref_{c}") for c in VELOCITY_CHANNELS]
    b = [F.col(f"{c}_entry_vel") for c in VELOCITY_CHANNELS]
    rows = rows.withColumns({"cosine_sim": s.velocity_cosine(a, b), "mag_penalty": s.magnitude_penalty(a, b)})
    rows = rows.withColumn("combined_score", F.col("cosine_sim") * F.col("mag_penalty"))
    rows = rows.withColumn("_down", F.coalesce(-F.round("combined_score", 9), F.lit(1e9)))
    ranked = o.number_rows(rows, keys, ["_down", "segment_id"], o.value_bucket(F.col("_down")), "rank", None)
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_down", *[f"_ref_{c}" for c in VELOCITY_CHANNELS])
