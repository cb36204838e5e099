"""Camera-trajectory analysis: poses to trajectory segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.operators import changepoints as cp
from kinolake.operators import motion as m
from kinolake.operators import ordering as o
from kinolake.operators import signal as sg

# Pose channels in order, and the least usable share of matched points.
POSE_CHANNELS = ("pan", "tilt", "roll", "tx", "ty", "tz")
MIN_INLIER_RATIO = 0.1


def trajectory_boundaries(poses: DataFrame, channels: Sequence[str] = POSE_CHANNELS,
                          penalty: float = 3.0, longest: int | None = None) -> DataFrame:
    """Inner boundary times of numbered poses: spike filter, scaling, absolute-cost partition."""
    clean = sg.minmax(sg.median_filter(poses, channels, longest=longest), channels, longest=longest)
    ends = cp.change_points(clean, ["video_id"], channels, "l1", penalty, min_rows=4, longest=longest)
    return sg.boundaries_to_times(ends, poses, "before")


def analyse_trajectory(poses: DataFrame, durations: DataFrame, penalty: float = 3.0) -> DataFrame:
    """Trajectory segments with mean rotation; poses without a match are interpolated first.

    ``durations`` has ``video_id`` and ``duration``. Means use the interpolated series only
    for boundaries; the reported means come from the poses as given.
    """
    longest = o.longest_series(poses, ["video_id"])
    rows = sg.numbered(poses, longest=longest)
    filled = sg.interpolate_bad(rows, POSE_CHANNELS, F.col("inlier_ratio") < MIN_INLIER_RATIO, longest=longest)
    bounds = trajectory_boundaries(filled, POSE_CHANNELS, penalty, longest)
    extent = durations.select("video_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    segments = sg.scene_edges(bounds.select("video_id", "time"), extent, longest=longest)
    return m.trajectory_segment_means(rows, segments)
