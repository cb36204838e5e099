"""Ordered timelines: boundaries between scenes, positions, totals, export items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions import scalars as s
from kinolake.functions import text as tx
from kinolake.operators import ordering as o
from kinolake.settings import EDITOR, VELOCITY_CHANNELS

# Seconds of a transition, and stitch actions that need none.
TRANSITION_SECONDS, PLAIN_ACTIONS = 0.5, ("cut", "accept", "")


def scene_boundaries(scenes: DataFrame, velocities: DataFrame, project: str = "project",
                     threshold: float = EDITOR.stitching_threshold, settings=EDITOR) -> DataFrame:
    """Each scene with the following one: last link against first link, cost and flag.

    ``scenes``: project, scene_id, scene_pos, ``links`` (array with segment_id). Pairs in
    which a scene has no links are skipped. Unknown segments stand still.
    """
    ends = scenes.select(project, "scene_id", "scene_pos",
                         F.try_element_at("links", F.lit(1))["segment_id"].alias("_first"),
                         F.try_element_at("links", F.lit(-1))["segment_id"].alias("_last"))
    rows = o.number_rows(ends, [project], ["scene_pos"], o.id_bucket(F.col("scene_pos")))
    rows, w = o.neighbourhood(rows, [project], 0, 1)
    pairs = o.own_rows(rows.withColumns({"scene_id_b": F.lead("scene_id").over(w), "segment_id_b": F.lead("_first").over(w)}))
    pairs = pairs.filter("_last IS NOT NULL AND segment_id_b IS NOT NULL").select(
        project, F.col("scene_id").alias("scene_id_a"), "scene_id_b", F.col("_last").alias("segment_id_a"), "segment_id_b")
    out = velocities.select(F.col("segment_id").alias("segment_id_a"), *[f"{c}_exit_vel" for c in VELOCITY_CHANNELS])
    into = velocities.select(F.col("segment_id").alias("segment_id_b"), *[f"{c}_entry_vel" for c in VELOCITY_CHANNELS])
    rows = pairs.join(out, "segment_id_a", "left").join(into, "segment_id_b", "left")
    cost = s.kinematic_cost([F.coalesce(f"{c}_exit_vel", F.lit(0.0)) for c in VELOCITY_CHANNELS],
                            [F.coalesce(f"{c}_entry_vel", F.lit(0.0)) for c in VELOCITY_CHANNELS], settings.w1, settings.w2)
    rows = rows.withColumn("kinematic_cost", cost).withColumn("flagged", F.col("kinematic_cost") > threshold)
    return rows.select(project, "scene_id_a", "scene_id_b", "segment_id_a", "segment_id_b", "kinematic_cost", "flagged")


def swap_candidates(boundaries: DataFrame, candidates: DataFrame, velocities: DataFrame, count: int = 3,
                    settings=EDITOR) -> DataFrame:
    """For each boundary the cheapest other entries of the incoming scene that lower its cost.

    ``candidates``: project, scene_id, segment_id, ``rank`` (bounded pool of the scene).
    """
    out = velocities.select(F.col("segment_id").alias("segment_id_a"), *[f"{c}_exit_vel" for c in VELOCITY_CHANNELS])
    into = velocities.select("segment_id", *[f"{c}_entry_vel" for c in VELOCITY_CHANNELS])
    pool = candidates.select("project", F.col("scene_id").alias("scene_id_b"), "segment_id", "rank").join(into, "segment_id")
    rows = boundaries.join(out, "segment_id_a").join(pool, ["project", "scene_id_b"]).filter(F.col("segment_id") != F.col("segment_id_b"))
    cost = s.kinematic_cost([F.col(f"{c}_exit_vel") for c in VELOCITY_CHANNELS],
                            [F.col(f"{c}_entry_vel") for c in VELOCITY_CHANNELS], settings.w1, settings.w2)
    rows = rows.withColumn("swap_cost", cost).filter(F.col("swap_cost") < F.col("kinematic_cost"))
    w = Window.partitionBy("project", "scene_id_a", "scene_id_b").orderBy(F.round("swap_cost", 9), "rank")
    return (rows.withColumn("swap_no", F.row_number().over(w)).filter(F.col("swap_no") <= count)
            .select("project", "scene_id_a", "scene_id_b", "segment_id", "swap_cost", "swap_no"))


def resolve_sources(entries: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Entries with the path and URI of their source; unknown sources use the file name.

    ``manifest``: video_hash, original_path, storage_key. Keyed files lie under ``root``.
    """
    key = F.col("storage_key")
    path = F.when(key.isNotNull(), F.concat(F.lit(root.rstrip("/") + "/"), key)).otherwise(F.col("original_path"))
    known = manifest.select(F.col("video_hash").alias("source_video"), tx.file_uri(path).alias("_uri"))
    return entries.join(known, "source_video", "left").withColumn(
        "source", F.coalesce("_uri", F.col("video_file"))).drop("_uri")


def stitch_actions(entries: DataFrame, boundaries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries with the action at their start, from decisions keyed by project and scene pair."""
    keyed = boundaries.join(decisions, ["project", "scene_id_a", "scene_id_b"]).select(
        "project", F.col("scene_id_b").alias("scene_id"), F.col("segment_id_b").alias("segment_id"), "action", "transition_type")
    return entries.join(keyed, ["project", "scene_id", "segment_id"], "left").withColumn(
        "stitch_action", s.stitch_action(F.col("action"), F.col("transition_type"))).drop("action", "transition_type")


def positions(entries: DataFrame, order: list[str], project: str = "project", bucket: Column | None = None,
              longest: int | None = None) -> DataFrame:
    """One-based running position of each entry in its project."""
    bucket = o.id_bucket(F.col(order[0])) if bucket is None else bucket
    rows = o.number_rows(entries, [project], order, bucket, "position", None, longest)
    return rows.withColumn("position", F.col("position") + 1)


def global_offsets(entries: DataFrame, project: str = "project", longest: int | None = None) -> DataFrame:
    """Start of each positioned entry in the whole timeline, and the timeline's length."""
    return o.running_total(entries, [project], ["position"], o.id_bucket(F.col("position")),
                           {"offset": F.col("duration")}, {"offset": "total_duration"}, longest)


def timeline_totals(scenes: DataFrame, entries: DataFrame, project: str = "project") -> DataFrame:
    """Duration and number of entries per scene; scenes without a chain stay with zeros."""
    sums = entries.groupBy(project, "scene_id").agg(
        F.sum("duration").alias("total_duration"), F.count(F.lit(1)).alias("segments"))
    rows = scenes.select(project, "scene_id").join(sums, [project, "scene_id"], "left")
    return rows.fillna({"total_duration": 0.0, "segments": 0})


def project_totals(scene_totals: DataFrame, project: str = "project") -> DataFrame:
    return scene_totals.groupBy(project).agg(
        F.sum("total_duration").alias("total_duration"), F.sum("segments").alias("total_segments"),
        F.count(F.lit(1)).alias("scenes"))


def playheads(entries: DataFrame, at: Column, project: str = "project", longest: int | None = None) -> DataFrame:
    """Global second and percentage of a playback time inside each entry."""
    rows = global_offsets(entries, project, longest)
    second, percent = s.playhead(F.col("offset"), at, F.col("start"), F.col("total_duration"))
    return rows.withColumns({"global_second": second, "percent": percent})


def export_items(entries: DataFrame, rate: float, project: str = "project", longest: int | None = None) -> DataFrame:
    """Track items of positioned entries: clips, transitions into clips, and scene markers.

    ``sort_key`` orders the items of a project; a transition precedes its clip.
    """
    rows = global_offsets(entries, project, longest)
    frames = lambda c: s.rational_time(c, rate)
    none = F.lit(None).cast("long")
    clips = rows.select(
        project, F.lit("clip").alias("kind"), (F.col("position") * 3 + 1).alias("sort_key"),
        F.col("segment_id").cast("string").alias("name"), "scene_id", frames(F.col("start")).alias("start_frame"),
        frames(F.col("end") - F.col("start")).alias("duration_frames"), "source")
    half = F.lit(round(TRANSITION_SECONDS / 2 * rate)).cast("long")
    into = rows.filter((F.col("position") > 1) & ~F.col("stitch_action").isin(*PLAIN_ACTIONS))
    transitions = into.select(
        project, F.lit("transition").alias("kind"), (F.col("position") * 3).alias("sort_key"),
        F.col("stitch_action").alias("name"), "scene_id", half.alias("start_frame"), half.alias("duration_frames"),
        F.lit(None).cast("string").alias("source"))
    first = rows.groupBy(project, "scene_id").agg(F.min_by(F.struct("position", "offset"), "position").alias("_f"))
    markers = first.select(
        project, F.lit("marker").alias("kind"), (F.col("_f.position") * 3 - 1).alias("sort_key"),
        F.concat(F.lit("Scene "), F.col("scene_id").cast("string")).alias("name"), "scene_id",
        frames(F.col("_f.offset")).alias("start_frame"), F.lit(0).cast("long").alias("duration_frames"),
        F.lit(None).cast("string").alias("source"))
    return clips.unionByName(transitions).unionByName(markers)
