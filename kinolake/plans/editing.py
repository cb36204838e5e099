"""Editing: assignments to chains, selected chains to a stitched timeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.operators import assemble as a
from kinolake.operators import timeline as tl
from kinolake.operators.describe import rating_or_good
from kinolake.settings import EDITOR
from kinolake.sources.writers import save_versioned


def assemble(scenes: DataFrame, assignments: DataFrame, segments: DataFrame, targets: DataFrame,
             selections: DataFrame, settings=EDITOR, flagged: DataFrame | None = None) -> DataFrame:
    """Scenes with their selected chain; scenes without a chain keep null links.

    Boundaries, entries and totals all start from the result: a caller that asks for several keeps it with ``write_once``.
    """
    chains = a.find_chains(a.only_scenes(assignments, flagged), segments, targets, settings)
    return a.selected_chain(a.only_scenes(scenes, flagged), chains, selections)


@dataclass
class Timeline:
    entries: DataFrame
    boundaries: DataFrame
    scenes: DataFrame

    def save(self, folder: str) -> int:
        """Store the entries as the next version."""
        return save_versioned(self.entries, folder)


def build_timeline(selected: DataFrame, segments: DataFrame, decisions: DataFrame, settings=EDITOR) -> Timeline:
    """Timeline of the selected chains: boundaries, stitch actions, positions and totals.

    ``selected``: project, scene_id, scene_pos, links, total_cost. ``decisions``: project,
    scene_id_a, scene_id_b, action, transition_type. With ``skip_stitching`` every entry is a cut.
    """
    entries = selected.select("project", "scene_id", "scene_pos", F.posexplode("links").alias("link_pos", "_l")).select(
        "project", "scene_id", "scene_pos", "link_pos", "_l.*")
    entries = entries.withColumn("duration", F.col("end") - F.col("start"))
    facts = segments.select("segment_id", "source_video", rating_or_good(F.col("rating")).alias("quality_rating"))
    entries = entries.join(facts, "segment_id", "left")
    boundaries = tl.scene_boundaries(selected, segments, threshold=settings.stitching_threshold, settings=settings)
    if settings.skip_stitching:
        boundaries = boundaries.limit(0)
        entries = entries.withColumn("stitch_action", F.lit("cut"))
    else:
        flagged = boundaries.filter("flagged")
        entries = tl.stitch_actions(entries, flagged, decisions)
    entries = tl.positions(entries, ["scene_pos", "link_pos"])
    return Timeline(entries, boundaries, tl.timeline_totals(selected, entries))
