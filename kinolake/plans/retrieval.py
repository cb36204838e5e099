"""Candidate pools: retrieval, contested segments, gap filling and the gap report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from kinolake.operators import retrieve as rt
from kinolake.session import cut_lineage
from kinolake.settings import EDITOR


@dataclass
class CandidatePools:
    candidates: DataFrame
    pools: DataFrame
    gaps: DataFrame


def candidate_pools(scenes: DataFrame, segments: DataFrame, settings=EDITOR, project: str = "project",
                    depth: int | None = None) -> CandidatePools:
    """Pools of each scene after every segment went to the scene that scores it highest.

    The retrieved candidates (at most k per scene) feed four steps, so they are written
    once to the checkpoint folder instead of being scored again.
    """
    candidates = cut_lineage(rt.retrieve_candidates(scenes, segments, project, settings.alpha,
                                                    settings.candidates_per_scene))
    deduped = rt.resolve_contested(candidates, project)
    added = rt.fill_gaps(deduped, scenes, segments, settings.min_candidates, project, settings.alpha, depth)
    pools = deduped.unionByName(added.select(*deduped.columns))
    gaps = rt.gap_report(scenes, pools, settings.min_candidates, project, after_fill=True)
    return CandidatePools(candidates, pools, gaps)
