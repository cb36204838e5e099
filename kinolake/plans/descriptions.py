"""From raw model responses to described segments, the stamped manifest and the readiness of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolake.operators import catalog as c
from kinolake.operators import describe as d


def ingest_descriptions(responses: DataFrame, segments: DataFrame, manifest: DataFrame, schema: str, required: str,
                        completed_at: Column, config_hash: Column, step: str = "described",
                        longest: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Described segments, rejected responses, the manifest with finished videos stamped, and readiness per project.

    ``responses``: segment_id, seq, response; ``segments``: project, video_hash, segment_id. A video is
    finished when each of its segments has an accepted description; a project is ready when all of
    its videos are. Responses to unknown segments are dropped.
    """
    accepted, rejected = d.ingest_responses(responses, schema, required)
    described = d.combined_view(segments, accepted.select("segment_id", "seq", "parsed"), longest=longest)
    finished = (described.groupBy("project", "video_hash").agg(F.every(F.col("seq").isNotNull()).alias("_all"))
                .filter("_all").select("project", "video_hash", completed_at.alias("completed_at"),
                                       config_hash.alias("new_hash")))
    stamped = c.mark_complete(manifest, finished, step)
    ready = c.all_described(stamped, "project", F.try_element_at("processing", F.lit(step)))
    return described, rejected, stamped, ready
