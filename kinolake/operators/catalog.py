"""Projects, manifests and versions: what exists, what is done, what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions import scalars as s
from kinolake.functions import text as tx


def pending(items: DataFrame, done: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Items that lack outputs, or all of them when forced."""
    return items if force else items.join(done.select(*keys), list(keys), "left_anti")


def step_is_current(manifest: DataFrame, step: str, config_hash: Column, per_step: bool = False) -> Column:
    """Condition: the step completed under the given configuration.

    The manifest keeps one configuration per video, overwritten by any step;
    ``per_step`` uses the map ``step_hashes`` instead.
    """
    stored = F.try_element_at("step_hashes", F.lit(step)) if per_step else F.col("config_hash")
    return s.step_current(F.try_element_at("processing", F.lit(step)), stored, config_hash)


def mark_complete(manifest: DataFrame, finished: DataFrame, step: str, keys: Sequence[str] = ("project", "video_hash")) -> DataFrame:
    """Manifest with the step of the finished videos stamped and their configuration stored.

    ``finished``: keys, ``completed_at``, ``new_hash``.
    """
    rows = manifest.join(finished, list(keys), "left")
    stamped = F.map_concat(F.map_filter("processing", lambda k, v: k != step),
                           F.create_map(F.lit(step), F.col("completed_at")))
    hit = F.col("completed_at").isNotNull()
    return rows.withColumns({
        "processing": F.when(hit, stamped).otherwise(F.col("processing")),
        "config_hash": F.when(hit, F.col("new_hash")).otherwise(F.col("config_hash")),
    }).drop("completed_at", "new_hash")


def entries_subset(df: DataFrame, identifier: str, wanted: Sequence | None, ordered: bool = True) -> DataFrame:
    """Rows whose identifier is listed, all rows for no list; sorted by it unless the caller needs no order."""
    kept = df if wanted is None else df.filter(F.col(identifier).isin(list(wanted)))
    return kept.orderBy(identifier) if ordered else kept


def described_only(segments: DataFrame, descriptions: DataFrame, video_key: str) -> DataFrame:
    """Segments of the videos that have a description file."""
    return segments.join(descriptions.select(video_key), video_key, "left_semi")


def register(new: DataFrame, manifest: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Manifest plus the unseen content hashes, the first arrival of each."""
    fields = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_f"))
    first = first.select(key, *[F.col(f"_f.{c}").alias(c) for c in fields])
    unseen = first.join(manifest.select(key), key, "left_anti")
    return manifest.unionByName(unseen.select(*manifest.columns))


def all_described(manifest: DataFrame, project: str, completed: Column) -> DataFrame:
    """Whether every video of a project is described."""
    return manifest.groupBy(project).agg(F.every(completed.isNotNull()).alias("ready"),
                                         F.count(F.lit(1)).alias("videos"))


def in_progress(tasks: DataFrame, manifest: DataFrame, project: str, video: str) -> DataFrame:
    """Projects blocked by running description tasks, with a message.

    ``tasks``: project, video, ``state``; ``manifest``: project, video, ``described_at``.
    """
    # Task states that count as running, and the message.
    running = tasks.filter(F.col("state").isin("STARTED", "RETRY"))
    undone = running.join(manifest.filter("described_at IS NOT NULL").select(project, video),
                          [project, video], "left_anti")
    firsts = _smallest(undone, project, video, 3)
    return undone.groupBy(project).agg(F.count(F.lit(1)).alias("running")).join(firsts, project).select(
        project, "running", F.format_string(
            "Video understanding still in progress for %d video(s) (%s). "
            "Wait for processing to complete before starting storyboard or editing.",
            "running", F.array_join("_firsts", ", ")).alias("message"))


def _smallest(df: DataFrame, key: str, value: str, count: int) -> DataFrame:
    """The smallest values per key; the rank filter keeps few rows per task before the shuffle."""
    ranked = df.select(key, value).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value)))
    return ranked.filter(F.col("_r") <= count).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value].cast("string")).alias("_firsts"))


def project_summary(projects: DataFrame, videos: DataFrame, outputs: DataFrame, project: str) -> DataFrame:
    """Status, number of videos and available outputs per project.

    ``outputs``: project and ``category`` (storyboard, timeline).
    """
    counts = videos.groupBy(project).agg(F.count(F.lit(1)).alias("video_count"))
    kinds = outputs.groupBy(project).agg(
        F.bool_or(F.col("category") == "storyboard").alias("has_storyboard"),
        F.bool_or(F.col("category") == "timeline").alias("has_timeline"))
    rows = projects.join(counts, project, "left").join(kinds, project, "left")
    return rows.fillna({"video_count": 0}).withColumns({
        c: F.coalesce(c, F.lit(False)) for c in ("has_storyboard", "has_timeline")})


def newest_versions(versions: DataFrame, count: int = 5) -> DataFrame:
    return versions.orderBy(F.desc("version")).limit(count)


def enriched_versions(versions: DataFrame, documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Versions with a 120-character brief and the source storyboard version, null when unreadable."""
    rows = versions.join(documents, list(keys), "left")
    brief = F.nullif(F.substring(F.coalesce("user_brief", F.lit("")), 1, 120), F.lit(""))
    return rows.withColumn("brief_snippet", brief).drop("user_brief")


def merge_results(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed merge in which new rows win."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def union_segments(*frames: DataFrame) -> DataFrame:
    """All videos' segments, duplicates kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def probe_to_video(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Media-probe JSON to video rows, and a reject table with reasons."""
    stream = "struct<codec_type:string,codec_name:string,duration:string,r_frame_rate:string,width:int,height:int>"
    schema = f"struct<streams:array<{stream}>,format:struct<duration:string>>"
    valid = F.try_parse_json(column).isNotNull()
    # parsed once per row: filters are not pushed below an explode, so its expression is not repeated for each use
    rows = df.select("*", F.explode(F.array(F.when(valid, F.from_json(column, schema)))).alias("_p"))
    rows = rows.withColumn("_v", F.try_element_at(
        F.filter("_p.streams", lambda x: x["codec_type"] == "video"), F.lit(1)))
    given = F.coalesce(F.nullif(F.col("_v.duration"), F.lit("")), F.col("_p.format.duration"))
    rows = rows.withColumns({
        "duration": given.try_cast("double"), "fps": tx.parse_rate(F.coalesce("_v.r_frame_rate", F.lit("0/1"))),
        "width": F.col("_v.width"), "height": F.col("_v.height"),
        "codec": F.coalesce("_v.codec_name", F.lit("unknown"))})
    reason = (F.when(F.col("_p").isNull(), "invalid JSON").when(F.col("_v").isNull(), "no video stream")
              .when(given.isNull(), "missing duration").when(F.col("duration").isNull(), "bad duration")
              .when(F.col("width").isNull() | F.col("height").isNull(), "missing size"))
    rows = rows.withColumn("reason", reason).drop("_p", "_v")
    videos = rows.filter("reason IS NULL").drop("reason", column)
    rejects = rows.filter("reason IS NOT NULL").drop("duration", "fps", "width", "height", "codec", column)
    return videos, rejects


def explode_analysis(doc: DataFrame, key: str) -> dict[str, DataFrame]:
    """One nested analysis document as three tables."""
    return {name: doc.select(key, F.inline(name)) for name in ("flow_decomposition", "flow_stats", "frame_metrics")}
