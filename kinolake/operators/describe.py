"""Descriptions of segments: joining, unnesting, searchable text, rendered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolake.functions import text as tx
from kinolake.operators import ordering as o


def extract_attrs(df: DataFrame, paths: Sequence[str], identifier: str, json_column: str | None = None) -> DataFrame:
    """Dotted look-ups as columns; a missing part gives null. The identifier always stays.

    Paths go into struct columns, or into ``json_column`` when it is given.
    """
    def one(path: str) -> Column:
        if json_column:
            return F.get_json_object(json_column, "$." + path)
        return F.col(path) if _has_path(df, path) else F.lit(None).cast("string")
    return df.select(identifier, *[one(p).alias(p.replace(".", "_")) for p in paths])


def _has_path(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return False
        kind = kind[part].dataType
    return True


def combined_view(segments: DataFrame, descriptions: DataFrame, key: str = "segment_id", order: Sequence[str] = ("seq",),
                  bucket: Column | None = None, longest: int | None = None) -> DataFrame:
    """Every segment with its descriptions as rows, numbered from 1 in arrival order.

    Segments without a description stay once, with nulls; orphan descriptions are dropped.
    The flat form holds any number of revisions per segment; see :func:`nest_descriptions`. Without ``longest`` the
    largest number of descriptions of a segment is counted, so that quantiles per segment are made only where one needs them.
    """
    bucket = o.id_bucket(F.col(order[0])) if bucket is None else bucket
    longest = o.longest_series(descriptions, [key]) if longest is None else longest
    known = descriptions.join(segments.select(key), key, "left_semi")
    numbered = o.number_rows(known, [key], order, bucket, "vlm_pos", None, longest)
    return segments.join(numbered.withColumn("vlm_pos", F.col("vlm_pos") + 1), key, "left")


def nest_descriptions(segments: DataFrame, descriptions: DataFrame, fields: Sequence[str], key: str = "segment_id",
                      order: Sequence[str] = ("seq",)) -> DataFrame:
    """Segment documents with an array ``vlm`` in arrival order; empty, never null, without any.

    For export: one document holds all revisions of its segment.
    """
    item = F.struct(*order, *fields)
    nested = descriptions.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("vlm"))
    empty = F.slice(F.array(F.struct(*[F.lit(None).cast(descriptions.schema[c].dataType).alias(c)
                                       for c in (*order, *fields)])), 1, 0)
    return segments.join(nested, key, "left").withColumn("vlm", F.coalesce("vlm", empty))


def first_descriptions(descriptions: DataFrame, fields: Sequence[str], key: str = "segment_id",
                       order: Sequence[str] = ("seq",)) -> DataFrame:
    """The first description of each segment: an aggregate, combined before the shuffle."""
    first = F.min_by(F.struct(*fields), F.struct(*order)).alias("_d")
    return descriptions.groupBy(key).agg(first).select(key, *[F.col(f"_d.{c}").alias(c) for c in fields])


def flatten_movements(segments: DataFrame, movements: str, keep: Sequence[str], digits: dict[str, int]) -> DataFrame:
    """One row per element of an array of structs, with the listed fields rounded."""
    flat = segments.select(*keep, F.inline(movements))
    return flat.withColumns({c: F.round(c, d) for c, d in digits.items()})


def flatten_channels(df: DataFrame, column: str, channels: Sequence[str], metrics: Sequence[str]) -> list[Column]:
    """Columns ``channel_metric`` of a struct of structs."""
    return [F.col(f"{column}.{c}.{m}").alias(f"{c}_{m}") for c in channels for m in metrics]


def quality_rating(vlm: Column) -> Column:
    """Rating of the first description; missing or empty means good."""
    rating = F.try_element_at(vlm, F.lit(1))["rating"]
    return F.coalesce(F.nullif(rating, F.lit("")), F.lit("good"))


def rating_or_good(rating: Column) -> Column:
    return F.coalesce(F.nullif(rating, F.lit("")), F.lit("good"))


def search_text(description: Column, highlights: Column, tags: Column, identifier: Column) -> Column:
    """Description, highlight texts and tags joined by spaces; the identifier when all are empty."""
    parts = F.array(description, F.array_join(highlights, " "), F.array_join(tags, " "))
    kept = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), identifier.cast("string"))


def query_text(narration: Column, description: Column, keywords: Column) -> Column:
    parts = F.array(narration, description, F.array_join(keywords, " "))
    return F.trim(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " "))


# -- rendered lines -------------------------------------------------------
# Line formats, placeholders and cut lengths (60 and 80 characters).

NO_DESCRIPTION = "(no description)"
EMPTY_CANDIDATES, EMPTY_CHAINS, EMPTY_SWAPS = "(none)", "(no chains)", "(no swap candidates)"
EMPTY_DESCRIPTIONS, EMPTY_CHAIN = "(no segment descriptions available)", "(no chain selected)"


def candidate_line(segment: Column, duration: Column, rating: Column, description: Column) -> Column:
    return F.format_string("%s | %.1fs | %s | %s", segment, duration, rating,
                           F.coalesce(description, F.lit(NO_DESCRIPTION)))


def description_line(segment: Column, start: Column, end: Column, description: Column) -> Column:
    return F.format_string("[Segment %s | %.1fs–%.1fs] %s", segment, start, end, description)


def swap_line(segment: Column, description: Column) -> Column:
    cut = F.substring(description, 1, 80)
    return F.format_string("%s | — | %s", segment, F.coalesce(cut, F.lit(NO_DESCRIPTION)))


def link_text(bucket: Column, segment: Column, description: Column) -> Column:
    return F.format_string("[b%d] %s (%s)", bucket, segment, F.coalesce(F.substring(description, 1, 60), F.lit("")))


def chain_line(rank: Column, cost: Column, duration: Column, links: Column) -> Column:
    """``links``: link texts in order."""
    return F.format_string("%d | cost=%.3f | %.1fs | %s", rank, cost, duration, F.array_join(links, " → "))


def timeline_line(scene: Column, description: Column, duration: Column, links: Column) -> Column:
    full = F.format_string("Scene %s [%s] — %.1fs — %s", scene, F.substring(F.coalesce(description, F.lit("")), 1, 80),
                           duration, F.array_join(links, " → "))
    return F.coalesce(F.when(links.isNotNull(), full), F.format_string("Scene %s: " + EMPTY_CHAIN, scene))


def timeline_link(segment: Column, description: Column) -> Column:
    return F.format_string("%s (%s)", segment, F.coalesce(F.substring(description, 1, 60), F.lit("")))


def boundary_line(scene_a: Column, scene_b: Column, cost: Column, flagged: Column) -> Column:
    flag = F.initcap(flagged.cast("string"))
    return F.format_string("Boundary %s→%s: cost=%.3f flagged=%s", scene_a, scene_b, cost, flag)


def beat_line(identifier: Column, text: Column) -> Column:
    return F.format_string("%s. %s", identifier, text)


def segment_index_item(segment: Column, start: Column, end: Column) -> Column:
    return F.to_json(F.struct(segment.alias("segment_id"), start.alias("start"), end.alias("end")))


def text_block(lines: DataFrame, keys: Sequence[str], line: str, order: Sequence[str], placeholder: str) -> DataFrame:
    """One text per group from its ordered lines. For groups of bounded size, such as the
    candidates or chains of a scene; longer texts stay lines."""
    item = F.struct(*order, line)
    blocks = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    joined = F.array_join(F.filter(F.transform("_l", lambda x: x[line]), lambda x: x.isNotNull()), "\n")
    return blocks.select(*keys, F.coalesce(F.nullif(joined, F.lit("")), F.lit(placeholder)).alias("text"))


def ingest_responses(responses: DataFrame, schema: str, required: str,
                     column: str = "response") -> tuple[DataFrame, DataFrame]:
    """Parsed responses and a reject table: unparseable ones and those without ``required``."""
    parsed = responses.withColumn("parsed", tx.parse_fenced_json(F.col(column), schema))
    good = F.col("parsed").isNotNull() & F.col(f"parsed.{required}").isNotNull()
    accepted = parsed.filter(good)
    rejected = parsed.filter(~F.coalesce(good, F.lit(False))).withColumn(
        "reason", F.when(tx.first_object(tx.strip_fences(F.col(column))).isNull(), "invalid JSON")
        .otherwise(F.lit(f"missing {required}"))).drop("parsed")
    return accepted, rejected
