"""Retrieval: scoring scenes against segments, candidate pools, vector series.

Scores of all scene-segment pairs are never rows. Scenes and segments are cut into numbered
blocks of bounded size, each pair of blocks meets in one task as two matrices, and only a
reduced result (the best few per scene, or sums) leaves the task. A project that holds most
of the data is spread over its blocks like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinolake.functions import vectors as v
from kinolake.operators import ordering as o
from kinolake.session import cut_lineage
from kinolake.settings import EDITOR

SCENE_BLOCK, SEGMENT_BLOCK = 256, 8192
WIDE_SCENES, WIDE_SEGMENTS = 16384, 65536  # rows of the two sides of a task that keeps the best only
TIE_DIGITS = 9
MAX_PIVOTS, MAX_WORDS = 1024, 1000
PLAIN_ROWS = 1_000_000
BOUND_SLACK = 1e-6  # angles and products are rounded


# -- block products --------------------------------------------------------

def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length < 1e-9, 1.0, length)


def _word_sets(lists: pd.Series) -> list[set[str]]:
    return [{w.lower() for w in x if w is not None} if x is not None else set() for x in lists]


def _overlap(rows: Sequence[frozenset[str]], cols: Sequence[frozenset[str]]) -> np.ndarray:
    """Jaccard overlap of word sets."""
    where: dict[str, list[int]] = {}
    for j, words in enumerate(cols):
        for w in words:
            where.setdefault(w, []).append(j)
    common = np.zeros((len(rows), len(cols)))
    for i, words in enumerate(rows):
        for w in words:
            if w in where:
                common[i, where[w]] += 1
    union = np.array([len(r) for r in rows])[:, None] + np.array([len(c) for c in cols])[None, :] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


class _Overlaps:
    """Overlaps of the keywords of scenes with the tags of segments; equal sets are compared once."""

    WHOLE = 1 << 22  # cells of a table of all different sets

    def __init__(self, keywords: pd.Series, tags: pd.Series):
        (self.row_of, self.rows), (self.col_of, self.cols) = (self._numbered(x) for x in (keywords, tags))
        self.table = _overlap(self.rows, self.cols) if len(self.rows) * len(self.cols) <= self.WHOLE else None

    @staticmethod
    def _numbered(lists: pd.Series) -> tuple[np.ndarray, list[frozenset[str]]]:
        number: dict[frozenset[str], int] = {}
        of = np.array([number.setdefault(frozenset(s), len(number)) for s in _word_sets(lists)], np.int64)
        return of, list(number)

    def of_set(self, row: int, cols: np.ndarray) -> np.ndarray:
        """Overlaps of the keyword set ``row`` with the tags of the segments ``cols``."""
        if self.table is not None:
            return self.table[row, self.col_of[cols]]
        some, at = np.unique(self.col_of[cols], return_inverse=True)
        return _overlap([self.rows[row]], [self.cols[i] for i in some])[0, at]


def block_scores(scenes: DataFrame, segments: DataFrame, project: str, reduce: Callable, schema: str,
                 scene_block: int = SCENE_BLOCK, segment_block: int = SEGMENT_BLOCK, scene_order: str = "scene_pos",
                 segment_order: str = "seg_pos", bucket_rows: int = o.CHUNK_ROWS) -> DataFrame:
    """Apply ``reduce(scenes, segments)`` to every pair of blocks of a project."""
    side_a = o.number_rows(scenes, [project], [scene_order], o.id_bucket(F.col(scene_order), bucket_rows), "_i", None)
    side_b = o.number_rows(segments, [project], [segment_order], o.id_bucket(F.col(segment_order), bucket_rows), "_i", None)
    side_a = side_a.withColumn("block_a", F.floor(F.col("_i") / scene_block))
    side_b = side_b.withColumn("block_b", F.floor(F.col("_i") / segment_block))
    blocks_a = side_a.groupBy(project).agg(F.max("block_a").alias("_last"))
    blocks_b = side_b.groupBy(project).agg(F.max("block_b").alias("_last"))
    spread = lambda side, blocks, name: (side.join(blocks, project).withColumn(
        name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last", "_i"))
    return _products(spread(side_a, blocks_b, "block_b"), spread(side_b, blocks_a, "block_a"), project,
                     [project, "block_a", "block_b"], reduce, schema)


def _products(left: DataFrame, right: DataFrame, project: str, keys: Sequence[str], reduce: Callable, schema: str) -> DataFrame:
    """``reduce(scenes, segments)`` for those that meet under ``keys``."""
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may be one table

    def guarded(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        out = reduce(a.reset_index(drop=True), b.reset_index(drop=True))
        out.insert(0, project, a[project].iloc[0])
        return out

    kind = T.StructType([left.schema[project], *T._parse_datatype_string(schema).fields])
    names = kind.fieldNames()
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(guarded, kind)


# -- blocks that need not all be opened --------------------------------------

def word_set(words: Column | str) -> Column:
    """Distinct lower-cased words, sorted, without nulls; empty for a null list."""
    column = F.col(words) if isinstance(words, str) else words
    lower = F.transform(column, lambda w: F.lower(w))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(lower, lambda w: w.isNotNull()))), F.array().cast("array<string>"))


def ball_blocks(segments: DataFrame, project: str, segment_block: int = SEGMENT_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments in blocks of like vectors: (segments with ``pivot`` and ``block``, pivots, blocks with their bounds).

    Pivots are a few vectors per project, chosen by a hash (four per block of rows, at most ``MAX_PIVOTS``); a segment
    belongs to the most similar one, and a pivot's segments are cut into blocks by their angle to it. A block has
    its range of angles and, unless there are too many, the words that occur in it.
    """
    sizes = segments.groupBy(project).agg(F.count(F.lit(1)).alias("_n"))
    count = F.least(F.lit(MAX_PIVOTS), F.when(F.col("_n") <= segment_block, 1).otherwise(F.ceil(4 * F.col("_n") / segment_block)))
    by_hash = Window.partitionBy(project).orderBy(F.xxhash64("seg_pos"), "seg_pos")
    pivots = (segments.select(project, "seg_pos", "vector").withColumn("pivot", F.row_number().over(by_hash))
              .filter(F.col("pivot") <= MAX_PIVOTS).join(sizes, project).filter(F.col("pivot") <= count))
    pivots = cut_lineage(pivots.select(project, F.col("pivot").cast("long").alias("pivot"), "vector"))

    def closest(a, b):
        similarity = _unit(b["vector"]) @ _unit(a["vector"]).T
        at = similarity.argmax(axis=1)
        return pd.DataFrame({"seg_pos": b["seg_pos"], "pivot": a["pivot"].to_numpy()[at],
                             "cos": similarity[np.arange(len(b)), at]})
    near = block_scores(pivots, segments.select(project, "seg_pos", "vector"), project, closest,
                        "seg_pos long, pivot long, cos double", segment_block=segment_block, scene_order="pivot")
    best = near.groupBy(project, "seg_pos").agg(F.max(F.struct("cos", -F.col("pivot"))).alias("_b")).select(
        project, "seg_pos", (-F.col("_b.col2")).alias("pivot"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_b.cos")))).alias("_angle"))
    placed = o.number_rows(best, [project, "pivot"], ["_angle", "seg_pos"], o.value_bucket(F.col("_angle")), "_i", None)
    placed = placed.withColumn("block", F.floor(F.col("_i") / segment_block)).drop("_i")
    rows = cut_lineage(segments.join(placed, [project, "seg_pos"]))
    words = F.array_distinct(F.flatten(F.collect_set(word_set("tags")))) if "tags" in segments.columns else F.lit(None).cast("array<string>")
    blocks = rows.groupBy(project, "pivot", "block").agg(F.min("_angle").alias("low"), F.max("_angle").alias("high"),
                                                         F.count(F.lit(1)).alias("rows"), words.alias("_words"))
    blocks = blocks.withColumn("_words", F.when(F.size("_words") <= MAX_WORDS, F.col("_words")))
    return rows.drop("_angle"), pivots, cut_lineage(blocks)


def open_blocks(scenes: DataFrame, segments: DataFrame, project: str, alpha: float, k: int,
                segment_block: int = SEGMENT_BLOCK, scene_block: int = SCENE_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The best k segments of each scene, and ``(project, opened, all_pairs)``: the scene-block pairs that were scored.

    A block can hold no score above the bound that the triangle inequality on angles and the words of the block
    give. Each scene first opens its most promising blocks, as many as hold k segments, and then only
    those whose bound reaches the k-th score found there.
    """
    rows, pivots, blocks = ball_blocks(segments, project, segment_block)
    scenes = cut_lineage(scenes)

    def angles(a, b):
        similarity = _unit(b["vector"]) @ _unit(a["vector"]).T
        return pd.DataFrame({"scene_pos": np.repeat(a["scene_pos"].to_numpy(), len(b)), "pivot": np.tile(b["pivot"].to_numpy(), len(a)),
                             "_theta": np.arccos(np.clip(similarity.T.ravel(), -1.0, 1.0))})
    seen = block_scores(scenes.select(project, "scene_pos", "vector"), pivots, project, angles,
                        "scene_pos long, pivot long, _theta double", scene_block, scene_order="scene_pos", segment_order="pivot")
    words = "keywords" in scenes.columns
    seen = seen.join(blocks, [project, "pivot"])
    if words:
        seen = seen.join(scenes.select(project, "scene_pos", word_set("keywords").alias("_own")), [project, "scene_pos"])
        share = F.coalesce(F.try_divide(F.size(F.array_intersect("_own", "_words")), F.size("_own")), F.lit(0.0))
        share = F.when(F.col("_words").isNull(), 1.0).otherwise(share)
    else:
        share = F.lit(0.0)
    gap = F.greatest(F.lit(0.0), F.col("_theta") - F.col("high"), F.col("low") - F.col("_theta"))
    bound = alpha * F.cos(gap) + (1.0 - alpha) * share + BOUND_SLACK
    bounds = seen.select(project, "scene_pos", "pivot", "block", "rows", bound.alias("_bound"))
    order = Window.partitionBy(project, "scene_pos").orderBy(F.desc("_bound"), "pivot", "block")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = cut_lineage(bounds.withColumn("_first", before < k).drop("rows"))

    first = cut_lineage(_score_opened(scenes, rows, bounds.filter("_first"), project, alpha, k, scene_block))
    least = rank_candidates(first, project).filter(F.col("rank") == k).select(
        project, "scene_pos", F.round("combined_score", TIE_DIGITS).alias("_least"))
    more = cut_lineage(bounds.filter("NOT _first").join(least, [project, "scene_pos"], "left")
                       .filter(F.col("_least").isNull() | (F.col("_bound") >= F.col("_least"))).drop("_least"))
    found = first.unionByName(_score_opened(scenes, rows, more, project, alpha, k, scene_block))
    opened = bounds.filter("_first").select(project).unionByName(more.select(project)).groupBy(project).agg(F.count(F.lit(1)).alias("opened"))
    report = bounds.groupBy(project).agg(F.count(F.lit(1)).alias("all_pairs")).join(opened, project)
    return rank_candidates(found, project).filter(F.col("rank") <= k), report


def _score_opened(scenes: DataFrame, rows: DataFrame, opened: DataFrame, project: str, alpha: float, k: int, scene_block: int) -> DataFrame:
    """Scores of the best k segments for each scene and block that it opens."""
    block = [project, "pivot", "block"]
    asked = scenes.join(opened.select(*block, "scene_pos"), [project, "scene_pos"])
    asked = o.number_rows(asked, block, ["scene_pos"], o.id_bucket(F.col("scene_pos")), "_i", None)
    asked = asked.withColumn("part", F.floor(F.col("_i") / scene_block)).drop("_i")
    parts = asked.groupBy(*block).agg(F.max("part").alias("_last"))
    held = rows.join(parts, block).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")

    return _products(asked, held, project, [*block, "part"], *_best_of(scenes, rows, alpha, k))


def _best_of(scenes: DataFrame, segments: DataFrame, alpha: float, k: int) -> tuple[Callable, str]:
    """What keeps the best k segments of each scene among those it meets, and its columns.

    Scores are made for some scenes and segments at a time. Segments come in their order, so that of equal scores only the
    first k count, and those that cannot pass a scene's k-th best are dropped by one comparison. With a column ``_holder`` a
    segment is open only to scenes before that position.
    """
    words = "keywords" in scenes.columns and "tags" in segments.columns

    def best(a, b):
        b = b.sort_values("seg_pos", kind="stable").reset_index(drop=True)
        overlaps = _Overlaps(a["keywords"], b["tags"]) if words else None
        if words:  # scenes of one set are neighbours and share a row of overlaps
            by_set = np.argsort(overlaps.row_of, kind="stable")
            a, overlaps.row_of = a.iloc[by_set].reset_index(drop=True), overlaps.row_of[by_set]
        x, y = _unit(a["vector"]), _unit(b["vector"])
        place = a["scene_pos"].to_numpy()
        holder = b["_holder"].fillna(np.inf).to_numpy() if "_holder" in b.columns else None
        found = []
        for i in range(0, len(a), SCENE_BLOCK):
            rows = np.arange(i, min(i + SCENE_BLOCK, len(a)))
            kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64))
            least = np.full(len(rows), -np.inf)
            for j in range(0, len(b), SEGMENT_BLOCK):
                cols = np.arange(j, min(j + SEGMENT_BLOCK, len(b)))
                score = (alpha * x[rows]) @ y[cols].T
                if words:
                    of = overlaps.row_of[rows]
                    edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
                    for s, e in zip(edges, edges[1:]):
                        score[s:e] += (1.0 - alpha) * overlaps.of_set(of[s], cols)
                if holder is not None:
                    score[holder[cols][None, :] <= place[rows][:, None]] = -np.inf
                bar = least + 0.4 * 10.0 ** -TIE_DIGITS
                if np.isneginf(least).any() and len(cols) > k:
                    bar = np.maximum(bar, np.partition(score, len(cols) - k, axis=1)[:, len(cols) - k] - 2.0 * 10.0 ** -TIE_DIGITS)
                r, c = np.nonzero((score > bar[:, None]) & (score > -np.inf))
                if not len(r):
                    continue
                same = np.einsum("ij,ij->i", x[rows[r]], y[cols[c]])
                shared = np.zeros(len(r))
                if words:
                    for s, e in zip(edges, edges[1:]):
                        a0, a1 = np.searchsorted(r, [s, e])
                        shared[a0:a1] = overlaps.of_set(of[s], cols[c[a0:a1]])
                kept = tuple(np.concatenate(p) for p in zip(kept, (r, cols[c], same, shared)))
                ranked = np.round(alpha * kept[2] + (1.0 - alpha) * kept[3], TIE_DIGITS)
                order = np.lexsort((kept[1], -ranked, kept[0]))
                first = np.searchsorted(kept[0][order], np.arange(len(rows)))
                turn = np.arange(len(order)) - first[kept[0][order]]
                order, turn = order[turn < k], turn[turn < k]
                last = order[turn == k - 1]
                least[kept[0][last]] = ranked[last]
                kept = tuple(p[order] for p in kept)
            found.append((rows[kept[0]], *kept[1:]))
        r, c, same, shared = (np.concatenate(p) for p in zip(*found))
        return pd.DataFrame({
            "scene_id": a["scene_id"].to_numpy()[r], "scene_pos": place[r], "segment_id": b["segment_id"].to_numpy()[c],
            "seg_pos": b["seg_pos"].to_numpy()[c], "embedding_score": same, "keyword_score": shared,
            "combined_score": alpha * same + (1.0 - alpha) * shared})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return best, (f"scene_id {kind(scenes, 'scene_id')}, scene_pos long, segment_id {kind(segments, 'segment_id')}, seg_pos long, "
                  "embedding_score double, keyword_score double, combined_score double")


def retrieve_candidates(scenes: DataFrame, segments: DataFrame, project: str = "project",
                        alpha: float = EDITOR.alpha, k: int = EDITOR.candidates_per_scene,
                        scene_block: int = WIDE_SCENES, segment_block: int = WIDE_SEGMENTS,
                        plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """The best k segments of each scene by vector and keyword score, ranked from 1.

    ``scenes``: project, scene_id, scene_pos, vector, keywords. ``segments``: project,
    segment_id, seg_pos, vector, tags. Scores equal to nine digits keep segment order. ``scene_pos`` and
    ``seg_pos`` are unique in a project. Where no project has more than ``plain_rows`` segments, bounds cost
    more than they save and every block is scored; beyond, only blocks that may hold one of the best
    (:func:`open_blocks`). The result is the same.
    """
    largest = segments.groupBy(project).count().agg(F.max("count")).first()[0] or 0
    if largest > plain_rows:
        return open_blocks(scenes, segments, project, alpha, k, min(segment_block, SEGMENT_BLOCK), min(scene_block, SCENE_BLOCK))[0]
    best, columns = _best_of(scenes, segments, alpha, k)
    tops = block_scores(scenes, segments, project, best, columns, scene_block, segment_block)
    return rank_candidates(tops, project).filter(F.col("rank") <= k)


def rank_candidates(candidates: DataFrame, project: str = "project") -> DataFrame:
    w = Window.partitionBy(project, "scene_id").orderBy(F.desc(F.round("combined_score", TIE_DIGITS)), "seg_pos")
    return candidates.withColumn("rank", F.row_number().over(w))


def vector_sums(vectors: DataFrame, project: str, vector: str = "vector") -> DataFrame:
    """``(project, count, total)``: number and sum of the unit vectors of each project."""
    mean = Summarizer.mean(array_to_vector(F.col("_u"))).alias("_m")
    sums = vectors.select(project, v.l2_normalise(F.col(vector)).alias("_u")).groupBy(project).agg(F.count(F.lit(1)).alias("count"), mean)
    return sums.select(project, "count", F.transform(vector_to_array("_m"), lambda e: e * F.col("count")).alias("total"))


def overlap_sums(scenes: DataFrame, segments: DataFrame, project: str) -> DataFrame:
    """``(project, _set, overlaps)``: for each set of keywords the sum of its overlaps with the tags of all segments.

    Equal sets count once, and only sets with a word in common meet, by way of the list of sets for each word.
    """
    sets = scenes.select(project, word_set("keywords").alias("_set")).distinct()
    tags = segments.groupBy(project, word_set("tags").alias("_tags")).agg(F.count(F.lit(1)).alias("_times"))
    left = sets.select(project, "_set", F.explode("_set").alias("_word"))
    right = tags.select(project, "_tags", "_times", F.explode("_tags").alias("_word"))
    common = left.join(right, [project, "_word"]).groupBy(project, "_set", "_tags", "_times").agg(F.count(F.lit(1)).alias("_c"))
    each = F.col("_times") * F.col("_c") / (F.size("_set") + F.size("_tags") - F.col("_c"))
    return common.groupBy(project, "_set").agg(F.sum(each).alias("overlaps"))


def score_summary(scenes: DataFrame, segments: DataFrame, project: str = "project",
                  alpha: float = EDITOR.alpha, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """All pairs of a scene in one row: number, mean and highest combined score.

    The mean follows from sums: a scene's similarities add up to its product with the sum of all unit vectors,
    its overlaps to a sum over word sets. Only the highest score looks at segments, in the blocks that may hold it.
    """
    sums = vector_sums(segments, project)
    rows = scenes.select(project, "scene_id", v.l2_normalise(F.col("vector")).alias("_u"), word_set("keywords").alias("_set"))
    rows = rows.join(sums, project).join(overlap_sums(scenes, segments, project), [project, "_set"], "left")
    mean = (alpha * v.dot(F.col("_u"), F.col("total")) + (1.0 - alpha) * F.coalesce("overlaps", F.lit(0.0))) / F.col("count")
    top = retrieve_candidates(scenes, segments, project, alpha, 1, plain_rows=plain_rows)
    return rows.select(project, "scene_id", F.col("count").alias("pairs"), mean.alias("mean_score")).join(
        top.select(project, "scene_id", F.col("combined_score").alias("top_score")), [project, "scene_id"])


def similarity_profile(vectors: DataFrame, project: str = "project", plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Row summary of the full cosine matrix: mean over the other vectors and the closest one.

    ``vectors``: project, vec_id (unique in a project), vector. The mean comes from the sum of all unit vectors; the
    closest vector is looked for in the blocks that may hold it.
    """
    both = vectors.select(project, "vec_id", "vector")
    sums = vector_sums(both, project)
    rows = both.select(project, "vec_id", v.l2_normalise(F.col("vector")).alias("_u")).join(sums, project)
    others = F.col("count") - 1
    rest = v.dot(F.col("_u"), F.col("total")) - v.dot(F.col("_u"), F.col("_u"))
    asked = both.select(project, F.col("vec_id").alias("scene_id"), F.col("vec_id").alias("scene_pos"), "vector")
    held = both.select(project, F.col("vec_id").alias("segment_id"), F.col("vec_id").alias("seg_pos"), "vector")
    # a vector may be its own best: of two, one is another
    two = retrieve_candidates(asked, held, project, 1.0, 2, plain_rows=plain_rows).filter("segment_id <> scene_id")
    near = two.groupBy(project, F.col("scene_id").alias("vec_id")).agg(F.min_by(F.struct("segment_id", F.round(
        "combined_score", TIE_DIGITS).alias("near")), "rank").alias("_n"))
    return rows.join(near, [project, "vec_id"], "left").select(
        project, "vec_id", others.alias("others"), F.when(others > 0, rest / others).alias("mean_similarity"),
        F.col("_n.segment_id").alias("nearest_id"), F.col("_n.near").alias("nearest_similarity"))


# -- pools -----------------------------------------------------------------

def lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Attach attributes by id; rows without a match are dropped."""
    return df.join(dimension, key)


def resolve_contested(candidates: DataFrame, project: str = "project") -> DataFrame:
    """Each segment only in the scene of its highest combined score, the earlier scene on a tie."""
    fields = [c for c in candidates.columns if c not in (project, "segment_id")]
    better = F.struct(F.round("combined_score", TIE_DIGITS), -F.col("scene_pos"))
    best = candidates.groupBy(project, "segment_id").agg(F.max_by(F.struct(*fields), better).alias("_b"))
    return best.select(project, "segment_id", *[F.col(f"_b.{c}").alias(c) for c in fields]).select(*candidates.columns)


def contested_count(candidates: DataFrame, project: str = "project") -> DataFrame:
    """Unique segments, scenes and segments wanted by several scenes."""
    per_segment = candidates.groupBy(project, "segment_id").agg(F.count(F.lit(1)).alias("_wanted"))
    scenes = candidates.groupBy(project, "scene_id").agg(F.lit(1).alias("_one")).groupBy(project).agg(
        F.count("_one").alias("scenes"))
    return per_segment.groupBy(project).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.col("_wanted") > 1).alias("contested")).join(scenes, project)


def gap_report(scenes: DataFrame, pools: DataFrame, minimum: int = EDITOR.min_candidates, project: str = "project",
               after_fill: bool = False) -> DataFrame:
    """Scenes whose pool is below the minimum, empty pools included, with a message."""
    sizes = pools.groupBy(project, "scene_id").agg(F.count(F.lit(1)).alias("pool_size"))
    rows = scenes.select(project, "scene_id", "scene_pos").join(sizes, [project, "scene_id"], "left")
    rows = rows.withColumn("pool_size", F.coalesce("pool_size", F.lit(0).cast("long"))).filter(
        F.col("pool_size") < minimum)
    # Warning texts.
    text = ("Scene %s still has only %d candidate(s) after gap fill (minimum %d)" if after_fill
            else "Scene %s has only %d candidate(s) after deduplication (minimum %d)")
    return rows.withColumn("message", F.format_string(text, "scene_id", "pool_size", F.lit(minimum)))


def unassigned(segments: DataFrame, pools: DataFrame, project: str = "project") -> DataFrame:
    return segments.join(pools.select(project, "segment_id"), [project, "segment_id"], "left_anti")


def fill_gaps(pools: DataFrame, scenes: DataFrame, segments: DataFrame, minimum: int = EDITOR.min_candidates,
              project: str = "project", alpha: float = EDITOR.alpha, depth: int | None = None) -> DataFrame:
    """Additions for scenes below the minimum: in scene order, their best unassigned segments.

    Each segment is used once. ``depth=None`` ranks all unassigned segments; a number keeps
    only those among a scene's best ``depth`` of all segments, where every segment that a
    scene retrieved is already assigned. Ranked lists start short and grow only when some
    scene used its list up, so their length follows the contention, not the table.
    """
    gaps = gap_report(scenes, pools, minimum, project).select(
        project, "scene_id", (F.lit(minimum) - F.col("pool_size")).alias("needed"))
    gap_scenes = scenes.join(gaps.select(project, "scene_id"), [project, "scene_id"], "left_semi")
    if depth is not None:
        ranked = retrieve_candidates(gap_scenes, segments, project, alpha, depth)
        lists = unassigned(ranked, pools, project)
        return _take_in_order(lists, gaps, project, depth)[0]
    gaps = cut_lineage(gaps.join(scenes.select(project, "scene_id", "scene_pos"), [project, "scene_id"]))
    free = cut_lineage(unassigned(segments, pools, project))
    gaps = _before_segments_run_out(gaps, free, project)
    gap_scenes = cut_lineage(scenes.join(gaps.select(project, "scene_id"), [project, "scene_id"], "left_semi"))
    gaps = gaps.drop("scene_pos").distinct()
    return _serve_in_order(gap_scenes, free, gaps, project, alpha, 4 * minimum)


def _before_segments_run_out(gaps: DataFrame, free: DataFrame, project: str) -> DataFrame:
    """Gaps of the scenes that come before all free segments are used: the others get none.

    Any scene may take any free segment, so the scenes before it take what they need. Only for unique positions.
    """
    counts = [df.agg(F.count(F.lit(1)), F.count_distinct(*c)).first() for df, c in
              ((gaps, (project, "scene_pos")), (free, (project, "seg_pos")))]
    if any(a != b for a, b in counts):
        return gaps
    before = o.running_total(gaps, [project], ["scene_pos"], o.id_bucket(F.col("scene_pos")), {"_before": F.col("needed").cast("long")})
    sizes = free.groupBy(project).agg(F.count(F.lit(1)).alias("_free"))
    return cut_lineage(before.join(sizes, project).filter("_before < _free").drop("_before", "_free"))


def _serve_in_order(scenes: DataFrame, free: DataFrame, gaps: DataFrame, project: str, alpha: float, length: int) -> DataFrame:
    """What scenes take when they choose one after another, from lists that grow only for scenes that used theirs up.

    A segment's holder only ever moves to an earlier scene, so a scene's further list leaves out what scenes up to itself hold,
    and all that was settled before stays. A list that comes back short held all that was still open.
    """
    scene, rows, offered = [project, "scene_id"], None, None
    holders = None
    asking = scenes
    while True:
        held = free if holders is None else free.join(holders, [project, "segment_id"], "left")
        lists = retrieve_candidates(asking, held, project, alpha, length)
        if offered is not None:
            lists = lists.join(offered.select(*scene, "_offered"), scene, "left").withColumn(
                "rank", (F.col("rank") + F.coalesce("_offered", F.lit(0))).cast("int")).drop("_offered")
        fresh = cut_lineage(lists.join(gaps, scene))
        columns = lists.columns
        got = fresh.groupBy(*scene).agg(F.count(F.lit(1)).alias("_fresh"), F.max("rank").alias("_offered"))
        full = cut_lineage(got.filter(F.col("_fresh") >= length).drop("_fresh"))
        rows = fresh if rows is None else rows.unionByName(fresh)
        # scenes that were not asked again keep the state of their lists
        open_lists = full if offered is None else offered.join(asking.select(*scene), scene, "left_anti").unionByName(full)
        offered = cut_lineage(open_lists)
        rows, holders = _settle(rows, project)
        counts = rows.groupBy(*scene).agg(F.count(F.lit(1)).alias("_got"))
        short = gaps.join(offered, scene).join(counts, scene, "left").filter(F.coalesce("_got", F.lit(0)) < F.col("needed"))
        asking = cut_lineage(scenes.join(short.select(*scene), scene, "left_semi"))
        if asking.isEmpty():
            turn = Window.partitionBy(*scene).orderBy("rank")
            return rows.withColumn("_turn", F.row_number().over(turn)).filter("_turn <= needed").select(*columns)
        length *= 2


def _settle(rows: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Rounds of proposals, as in :func:`_take_in_order`: the list entries left, and the holder of each segment.

    Every entry whose segment an earlier scene holds is struck off, proposed or not, for it never comes back.
    """
    scene = Window.partitionBy(project, "scene_id").orderBy("rank")  # one ranked list of bounded length
    rows = cut_lineage(rows)
    left = rows.count()
    while True:
        turns = rows.withColumn("_turn", F.row_number().over(scene))
        holders = turns.filter(F.col("_turn") <= F.col("needed")).groupBy(project, "segment_id").agg(F.min("scene_pos").alias("_holder"))
        kept = cut_lineage(rows.join(holders, [project, "segment_id"], "left").filter(
            F.col("_holder").isNull() | (F.col("scene_pos") <= F.col("_holder"))).drop("_holder"))
        count = kept.count()
        if count == left:
            return kept, cut_lineage(holders)
        rows, left = kept, count


def _take_in_order(lists: DataFrame, gaps: DataFrame, project: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Scenes choose one after another from their ranked lists, in rounds of proposals.

    In a round every scene proposes its best open entries, as many as it needs, and each segment
    holds the earliest scene; the other proposals are struck off. A segment's holder can only move to
    an earlier scene, so struck entries never come back, and when a round strikes nothing the
    proposals are what choosing in scene order gives. No round brings a project together.
    """
    rows = cut_lineage(lists.join(gaps, [project, "scene_id"]))
    scene = Window.partitionBy(project, "scene_id").orderBy("rank")  # one ranked list of bounded length
    while True:
        asked = rows.withColumn("_turn", F.row_number().over(scene)).filter(F.col("_turn") <= F.col("needed")).drop("_turn")
        holders = asked.groupBy(project, "segment_id").agg(F.min("scene_pos").alias("_holder"))
        struck = cut_lineage(asked.join(holders, [project, "segment_id"]).filter("scene_pos > _holder")
                             .select(project, "scene_id", "segment_id"))
        if struck.isEmpty():
            break
        rows = cut_lineage(rows.join(struck, [project, "scene_id", "segment_id"], "left_anti"))
    taken = cut_lineage(asked)
    counts = taken.groupBy(project, "scene_id").agg(F.count(F.lit(1)).alias("_got"))
    offered = lists.groupBy(project, "scene_id").agg(F.count(F.lit(1)).alias("_offered"))
    short = (gaps.join(offered, [project, "scene_id"]).join(counts, [project, "scene_id"], "left")
             .filter((F.coalesce("_got", F.lit(0)) < F.col("needed")) & (F.col("_offered") >= length)))
    return taken.select(*lists.columns), short


def segments_per_video(segments: DataFrame) -> DataFrame:
    """Segment counts by file name, else by source, else ``unknown``."""
    name = F.coalesce(F.nullif("video_file", F.lit("")), F.nullif("source_video", F.lit("")), F.lit("unknown"))
    return segments.groupBy(name.alias("video")).agg(F.count(F.lit(1)).alias("segments"))


def tag_intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def tag_union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


# -- vectors ---------------------------------------------------------------

def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str, dims: int) -> DataFrame:
    """Mean of the unmasked token vectors of each document, scaled to unit length."""
    kept = tokens.filter(F.col(mask) > 0).groupBy(key).agg(
        Summarizer.mean(array_to_vector(F.transform(vector, lambda x: x.cast("double")))).alias("_v"))
    kept = kept.select(key, vector_to_array("_v").alias("_m"))
    every = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("tokens"))
    pooled = F.coalesce("_m", F.array_repeat(F.lit(0.0), dims))
    return every.join(kept, key, "left").select(key, "tokens", v.l2_normalise(pooled).alias("vector"))


def consecutive_distance(vectors: DataFrame, keys: Sequence[str], vector: str = "vector", time: str = "timestamp",
                         longest: int | None = None) -> DataFrame:
    """Cosine distance of numbered vectors to their successor, at the middle time."""
    rows, w = o.neighbourhood(vectors, keys, 0, 1, longest=longest)
    rows = o.own_rows(rows.withColumns({"_next": F.lead(vector).over(w), "_t": F.lead(time).over(w)}))
    return rows.filter("_next IS NOT NULL").select(
        *keys, "pos", ((F.col(time) + F.col("_t")) / 2).alias("time"), (1 - v.cosine(F.col(vector), F.col("_next"))).alias("distance"))


def split_score(vectors: DataFrame, keys: Sequence[str], width: int = 10, vector: str = "vector",
                longest: int | None = None) -> DataFrame:
    """Cosine distance between the means of the previous and the next ``width`` numbered vectors.

    Zero for the first and last ``width`` rows. Cosine ignores length, so sums stand in for means.
    """
    rows, w = o.neighbourhood(vectors, keys, width, width - 1, longest=longest)
    rows = o.own_rows(rows.withColumn("_near", F.collect_list(vector).over(w.rowsBetween(-width, width - 1))))
    inner = (F.col("pos") >= width) & (F.col("pos") < F.col("n") - width)

    def total(part: Column) -> Column:
        first = F.transform(F.element_at(part, 1), lambda x: x.cast("double"))
        rest = F.slice(part, 2, width)
        return F.aggregate(rest, first, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q.cast("double")))
    near = F.when(inner, F.col("_near"))
    distance = 1 - v.cosine(total(F.slice(near, 1, width)), total(F.slice(near, width + 1, width)))
    return rows.withColumn("score", F.when(inner, distance).otherwise(F.lit(0.0))).drop("_near")


def select_keyframes(vectors: DataFrame, keys: Sequence[str], count: int = 3, vector: str = "vector",
                     longest: int | None = None) -> DataFrame:
    """Up to ``count`` diverse rows of each numbered series, starting from the middle one.

    Each round takes the row whose least distance to the chosen ones is largest, the first
    on a tie. Where series fit one task, a round is a window over them, and all rounds share the exchange that the rows
    come from; else it is one aggregate per series, and its choice is written, so a later
    round reads the rows once more but no earlier round. Short series keep all rows.
    """
    keys = list(keys)
    pick = F.struct("pos", vector)
    if o.fits_one_task(longest):
        series = Window.partitionBy(*keys)
        middle = F.when(F.col("pos") == F.floor(F.col("n") / 2), F.lit(0))
        rows = vectors.withColumns({"_d": F.lit(float("inf")), "_used": F.lit(False), "_s": F.max_by(pick, middle).over(series)})
        for _ in range(count - 1):
            gap = 1 - v.dot(F.col(vector), F.col("_s")[vector])
            rows = rows.withColumns({"_d": F.least("_d", F.round(gap, TIE_DIGITS)),
                                     "_used": F.col("_used") | (F.col("pos") == F.col("_s.pos"))})
            best = F.when(~F.col("_used"), F.struct("_d", -F.col("pos")))
            rows = rows.withColumn("_s", F.max_by(pick, best).over(series))
        return rows.filter((F.col("n") <= count) | F.col("_used") | (F.col("pos") == F.col("_s.pos"))).select(*vectors.columns)
    chosen = vectors.filter(F.col("pos") == F.floor(F.col("n") / 2)).select(*keys, "pos")
    seed = vectors.filter(F.col("pos") == F.floor(F.col("n") / 2)).select(*keys, F.struct("pos", vector).alias("_s"))
    rows = vectors.filter(F.col("n") > count).withColumns({"_d": F.lit(float("inf")), "_used": F.lit(False)})
    for _ in range(count - 1):
        rows = rows.join(seed, keys, "left")
        gap = 1 - v.dot(F.col(vector), F.col("_s")[vector])
        rows = rows.withColumns({"_d": F.least("_d", F.round(gap, TIE_DIGITS)),
                                 "_used": F.col("_used") | (F.col("pos") == F.col("_s.pos"))}).drop("_s")
        best = F.struct("_d", -F.col("pos"))
        seed = cut_lineage(rows.filter("NOT _used").groupBy(*keys).agg(F.max_by(pick, best).alias("_s")))
        chosen = chosen.unionByName(seed.select(*keys, F.col("_s.pos").alias("pos")))
    long = vectors.filter(F.col("n") > count).join(chosen, [*keys, "pos"], "left_semi")
    return vectors.filter(F.col("n") <= count).unionByName(long)


def pca(vectors: DataFrame, vector: str = "vector", components: int = 50) -> tuple[DataFrame, list[float]]:
    """Adds ``projection`` on the main axes after centring; also gives the share of variance of each axis.

    Two passes add up means and products per task and per cell of the matrix, which alone reaches the driver (a
    square of the vectors' length); the third projects. An axis points where its entry of largest size is positive.
    There are at most as many axes as entries, and one fewer than vectors. Null vectors take no part and have a null
    projection; without two vectors there are no axes, so projections are empty.
    """
    known = vectors.filter(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: x.cast("double")).alias("_x"))

    def sums(centre: np.ndarray | None):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                part = np.append(x.sum(axis=0), len(x)) if centre is None else ((x - centre).T @ (x - centre)).ravel()
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "v"])
        rows = known.mapInArrow(add, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(rows, key=lambda r: r["cell"])])

    schema = T.StructType([*vectors.drop("projection").schema.fields, T.StructField("projection", T.ArrayType(T.DoubleType()))])
    first = sums(None)
    count = int(first[-1]) if len(first) else 0
    dims = max(0, len(first) - 1)
    k = max(0, min(components, dims, count - 1))
    centre, axes, share = np.zeros(dims), np.zeros((dims, 0)), []
    if k:
        centre = first[:-1] / count
        values, found = np.linalg.eigh(sums(centre).reshape(dims, dims))
        axes = found[:, ::-1][:, :k]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        spread = np.maximum(values[::-1], 0.0)
        share = (spread[:k] / (spread.sum() or 1.0)).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = np.flatnonzero(batch.column(vector).is_valid().to_numpy(zero_copy_only=False))
            out: list[list[float] | None] = [None] * batch.num_rows
            if len(there):
                x = batch.column(vector).take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(len(there), -1)
                for i, y in zip(there.tolist(), ((x - centre) @ axes if k else np.zeros((len(there), 0))).tolist()):
                    out[i] = y
            yield batch.append_column("projection", pa.array(out, pa.list_(pa.float64())))

    return vectors.drop("projection").mapInArrow(project, schema), share
