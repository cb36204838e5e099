"""Embedding near-duplicates by sorted projection passes.

Each pass orders the vectors by a string of random sign bits, so that like vectors tend to be neighbours, and compares
every vector with the next few in that order. Verified links of all passes are united. A pair met in several passes
is counted in the first one only, which each task can tell from the places of both vectors in all orders, so pairs
are never rows. The number of passes follows from the number of vectors and the recall asked for.

A window that is full of links says that there are more beyond it. The group of a vector with such a window is a dense
class, whose pairs are all counted: many of them without being looked at, from the angles to the middle of
the class, the rest by products of blocks spread over the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolake.llm.components import connected_components
from kinolake.llm.gray_index import merge_labels
from kinolake.llm.vectors import by_length, normalised, usable_vectors
from kinolake.session import cut_lineage

BITS = 63
RECALL = 0.99  # chance for a pair at the threshold to meet, were the vectors spread evenly
SLACK = 1e-9  # angles this close to a limit are left to the exact product


def passes_for(count: int, threshold: float, window: int, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``.

    Two vectors agree in a sign bit with probability 1 - angle / pi; they meet in a pass if they agree in so many
    leading bits that no more than a window of vectors shares them.
    """
    agree = 1 - math.acos(threshold) / math.pi
    once = agree ** max(1.0, math.log2(max(2.0, count / window)))
    return max(3, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                 window: int = 256, chunk: int = 8192, passes: int | None = None, seed: int = 7) -> DataFrame:
    """``n_links``, ``component_id`` and ``kept`` for every row of the input, by cosine in double precision.

    Adds the three columns (replacing input columns of these names). Links are pairs with a cosine of at least
    ``threshold`` that lie within ``window`` places of each other in one of the orders, or in one dense class; in a
    class every link is counted, whatever its size. ``passes`` is derived from the number of vectors unless given.
    ``chunk`` vectors are compared in one task; the result does not depend on it. Null, empty, zero or non-finite
    vectors and null ids link with nothing: 0, own id, kept. Rows that share an id are one vector, the
    smallest; vectors of different lengths never link. An empty table gives an empty result.
    """
    df = df.drop("n_links", "component_id", "kept")
    vectors = cut_lineage(usable_vectors(df, id_col, vector_col))
    # equal vectors are one representative with a weight
    groups = cut_lineage(vectors.groupBy("vector").agg(F.min("id").alias("rep"), F.count("id").alias("weight")))
    rows = groups.select(F.col("rep").alias("id"), "vector", "weight")
    count = passes or passes_for(rows.count(), threshold, window)
    rows = cut_lineage(rows.join(_places(rows, count, seed), "id").withColumn("class", F.lit(None).cast("long")))
    met = cut_lineage(_meet(rows, threshold, window, chunk))
    links = met.select(F.col("id").alias("a"), F.col("root").alias("b"))
    full = met.where("full").select("id").distinct()
    if not full.isEmpty():
        classes = cut_lineage(_classes(met, full))
        rows = cut_lineage(rows.drop("class").join(classes, "id", "left"))
        # pairs inside a class are left to it
        met = cut_lineage(_meet(rows, threshold, window, chunk))
        inside = cut_lineage(_dense(rows.where("class IS NOT NULL"), threshold, chunk))
        links = links.unionByName(inside.select(F.col("id").alias("a"), F.col("root").alias("b")))
        met = met.select("id", "links").unionByName(inside.select("id", "links"))
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(links)
    labels = (groups.select("vector", "rep", "weight").join(counts.withColumnRenamed("id", "rep"), "rep", "left")
              .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
              .select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    per_id = vectors.join(labels, "vector").select(F.col("id").alias("_llm_id"), "n_links", "component_id")
    own = F.col(id_col).cast("long")
    return (df.join(per_id, own == F.col("_llm_id"), "left").drop("_llm_id")
            .withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
            .withColumn("component_id", F.coalesce("component_id", own))
            .withColumn("kept", F.coalesce(own == F.col("component_id"), F.lit(True))))


def _places(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """``(id, places)``: the place of each vector in the order of (sign bits, id) of every pass."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, matrix in by_length(batch.column("vector")):
                size = matrix.shape[1]
                if size not in planes:
                    planes[size] = np.random.default_rng((seed, size)).standard_normal((size, passes * BITS))
                bits = (normalised(matrix) @ planes[size] > 0).reshape(len(rows), passes, BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[rows], passes)), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(rows))),
                     pa.array((bits @ weight).ravel())], names=["id", "pass", "key"])

    placed = _numbered(vectors.select("id", "vector").mapInArrow(keys, "id long, pass int, key long"), "pass", ["key", "id"])
    return placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pass", "place")))["place"].alias("places"))


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``place``, from 0 in each group; a sort over all tasks, and counts per group and task."""
    ordered = cut_lineage(rows.orderBy(group, *order).withColumn("_row", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_row", 33))
    sizes = ordered.groupBy(group, "_part").agg(F.count("_row").alias("n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return ordered.join(offsets, [group, "_part"]).withColumn(
        "place", F.col("_offset") + F.col("_row") - F.col("_first")).drop("_row", "_part", "_first", "_offset")


def _meet(rows: DataFrame, threshold: float, window: int, chunk: int) -> DataFrame:
    """``(id, links, root, full)`` per pass and chunk of its order, for vectors with a link there.

    ``links`` is the weight linked first in this pass outside the own class, ``root`` the smallest id of the group
    there, and ``full`` says that at least half of the vectors after this one in the window are linked to it.
    """
    each = rows.select("*", F.posexplode("places").alias("pass", "place"))
    home = F.floor(F.col("place") / chunk)
    # the first rows of a chunk are also seen by the chunk before
    both = F.when((F.col("place") % chunk < window) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    each = each.withColumn("home", home).withColumn("part", F.explode(both))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        ids, weight, place = (table[c].to_numpy() for c in ("id", "weight", "place"))
        own = table["home"].to_numpy() == table["part"][0].as_py()
        classes = table["class"].fill_null(-1).to_numpy()
        this = table["pass"][0].as_py()
        places = np.array(table["places"].to_pylist(), np.int64)
        links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        full = np.zeros(len(ids), bool)
        for subset, matrix in by_length(table["vector"]):
            unit = normalised(matrix)
            starts = np.flatnonzero(own[subset])
            for i in range(0, len(starts), window):
                left = starts[i:i + window]
                right = np.arange(left[0], min(len(subset), left[-1] + window + 1))
                a, b = subset[left], subset[right]
                apart = place[b][None, :] - place[a][:, None]
                near = (apart > 0) & (apart <= window)
                meets = near.sum(axis=1)
                near &= unit[left] @ unit[right].T >= threshold
                full[a] |= (2 * near.sum(axis=1) >= meets) & (meets >= window)
                some_a, some_b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(some_a):
                    continue
                a, b, near = a[some_a], b[some_b], near[np.ix_(some_a, some_b)]
                x, y = np.nonzero(near)
                merge_labels(labels, a[x], b[y])
                first = ~(np.abs(places[a[x], :this] - places[b[y], :this]) <= window).any(axis=1)
                first &= (classes[a[x]] != classes[b[y]]) | (classes[a[x]] < 0)
                np.add.at(links, a[x[first]], weight[b[y[first]]])
                np.add.at(links, b[y[first]], weight[a[x[first]]])
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, labels, ids)
        root = least[labels]
        some = np.flatnonzero((root != ids) | (links > 0) | full)
        return pa.table({"id": ids[some], "links": links[some], "root": root[some], "full": full[some]})

    return each.groupBy("pass", "part").applyInArrow(compare, "id long, links long, root long, full boolean")


def _classes(met: DataFrame, full: DataFrame) -> DataFrame:
    """``(id, class)``: the groups that links make, where a vector of the group has a full window."""
    pairs = met.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    parts = cut_lineage(connected_components(pairs))
    dense = parts.join(full.withColumnRenamed("id", "node"), "node").select("component").distinct()
    return parts.join(dense, "component").select(F.col("node").alias("id"), F.col("component").alias("class"))


def _dense(rows: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """``(id, links, root)``: weights linked inside the classes, and roots that unite what is linked.

    Vectors are ordered by their angle to the middle of the class and cut into blocks. Two angles that add up to
    no more than the threshold's are a link, two that lie further apart than it are none; blocks
    meet only where neither settles all pairs.
    """
    limit = math.acos(threshold)
    rows = rows.select("class", "id", "vector", "weight")
    middles = (rows.select("class", "weight", F.posexplode("vector").alias("at", "x"))
               .groupBy("class", "at").agg(F.sum(F.col("x").cast("double") * F.col("weight")).alias("x"))
               .groupBy("class").agg(F.sort_array(F.collect_list(F.struct("at", "x")))["x"].alias("middle")))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, x: s + x)
    across = F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col("middle"), F.col("middle")))
    # a middle of zero says nothing: a right angle leaves all to the products
    cosine = F.when(across > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("vector"), F.col("middle")) / across))).otherwise(0.0)
    rows = _numbered(rows.join(middles, "class").withColumn("angle", F.acos(cosine)).drop("middle"), "class", ["angle", "id"])
    blocks = cut_lineage(rows.withColumn("block", F.floor(F.col("place") / chunk)).drop("place"))
    shape = cut_lineage(blocks.groupBy("class", "block").agg(F.min("angle").alias("low"), F.max("angle").alias("high"),
                                                             F.sum("weight").alias("held"), F.min("id").alias("least")))
    other = shape.select("class", *[F.col(c).alias(f"_{c}") for c in ("block", "low", "high", "held", "least")])
    pairs = cut_lineage(shape.join(other, "class").where("block <= _block"))
    all_linked = F.col("high") + F.col("_high") <= limit - SLACK
    none_linked = (F.col("_low") - F.col("high") > limit + SLACK) | (F.col("low") - F.col("_high") > limit + SLACK)
    # what the vectors of a block get from blocks that are linked to it as a whole, their own included
    sure = pairs.where(all_linked)
    whole = sure.select("class", "block", F.col("_held").alias("gain"), F.col("_least").alias("root"),
                        (F.col("block") == F.col("_block")).alias("own"))
    whole = whole.unionByName(sure.where("block < _block").select(
        "class", F.col("_block").alias("block"), F.col("held").alias("gain"), F.col("least").alias("root"), F.lit(False).alias("own")))
    whole = whole.groupBy("class", "block").agg(F.sum("gain").alias("gain"), F.min("root").alias("root"), F.max("own").alias("own"))
    given = blocks.join(whole, ["class", "block"]).select(
        "id", (F.col("gain") - F.when(F.col("own"), F.col("weight")).otherwise(0)).alias("links"), F.least("id", "root").alias("root"))
    unsure = pairs.where(~all_linked & ~none_linked).select("class", "block", F.col("block").alias("left"), F.col("_block").alias("right"))
    meeting = blocks.join(unsure.unionByName(unsure.where("left < right").withColumn("block", F.col("right"))), ["class", "block"])

    def multiply(table: pa.Table) -> pa.Table:
        ids, weight, block = (table[c].to_numpy() for c in ("id", "weight", "block"))
        low, high = table["left"][0].as_py(), table["right"][0].as_py()
        links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        unit = normalised(by_length(table["vector"])[0][1])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for i in range(0, len(left), 256):
            a = left[i:i + 256]
            b = right[i:] if low == high else right
            near = unit[a] @ unit[b].T >= threshold
            if low == high:
                near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            links[a] += near.astype(np.int64) @ weight[b]
            links[b] += weight[a] @ near.astype(np.int64)
            x, y = np.nonzero(near & (labels[a][:, None] != labels[b][None, :]))
            if len(x):
                merge_labels(labels, a[x], b[y])
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, labels, ids)
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "links": links[some], "root": least[labels[some]]})

    found = meeting.groupBy("class", "left", "right").applyInArrow(multiply, "id long, links long, root long")
    return found.unionByName(given)
