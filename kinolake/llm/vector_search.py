"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector's code is the signs of its rotated coordinates, packed into 64-bit words, with two scalars:
its length and the inner product of its direction with its code. Inner products with a query,
whose rotated coordinates are quantised to a few bits, are estimated from bit counts, and the
scalars bound the error. A block of candidates ranks the best estimates exactly, and then every other
vector whose upper bound reaches the current k-th score. All vectors are coded and scanned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.llm.vectors import by_length, usable_vectors
from kinolake.session import cut_lineage

QUERY_BITS = 6
QUERIES_AT_ONCE = 64
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 1 << 16


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", bound: float = 2.5, seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of every query row.

    ``bound`` is the number of standard errors by which a vector may exceed its estimate and still be
    ranked. Scores are exact, in double precision; ties go to the smaller id; a query's own id is no
    candidate. Null, empty, zero and non-finite vectors and null ids take no part, and rows that
    share an id are one vector, the smallest. Only vectors of equal length are compared. Other
    columns of the input are ignored.
    """
    base = cut_lineage(usable_vectors(candidates, id_col, vector_col))
    asked = cut_lineage(usable_vectors(queries, id_col, vector_col))
    spark = base.sparkSession
    slots = max(-(-base.count() // CANDIDATE_BLOCK), spark.sparkContext.defaultParallelism)
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    # every block of queries meets every block of candidates
    left = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    right = base.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def search(ask: pa.Table, have: pa.Table) -> pa.Table:
        out_ids, out_best, out_scores = [], [], []
        if ask.num_rows and have.num_rows:
            have_ids, ask_ids = have["id"].to_numpy(), ask["id"].to_numpy()
            shelves = {m.shape[1]: (have_ids[r], m) for r, m in by_length(have["vector"])}
            for rows, matrix in by_length(ask["vector"]):
                if matrix.shape[1] not in shelves:
                    continue
                ids, base_matrix = shelves[matrix.shape[1]]
                order = np.argsort(ids)
                index = OneBitIndex(base_matrix[order], seed)
                for row, query in zip(rows.tolist(), index.search(matrix, k, bound, ids[order], ask_ids[rows])):
                    out_ids.append(ask_ids[row])
                    out_best.append(query[0])
                    out_scores.append(query[1])
        return pa.table({"query_id": pa.array(out_ids, pa.int64()),
                         "best": pa.array(out_best, pa.list_(pa.int64())),
                         "scores": pa.array(out_scores, pa.list_(pa.float64()))})

    found = (left.groupBy("group", "slot").cogroup(right.groupBy("group", "slot"))
             .applyInArrow(search, "query_id long, best array<long>, scores array<double>"))
    pairs = F.transform(F.arrays_zip("best", "scores"), lambda x: F.struct((-x["scores"]).alias("far"),
                                                                          x["best"].alias("vec_id")))
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"),
        (F.lit(0.0) - F.col("x.far")).alias("score"))


class OneBitIndex:
    """Codes of the rows of a matrix; ``search`` yields ids and exact scores of the best rows."""

    def __init__(self, vectors: np.ndarray, seed: int):
        self.vectors = vectors
        size = vectors.shape[1]
        self.width = -(-size // 64) * 64
        noise = np.random.default_rng((seed, self.width)).standard_normal((self.width, self.width))
        self.rotation = np.linalg.qr(noise)[0][:size]
        rotated = vectors @ self.rotation
        self.length = np.sqrt((vectors * vectors).sum(axis=1))
        signs = rotated > 0
        self.codes = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        self.ones = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int32)
        # inner product of a vector's direction with its code, a unit vector
        self.match = np.abs(rotated).sum(axis=1) / (self.length * np.sqrt(self.width))
        self.spread = np.sqrt(np.maximum(1 - self.match ** 2, 0) / (self.match ** 2 * max(self.width - 1, 1)))

    def search(self, queries: np.ndarray, k: int, bound: float, ids: np.ndarray, own: np.ndarray):
        for first in range(0, len(queries), QUERIES_AT_ONCE):
            some = queries[first:first + QUERIES_AT_ONCE]
            estimate = self._estimate(some @ self.rotation)
            margin = bound * (self.spread * self.length)[None, :] * np.sqrt((some * some).sum(axis=1))[:, None]
            for i, query in enumerate(some):
                yield self._rank(query, estimate[i], margin[i], k, ids, own[first + i])

    def _estimate(self, rotated: np.ndarray) -> np.ndarray:
        """Estimated inner products from bit counts of codes and quantised queries."""
        low = rotated.min(axis=1, keepdims=True)
        step = np.maximum((rotated.max(axis=1, keepdims=True) - low) / (2 ** QUERY_BITS - 1), 1e-300)
        levels = np.rint((rotated - low) / step).astype(np.uint8)
        counts = np.zeros((len(rotated), len(self.codes)), np.int32)
        for j in range(QUERY_BITS):
            planes = np.packbits(levels >> j & 1, axis=1, bitorder="little").view(np.uint64)
            for word in range(self.width // 64):
                counts += np.bitwise_count(planes[:, word, None] & self.codes[None, :, word]).astype(np.int32) << j
        total = levels.sum(axis=1, dtype=np.int64)[:, None] * step + self.width * low
        inside = counts * step + self.ones[None, :] * low  # sum of the query's values where the code is one
        return (2 * inside - total) * (self.length / (self.match * np.sqrt(self.width)))[None, :]

    def _rank(self, query, estimate, margin, k, ids, own):
        others = ids != own
        upper = np.where(others, estimate + margin, -np.inf)
        first = min(4 * k, len(ids))
        lead = np.argpartition(-np.where(others, estimate, -np.inf), first - 1)[:first]
        lead = lead[others[lead]]
        score = np.sort((self.vectors[lead] * query).sum(axis=1))
        limit = score[-k] if len(score) >= k else -np.inf
        pick = np.union1d(lead, np.flatnonzero(others & (upper >= limit)))
        score = (self.vectors[pick] * query).sum(axis=1)
        best = np.lexsort((ids[pick], -score))[:k]
        return ids[pick[best]], score[best]
