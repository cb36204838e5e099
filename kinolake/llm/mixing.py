"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Capacity flows from
patterns to the quotas of their sources; the n-th use of a pattern's words costs more than the
one before, so nothing repeats while fresh words are left. Within a pattern, whole repeats go to
all documents, and the rest to documents in the order of a seeded hash.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolake.session import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3  # hex digits of the seeded hash that form a bucket
BROADCAST_PATTERNS = 10_000
PATTERN, BUCKET = "_llm_pattern", "_llm_bucket"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[int], most: int) -> list[Fraction]:
    """Shares of the total size by weight, none above ``most`` times its size, the excess reshared."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        level = Fraction(rest, weight) if weight else Fraction(0)
        over = {i for i, w in enumerate(weights) if i not in capped and w * level > most * sizes[i]}
        if not over:
            return [Fraction(most * sizes[i]) if i in capped else w * level for i, w in enumerate(weights)]
        capped |= over


def route(supply: list[int], members: list[list[int]], quotas: list[int], most: int) -> list[list[int]]:
    """Words of each pattern for each of its sources: a flow of most words at the least repetition.

    Only the uses of a pattern have costs, rising with each use, so the uses are opened one after
    the other and the flow is completed by augmenting paths in between; a path may move words
    between sources, but never takes back words of an earlier use.
    """
    flow = [[0] * len(m) for m in members]
    left = list(quotas)
    feeders: list[list[tuple[int, int]]] = [[] for _ in quotas]
    for p, m in enumerate(members):
        for k, s in enumerate(m):
            feeders[s].append((p, k))
    for _ in range(most):
        spare = list(supply)
        for p in range(len(members)):
            while spare[p]:
                # breadth first from the pattern to a source below its quota
                parent, found, queue, seen = {}, None, deque([p]), {p}
                while queue and found is None:
                    q = queue.popleft()
                    for k, s in enumerate(members[q]):
                        if ("s", s) in parent:
                            continue
                        parent["s", s] = (q, k)
                        if left[s]:
                            found = s
                            break
                        for r, j in feeders[s]:
                            if r not in seen and flow[r][j]:
                                seen.add(r)
                                parent["p", r] = (s, j)
                                queue.append(r)
                if found is None:
                    break
                path, s = [], found
                while True:
                    q, k = parent["s", s]
                    path.append((q, k, 1))
                    if q == p:
                        break
                    s, j = parent["p", q]
                    path.append((q, j, -1))
                amount = min([spare[p], left[found], *(flow[q][k] for q, k, sign in path if sign < 0)])
                for q, k, sign in path:
                    flow[q][k] += sign * amount
                spare[p] -= amount
                left[found] -= amount
    return flow


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17,
                id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """The documents with ``size`` and ``taken`` (words, repeats counted), and the plan per source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total size; targets
    above ``most`` times a source's size are cut and reshared. ``sources`` is an array column for
    overlapping sources (default: the column ``source``). A document is taken whole or not at all, at most
    ``most`` times, so a pattern comes within half a document of its flow. Null texts have size 0;
    repeated rows are separate documents. Input columns named ``size`` or ``taken`` are replaced. The
    plan (source, source_size, target, routed) has one row per source; it and the flow's patterns are
    what passes through the driver, never documents.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "taken")
    member = F.array("source") if sources is None else sources
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = (docs.withColumn("size", word_count(F.col(text_col)))
             .withColumn(PATTERN, F.to_json(F.array_sort(F.array_distinct(member))))
             .withColumn("_llm_order", digest).withColumn(BUCKET, F.substring("_llm_order", 1, BUCKET_DIGITS)))
    sums = cut_lineage(sized.withColumn("_llm_member", F.array_distinct(member)).groupBy(PATTERN, BUCKET).agg(
        F.sum("size").alias("size"), F.first("_llm_member").alias("member")))
    patterns = sums.groupBy(PATTERN).agg(F.sum("size").alias("size"), F.first("member").alias("member")).orderBy(PATTERN)
    rows = patterns.collect()
    names = sorted({s for r in rows for s in r["member"]}, key=lambda s: (s is None, (s or "").encode()))
    index = {s: i for i, s in enumerate(names)}
    members = [sorted(index[s] for s in r["member"]) for r in rows]
    sizes = [0] * len(names)
    for r, m in zip(rows, members):
        for s in m:
            sizes[s] += r["size"]
    total = sum(r["size"] for r in rows)
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most)
    if sum(sizes) > total:  # overlapping sources count words twice: scale to the words there are
        targets = [t * total / sum(sizes) for t in targets]
    flow = route([r["size"] for r in rows], members, [int(t) for t in targets], most)
    routed = [0] * len(names)
    for m, f in zip(members, flow):
        for s, words in zip(m, f):
            routed[s] += words
    # Arrow tables become rows inside the JVM, without Python workers
    plan = spark.createDataFrame(pa.table({
        "source": pa.array(names, pa.string()), "source_size": pa.array(sizes, pa.int64()),
        "target": pa.array([float(t) for t in targets], pa.float64()), "routed": pa.array(routed, pa.int64())}))
    uses = [divmod(sum(f), r["size"]) if r["size"] else (0, 0) for r, f in zip(rows, flow)]
    shares = spark.createDataFrame(pa.table({
        PATTERN: pa.array([r[PATTERN] for r in rows], pa.string()), "whole": pa.array([w for w, _ in uses], pa.int64()),
        "rest": pa.array([x for _, x in uses], pa.int64())}))
    # the bucket in which the rest runs out, and the words of the pattern before it
    before = F.expr(f"sum(size) OVER (PARTITION BY {PATTERN} ORDER BY {BUCKET})") - F.col("size")
    edge = (sums.withColumn("before", before).join(shares, PATTERN)
            .where("before <= rest AND rest < before + size").select(PATTERN, F.col(BUCKET).alias("edge"), "before"))
    settings = shares.join(edge, PATTERN, "left")
    # one row per pattern: its size is known, so a catalog of modest size may be broadcast
    planned = sized.join(F.broadcast(settings) if len(rows) <= BROADCAST_PATTERNS else settings, PATTERN)
    last = planned.where(F.col(BUCKET) == F.col("edge"))
    place = F.expr(f"sum(size) OVER (PARTITION BY {PATTERN} ORDER BY _llm_order, {id_col}, size "
                   "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    last = last.withColumn("extra", 2 * (F.col("before") + place) - F.col("size") <= 2 * F.col("rest"))
    others = planned.where(F.col("edge").isNull() | (F.col(BUCKET) != F.col("edge"))).withColumn(
        "extra", F.col("edge").isNotNull() & (F.col(BUCKET) < F.col("edge")))
    taken = (F.col("whole") + F.col("extra").cast("long")) * F.col("size")
    chosen = last.unionByName(others).withColumn("taken", taken)
    return chosen.select(*docs.columns, "size", "taken"), plan
