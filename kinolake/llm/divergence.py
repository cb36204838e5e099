"""How the sources of a language differ in their terms, by row accumulation over a term-major index.

Terms are counted per (language, source) inside the tasks that read the texts. The kept counts form a sparse
matrix of groups by terms, cut into buckets of terms. A task holds one bucket as an index from a term to its
groups; each group walks through its own terms and scatters what it shares with other groups into a dense
accumulator with one place per peer, so no pair of postings is ever a row. Terms that one of two groups lacks
are not visited: their sum comes from how often each count occurs in a group, against the peer's
probability of an absent term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolake.llm.blocks import group_bounds
from kinolake.session import scratch_path

SCALE = 1_000_000_000
TILE = 1024  # groups of a language that meet as rows or as peers in one task
BUCKET_POSTINGS = 100_000  # counts of one language in a bucket of terms, or as many as its pairs of sources
STEP = 1 << 20  # places scattered at once
HELD = 400_000  # different counts that a task holds before it passes them on
# bytes outside letters and non-ASCII characters end a term; A-Z become a-z
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The lower-cased terms of a text in UTF-8: runs of A-Z, a-z and characters beyond ASCII."""
    return raw.translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the term, per group.

    Every group also has one row with a null term. Null texts, languages and sources count as ''.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                          for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def rows(held) -> pa.RecordBatch:
        langs, sources, terms, n, some = [], [], [], [], []
        for (lang, source), (counts, docs_with) in held.items():
            langs += [lang] * (len(counts) + 1)
            sources += [source] * (len(counts) + 1)
            terms += [None, *counts]
            n += [0, *counts.values()]
            some += [0, *map(docs_with.__getitem__, counts)]
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
             pa.array(n, pa.int64()), pa.array(some, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            size = 0
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                counts, docs_with = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms_of(text.as_py())
                counts.update(found)
                docs_with.update(set(found))
                size += len(found)
                if size > HELD and sum(len(c) for c, _ in held.values()) > HELD:
                    yield rows(held)
                    held, size = {}, 0
            if sum(len(c) for c, _ in held.values()) > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    found = plain.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kinds: Column) -> Column:
    """``1 + floor(1000000000 * (n + 1) / (total + kinds))``, exactly."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"),
                           (total + kinds).cast("decimal(20,0)")) + 1


def shares(n: np.ndarray, total: np.ndarray, kinds: int) -> np.ndarray:
    """As :func:`share`; long division, three digits at a time, stays inside 64 bits."""
    below = total + kinds
    rest, out = n + 1, np.zeros_like(below)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                  min_docs: int = 3, top: int = 200, tile: int = TILE, bucket_postings: int = BUCKET_POSTINGS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: what sets each source of a language apart.

    Each language keeps the V terms found in at least ``min_docs`` of its rows. With p and q the smoothed shares of a
    term (see :func:`share`) and f = floor((p - q)^2 / q), part ``pair`` has the sum of f over all kept terms against
    each other source of the language, and part ``term`` the ``top`` terms that a source has more often than its
    language. Ranks run from 1 by descending value, ties by item in UTF-8 order. ``tile`` and ``bucket_postings`` only
    bound the tasks.

    Null texts, languages and sources count as ''. Sources without kept terms take part with counts of zero; where a
    language keeps no term, pairs have value 0 and there are no terms. Rows that repeat are documents of
    their own. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "term-counts")
    term_counts(docs, lang_col, source_col, text_col).write.parquet(path)
    counts = spark.read.parquet(path)
    kept = (counts.where("term IS NOT NULL").groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
            .select("lang", "term", "lang_n"))
    path = scratch_path(spark, "postings")
    counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]).write.parquet(path)
    postings = spark.read.parquet(path)
    path = scratch_path(spark, "groups")
    _groups(counts, postings, tile, bucket_postings).write.parquet(path)
    placed = postings.join(spark.read.parquet(path), ["lang", "source"])

    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("lang_n"), F.col("lang_total"), F.col("kinds"))
    terms = (placed.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value")))
    pairs = _pairs(placed, spark.read.parquet(path)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        return rows.withColumn("rank", F.row_number().over(order))

    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def _groups(counts: DataFrame, postings: DataFrame, tile: int, bucket_postings: int) -> DataFrame:
    """Per group: occurrences of kept terms, those of the language, V, and the place among the groups of the language."""
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("n").alias("size"))
    whole = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("size").alias("size"))
    kinds = postings.select("lang", "term").distinct().groupBy("lang").agg(F.count("term").alias("kinds"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = (counts.where("term IS NULL").select("lang", "source").join(own.drop("size"), ["lang", "source"], "left")
              .join(whole, "lang", "left").join(kinds, "lang", "left"))
    # as many rows per language as it has sources
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("tiles", F.floor(F.max("place").over(Window.partitionBy("lang")) / tile) + 1)
    # a bucket has no fewer counts than the pairs of sources that it gives back
    groups = groups.withColumn("pairs", F.pow(F.max("place").over(Window.partitionBy("lang")) + 1, F.lit(2)))
    buckets = F.greatest(F.lit(1), F.ceil(F.coalesce("size", F.lit(0)) / F.greatest(F.lit(bucket_postings), "pairs"))).alias("buckets")
    return groups.select("lang", "source", *map(zero, ("total", "lang_total", "kinds")),
                         F.floor(F.col("place") / tile).alias("tile"), (F.col("place") % tile).alias("slot"), "tiles", buckets)


def _pairs(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for all pairs of sources of a language."""
    spread = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumns(
        {"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    keys = ["lang", "bucket", "low", "high"]
    entries = spread(placed.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")))).select(
        *keys, "tile", "slot", "term", "n")
    members = spread(groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))).select(
        *keys, "tile", "slot", "source", "total", "kinds")

    def accumulate(table: pa.Table, here: pa.Table) -> pa.Table:
        lang, bucket = here["lang"][0], here["bucket"][0].as_py()
        low, high, kinds = (here[c][0].as_py() for c in ("low", "high", "kinds"))
        tiles = here["tile"].to_numpy()
        side = {}
        term = table["term"].combine_chunks().dictionary_encode() if table.num_rows else None
        for t in {low, high}:
            own = here.filter(pa.array(tiles == t)).sort_by("slot")
            total = own["total"].to_numpy()
            if kinds == 0:  # a language without kept terms
                side[t] = (own["source"].to_pylist(), total, None, None)
                continue
            some = np.flatnonzero(table["tile"].to_numpy() == t)
            slots = table["slot"].to_numpy()[some]
            p = shares(table["n"].to_numpy()[some], total[slots], kinds)
            ids = term.indices.to_numpy()[some] if term is not None else np.zeros(0, np.int64)
            side[t] = own["source"].to_pylist(), shares(np.zeros_like(total), total, kinds), (slots, ids, p), total
        out = {"source": [], "item": [], "value": []}
        for a, b in {(low, high), (high, low)}:
            names, absent, own, _ = side[a]
            peers, base, index, _ = side[b]
            value = np.zeros((len(names), len(peers)), np.int64)
            if kinds:
                value = _scatter(own, absent, index, base)
                if bucket == 0:
                    value += kinds * excess(absent[:, None], base[None, :])
            keep = ~np.eye(len(names), dtype=bool).ravel() if a == b else np.ones(value.size, bool)
            out["source"].append(np.repeat(np.array(names, object), len(peers))[keep])
            out["item"].append(np.tile(np.array(peers, object), len(names))[keep])
            out["value"].append(value.ravel()[keep])
        n = sum(map(len, out["value"]))
        return pa.table({"lang": pa.array([lang.as_py()] * n, pa.string()),
                         "source": pa.array(np.concatenate(out["source"]), pa.string()),
                         "item": pa.array(np.concatenate(out["item"]), pa.string()),
                         "value": pa.array(np.concatenate(out["value"]))})

    parts = entries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(
        accumulate, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _scatter(rows, absent: np.ndarray, index, base: np.ndarray) -> np.ndarray:
    """What the terms of a bucket add to ``kinds * excess(absent, base)``, group by peer.

    ``rows`` and ``index`` are (group, term, share); ``absent`` and ``base`` the shares of terms that a group or peer
    lacks. Sums may wrap on the way; the end result fits 64 bits.
    """
    slots, ids, p = rows
    peer, peer_ids, q = index
    none = excess(absent[:, None], base[None, :])
    out = np.zeros(none.shape, np.int64)
    # terms of one side only, as if the other side lacked them all
    for g, value, times in _repeated(slots, p):
        out[g] += (times[:, None] * (excess(value[:, None], base[None, :]) - none[g])).sum(axis=0)
    for h, value, times in _repeated(peer, q):
        out[:, h] += (times[:, None] * (excess(absent[None, :], value[:, None]) - none[:, h])).sum(axis=0)
    # shared terms: each group walks through the index and adds up per peer
    order = np.argsort(peer_ids, kind="stable")
    peer, peer_ids, q = peer[order], peer_ids[order], q[order]
    first, last = np.searchsorted(peer_ids, ids, "left"), np.searchsorted(peer_ids, ids, "right")
    by_group = np.lexsort((ids, slots))
    cut = group_bounds(slots[by_group])
    for a, b in zip(cut[:-1], cut[1:]):
        mine = by_group[a:b]
        g, width = slots[mine[0]], last[mine] - first[mine]
        ends = np.cumsum(width)
        at = 0
        while at < len(mine):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            some, wide = mine[at:to], width[at:to]
            place = np.repeat(first[some] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
            mine_p, h, their_q = np.repeat(p[some], wide), peer[place], q[place]
            np.add.at(out[g], h, excess(mine_p, their_q) - excess(mine_p, base[h])
                      - excess(absent[g], their_q) + none[g, h])
            at = to
    return out


def _repeated(slots: np.ndarray, values: np.ndarray):
    """Per group its different values and how often each occurs, some thousand at a time."""
    order = np.lexsort((values, slots))
    slots, values = slots[order], values[order]
    cut = np.flatnonzero(np.concatenate(([True], (slots[1:] != slots[:-1]) | (values[1:] != values[:-1])))) if len(slots) else []
    times = np.diff(np.append(cut, len(slots)))
    heads, kept = slots[cut], values[cut]
    bounds = group_bounds(heads)
    for a, b in zip(bounds[:-1], bounds[1:]):
        for i in range(a, b, 2048):
            yield heads[a], kept[i:min(b, i + 2048)], times[i:min(b, i + 2048)]
