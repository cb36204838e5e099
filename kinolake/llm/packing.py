"""Best-fit packing of documents into bins, with conflicts.

Documents are dealt to shards of bounded size by a hash, and each shard packs its own, largest
first. Open bins are ordered by the room left; the search starts at the smallest sufficient room
and moves to its successors until a bin has neither the document's source nor its duplicate cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.session import cut_lineage

SHARD_ROWS = 4096
SCHEMA = "doc_id long, piece int, bin_id long, start long, length long, bin_offset long, source string, cluster long"


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Bins for ``docs(doc_id, size, source, cluster)``; other columns are ignored.

    Returns a row per piece: words [start, start + length) of the document lie at ``bin_offset`` of
    ``bin_id``. No bin exceeds ``capacity`` or holds two pieces of one source (null is a source, too) or of
    one cluster (null: none). Longer documents are cut: full pieces fill bins of their own, the
    remainder is packed. Every row is placed once, empty documents as a piece of length 0; null
    sizes count as 0 and repeated rows are separate documents, dealt to different shards. An empty table gives no bins.
    """
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                                   F.col("cluster").cast("long").alias("cluster"),
                                   F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")))
    shards = max(1, -(-rows.count() // shard_rows))
    # equal rows travel as one with a number of times, and go to as many shards as there are of them
    equal = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times"))
    spread = F.least("times", F.lit(shards))
    dealt = equal.withColumn("spread", spread).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)))
    dealt = dealt.withColumns({
        "shard": F.pmod(F.pmod(F.xxhash64("doc_id", "cluster", "size"), F.lit(shards)) + F.col("copy"), F.lit(shards)),
        "times": F.expr("times div spread") + (F.col("copy") < F.col("times") % F.col("spread")).cast("long")}).drop("copy", "spread")

    def pack(table: pa.Table) -> pa.Table:
        base = table["shard"][0].as_py() << 32
        rows = table.select(["doc_id", "source", "cluster", "size", "times"]).to_pylist()
        items = sorted((r for r in rows for _ in range(r["times"])), key=lambda r: (
            -(r["size"] % capacity), r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["size"]))
        shelf, out = Shelf(capacity, items), []
        for item in items:
            full, rest = divmod(item["size"], capacity)
            for piece in range(full):
                out.append((item, piece, shelf.full_bin(), piece * capacity, capacity, 0))
            if rest or not full:
                at, offset = shelf.place(item, rest)
                out.append((item, full, at, full * capacity, rest, offset))
        columns = list(zip(*[(i["doc_id"], piece, base + at, start, length, offset, i["source"], i["cluster"])
                             for i, piece, at, start, length, offset in out]))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    return dealt.groupBy("shard").applyInArrow(pack, SCHEMA)


class Shelf:
    """Open bins by room left, each with a bitmap of sources and one of clusters."""

    def __init__(self, capacity: int, items: list[dict]):
        self.capacity = capacity
        self.source_bit: dict = {}
        self.cluster_bit: dict = {}
        counts: dict = {}
        for item in items:
            self.source_bit.setdefault(item["source"], 1 << len(self.source_bit))
            counts[item["cluster"]] = counts.get(item["cluster"], 0) + 1
        for cluster, count in counts.items():
            # a cluster met once cannot conflict and needs no bit
            self.cluster_bit[cluster] = 1 << len(self.cluster_bit) if cluster is not None and count > 1 else 0
        self.order: list[tuple[int, int]] = []  # (room, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def full_bin(self) -> int:
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.sources) - 1

    def place(self, item: dict, size: int) -> tuple[int, int]:
        source, cluster = self.source_bit[item["source"]], self.cluster_bit[item["cluster"]]
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, bin_ = self.order[at]
            if not (self.sources[bin_] & source or self.clusters[bin_] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            bin_, room = self.full_bin(), self.capacity
        self.sources[bin_] |= source
        self.clusters[bin_] |= cluster
        insort(self.order, (room - size, bin_))
        return bin_, self.capacity - room
