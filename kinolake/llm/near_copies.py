"""Near copies beyond the reach of one fingerprint: SimHash views of a text, then an exact check.

One 64-bit fingerprint of word shingles links texts of nearly equal shingles; copies at a similarity of
0.8 lie more than two bits apart. Here each text gets several fingerprints of its different words,
each with a seed of its own. In every view the Gray-ordered index links fingerprints within two
bits, which gives groups of candidates; each text is compared with one of them by its shingles of five
words first. Groups that this leaves apart are compared in full, block by block: texts as alike as asked
share one of their rarest shingles there, so only those that share one are counted, and no alike pair
of a group is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.llm.blocks import GOLDEN, mix, utf8, word_hashes
from kinolake.llm.components import connected_components
from kinolake.llm.simhash_dedup import _LOWER, WORD, fingerprint_links
from kinolake.session import cut_lineage

VIEWS = 12
KEY = "_llm_key"
BLOCKS = 16  # of a group, between the least and the largest size of a block
BLOCK_BYTES = 128 << 10, 4 << 20
TEXT_BYTES = 256  # what a text weighs beside its shingles
TASK_BYTES = 16 << 20


def drop_near_copies(docs: DataFrame, key: str, similarity: float = 0.8, shingle: int = 5, views: int = VIEWS,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies found: of each component the row with the smallest id stays.

    ``key`` is a long that no two rows share. Two rows link if the views bring them together, directly or
    through others, and their sets of ``shingle``-word shingles (A-Z lower-cased) have a Jaccard
    similarity of at least ``similarity``; texts of fewer words count as one shingle. Null and empty
    texts link with nothing; null ids stay last. An empty table gives an empty result.
    """
    links = cut_lineage(near_links(docs, key, similarity, shingle, views, text_col))
    groups = connected_components(links).withColumnRenamed("node", KEY)
    named = docs.select(F.col(key).alias(KEY), F.col(id_col).alias("id")).join(groups, KEY)
    place = F.struct(F.col("id").isNull(), "id", KEY)
    first = named.groupBy("component").agg(F.min(place).alias("first")).select("component", F.col(f"first.{KEY}").alias("kept"))
    gone = named.join(first, "component").where(F.col(KEY) != F.col("kept")).select(F.col(KEY).alias(key))
    return docs.join(gone, key, "left_anti")


def near_links(docs: DataFrame, key: str, similarity: float = 0.8, shingle: int = 5, views: int = VIEWS,
               text_col: str = "text") -> DataFrame:
    """``(a, b)``: links that connect just the texts which views bring together and whose shingles are alike enough."""
    texts = docs.select(F.col(key).alias(KEY), F.col(text_col).alias("text"))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            keys, raw = batch.column(KEY).to_numpy(), [t.translate(_LOWER) for t in utf8(batch.column("text"))]
            hashes, counts = word_hashes(raw)
            ends = np.cumsum(counts)
            out = np.zeros((len(keys), views), np.uint64)
            for i, (a, b) in enumerate(zip(ends - counts, ends)):
                out[i] = _views(np.unique(hashes[a:b]), views)
            some = np.flatnonzero(counts > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(keys[some], views)), pa.array(np.tile(np.arange(views), len(some))),
                 pa.array(out[some].view(np.int64).ravel())], names=[KEY, "view", "fingerprint"])

    placed = cut_lineage(texts.mapInArrow(fingerprints, f"{KEY} long, view long, fingerprint long"))
    # a fingerprint is spoken for by its smallest key; the others are compared with that one
    leaders = cut_lineage(placed.groupBy("view", "fingerprint").agg(F.min(KEY).alias("leader"), F.count(KEY).alias("n")))
    same = (placed.join(leaders.where("n > 1").select("view", "fingerprint", "leader"), ["view", "fingerprint"])
            .where(F.col(KEY) != F.col("leader")).select(F.col(KEY).alias("a"), F.col("leader").alias("b")))
    near = fingerprint_links(leaders.select("view", "fingerprint"), by_view=True)
    ends = [leaders.select("view", F.col("fingerprint").alias(c), F.col("leader").alias(f"key_{c}")) for c in "ab"]
    near = (near.join(ends[0], ["view", "a"]).join(ends[1], ["view", "b"])
            .select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))
    pairs = same.unionByName(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = cut_lineage(pairs)
    # each text meets one candidate first; that closes most groups
    first = pairs.groupBy("a").agg(F.min("b").alias("b"))
    links = cut_lineage(_alike(first, texts, similarity, shingle))
    return links.unionByName(_missed(pairs, links, texts, similarity, shingle))


def _missed(pairs: DataFrame, links: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links between texts that ``pairs`` connect and ``links`` leave apart.

    The texts of a group lie in blocks, and each pair of blocks meets in a cell of its own, which compares the texts
    there and sends on only what connects them, so no pair of texts becomes a row.
    """
    groups = connected_components(pairs).select(F.col("node").alias(KEY), F.col("component").alias("group"))
    known = connected_components(links).select(F.col("node").alias(KEY), "component")
    placed = cut_lineage(groups.join(known, KEY, "left").withColumn("component", F.coalesce("component", KEY)))
    # the one pair of a group of two has been compared
    open_groups = placed.groupBy("group").agg(F.count(KEY).alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
    placed = cut_lineage(placed.join(open_groups.where("n > 2 AND x <> y").select("group"), "group"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            packed = [_shingles(text, shingle).tobytes() for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (KEY, "group", "component")), pa.array(packed, pa.binary())],
                                             names=[KEY, "group", "component", "parts"])

    packed = cut_lineage(texts.join(placed.select(KEY, "group", "component"), KEY)
                         .select(KEY, "group", "component", "text")
                         .mapInArrow(sets, f"{KEY} long, group long, component long, parts binary"))
    weight = F.sum(F.octet_length("parts") + F.lit(TEXT_BYTES))
    blocks = F.least(F.ceil(F.col("weight") / BLOCK_BYTES[0]), F.greatest(F.lit(BLOCKS), F.ceil(F.col("weight") / BLOCK_BYTES[1])))
    sizes = cut_lineage(packed.groupBy("group").agg(weight.alias("weight")).select("group", "weight", blocks.cast("int").alias("blocks")))
    total = sizes.agg(F.sum(F.col("weight") * F.col("blocks"))).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_BYTES))
    cells = (packed.join(sizes.select("group", "blocks"), "group")
             .withColumn("block", F.pmod(F.xxhash64(KEY), F.col("blocks")).cast("int"))
             .withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("group", F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"),
                     "block", KEY, "component", "parts"))

    def compare(cell: pa.Table) -> pa.Table:
        a, b = _cell_links(cell, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # in ranges, as cells of a large group are many and alike in size; a cell is never cut
    return (cells.repartitionByRange(tasks, "group", "low", "high").groupBy("group", "low", "high")
            .applyInArrow(compare, "a long, b long"))


def _cell_links(cell: pa.Table, similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect the alike texts of two blocks (or of one) as far as their components leave them apart.

    An alike pair shares at least ``similarity`` of either text's shingles, so in any order of the
    shingles it shares one of the first of both, up to one more than either may lack. In the order of
    frequency in the cell these are rare, and shingles of one text alone take up places for nothing.
    """
    cell = cell.combine_chunks()
    keys, block = cell[KEY].to_numpy(), cell["block"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in cell["parts"].to_pylist()]
    size = np.array([len(x) for x in sets], np.int64)
    label = np.unique(cell["component"].to_numpy(), return_inverse=True)[1]
    if label.max() == 0:
        return [], []
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    some = often[ids] > 1  # a shingle of one text alone is in no pair
    ids, owner = ids[some], owner[some]
    order = np.lexsort((ids, often[ids], owner))
    ids, owner = ids[order], owner[order]
    count = np.bincount(owner, minlength=len(sets))
    start = np.concatenate(([0], np.cumsum(count)))
    # as many as a text may lack and one, less those no other text has
    first = size - np.ceil(size * similarity - 1e-6).astype(np.int64) + 1 - (size - count)
    ahead = np.flatnonzero(np.arange(len(ids)) - start[owner] < first[owner])
    ahead = ahead[np.argsort(ids[ahead], kind="stable")]
    post, bounds = owner[ahead], np.searchsorted(ids[ahead], np.arange(len(often) + 1))
    one = cell["low"][0].as_py() == cell["high"][0].as_py()
    left = np.arange(len(sets)) if one else np.flatnonzero(block == block.min())
    mark, out = np.zeros(len(often), bool), ([], [])
    for x in left:
        mine = ids[start[x]:start[x + 1]]
        lists = [post[bounds[i]:bounds[i + 1]] for i in mine[:max(int(first[x]), 0)]]
        near = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        near = near[near > x] if one else near[block[near] != block[x]]
        near = near[label[near] != label[x]]
        near = near[np.minimum(size[near], size[x]) >= np.maximum(size[near], size[x]) * similarity - 1e-6]
        mark[mine] = True
        for y in near:
            if label[y] == label[x]:
                continue
            common = int(np.count_nonzero(mark[ids[start[y]:start[y + 1]]]))
            if common >= similarity * (size[x] + size[y] - common):
                label[label == label[y]] = label[x]
                out[0].append(int(keys[x]))
                out[1].append(int(keys[y]))
        mark[mine] = False
    return out


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs whose texts are alike enough; only shingles of texts that meet a candidate travel."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            packed = [_shingles(text, shingle).tobytes() for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(packed, pa.binary())], names=["key", "parts"])

    def met(end: str, name: str) -> DataFrame:
        some = pairs.select(F.col(end).alias(KEY)).distinct()
        return texts.join(some, KEY, "left_semi").mapInArrow(sets, f"{end} long, {name} binary")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            fine = []
            for x, y in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                fine.append(common >= similarity * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(fine, pa.bool_()))

    both = pairs.join(met("a", "one"), "a").join(met("b", "other"), "b").select("a", "b", "one", "other")
    return both.mapInArrow(check, "a long, b long")


def _small(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Some texts at a time, as they are held several times over."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _views(words: np.ndarray, views: int) -> np.ndarray:
    out, seeds = np.zeros(views, np.uint64), np.arange(1, views + 1, dtype=np.uint64) * GOLDEN
    for v in range(views if len(words) else 0):
        ones = np.zeros(64, np.int64)
        for first in range(0, len(words), 1 << 16):
            bits = mix(words[first:first + (1 << 16)] + seeds[v])
            ones += np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[v] = np.packbits(ones * 2 > len(words), bitorder="little").view(np.uint64)[0]
    return out


def _shingles(text: bytes, size: int) -> np.ndarray:
    """Hashes of the different shingles of a text, in order."""
    words = WORD.findall(text.translate(_LOWER))
    parts = {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts)))
