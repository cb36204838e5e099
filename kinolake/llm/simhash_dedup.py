"""SimHash near-duplicates: 64-bit fingerprints, linked exactly with a Gray-ordered index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinolake.llm.blocks import utf8
from kinolake.llm.components import connected_components
from kinolake.llm.gray_index import GrayIndex, gray_rank, merge_labels
from kinolake.session import cut_lineage

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SHINGLES_AT_ONCE = 1 << 16
PARTS = 64  # numbers of keys per view; 42 are in use
LARGE_KEY = 4096  # fingerprints that share half their bits; more are split by further bits


def fingerprint_documents(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42,
                          name: str = "fingerprint") -> DataFrame:
    """Adds the SimHash of every whole text as a long (its 64 bits).

    A-Z is lower-cased; shingles are ``shingle`` consecutive words with repeats, or all words where
    there are fewer; a bit is set if more than half of the XXH64 values have it. No words (empty,
    null): zero. An input column called like the result is replaced.
    """
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t, shingle, seed) for t in utf8(batch.column(text_col))], np.uint64)
            yield batch.append_column(name, pa.array(values.view(np.int64), pa.int64()))

    return docs.mapInArrow(add, schema)


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    words = WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    parts = zip(*(islice(words, j, None) for j in range(shingle)))
    hashes = map(lambda x: xxhash.xxh64_intdigest(x, seed), map(b" ".join, parts))
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for _ in range(0, n, SHINGLES_AT_ONCE):
        h = np.fromiter(islice(hashes, SHINGLES_AT_ONCE), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_links(prints: DataFrame, distance: int = 2, large_key: int = LARGE_KEY, by_view: bool = False) -> DataFrame:
    """Links (a, b) that connect just the distinct fingerprints at most ``distance`` (0 to 2) bits apart.

    Fingerprints are cut into four words of 16 bits; two with at most two differing bits agree in at
    least two words, so they meet under one of six keys. Keys shared by more than ``large_key``
    fingerprints are split again: the other 32 bits are cut into four bytes, of which two must
    agree as well, so at most 2^16 fingerprints can share such a key. Under each key, the
    Gray-ordered index finds all pairs; only a spanning set of links leaves the task. With ``by_view``,
    fingerprints link only within their ``view`` (a small number from 0), which the result carries.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    view = F.col("view").cast("long") if by_view else F.lit(0).cast("long")
    prints = cut_lineage(prints.select("fingerprint", view.alias("view")).where("fingerprint IS NOT NULL").distinct())
    keys = [_mask(pair, 16) for pair in combinations(range(4), 2)]
    first = prints.select("fingerprint", "view", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in keys]))
                          .alias("part", "key")).withColumn("part", F.col("part") + F.col("view") * PARTS).drop("view")
    sizes = first.groupBy("part", "key").agg(F.count("key").alias("size")).where("size > 1")
    first = first.join(sizes, ["part", "key"])
    inner = F.array(*[F.array(*[F.lit(_signed(_unsigned(m) | _finer(m, pair))) for pair in combinations(range(4), 2)])
                      for m in keys])
    finer = (first.where(F.col("size") > large_key)
             .select("fingerprint", "part", F.posexplode(inner[(F.col("part") % PARTS).cast("int")]).alias("piece", "mask"))
             .select("fingerprint", (F.col("part") + F.col("part") % PARTS * 5 + F.col("piece") + 6).alias("part"),
                     F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key")))
    members = first.where(F.col("size") <= large_key).select("fingerprint", "part", "key").unionByName(finer)
    # all rows of a key lie in one partition, sorted together; no key has more than 2^16 rows
    placed = members.repartition("part", "key").sortWithinPartitions("part", "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            piece = pa.table(batch.columns, names=batch.schema.names) if batch.num_rows else None
            if piece is None:
                continue
            rest = piece if rest is None else pa.concat_tables([rest, piece])
            part, key = rest["part"].to_numpy(), rest["key"].to_numpy()
            whole = np.flatnonzero((part != part[-1]) | (key != key[-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield _spanning(rest.slice(0, cut), distance)
            rest = rest.slice(cut)
        if rest is not None:
            yield _spanning(rest, distance)

    found = placed.mapInArrow(search, "a long, b long, view long")
    return found if by_view else found.drop("view")


def _spanning(rows: pa.Table, distance: int) -> pa.RecordBatch:
    part, key = rows["part"].to_numpy().astype(np.int64), rows["key"].to_numpy()
    values = rows["fingerprint"].to_numpy().view(np.uint64)
    order = np.lexsort((gray_rank(values), key, part))
    part, key, values = part[order], key[order], values[order]
    new = np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])))
    labels = np.arange(len(values))
    for a, b in GrayIndex(values, np.flatnonzero(new)).links(distance):
        merge_labels(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(values)))
    signed = values.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[labels[moved]]), pa.array(part[moved] // PARTS)],
                                      names=["a", "b", "view"])


def group_near_duplicates(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text",
                          shingle: int = 3, seed: int = 42) -> DataFrame:
    """``fingerprint`` (long) and ``component_id`` (smallest reachable id) per row of the input's ids.

    Documents link when their fingerprints differ in at most ``distance`` bits, empty texts with fingerprint
    zero like any other. Rows with a null id get a fingerprint and a component, but never name one
    unless all ids of it are null. An empty table gives an empty result.
    """
    prints, labels = _label(docs, distance, id_col, text_col, shingle, seed)
    names = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labels.join(names, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")


def keep_one_per_group(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id (null ids last).

    Rows equal in id and fingerprint count as one, the smallest by all columns, so exactly one row
    of every group stays. All columns must be orderable.
    """
    return keep_with_prints(docs, distance, id_col, text_col, shingle, seed).select(*docs.columns)


def keep_with_prints(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = 3, seed: int = 42, name: str = "_llm_print", partitions: int | None = None) -> DataFrame:
    """As :func:`keep_one_per_group`, with the fingerprint of each row, which no two rows share.

    With ``partitions``, the result lies in so many partitions by this fingerprint.
    """
    prints, labels = _label(docs, distance, id_col, text_col, shingle, seed)
    chosen = labels.groupBy("component").agg(
        F.min(F.struct(F.col("least").isNull(), "least", "fingerprint")).alias("k")).select(
        F.col("k.least").alias("_llm_least"), F.col("k.fingerprint").alias("_llm_kept"))
    marked = fingerprint_documents(docs, text_col, shingle, seed, name)
    stay = marked.join(chosen, (F.col(name) == F.col("_llm_kept"))
                       & F.col(id_col).eqNullSafe(F.col("_llm_least")), "left_semi")
    if partitions:
        stay = stay.repartition(partitions, name)
    return stay.groupBy(name).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*", name)


def _label(docs, distance, id_col, text_col, shingle, seed):
    """Fingerprints per row, and per fingerprint its smallest id and its component."""
    prints = cut_lineage(fingerprint_documents(docs.select(id_col, text_col), text_col, shingle, seed)
                         .select(id_col, "fingerprint"))
    smallest = prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"))
    groups = connected_components(fingerprint_links(prints, distance)).withColumnRenamed("node", "fingerprint")
    return prints, smallest.join(groups, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))


def _unsigned(mask: int) -> int:
    return mask & (1 << 64) - 1


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(words, width: int) -> int:
    return _signed(sum(((1 << width) - 1) << (w * width) for w in words))


def _finer(mask: int, pair) -> int:
    """Two of the four bytes that the mask leaves open."""
    free = [byte for byte in range(8) if not _unsigned(mask) >> (8 * byte) & 0xFF]
    return sum(0xFF << (8 * free[p]) for p in pair)
