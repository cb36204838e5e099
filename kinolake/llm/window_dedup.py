"""Substring deduplication by word windows with a count-min prefilter.

Three passes over blocks of documents, all fed by one exchange of the text. First, each block
makes a sketch of its windows: one wide row of counters, kept as the sorted numbers of the
counters above zero and cut into shards. Shards add up the sketches and tell each block which of
its counters exceed one; a counter can only be too high, so no repeated window is lost. Second,
blocks send 96-bit hashes of just the windows estimated repeated, the earliest of each, and
shards find the earliest in all blocks. Third, blocks remove the words covered by the rest.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from kinolake.llm.blocks import (ANSWER, BLOCK, BLOCK_BYTES, MESSAGE, answers, block_count, group_bounds, in_blocks,
                                 messages, mix, pack, pack_sorted, shard_of, unpack, unpack_sorted, utf8, word_hashes)

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COUNTERS_PER_WINDOW = 16
_SECOND = np.uint64(0xA0761D6478BD642F)


def dedup_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove words covered by a window of ``window`` words that also starts earlier.

    Earlier means a smaller id, or the same document and an earlier start. Windows are judged on
    the input. Adds ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) and
    ``removed_spans`` (maximal word ranges [from, to)); input columns of these names are replaced,
    all others pass through. Null texts have no words; null ids count as smallest; rows that
    share an id are ordered by their text. An empty table gives an empty result.
    """
    added = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()),
                        StructField("kept_text", StringType()),
                        StructField("removed_spans", ArrayType(ArrayType(IntegerType())))])
    docs = docs.drop(*added.fieldNames())
    columns = docs.columns
    out_schema = StructType(docs.schema.fields + added.fields)
    blocks = block_count(docs, F.col(text_col), block_bytes)
    # counters of one shard: a power of two for about block_bytes / 6 windows
    bits = min(31, max(8, int(np.ceil(np.log2(COUNTERS_PER_WINDOW * block_bytes / 6)))))
    placed = in_blocks(docs, blocks, id_col)

    def hashed(table: pa.Table):
        return _windows(table, window, id_col, text_col)

    def cell(h1):
        return ((h1 & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)

    def sketch(table: pa.Table) -> pa.Table:
        h1 = hashed(table)[3]
        return messages(*_sparse_counters(h1, cell, blocks, bits, table[BLOCK][0].as_py()))

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(p) for p in table["payload"].to_pylist()]
        seen = np.zeros(1 << bits, np.uint8)
        for p in parts:
            seen[p] = np.minimum(seen[p], 1) + 1
        return answers(table["block"].to_numpy(), table["shard"].to_numpy(),
                       [pack_sorted(p[seen[p] > 1]) for p in parts])

    def candidates(table: pa.Table, answer: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return messages([], [], [])
        _, ids, doc, h1, h2, _ = hashed(table)
        if len(h1) == 0:
            return messages([], [], [])
        order = np.lexsort((np.arange(len(h1)), h2, h1))
        lead = _first_of_each(h1[order], h2[order])
        shards, cells = shard_of(h1, blocks), cell(h1)
        hot = _repeated_cell(shards, cells)
        if answer.num_rows:
            known = np.sort(np.concatenate([(np.int64(s) << bits) | unpack_sorted(p) for s, p in
                                            zip(answer["shard"].to_pylist(), answer["payload"].to_pylist())]))
            hot |= _contains(known, (shards << bits) | cells)
        pick = order[lead]
        pick = pick[hot[pick]]
        cut = group_bounds(shards[pick])
        return messages(shards[pick[cut[:-1]]], table[BLOCK][0].as_py(), [
            pack(h1[p], h2[p].astype(np.uint32), ids[doc[p]], p.astype(np.int32))
            for p in (pick[a:b] for a, b in zip(cut[:-1], cut[1:]))])

    def earliest(table: pa.Table) -> pa.Table:
        parts = [unpack(p, np.uint64, np.uint32, np.int64, np.int32) for p in table["payload"].to_pylist()]
        h1, h2, ids, at = (np.concatenate(x) for x in zip(*parts))
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((ids, h2, h1))
        lead = _first_of_each(h1[order], h2[order])
        late = np.ones(len(order), bool)
        late[order[lead]] = False
        cut = np.searchsorted(source, np.arange(len(parts) + 1))
        return answers(table["block"].to_numpy(), table["shard"].to_numpy(), [
            pack(at[a:b][late[a:b]]) for a, b in zip(cut[:-1], cut[1:])])

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return out_arrow(table, [], [], [], [])
        table, _, doc, h1, h2, counts = hashed(table)
        starts = np.concatenate(([0], np.cumsum(counts)))
        gone = np.zeros(starts[-1] + 1, np.int64)
        if len(h1):
            order = np.lexsort((np.arange(len(h1)), h2, h1))
            lead = _first_of_each(h1[order], h2[order])
            removed = np.ones(len(h1), bool)
            removed[order[lead]] = False
            if answer.num_rows:
                late = np.zeros(len(h1), bool)
                late[np.concatenate([unpack(p, np.int32)[0] for p in answer["payload"].to_pylist()])] = True
                removed |= late
            inner = np.arange(len(h1)) - np.searchsorted(doc, doc, "left")
            first = starts[doc[removed]] + inner[removed]
            np.add.at(gone, first, 1)
            np.add.at(gone, first + window, -1)
        gone = np.cumsum(gone) > 0
        texts, removals, spans = [], [], []
        for i, raw in enumerate(utf8(table[text_col])):
            words, flags = WORD.findall(raw), gone[starts[i]:starts[i + 1]]
            if flags.any():
                edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
                spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist())
                words = [w for w, f in zip(words, flags.tolist()) if not f]
            else:
                spans.append([])
            removals.append(int(flags.sum()))
            texts.append(b" ".join(words).decode())
        return out_arrow(table, counts, removals, texts, spans)

    def out_arrow(table, counts, removals, texts, spans):
        table = table.select(columns)
        for name, values, kind in zip(added.fieldNames(), (counts, removals, texts, spans),
                                      (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())))):
            table = table.append_column(name, pa.array(values, kind))
        return table

    counted = placed.groupBy(BLOCK).applyInArrow(sketch, MESSAGE).groupBy("shard").applyInArrow(merge, ANSWER)
    sent = placed.groupBy(BLOCK).cogroup(counted.groupBy("block")).applyInArrow(candidates, MESSAGE)
    found = sent.groupBy("shard").applyInArrow(earliest, ANSWER)
    return placed.groupBy(BLOCK).cogroup(found.groupBy("block")).applyInArrow(finish, out_schema)


def _windows(table: pa.Table, window: int, id_col: str, text_col: str):
    """The block in document order, ids, and per window: document, two hashes; words per document."""
    texts = utf8(table[text_col])
    ids = table[id_col].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    words, counts = word_hashes([texts[i] for i in order])
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    n = len(words) - window + 1
    if n <= 0 or len(doc) == 0:
        none = np.zeros(0, np.uint64)
        return table.take(order), ids[order], doc[:0], none, none, counts
    ends = np.cumsum(counts)
    whole = np.arange(n) + window <= np.repeat(ends, counts)[:n]
    second = mix(words ^ _SECOND)
    h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(window):
        h1 = h1 * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
        h2 = h2 * np.uint64(0x9FB21C651E98DF25) + second[j:j + n]
    return table.take(order), ids[order], doc, mix(h1[whole]), mix(h2[whole]) >> np.uint64(32), counts


def _sparse_counters(h1, cell, shards, bits, block):
    """One message per shard: the block's counters above zero."""
    both = np.unique((shard_of(h1, shards) << bits) | cell(h1))
    shard = both >> bits
    cut = group_bounds(shard)
    low = both & ((1 << bits) - 1)
    return shard[cut[:-1]], block, [pack_sorted(low[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _repeated_cell(shards, cells):
    """Whether another window of the block has the same counter."""
    _, back, count = np.unique((shards << 32) | cells, return_inverse=True, return_counts=True)
    return count[back] > 1


def _first_of_each(h1, h2):
    return np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))


def _contains(known, values):
    at = np.minimum(np.searchsorted(known, values), len(known) - 1) if len(known) else None
    return known[at] == values if len(known) else np.zeros(len(values), bool)
