"""Exact removal of long repeated byte strings with run-length BWT indexes.

A string of ``length`` bytes is given the smallest hash of its ``KMER``-byte substrings as its key.
Equal strings have equal keys, so strings can only repeat within a key. Consecutive starts with one
key form a fragment. Blocks of documents send keys and content hashes of fragments to shards;
fragments whose key occurs once are done, fragments that occur identically twice are repeated as
a whole, and only fragments that share a key with different content are sent in full, once per
content. For these a shard builds the run-length index, streams the matching statistics and
marks the starts of matches of at least ``length`` bytes. A key with very many contents would not
fit one index; its strings are spread over all shards by 128-bit hashes of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from kinolake.llm.blocks import (ANSWER, BLOCK, BLOCK_BYTES, MESSAGE, answers, block_count, group_bounds, in_blocks,
                                 messages, mix, pack, powers, shard_of, unpack, utf8)
from kinolake.llm.run_length_index import RunLengthIndex

KMER = 32
CHUNK = 1 << 20
LONGEST_RUN = 4096  # starts per fragment; longer runs of one key are cut, which loses nothing
_BASE = 0xD6E8FEB86659FD93
BATCH_BYTES = 1 << 18  # text of one index; a key is never cut
CONTENTS_PER_INDEX = 512  # keys with more contents are matched by hashes of their strings instead
REPEATED, SEND, SPLIT = 1, 2, 4  # bits of a fragment's status
FRAGMENTS, STRINGS, KNOWN = b"f", b"s", b"k"  # kinds of messages


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES, contents_per_index: int = CONTENTS_PER_INDEX) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    All occurrences go, in the same document too, overlaps included; strings are judged on the
    input. Adds ``n_bytes``, ``n_removed``, ``removed_spans`` (maximal byte ranges [from, to)) and
    ``kept_bytes``; input columns of these names are replaced, all others pass through. Matches
    never cross documents. Null texts are empty; rows that share an id are separate documents; an
    empty table gives an empty result.
    """
    if length < 2 * KMER:
        raise ValueError(f"length must be at least {2 * KMER}")
    added = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
                        StructField("removed_spans", ArrayType(ArrayType(LongType()))),
                        StructField("kept_bytes", BinaryType())])
    docs = docs.drop(*added.fieldNames())
    columns = docs.columns
    out_schema = StructType(docs.schema.fields + added.fields)
    blocks = block_count(docs, F.col(text_col), block_bytes)
    placed = in_blocks(docs, blocks, id_col, text_col)

    def prepared(table, inner=False):
        texts = utf8(table[text_col])
        ids = table[id_col].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        texts = [texts[i] for i in order]
        return order, texts, _fragments(texts, length, inner)

    def announce(table: pa.Table) -> pa.Table:
        _, texts, found = prepared(table, inner=True)
        key, content, lead, several = _contents(texts, found, length)
        several, twice = several.astype(np.uint8), found[4][lead].astype(np.uint8)
        shards = shard_of(mix(key[lead]), blocks)  # keys are minima, so not spread by themselves
        by = np.argsort(shards, kind="stable")
        cut = group_bounds(shards[by])
        return messages(shards[by][cut[:-1]], table[BLOCK][0].as_py(), [
            pack(key[lead][p], content[lead][p], several[p] + 2 * twice[p], lead[p].astype(np.int32))
            for p in (by[a:b] for a, b in zip(cut[:-1], cut[1:]))])

    def judge(table: pa.Table) -> pa.Table:
        parts = [unpack(p, np.uint64, np.uint64, np.uint8, np.int32) for p in table["payload"].to_pylist()]
        key, content, several, at = (np.concatenate(x) for x in zip(*parts))
        source = np.repeat(table["block"].to_numpy(), [len(p[0]) for p in parts])
        order = np.lexsort((source, content, key))
        k, c = key[order], content[order]
        new_key = np.concatenate(([True], k[1:] != k[:-1]))
        new = new_key | np.concatenate(([True], c[1:] != c[:-1]))
        group, per_key = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        copies = np.bincount(group) + np.bincount(group, several[order] & 1)
        twice = several[order] > 1
        contents = np.bincount(per_key, new)
        status = np.where(copies[group] > 1, REPEATED, 0)
        many = np.where(contents[per_key] > contents_per_index, SPLIT, SEND)
        status = status | np.where(new & ((contents[per_key] > 1) | (twice & (copies[group] == 1))), many, 0)
        result = np.empty(len(order), np.uint8)
        result[order] = status
        cut = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
        keep = [np.flatnonzero(result[a:b] > 0) for a, b in zip(cut[:-1], cut[1:])]
        return answers(table["block"].to_numpy(), table["shard"].to_numpy(),
                       [pack(at[a:b][i], result[a:b][i]) for a, b, i in zip(cut[:-1], cut[1:], keep)])

    def send(table: pa.Table, answer: pa.Table) -> pa.Table:
        if table.num_rows == 0 or answer.num_rows == 0:
            return messages([], [], [])
        _, texts, (doc, first, last, key, _) = prepared(table)
        at, status = (np.concatenate(x) for x in zip(*[unpack(p, np.int32, np.uint8)
                                                       for p in answer["payload"].to_pylist()]))
        block, shards, payloads = table[BLOCK][0].as_py(), [], []
        pick = np.sort(at[status & SEND > 0])
        home = shard_of(mix(key[pick]), blocks)
        by = np.argsort(home, kind="stable")
        cut = group_bounds(home[by])
        for a, b in zip(cut[:-1], cut[1:]):
            some = pick[by[a:b]]
            body = [texts[doc[i]][first[i]:last[i] + length] for i in some.tolist()]
            sizes = np.array([len(x) for x in body], np.int32)
            shards.append(home[by[a]])
            payloads.append(FRAGMENTS + pack(key[some], some.astype(np.int32), sizes) + b"".join(body))
        for shard, payload in _split_strings(texts, doc, first, last, np.sort(at[status & SPLIT > 0]), length, blocks):
            shards.append(block % blocks if shard < 0 else shard)
            payloads.append(payload)
        return messages(shards, block, payloads)

    def match(table: pa.Table) -> pa.Table:
        fragments, strings, found = [], [], {}
        for block, payload in zip(table["block"].to_pylist(), table["payload"].to_pylist()):
            kind, payload = payload[:1], payload[1:]
            if kind == FRAGMENTS:
                key, at, sizes = unpack(payload, np.uint64, np.int32, np.int32)
                place = np.cumsum(sizes) - sizes + 8 + 16 * len(at)
                fragments += [(k, block, i, payload[p:p + n]) for k, i, p, n in
                              zip(key.tolist(), at.tolist(), place.tolist(), sizes.tolist())]
            elif kind == STRINGS:
                strings.append((block, *unpack(payload, np.uint64, np.uint64, np.int32, np.int32, np.uint8)))
            else:
                found.setdefault(block, []).append(unpack(payload, np.int32, np.int32))
        for block, rows in _index_matches(fragments, length):
            found.setdefault(block, []).append(rows)
        for block, rows in _string_matches(strings):
            found.setdefault(block, []).append(rows)
        return answers(list(found), np.full(len(found), -1), [
            pack(*(np.concatenate(x) for x in zip(*rows))) for rows in found.values()])

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return out_arrow(table, [], [], [], [])
        order, texts, found = prepared(table)
        doc, first, last, _, _ = found
        offset = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        gone = np.zeros(offset[-1] + 1, np.int32)
        starts, stops = [], []
        whole = np.zeros(len(doc), bool)
        for shard, payload in zip(answer["shard"].to_pylist(), answer["payload"].to_pylist()):
            if shard < 0:
                at, a = unpack(payload, np.int32, np.int32)
                starts.append(offset[doc[at]] + first[at] + a)
                stops.append(starts[-1])
            else:
                at, status = unpack(payload, np.int32, np.uint8)
                whole[at[status & REPEATED > 0]] = True
        if len(doc):
            key, content, lead, several = _contents(texts, found, length)
            _, back = _group(key, content)
            flagged = whole[lead] | several
            at = np.flatnonzero(flagged[back])
            starts.append(offset[doc[at]] + first[at])
            stops.append(offset[doc[at]] + last[at])
        for a, b in zip(starts, stops):
            np.add.at(gone, a, 1)
            np.add.at(gone, b + length, -1)
        gone = np.cumsum(gone) > 0
        kept, removed, spans = [], [], []
        for i, raw in enumerate(texts):
            flags = gone[offset[i]:offset[i + 1]]
            edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
            ranges = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist()
            spans.append(ranges)
            removed.append(sum(b - a for a, b in ranges))
            kept.append(b"".join(raw[a:b] for a, b in zip([0, *[r[1] for r in ranges]],
                                                          [*[r[0] for r in ranges], len(raw)])))
        return out_arrow(table.take(order), [len(t) for t in texts], removed, spans, kept)

    def out_arrow(table, sizes, removed, spans, kept):
        table = table.select(columns)
        for name, values, kind in zip(added.fieldNames(), (sizes, removed, spans, kept),
                                      (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())):
            table = table.append_column(name, pa.array(values, kind))
        return table

    judged = placed.groupBy(BLOCK).applyInArrow(announce, MESSAGE).groupBy("shard").applyInArrow(judge, ANSWER)
    sent = placed.groupBy(BLOCK).cogroup(judged.groupBy("block")).applyInArrow(send, MESSAGE)
    matched = sent.groupBy("shard").applyInArrow(match, ANSWER)
    found = judged.unionByName(matched)
    return placed.groupBy(BLOCK).cogroup(found.groupBy("block")).applyInArrow(finish, out_schema)


def _index_matches(fragments, length):
    """Per block: fragment and start of every string that repeats among fragments of one key."""
    fragments.sort(key=lambda x: x[0])
    first = 0
    while first < len(fragments):
        last, size = first, 0
        while last < len(fragments) and (size < BATCH_BYTES or fragments[last][0] == fragments[last - 1][0]):
            size += len(fragments[last][3])
            last += 1
        batch = fragments[first:last]
        first = last
        long = RunLengthIndex([x[3] for x in batch]).matching_statistics() >= length
        place = 0
        for _, block, i, text in batch:
            starts = np.flatnonzero(long[place:place + len(text) - length + 1])
            place += len(text)
            if len(starts):
                yield block, (np.full(len(starts), i, np.int32), starts.astype(np.int32))


def _split_strings(texts, doc, first, last, pick, length, shards):
    """Messages with the hashes of all strings of some fragments, each string once.

    Strings that already repeat inside the block are sent back as known (shard -1).
    """
    if len(pick) == 0:
        return
    parts = []
    for i in pick.tolist():
        data = np.frombuffer(texts[doc[i]][first[i]:last[i] + length], np.uint8).astype(np.uint64) + np.uint64(1)
        count, hashes = len(data) - length + 1, []
        for base in (_BASE, 0x9FB21C651E98DF25):
            prefix = np.concatenate((np.zeros(1, np.uint64),
                                     np.cumsum(mix(data * np.uint64(base)) * powers(base, len(data)), dtype=np.uint64)))
            hashes.append(mix((prefix[length:] - prefix[:-length]) * powers(pow(base, -1, 1 << 64), count)))
        parts.append((*hashes, np.full(count, i, np.int32), np.arange(count, dtype=np.int32)))
    h1, h2, at, start = (np.concatenate(x) for x in zip(*parts))
    lead, back = _group(h1, h2)
    several = np.bincount(back) > 1
    known = several[back]
    if known.any():
        yield -1, KNOWN + pack(at[known], start[known])
    home = shard_of(h1[lead], shards)
    by = np.argsort(home, kind="stable")
    cut = group_bounds(home[by])
    for a, b in zip(cut[:-1], cut[1:]):
        some = lead[by[a:b]]
        yield home[by[a]], STRINGS + pack(h1[some], h2[some], at[some], start[some],
                                          several[by[a:b]].astype(np.uint8))


def _string_matches(parts):
    if not parts:
        return
    block = np.repeat([x[0] for x in parts], [len(x[1]) for x in parts])
    h1, h2, at, start, several = (np.concatenate(x) for x in zip(*[x[1:] for x in parts]))
    _, back = _group(h1, h2)
    repeated = (np.bincount(back) + np.bincount(back, several) > 1)[back]
    for b in np.unique(block[repeated]).tolist():
        mine = repeated & (block == b)
        yield b, (at[mine], start[mine])


def _fragments(texts: list[bytes], length: int, inner: bool):
    """Maximal runs of string starts with one key: document, first and last start, key, key seen twice.

    The last is only worked out where ``inner`` is set.
    """
    parts, first = [], 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < CHUNK):
            size += len(texts[last])
            last += 1
        parts.append(_fragment_chunk(texts[first:last], first, length, inner))
        first = last
    if not parts:
        return _no_fragments()
    return tuple(np.concatenate(x) for x in zip(*parts))


def _no_fragments():
    return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))


def _fragment_chunk(texts: list[bytes], first_doc: int, length: int, inner: bool):
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - KMER + 1
    width = length - KMER + 1
    if n < width:
        return _no_fragments()
    value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * powers(_BASE, len(data)), dtype=np.uint64)))
    hashes = mix((prefix[KMER:] - prefix[:-KMER]) * powers(pow(_BASE, -1, 1 << 64), n))
    key = _sliding(np.minimum, hashes, width, np.iinfo(np.uint64).max)
    m = len(key)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)[:m]
    at = np.flatnonzero(np.arange(m) + length <= ends[doc])
    if len(at) == 0:
        return _no_fragments()
    k, d = key[at], doc[at]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - start) % LONGEST_RUN == 0
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(at)) - 1
    base = (ends - sizes)[d[lead]]
    if not inner:
        return d[lead] + first_doc, at[lead] - base, at[last] - base, k[lead], np.zeros(len(lead), bool)
    # places whose hash is the key of a string around them; two in one fragment may repeat inside it
    edge = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, key, edge)), width, 0) == hashes)
    values, index = np.unique(hashes[place], return_inverse=True)
    spot = np.sort(index * np.int64(n + 1) + place)
    mine = np.searchsorted(values, k[lead]) * np.int64(n + 1)
    twice = np.searchsorted(spot, mine + at[last] + width) - np.searchsorted(spot, mine + at[lead]) > 1
    return d[lead] + first_doc, at[lead] - base, at[last] - base, k[lead], twice


def _sliding(pick, values, width, neutral):
    """Extreme of each ``width`` neighbours: running extremes of rows, from both ends."""
    pad = np.full(-len(values) % width, neutral, values.dtype)
    grid = np.concatenate((values, pad)).reshape(-1, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(values) - width + 1
    return pick(behind[:m], ahead[width - 1:width - 1 + m])


def _contents(texts, found, length):
    """Keys, content hashes, first fragment of each (key, content), and whether it occurs again."""
    doc, first, last, key, _ = found
    content = np.array([int.from_bytes(hashlib.blake2b(texts[d][a:b + length], digest_size=8).digest(), "little")
                        for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist())], np.uint64)
    lead, back = _group(key, content)
    return key, content, lead, np.bincount(back, minlength=len(lead)) > 1


def _group(key, content):
    order = np.lexsort((np.arange(len(key)), content, key))
    k, c = key[order], content[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))) if len(k) else np.zeros(0, bool)
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back
