"""Documents in blocks, and packed arrays that blocks and shards exchange.

A block is a bounded set of documents, chosen by a hash of the id (and the text, where order among equal ids
does not matter), so every run makes the same blocks. Blocks send packed arrays to shards (ranges of hash values) and get packed answers
back. A block sends a value once however often it occurs inside, so what meets in one shard for
one value grows with the number of blocks, never with the number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "_llm_block"
BLOCK_BYTES = 4 << 20
MESSAGE = "shard int, block int, payload binary"
ANSWER = "block int, shard int, payload binary"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def block_count(df: DataFrame, text: Column, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks needed for the whole table; one aggregate of a single row."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0]
    return max(1, -(-int(total or 0) // block_bytes))


def in_blocks(df: DataFrame, blocks: int, *keys: str) -> DataFrame:
    return df.withColumn(BLOCK, F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """The first ``count`` powers of an odd base; kept, as every chunk of text needs them."""
    known = _POWERS.get(base)
    if known is None or len(known) < count:
        out = np.full(max(count, 1), base, np.uint64)
        out[0] = 1
        known = np.cumprod(out, dtype=np.uint64)
        if count <= 1 << 21:
            _POWERS[base] = known
    return known[:max(count, 1)]


def group_bounds(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if len(sorted_values) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, one after the other."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    n, at, out = int.from_bytes(payload[:8], "little"), 8, []
    for kind in kinds:
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as steps of two bytes, or four where a step is longer."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    kind = np.uint16 if len(steps) == 0 or steps.max() < 65536 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def unpack_sorted(payload: bytes) -> np.ndarray:
    kind = np.uint16 if payload[0] == 2 else np.uint32
    return np.cumsum(np.frombuffer(payload, kind, -1, 1).astype(np.int64))


def messages(shards: np.ndarray, blocks, payloads: list[bytes]) -> pa.Table:
    n = len(payloads)
    block = np.full(n, blocks, np.int32) if np.isscalar(blocks) else np.asarray(blocks, np.int32)
    return pa.table({"shard": pa.array(np.asarray(shards, np.int32)), "block": pa.array(block),
                     "payload": pa.array(payloads, pa.binary())})


def answers(blocks, shards, payloads: list[bytes]) -> pa.Table:
    return messages(shards, blocks, payloads).select(["block", "shard", "payload"])


def utf8(column) -> list[bytes]:
    """The texts of a string column as bytes; null becomes empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the number of words per text."""
    hashes, counts, first = [], [], 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < chunk):
            size += len(texts[last]) + 1
            last += 1
        h, c = _hash_chunk(texts[first:last])
        hashes.append(h)
        counts.append(c)
        first = last
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _hash_chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, sizes, "left"), prepend=0)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
    value = _BYTE_VALUE[data[inside]] * powers(0xD6E8FEB86659FD93, int(lengths.max()))[place]
    return mix(np.add.reduceat(value, offsets) + lengths.astype(np.uint64) * GOLDEN), counts
