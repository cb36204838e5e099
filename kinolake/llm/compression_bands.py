"""Quality rules for texts, with bands for how well they compress.

Repetitive text compresses too well for its length, random or encoded text too badly. What is usual depends on
the length: short texts give the compressor little to go by. The zstandard ratio of the whole text and of each fixed
chunk must lie between two limits that run in straight lines between powers of two of the length in bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

SPACES = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
LEVEL = 3
CHUNK = 2048
CHUNK_SHARE = 0.25  # a larger share of chunks outside the limits rejects a text
# (log2 of the bytes, least ratio, largest ratio); set from documents labelled as good, with a margin
LIMITS = ((5, 0.70, 1.00), (6, 0.80, 1.22), (7, 1.00, 1.52), (8, 1.25, 1.70), (9, 1.42, 1.86), (10, 1.68, 2.06),
          (11, 1.86, 2.18), (12, 2.04, 2.30), (13, 2.14, 2.41), (14, 2.22, 2.49), (17, 2.32, 2.70), (20, 2.38, 2.85))
_NOT_COUNTED = SPACES + bytes(range(0x80, 0xC0))
WORDS_AT_ONCE = 1 << 20
ADDED = StructType([*[StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    StructField("base_failed", BooleanType()), StructField("ratio", DoubleType()),
                    StructField("n_chunks", LongType()), StructField("n_chunks_out", LongType()),
                    StructField("kept", BooleanType())])


def limits_at(size: np.ndarray | int, limits=LIMITS) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest ratio of a text of so many bytes; beyond the ends of the table its end values hold."""
    at, low, high = np.array(limits, float).T
    x = np.log2(np.maximum(size, 1))
    return np.interp(x, at, low), np.interp(x, at, high)


def apply_quality_rules(docs: DataFrame, text_col: str = "text", limits=LIMITS, chunk: int = CHUNK,
                        chunk_share: float = CHUNK_SHARE, level: int = LEVEL) -> DataFrame:
    """Adds counts, ``base_failed``, the ratios' figures and ``kept`` to every row.

    ``n_words``; ``word_chars`` (code points in words); ``n_symbols``; ``n_dup_lines`` (lines with a word, equal to an
    earlier line); ``n_repeat_words`` (words in five-word windows that occur twice or more in the text). A text fails the
    base with fewer than 10 words, or more than a fifth of them repeated. It is kept if it passes the base, its
    ``ratio`` (bytes per zstandard byte) lies within the limits for its length, and at most ``chunk_share`` of its
    ``n_chunks`` whole chunks of ``chunk`` bytes lie outside the limits for theirs (``n_chunks_out``).

    Null and empty texts have no words and a ratio of 0, and are not kept. Texts are judged whole and each for itself, so
    repeated rows get equal results and an empty table an empty one. Input columns of the added names are replaced.
    """
    docs = docs.drop(*ADDED.fieldNames())
    schema = StructType([*docs.schema.fields, *ADDED.fields])
    chunk_low, chunk_high = limits_at(chunk, limits)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)

        def ratio(raw) -> float:
            return len(raw) / len(compressor.compress(raw))

        for batch in batches:
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            n_words, repeated = repeats(texts)
            chars = [len(t.translate(None, _NOT_COUNTED)) for t in texts]
            symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
            same = [_equal_lines(t) for t in texts]
            failed = (n_words < 10) | (100 * repeated > 20 * n_words)
            whole = np.array([ratio(t) if t else 0.0 for t in texts])
            low, high = limits_at(np.array([len(t) for t in texts]), limits)
            parts, outside = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                parts[i] = len(t) // chunk
                view = memoryview(t)
                outside[i] = sum(not chunk_low <= ratio(view[a:a + chunk]) <= chunk_high
                                 for a in range(0, parts[i] * chunk, chunk))
            kept = ~failed & (low <= whole) & (whole <= high) & (outside <= chunk_share * parts)
            for name, values in zip(ADDED.fieldNames(), (n_words, chars, symbols, same, repeated, failed, whole, parts,
                                                         outside, kept)):
                batch = batch.append_column(name, pa.array(values))
            yield batch

    return docs.mapInArrow(judge, schema)


def _equal_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeats(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many lie in a window of ``width`` words found twice or more in that text."""
    words, found = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        lists, size, last = [], 0, first
        while last < len(texts) and (last == first or size < WORDS_AT_ONCE):
            lists.append(texts[last].split())  # of bytes: splits at the six ASCII spaces only
            size += len(lists[-1])
            last += 1
        lengths = np.array([len(x) for x in lists])
        words[first:last] = lengths
        ids: dict[bytes, int] = defaultdict(count().__next__)
        flat = np.fromiter((ids[w] for x in lists for w in x), np.int64, size)
        doc = np.repeat(np.arange(len(lists)), lengths)
        n = size - width + 1
        if n > 0:
            starts = np.flatnonzero(doc[:n] == doc[width - 1:])
            key = flat
            for k in range(1, width):  # numbers of ever longer runs of words
                longer = key[:len(key) - 1] * np.int64(size) + flat[k:k + len(key) - 1]
                key = np.unique(longer, return_inverse=True)[1]
            pair = key[starts] * np.int64(len(lists)) + doc[starts]
            _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
            twice = starts[times[back] > 1]
            edge = np.zeros(size + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + width, -1)
            found[first:last] = np.bincount(doc, np.cumsum(edge)[:size] > 0, len(lists)).astype(np.int64)
        first = last
    return words, found
