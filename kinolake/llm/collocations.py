"""Phrases whose words occur together more often than by chance, from counts of the longest windows only.

Every word starts one window: itself and the next words of its piece, side by side as columns and padded at the end.
Equal windows are added up first, as one text each; Spark's ROLLUP over their columns then adds these up to all shorter phrases.
A window is padded from the place on where the run of words up to there occurs too seldom in the corpus, which loses no
phrase: all parts of a frequent phrase are frequent. Which runs those are is a bit map of bounded size
over counted cells, one for some bytes of text; where cells or bits collide, a window merely stays longer than needed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolake.llm.blocks import block_count, group_bounds, mix, shard_of
from kinolake.session import cut_lineage

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
NO_LANGUAGE = "und"
SLICE = 2 << 20  # bytes of text that a task turns into windows at once
HELD = 4 << 20  # counted cells that a task holds before it sends them
SHARD_BYTES = 16 << 20  # text whose cells meet in one task
CELL_BITS = 22  # cells of a shard: about three different runs meet in one, so few reach the count by collision
TIMES_BITS = 28
MAX_BITS = 1 << 27  # 16 MB; the map is no larger for any corpus
SEGMENT = 1 << 15
# A-Z become a-z, separators of pieces a line feed, tabs a space
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
_PAIR, _LANG = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
COLUMNS = [f"w{i}" for i in range(1, LONGEST + 1)]


class _Words:
    """The words of some texts of one language as numbers; 0 stands for the end of a piece."""

    def __init__(self, lang: str, raw: bytes):
        ids: dict[bytes, int] = defaultdict(count().__next__)
        ends, blank = ids[b"\n"], ids[b""]
        parts = raw.replace(b"\n", b" \n ").split(b" ")
        places = np.fromiter(map(ids.__getitem__, parts), np.int64, len(parts))
        self.places = places[places != blank]
        self.names = list(ids)
        self.is_word = self.places != ends
        self.lang = lang
        seed = np.uint64(xxhash.xxh64_intdigest(lang))
        plain = np.fromiter(map(xxhash.xxh64_intdigest, self.names), np.uint64, len(self.names))
        self.word_hash = mix(plain ^ seed)
        self.pair_hash = mix(plain * _PAIR + seed)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For two words up to the longest: places with so many words ahead in their piece, and hashes of these."""
        at = np.flatnonzero(self.is_word[:-1] & self.is_word[1:])
        hashes = mix(self.pair_hash[self.places[at]] * _LANG + self.word_hash[self.places[at + 1]])
        yield at, hashes
        for size in range(3, LONGEST + 1):
            longer = np.flatnonzero(np.diff(at) == 1)
            at = at[longer]
            hashes = mix(hashes[longer] * _PAIR + self.word_hash[self.places[at + size - 1]])
            yield at, hashes


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """Words of each language in slices of bounded size; a slice ends with a piece."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size = 0
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            raw = text.as_py().translate(_BYTES)
            while len(raw) > SLICE and (cut := raw.find(b"\n", SLICE)) >= 0:
                yield _Words(lang, raw[:cut])
                raw = raw[cut:]
            held.setdefault(lang, []).append(raw)
            size += len(raw)
            if size > SLICE:
                yield from (_Words(x, b"\n".join(t)) for x, t in held.items())
                held, size = {}, 0
        yield from (_Words(x, b"\n".join(t)) for x, t in held.items())


def _plain(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _cells(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash and some of its bits: what is counted."""
    return shard_of(hashes, shards).astype(np.uint64) << np.uint64(CELL_BITS) | hashes & np.uint64((1 << CELL_BITS) - 1)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in one or two bytes each, whichever is shorter; those too large follow in full."""
    kind = min((np.uint8, np.uint16), key=lambda k: np.dtype(k).itemsize * len(values) + 4 * int((values >= np.iinfo(k).max).sum()))
    large = values[values >= np.iinfo(kind).max]
    head = np.array([np.dtype(kind).itemsize, len(values), len(large)], np.int64)
    return head.tobytes() + np.minimum(values, np.iinfo(kind).max).astype(kind).tobytes() + large.astype(np.uint32).tobytes()


def _widen(payload: bytes, at: int) -> tuple[np.ndarray, int]:
    """What :func:`_narrow` packed from ``at`` on, and where it ends."""
    width, n, more = np.frombuffer(payload, np.int64, 3, at).tolist()
    kind, at = {1: np.uint8, 2: np.uint16}[width], at + 24
    short = np.frombuffer(payload, kind, n, at)
    values, at = short.astype(np.int64), at + n * width
    values[short == np.iinfo(kind).max] = np.frombuffer(payload, np.uint32, more, at)
    return values, at + 4 * more


def _frequent_bits(plain: DataFrame, min_count: int, max_bits: int, shards: int) -> np.ndarray:
    """A bit map in which the cells of all runs of one to five words with ``min_count`` occurrences are set.

    Tasks add up their counts and send them to the shards as packed steps between cells; a shard adds them up in one array.
    """
    most = np.uint64((1 << TIMES_BITS) - 1)

    def counted(cells: np.ndarray, times: np.ndarray) -> np.ndarray:
        return cells << np.uint64(TIMES_BITS) | np.minimum(times.astype(np.uint64), most)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(held)
        held.clear()
        both.sort()
        cells = both >> np.uint64(TIMES_BITS)
        first = group_bounds(cells)[:-1]
        times = np.add.reduceat(both & most, first)
        cells = cells[first]
        cut = group_bounds(cells >> np.uint64(CELL_BITS))
        low = (cells & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array((cells[cut[:-1]] >> np.uint64(CELL_BITS)).astype(np.int64)),
             pa.array([_narrow(np.diff(low[a:b], prepend=0)) + _narrow(times[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
            names=["shard", "payload"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words in _slices(batches):
            own = np.bincount(words.places[words.is_word], minlength=len(words.names))
            some = np.flatnonzero(own)
            for cells, times in [(_cells(words.word_hash[some], shards), own[some]), *(
                    _counted(_cells(h, shards)) for _, h in words.runs())]:
                held.append(counted(cells, times))
                size += len(cells)
            if size > HELD:
                yield packed(held)
                size = 0
        if size:
            yield packed(held)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for payload in table["payload"]:
            steps, end = _widen(payload := payload.as_py(), 0)
            total[np.cumsum(steps)] += _widen(payload, end)[0]  # cells of a payload differ
        cells = np.uint64(table["shard"][0].as_py()) << np.uint64(CELL_BITS) | np.flatnonzero(total >= min_count).astype(np.uint64)
        return pa.table({"h": pa.array(mix(cells).view(np.int64))})

    frequent = cut_lineage(plain.mapInArrow(hashes, "shard long, payload binary").groupBy("shard").applyInArrow(add, "h long"))
    bits = 1 << min(max_bits.bit_length() - 1, max(SEGMENT.bit_length() - 1, (16 * frequent.count()).bit_length()))

    def segment(table: pa.Table) -> pa.Table:
        flags = np.zeros(SEGMENT, bool)
        flags[table["h"].to_numpy() & (SEGMENT - 1)] = True
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    # at most bits / 8 bytes reach the driver
    places = frequent.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("h")).distinct()
    found = (places.select("h", F.shiftright("h", SEGMENT.bit_length() - 1).alias("part")).groupBy("part")
             .applyInArrow(segment, "part long, bits binary").collect())
    out = np.zeros(bits // 8, np.uint8)
    for row in found:
        out[row["part"] * SEGMENT // 8:(row["part"] + 1) * SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and how often each occurs."""
    keys = np.sort(keys)
    cut = group_bounds(keys)
    return keys[cut[:-1]], np.diff(cut)


def _is_set(bits: np.ndarray, hashes: np.ndarray, shards: int) -> np.ndarray:
    at = mix(_cells(hashes, shards)) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text",
                  max_bits: int = MAX_BITS) -> DataFrame:
    """``(lang, words, f, n)``: all phrases of one to five words with ``min_count`` occurrences inside pieces.

    ``n`` counts all words of the language. Null languages count as ``und``, null texts have no words.
    """
    plain = _plain(docs, lang_col, text_col)
    shards = block_count(plain, F.col("text"), SHARD_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast(_frequent_bits(plain, min_count, max_bits, shards))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for words in _slices(batches):
            known = _is_set(bits, words.word_hash, shards)
            seen = words.places
            depth = (known[seen] & words.is_word).astype(np.int8)
            rare = int(words.is_word.sum() - depth.sum())
            run = depth > 0
            for at, hashes in words.runs():
                whole = np.zeros(len(seen), bool)
                whole[at] = _is_set(bits, hashes, shards)
                run = run & whole
                depth += run
            for _ in range(LONGEST - 1):  # the rest of a frequent run is one as well
                depth[:-1] = np.minimum(depth[:-1], depth[1:] + 1)
            names = pa.array([b"" if x == b"\n" else x for x in words.names], pa.binary()).cast(pa.string())
            single = np.bincount(seen[depth == 1], minlength=len(words.names))
            some = np.flatnonzero(single)
            starts = np.flatnonzero(depth > 1)
            columns = np.zeros((LONGEST, len(starts)), np.int64)  # 0 names the empty pad
            for k in range(LONGEST):
                there = depth[starts] > k
                columns[k, there] = seen[starts[there] + k]
            key = columns[0]
            for k in range(1, LONGEST):
                key = np.unique(key * np.int64(len(words.names)) + columns[k], return_inverse=True)[1]
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            held = np.zeros((LONGEST, 1 + len(some) + len(first)), np.int64)
            held[0, 1:1 + len(some)] = some
            held[:, 1 + len(some):] = columns[:, first]
            yield pa.RecordBatch.from_arrays(
                [pa.array([words.lang] * held.shape[1], pa.string()),
                 pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in held], " "),  # no word holds a space
                 pa.array(np.concatenate(([rare], single[some], times)))], names=["lang", "words", "n"])

    whole = plain.mapInArrow(windows, "lang string, words string, n long").groupBy("lang", "words").agg(F.sum("n").alias("n"))
    words = F.split("words", " ")
    summed = (whole.select("lang", *[words[i].alias(c) for i, c in enumerate(COLUMNS)], "n")
              .rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level")))
    levels = {(1 << (LONGEST - k)) - 1: k for k in range(LONGEST + 1)}
    size = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])[F.col("level").cast("int")]
    counted = summed.where(F.col("level") < (1 << LONGEST)).select(
        "lang", size.alias("size"), F.slice(F.array(*COLUMNS), 1, size).alias("words"), "f")
    # a phrase may not end in a pad; the level without words holds n
    counted = cut_lineage(counted.where((F.col("size") == 0) | (F.col("f") >= min_count) & (F.get("words", F.col("size") - 1) != "")))
    totals = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    return counted.where("size > 0").join(totals, "lang").select("lang", "words", "f", "n")


def mine_collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang_col: str = "lang",
                      text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two to five words of each language.

    A-Z are lower-cased, pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs. ``a`` counts a phrase; cut
    after its first words, ``l`` counts these and ``r`` the rest, and its score is the least of
    floor(1000 a n / (l r)) over the cuts, ties to the earliest cut. Phrases inside a longer one that is as frequent are
    left out. Ranks go by score, ``a`` (both descending) and the phrase in UTF-8 order.

    Null languages count as ``und`` and null texts as empty; repeated rows count each. An empty table, or one
    without frequent phrases, gives an empty result. Other columns are not read.
    """
    phrases = cut_lineage(count_phrases(docs, min_count, lang_col, text_col, max_bits))
    text = lambda words: F.array_join(words, " ")
    known = phrases.select("lang", text(F.col("words")).alias("phrase"), "f")
    many = phrases.withColumn("size", F.size("words")).where("size > 1").withColumn("phrase", text(F.col("words")))
    cuts = many.select("lang", "phrase", "words", "size", F.col("f").alias("a"), "n",
                       F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", text(F.slice("words", 1, F.col("k"))).alias("_first"),
                       text(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))).alias("_rest"))
    for name, part in (("l", "_first"), ("r", "_rest")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    exact = lambda c: F.col(c).cast("decimal(17,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")), exact("l") * exact("r"))
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every shorter phrase inside a phrase, with the count of the longer one
    spans = F.expr("filter(flatten(transform(sequence(1, size), i -> transform(sequence(2, size), "
                   "m -> struct(i AS i, m AS m)))), x -> x.m < size AND x.i + x.m - 1 <= size)")
    inner = many.where("size > 2").select("lang", "words", "f", F.explode(spans).alias("s")).select(
        "lang", text(F.slice("words", F.col("s.i"), F.col("s.m"))).alias("phrase"), "f")
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    free = scored.join(longer, ["lang", "phrase"], "left").where("_longer IS NULL OR _longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = free.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
