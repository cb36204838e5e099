"""Toxic spans and document scores from a linear-chain conditional random field.

Labels mark documents. A word, or its beginning, that occurs mostly in toxic documents has a high
log-odds; the words of toxic documents above a limit are the labelled tokens. The chain is
fitted on them, with the log-odds of a word and of its beginnings as features. A document's own label
never counts towards the log-odds it is fitted with. Forward-backward marginals of a whole text
give the score, by a logistic fit of their sum of squares and maximum, and the spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from kinolake.llm.blocks import mix, utf8, word_hashes
from kinolake.llm.chain_field import ChainField
from kinolake.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TRAIN_DOCS = 20_000  # labelled documents used for fitting, chosen by a hash
CHAIN_PIECES = 8_000  # pieces of at most PIECE tokens that the chain is fitted on
PIECE = 256
KINDS = (None, 5, 4)  # a word whole, and beginnings of these lengths
EDGES = np.array([0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3.25, 3.75, 4.5, 5.5])
TOKEN_LIMIT = 1.5  # log-odds from which a word of a toxic document is a labelled token
SHRINK = 5.0
CACHE = 400_000
LANES = 256
TOKENS_AT_ONCE = 1 << 20
TEXTS_AT_ONCE = 512
COPY_KEYS = 3
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def held_out(id_col: Column) -> Column:
    """The fifth of the documents whose labels are never used."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features_of(word: str) -> list[str]:
    """The word without case and outer marks, and its beginnings; kinds are told apart by a prefix."""
    word = word.lower().strip("".join(c for c in set(word) if not c.isalnum())) if not word.isalnum() else word.lower()
    return [f"{k or 0}{word[:k]}" if k is None or len(word) > k else "" for k in KINDS]


class Lexicon:
    """Documents of each class that contain a word or beginning, and log-odds as bins."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.counts, self.toxic, self.clean = counts, toxic, clean

    def odds(self, name: str, label: int | None) -> float:
        """Shrunken log-odds, without the document that asks if its label is given."""
        found = self.counts.get(name)
        if found is None:
            return 0.0
        t, c = found
        toxic, clean = self.toxic, self.clean
        if label is not None:
            t, c, toxic, clean = t - (label == 1), c - (label == 0), toxic - (label == 1), clean - (label == 0)
        base = max(toxic, 1) / (max(toxic, 1) + max(clean, 1))
        return float(np.log((t + SHRINK * base) / (c + SHRINK * (1 - base)) * (1 - base) / base))

    def bins(self, words: list[str], label: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Feature values (0: none) and the highest log-odds of each word."""
        odds = np.array([[self.odds(n, label) if n else 0.0 for n in features_of(w)] for w in words]).reshape(-1, len(KINDS))
        place = np.searchsorted(EDGES, odds, "right")
        return np.where(place > 0, place + np.arange(len(KINDS)) * len(EDGES), 0), odds.max(axis=1, initial=0.0)


class ToxicModel:
    def __init__(self, lexicon: Lexicon, chain: ChainField, weights: np.ndarray):
        self.lexicon, self.chain, self.weights = lexicon, chain, weights
        self.cache: dict[str, float] = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        try:
            return np.array([self.cache[w] for w in words], np.float64)
        except KeyError:
            if len(self.cache) > CACHE:
                self.cache.clear()
            new = list({w for w in words if w not in self.cache})
            self.cache.update(zip(new, self.chain.emission(self.lexicon.bins(new)[0]).tolist()))
            known = self.cache
            return np.array([known[w] if w in known else self.chain.emission(self.lexicon.bins([w])[0])[0]
                             for w in words], np.float64)

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of the toxic label of each token; texts of like length go side by side."""
        order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(emissions)
        at = 0
        while at < len(order) and len(emissions[order[at]]):
            longest = len(emissions[order[at]])
            some = order[at:at + max(1, min(LANES, TOKENS_AT_ONCE // longest))]
            some = [i for i in some if len(emissions[i])]
            lengths = np.array([len(emissions[i]) for i in some])
            grid = np.zeros((longest, len(some)))
            for lane, i in enumerate(some):
                grid[:lengths[lane], lane] = emissions[i]
            p = self.chain.marginals(grid, lengths)
            for lane, i in enumerate(some):
                out[i] = p[:lengths[lane], lane]
            at += len(some)
        return out

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(summary(p) @ self.weights, -_FAR, _FAR))))


_FAR = 30.0


def summary(p: np.ndarray) -> np.ndarray:
    """What the marginals of a document say about it as a whole."""
    return np.array([1.0, np.log1p((p * p).sum()), p.max(initial=0.0)])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 train_docs: int = TRAIN_DOCS) -> ToxicModel | float:
    """The model from at most ``train_docs`` labelled documents outside the held-out fifth.

    ``labels(doc_id, toxic)``: null ids and labels are left out, and a document labelled twice is toxic if any
    label says so. Without documents of both classes there is nothing to learn, and the result is the
    share of toxic ones (0 without labels) as the score of every document.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_llm_label")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_llm_label")
    # copies would make the words of one document look frequent: keep one of each group of a label
    found = found.withColumn("_llm_row", F.monotonically_increasing_id())
    keys = [f"k{i}" for i in range(COPY_KEYS)]
    found = cut_lineage(found.mapInArrow(_copy_keys, ", ".join(
        ["doc_id long, text string, _llm_label int, _llm_row long", *[f"{k} long" for k in keys]])))
    light = found.select("doc_id", "_llm_label", "_llm_row", *keys)
    for key in keys:
        light = light.groupBy("_llm_label", key).agg(F.min(F.struct("doc_id", "_llm_row", *keys)).alias("r")).select(
            "_llm_label", "r.*")
    train = found.join(F.broadcast(light.select("_llm_row")), "_llm_row").select("doc_id", "text", "_llm_label")
    train = cut_lineage(train)
    sizes = {r["_llm_label"]: r["count"] for r in train.groupBy("_llm_label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return 1.0 if toxic else 0.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("_llm_label").to_pylist()):
                found[int(label == 1)].update({n for w in set(WORD.findall(text)) for n in features_of(w) if n})
            names = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][n] for n in names], pa.int64()),
                                              pa.array([found[0][n] for n in names], pa.int64())], names=["name", "t", "c"])

    totals = (train.mapInArrow(count, "name string, t long, c long").groupBy("name")
              .agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    base = toxic / (toxic + clean)
    rise = F.log((F.col("t") + SHRINK * base) / (F.col("c") + SHRINK * (1 - base)) * ((1 - base) / base))
    # words of at most ``train_docs`` documents, so bounded with them
    best = totals.where((F.col("t") > 1) & (rise > float(EDGES[0]))).collect()
    lexicon = Lexicon({r["name"]: (r["t"], r["c"]) for r in best}, toxic, clean)
    del best

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, label in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_llm_label"))):
                words = WORD.findall(text)
                bins, high = lexicon.bins(words, int(label == 1))
                tags = ((high >= TOKEN_LIMIT) & (label == 1)).astype(np.uint8)
                at = int(tags.argmax()) if tags.any() else len(words) // 2
                at = max(0, min(at - PIECE // 2, len(words) - PIECE))
                if words:
                    rows.append((i, bins[at:at + PIECE].astype(np.uint8).tobytes(), tags[at:at + PIECE].tobytes()))
            ids, b, t = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(b, pa.binary()), pa.array(t, pa.binary())],
                                             names=["doc_id", "bins", "tags"])

    # both classes in equal numbers at most; ids are chosen before texts are touched
    light = train.select("doc_id", "_llm_label")
    some = [light.where(F.col("_llm_label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CHAIN_PIECES // 2)
            for y in (0, 1)]
    chosen = some[0].unionByName(some[1]).select("doc_id")
    parts = train.join(F.broadcast(chosen), "doc_id").mapInArrow(pieces, "doc_id long, bins binary, tags binary").collect()
    parts.sort(key=lambda r: (-len(r["tags"]), r["doc_id"]))
    chain = ChainField(len(KINDS) * len(EDGES))
    if parts:
        lengths = np.array([len(r["tags"]) for r in parts])
        bins = np.zeros((lengths[0], len(parts), len(KINDS)), np.uint8)
        tags = np.zeros((lengths[0], len(parts)), np.uint8)
        for lane, r in enumerate(parts):
            bins[:lengths[lane], lane] = np.frombuffer(r["bins"], np.uint8).reshape(-1, len(KINDS))
            tags[:lengths[lane], lane] = np.frombuffer(r["tags"], np.uint8)
        del parts
        chain.fit(bins, tags, lengths)
        del bins, tags
    model = ToxicModel(lexicon, chain, np.zeros(3))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [int(x == 1) for x in batch.column("_llm_label").to_pylist()]
            emissions = [chain.emission(lexicon.bins(WORD.findall(t), y)[0])
                         for t, y in zip(batch.column("text").to_pylist(), marks)]
            x = np.array([summary(p) for p in model.marginals(emissions)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), pa.array(marks, pa.int64())],
                                             names=["sum", "most", "y"])

    rows = sorted(map(tuple, train.mapInArrow(summaries, "sum double, most double, y long").collect()))
    model.weights = _logistic(np.array([(1.0, s, m) for s, m, _ in rows]), np.array([y for *_, y in rows]))
    return model


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of two smallest hashes each over shingles of five words; near copies share one or more."""
    for batch in batches:
        words, counts = word_hashes(utf8(batch.column("text")))
        width = np.minimum(np.maximum(counts, 1), 5)
        firsts = np.cumsum(counts) - counts
        padded = np.concatenate((words, np.zeros(5, np.uint64)))
        shingle = np.zeros(len(words), np.uint64)
        for j in range(5):
            shingle = shingle * _SHINGLE + padded[j:j + len(words)]
        sizes = np.maximum(counts - width + 1, 1)
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        values = shingle[np.minimum(np.repeat(firsts, sizes) + place, len(shingle) - 1)] if len(shingle) else np.zeros(len(place), np.uint64)
        # texts of fewer words are one shingle of what they have
        short = np.flatnonzero(counts < 5)
        own = counts[short].astype(np.uint64)
        for j in range(5):
            own = own * _SHINGLE + np.where(j < counts[short], padded[np.minimum(firsts[short] + j, len(words))], 0).astype(np.uint64)
        values[ends[short] - 1] = own
        seeds = np.arange(2 * COPY_KEYS, dtype=np.uint64) * _SHINGLE
        least = [np.minimum.reduceat(mix(values + s), ends - sizes) if len(ends) else values for s in seeds]
        for k in range(COPY_KEYS):
            key = mix(least[2 * k] * _SHINGLE + least[2 * k + 1])
            batch = batch.append_column(f"k{k}", pa.array(key.view(np.int64)))
        yield batch


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -_FAR, _FAR)))
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
    return w


def score_toxicity(docs: DataFrame, model: ToxicModel | float, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``toxic_spans``, the character ranges [from, to) of toxic tokens.

    Neighbouring toxic tokens (marginal of at least a half) form one span. Null and empty texts have no
    tokens and get the score of a text without any sign of toxicity. Whole texts are scored; input columns
    of these names are replaced.
    """
    docs = docs.drop("score", "toxic_spans")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()),
                         StructField("toxic_spans", ArrayType(ArrayType(IntegerType())))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            if isinstance(model, float):
                scores, spans = [model] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for first in range(0, 0 if isinstance(model, float) else batch.num_rows, TEXTS_AT_ONCE):
                some = [t or "" for t in batch.column(text_col).slice(first, TEXTS_AT_ONCE).to_pylist()]
                marginals = model.marginals([model.emissions(WORD.findall(t)) for t in some])
                for text, p in zip(some, marginals):
                    scores.append(model.score(p))
                    spans.append(_spans(text, p >= 0.5) if (p >= 0.5).any() else [])
            out = batch.append_column("score", pa.array(scores, pa.float64()))
            yield out.append_column("toxic_spans", pa.array(spans, pa.list_(pa.list_(pa.int32()))))

    return docs.mapInArrow(score, schema)


def _spans(text: str, toxic: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = []
    joined = False
    for match, flag in zip(WORD.finditer(text), toxic.tolist()):
        if flag and joined:
            out[-1][1] = match.end()
        elif flag:
            out.append([match.start(), match.end()])
        joined = flag
    return out
