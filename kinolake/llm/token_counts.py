"""Token counts of documents in flat token files that have separators but no index.

A file is a run of token ids, cut anywhere into blocks. Each block is searched for the separator as a
whole array. What happens across blocks is one prefix scan over a row per block: tokens and separators
before it, and the place of the last separator. The scan has two levels, so a file of any
length is no single task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinolake.session import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern of this vocabulary, and its free id as end-of-document mark.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 18
BLOCKS_PER_SPAN = 4096


def encoder(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      vocabulary: str = VOCABULARY, separator: int = SEPARATOR, kind: str = "uint16",
                      block_tokens: int = BLOCK_TOKENS) -> None:
    """Write ``path/tokens`` (file, block, tokens) and the writing order ``path/order`` (file, ordinal, doc_id).

    Each Spark partition is a file: the ids of its texts, each text followed by the separator, cut into
    blocks of ``block_tokens`` ids of type ``kind``. The string of a special token in a text is ordinary text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, ordinal, waiting, size = TaskContext.get().partitionId(), 0, 0, [], 0
        model = encoder(vocabulary)  # once per file
        for batch in batches:
            ids, done = batch.column(id_col).to_pylist(), []
            for text in batch.column(text_col).to_pylist():
                tokens = np.array([*model.encode_ordinary(text or ""), separator], kind)
                waiting.append(tokens)
                size += len(tokens)
                if size >= block_tokens:
                    flat = np.concatenate(waiting)
                    full = size // block_tokens
                    done += [flat[i * block_tokens:(i + 1) * block_tokens].tobytes() for i in range(full)]
                    waiting, size = [flat[full * block_tokens:]], size - full * block_tokens
            yield _token_rows(file, block, done, ordinal, ids)
            block, ordinal = block + len(done), ordinal + len(ids)
        if size:
            yield _token_rows(file, block, [np.concatenate(waiting).tobytes()], ordinal, [])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(
        encode, "file int, number long, tokens binary, doc_id long, part string")
    rows.write.partitionBy("part").option("compression", "zstd").parquet(path)


def _token_rows(file, block, payloads, ordinal, ids):
    n, m = len(payloads), len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * (n + m), pa.int32()), pa.array([*range(block, block + n), *range(ordinal, ordinal + m)], pa.int64()),
         pa.array([*payloads, *[None] * m], pa.binary()), pa.array([*[None] * n, *ids], pa.int64()),
         pa.array(["tokens"] * n + ["order"] * m)], names=["file", "number", "tokens", "doc_id", "part"])


def scan_separators(blocks: DataFrame, separator: int = SEPARATOR, kind: str = "uint16",
                    blocks_per_span: int = BLOCKS_PER_SPAN) -> DataFrame:
    """``(file, ordinal, start, n_tokens, closed)`` for every document of ``blocks(file, block, tokens)``.

    ``ordinal`` counts the documents of a file from 0, ``start`` is the place of its first token. Tokens after
    a file's last separator are one more document with ``closed`` false. Empty and null blocks hold no
    tokens; blocks may have any sizes; their order is that of ``block``, which must not repeat within
    a file. Other columns are ignored, and an empty table has no documents.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.frombuffer(p or b"", kind) for p in batch.column("tokens").to_pylist()]
            ends = [np.flatnonzero(a == separator) for a in arrays]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([len(a) for a in arrays], pa.int64()),
                 pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "tokens", "ends"])

    found = blocks.select(F.col("file").cast("int"), F.col("block").cast("long"), "tokens").mapInArrow(
        search, "file int, block long, tokens long, ends array<long>")
    found = found.withColumn("span", F.floor(F.col("block") / blocks_per_span)).withColumn("marks", F.size("ends"))
    inside = Window.partitionBy("file", "span").orderBy("block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("at", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    found = found.withColumn("marks_before", F.coalesce(F.sum("marks").over(earlier), F.lit(0)))
    last = F.col("at") + F.element_at("ends", -1)
    found = found.withColumn("last", F.when(F.col("marks") > 0, last)).withColumn("last_before", F.max("last").over(earlier))
    spans = found.groupBy("file", "span").agg(F.sum("tokens").alias("n"), F.sum("marks").alias("m"), F.max("last").alias("l"))
    # one row per span of blocks
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("span_at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    spans = spans.select("file", "span", "span_at", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("span_marks"),
                         F.max(F.col("span_at") + F.col("l")).over(before).alias("span_last"))
    placed = found.join(spans, ["file", "span"])
    start = F.col("span_at") + F.col("at")
    carried = F.coalesce(F.col("span_at") + F.col("last_before"), F.col("span_last"), F.lit(-1))
    closed = placed.select("file", F.posexplode("ends").alias("i", "end"), start.alias("place"), carried.alias("carried"), "ends",
                           (F.col("span_marks") + F.col("marks_before")).alias("base"))
    opened = F.when(F.col("i") == 0, F.col("carried")).otherwise(F.col("place") + F.get("ends", F.col("i") - 1)) + 1
    closed = closed.select("file", (F.col("base") + F.col("i")).alias("ordinal"), opened.alias("start"),
                           (F.col("place") + F.col("end") - opened).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = placed.groupBy("file").agg(F.sum("marks").alias("ordinal"), F.sum("tokens").alias("n"),
                                      (F.coalesce(F.max(F.col("span_at") + F.col("last")), F.lit(-1)) + 1).alias("start"))
    rest = rest.where("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"),
                                          F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def count_tokens(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(doc_id, n_tokens)``: documents written to flat token files in the shared folder, then counted there.

    Null and empty texts have no tokens; repeated rows are separate documents, and null ids stay null.
    """
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, id_col, text_col, vocabulary, block_tokens=block_tokens)
    schema = "file int, number long, tokens binary, doc_id long, part string"
    written = spark.read.schema(schema).parquet(path)
    counts = scan_separators(written.where("part = 'tokens'").withColumnRenamed("number", "block"))
    order = written.where("part = 'order'").select("file", F.col("number").alias("ordinal"), "doc_id")
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
