"""Structured Streaming operators; event-time handling is bounded by watermarks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinolake.session import scratch_path
from kinolake.sources.readers import child, file_system

PAIR_SCHEMA = "video_id long, idx long, timestamp double, pan double, prev_idx long, prev_timestamp double, prev_pan double"
SAMPLE = ("idx", "timestamp", "pan")
PACKED = np.dtype([("known", "?"), ("video_id", "<i8"), ("idx", "<i8"), ("timestamp", "<f8"), ("pan", "<f8"), ("at", "<i8")])
PACKED_ROWS = 50_000  # samples of one packed array
BUCKETS = 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keep_state_on_disk(spark: SparkSession) -> None:
    """Keyed state with timers needs the store on local disk; queries with a checkpoint keep the store they began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _Pairs(StatefulProcessor):
    """Samples wait until the watermark has passed them, and then leave in order of time.

    A key is a bucket of videos. Its waiting samples are packed arrays, one per arrival, and so is the last sample of each video,
    so the calls to the store grow with the buckets and not with the videos or samples.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.last = handle.getListState("last", "packed binary")

    @staticmethod
    def _packed(rows: np.ndarray) -> list[tuple]:
        return [(rows[i:i + PACKED_ROWS].tobytes(),) for i in range(0, len(rows), PACKED_ROWS)]

    @staticmethod
    def _rows(state) -> np.ndarray:
        return np.concatenate([np.empty(0, PACKED), *[np.frombuffer(r[0], PACKED) for r in state.get()]])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for fresh in rows:
            if fresh.empty:
                continue
            packed = np.zeros(len(fresh), PACKED)
            packed["known"] = fresh["video_id"].notna()
            packed["video_id"] = fresh["video_id"].fillna(0).astype("int64")
            for c in SAMPLE:
                packed[c] = fresh[c].astype(PACKED[c])
            # the first millisecond at which no earlier sample can come any more
            packed["at"] = -(-fresh["ts"].astype("datetime64[us]").astype("int64") // 1000)
            self.waiting.appendList(self._packed(packed))
            first = int(packed["at"].min()) if first is None else min(first, int(packed["at"].min()))
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = self._rows(self.waiting)
        ready, rest = rows[rows["at"] <= mark], rows[rows["at"] > mark]
        if not len(ready):
            return
        if len(rest):
            self.waiting.put(self._packed(rest))
            self.handle.registerTimer(int(rest["at"].min()))
        else:
            self.waiting.clear()
        before = self._rows(self.last)
        rows, fresh = np.concatenate([before, ready]), np.arange(len(before) + len(ready)) >= len(before)
        order = np.lexsort((rows["idx"], rows["timestamp"], fresh, rows["video_id"], rows["known"]))
        rows, fresh = rows[order], fresh[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows["video_id"][1:] != rows["video_id"][:-1]) | (rows["known"][1:] != rows["known"][:-1])
        self.last.put(self._packed(rows[np.append(first[1:], True)]))
        previous = np.roll(rows, 1)[fresh]
        rows, alone = rows[fresh], first[fresh]
        whole = lambda values, missing: pd.arrays.IntegerArray(np.array(values), np.array(missing))
        yield pd.DataFrame({
            "video_id": whole(rows["video_id"], ~rows["known"]), **{c: np.array(rows[c]) for c in SAMPLE},
            "prev_idx": whole(previous["idx"], alone), "prev_timestamp": np.where(alone, np.nan, previous["timestamp"]),
            "prev_pan": np.where(alone, np.nan, previous["pan"])})


def stream_frame_pairs(samples: DataFrame, lateness: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Each sample with its predecessor across micro-batches, as the batch form gives it.

    ``samples``: video_id, idx, timestamp, pan and the event time ``ts``. A sample is held back until the watermark
    passes it, so those that arrive in any order within ``lateness`` find their true predecessor; one
    that comes later is left out by the watermark. State is the samples held back and, however long a video is
    silent, its last one. The last ``lateness`` of a stream leaves when later samples of any video arrive.

    Videos share ``buckets`` keys of state by a hash. A checkpoint keeps the number it began with; the last samples of a
    bucket are rewritten whenever some of its samples leave, so very many videos want more buckets.
    """
    _keep_state_on_disk(samples.sparkSession)
    keyed = samples.withColumn("_bucket", F.pmod(F.xxhash64("video_id"), F.lit(buckets)))
    return keyed.withWatermark("ts", lateness).groupBy("_bucket").transformWithStateInPandas(
        _Pairs(), PAIR_SCHEMA, "Append", "EventTime")


class _FirstSeen(StatefulProcessor):
    """The first row of every key; a flag per key is all that is kept."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        self.seen.update((True,))
        yield pd.concat(list(rows)).sort_values(self.order).iloc[:1]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))


def stream_register(files: DataFrame, manifest_path: str, key: str, order: str, checkpoint: str):
    """Add unseen content hashes to the manifest table, micro-batch by micro-batch.

    Known hashes are keyed state on local disk, saved with the checkpoint. The manifest is read once, when a
    checkpoint is new, as the first state. A replayed batch replaces its own files and adds nothing.
    """
    spark = files.sparkSession
    _keep_state_on_disk(spark)
    try:
        known = spark.read.schema(files.schema).parquet(manifest_path).select(key).distinct().groupBy(key)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], files.schema).write.parquet(manifest_path)
        known = None
    fresh = files.groupBy(key).transformWithStateInPandas(_FirstSeen(order), files.schema, "Append", "None", known)
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, epoch: int) -> None:
        root, store = file_system(batch.sparkSession, manifest_path)
        prefix, staged = f"batch-{run}-{epoch}-", child(batch.sparkSession, root, f"_staged-{uuid.uuid4().hex}")
        try:
            batch.write.parquet(staged.toString())
            for old in store.listStatus(root):
                if old.getPath().getName().startswith(prefix):
                    store.delete(old.getPath(), False)
            for part in store.listStatus(staged):
                name = part.getPath().getName()
                if name.startswith("part-") and not store.rename(part.getPath(), child(batch.sparkSession, root, prefix + name)):
                    raise OSError(f"batch {epoch} could not be put in place in {manifest_path}")
        finally:
            store.delete(staged, True)

    return (fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_step_status(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """Latest completed step (of equal times the last by name) and readiness per video.

    ``events``: video_id, step, ts. Use update mode; state is one row per video.
    """
    rows = events.withWatermark("ts", lateness) if lateness else events
    return rows.groupBy("video_id").agg(
        F.max_by("step", F.struct("ts", "step")).alias("current_step"), F.max("ts").alias("updated_at"),
        F.bool_or(F.col("step") == "described").alias("ready"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available now into a table in the shared folder and read it."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, name + "-checkpoint")
    if mode == "append":
        query = (stream.writeStream.format("parquet").option("path", path).outputMode("append")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    else:
        def write(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        query = (stream.writeStream.foreachBatch(write).outputMode(mode)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(path)


def latest_updates(updates: DataFrame, key: str) -> DataFrame:
    """Current row per key from the batches of an update-mode stream."""
    fields = [c for c in updates.columns if c not in (key, "epoch", "batch")]
    best = updates.groupBy(key).agg(F.max_by(F.struct(*fields), "epoch").alias("_u"))
    return best.select(key, *[F.col(f"_u.{c}").alias(c) for c in fields])
