"""Streaming operators over the tables as file streams; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolake.registry.base import EVENTS_SQL, micros, query, table
from kinolake.session import scratch_path
from kinolake.streaming import incremental as inc

SLICES, FILES = 5, 4


def as_file_stream(df, name, order, closing=None):
    """The rows as files that arrive slice by slice; a micro-batch takes one slice, and ``closing`` rows come last."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    place = F.col(order).cast("double")
    low, high = df.agg(F.min(place), F.max(place)).first()
    part = F.least(F.floor((place - low) / (high - low) * SLICES), F.lit(SLICES - 1))
    for i in range(SLICES):
        df.filter(part == i).repartition(FILES).write.mode("append").parquet(path)
    if closing is not None:
        closing.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


@query("ss01_stream_frame_pairs", f"""WITH {EVENTS_SQL} SELECT idx, pan, lag(idx) OVER v AS prev_idx, lag(pan) OVER v AS prev_pan FROM ev
   WINDOW v AS (PARTITION BY video_id ORDER BY "timestamp", idx)""")
def frame_pairs(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("idx"), (micros("ts") / 1e6).alias("timestamp"),
        F.col("value").alias("pan"), F.timestamp_micros(micros("ts")).alias("ts"))
    # a sample of no video, two hours after the last one, lets the others leave
    closing = e.agg(F.max("ts").alias("last")).select(
        F.lit(-1).cast("long").alias("video_id"), F.lit(-1).cast("long").alias("idx"), F.lit(0.0).alias("timestamp"), F.lit(0.0).alias("pan"),
        (F.col("last") + F.expr("INTERVAL 2 HOURS")).alias("ts"))
    pairs = inc.stream_frame_pairs(as_file_stream(e, "samples", "ts", closing), "1 hour")
    return inc.run_to_table(pairs, "pairs").select("idx", "pan", "prev_idx", "prev_pan")


@query("ss02_stream_register", "SELECT substr(sha256(text), 1, 16) AS video_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def register(spark, sf):
    d = table(spark, sf, "documents").select(F.substring(F.sha2("text", 256), 1, 16).alias("video_hash"), "doc_id")
    path, checkpoint = scratch_path(spark, "manifest"), scratch_path(spark, "manifest-checkpoint")
    inc.stream_register(as_file_stream(d, "files", "doc_id"), path, "video_hash", "doc_id", checkpoint).awaitTermination()
    return spark.read.parquet(path)


@query("ss03_stream_step_status", """SELECT user_id AS video_id, replace(arg_max(CASE WHEN event_type = 'purchase' THEN 'described' ELSE event_type END, struct_pack(a := ts, b := CASE WHEN event_type = 'purchase' THEN 'described' ELSE event_type END)), 'described', 'purchase') AS current_step, epoch_us(max(ts)) AS updated_us, bool_or(event_type = 'purchase') AS ready FROM events GROUP BY user_id""")
def step_status(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.timestamp_micros(micros("ts")).alias("ts"),
                                          F.when(F.col("event_type") == "purchase", "described").otherwise(F.col("event_type")).alias("step"))
    status = inc.latest_updates(inc.run_to_table(inc.stream_step_status(as_file_stream(e, "steps", "ts")), "status", "update"), "video_id")
    step = F.when(F.col("current_step") == "described", "purchase").otherwise(F.col("current_step"))
    return status.select("video_id", step.alias("current_step"), F.unix_micros("updated_at").alias("updated_us"), "ready")
