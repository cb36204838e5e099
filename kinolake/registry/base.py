"""Bindings of the test tables to the library's inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolake.operators.ordering import longest_series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: Column | str) -> Column:
    """Rounded for comparison; adding zero turns a negative zero positive."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session zone."""
    c = F.col(ts)
    minutes = F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


# -- events as the samples of a signal: one video per user -----------------

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("idx"),
        (micros("ts") / 1e6).alias("timestamp"), "event_type",
        F.col("value").alias("pan"), k.alias("tilt"), (F.sqrt("value") - F.sqrt(k)).alias("zoom"),
        F.sqrt(F.col("value") * F.col("value") + k * k).alias("camera_magnitude"))


EVENTS_SQL = """ev AS (
  SELECT user_id AS video_id, event_id AS idx, epoch_us(ts) / 1e6::DOUBLE AS "timestamp", event_type,
         value AS pan, k AS tilt, sqrt(value) - sqrt(k) AS zoom, sqrt(value * value + k * k) AS camera_magnitude
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""

NUMBERED_SQL = EVENTS_SQL + """, sig AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "timestamp", idx) - 1 AS pos,
         count(*) OVER (PARTITION BY video_id) AS n FROM ev)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).drop("event_type")


def longest(spark: SparkSession, sf_dir: str) -> int:
    """Samples of the longest video, which decides between plain and chunked windows."""
    return longest_series(table(spark, sf_dir, "events"), ["user_id"])


# -- parts as segments, line items as assignments to scenes ----------------

# Rating names by brand number modulo eight.
RATINGS = ("excellent", "good", "Medium", "fair", "bad", "POOR", "")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 8
    rating = None
    for i, name in enumerate(RATINGS):
        rating = F.when(brand == i, name) if rating is None else rating.when(brand == i, name)
    return p.select(
        key.alias("segment_id"), F.col("p_name").alias("video_file"), rating.alias("rating"),
        F.col("p_brand").alias("source_video"),
        (size * 1.0).alias("start"), (size + 2.0 + key % 9).alias("end"),
        ((size % 7 - 3) / 10).alias("pan_entry_vel"), ((size % 5 - 2) / 10).alias("tilt_entry_vel"),
        ((key % 3 - 1) / 10).alias("zoom_entry_vel"),
        ((key % 5 - 2) / 10).alias("pan_exit_vel"), ((size % 3 - 1) / 10).alias("tilt_exit_vel"),
        ((key % 7 - 3) / 10).alias("zoom_exit_vel"),
        ((size % 11) / 20).alias("pan_std_deriv"), ((size % 4) / 20).alias("tilt_std_deriv"),
        ((key % 6) / 20).alias("zoom_std_deriv"),
        ((key % 9 - 4) / 4).alias("pan_monotonicity"), ((key % 5 - 2) / 2).alias("tilt_monotonicity"),
        ((size % 3 - 1) / 1.0).alias("zoom_monotonicity"))


SEGMENTS_SQL = """segs AS (
  SELECT p_partkey AS segment_id, p_name AS video_file, p_brand AS source_video,
    CASE CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 8 WHEN 0 THEN 'excellent' WHEN 1 THEN 'good'
      WHEN 2 THEN 'Medium' WHEN 3 THEN 'fair' WHEN 4 THEN 'bad' WHEN 5 THEN 'POOR' WHEN 6 THEN '' END AS rating,
    p_size * 1.0::DOUBLE AS "start", (p_size + 2 + p_partkey % 9)::DOUBLE AS "end",
    (p_size % 7 - 3) / 10 AS pan_entry_vel, (p_size % 5 - 2) / 10 AS tilt_entry_vel, (p_partkey % 3 - 1) / 10 AS zoom_entry_vel,
    (p_partkey % 5 - 2) / 10 AS pan_exit_vel, (p_size % 3 - 1) / 10 AS tilt_exit_vel, (p_partkey % 7 - 3) / 10 AS zoom_exit_vel,
    (p_size % 11) / 20 AS pan_std_deriv, (p_size % 4) / 20 AS tilt_std_deriv, (p_partkey % 6) / 20 AS zoom_std_deriv,
    (p_partkey % 9 - 4) / 4 AS pan_monotonicity, (p_partkey % 5 - 2) / 2 AS tilt_monotonicity,
    (p_size % 3 - 1) / 1 AS zoom_monotonicity
  FROM part)"""

PENALTY_SQL = """(0.2 * (pan_std_deriv + tilt_std_deriv + zoom_std_deriv) / 3
   - 0.1 * (abs(pan_monotonicity) + abs(tilt_monotonicity) + abs(zoom_monotonicity)) / 3)"""
MULTIPLIER_SQL = """CASE lower(rating) WHEN 'excellent' THEN 0.5 WHEN 'good' THEN 1.0 WHEN 'medium' THEN 2.0
   WHEN 'fair' THEN 2.0 WHEN 'bad' THEN 5.0 WHEN 'poor' THEN 5.0 ELSE 1.0 END"""


def kinematic_sql(a: str, b: str) -> str:
    """Cost from the exit velocity of alias ``a`` to the entry velocity of alias ``b``."""
    x = [f"{a}.{c}_exit_vel" for c in ("pan", "tilt", "zoom")]
    y = [f"{b}.{c}_entry_vel" for c in ("pan", "tilt", "zoom")]
    nx = "sqrt(" + "+".join(f"{v}*{v}" for v in x) + ")"
    ny = "sqrt(" + "+".join(f"{v}*{v}" for v in y) + ")"
    d = "(" + "+".join(f"{p}*{q}" for p, q in zip(x, y)) + ")"
    return (f"CASE WHEN {nx} < 1e-8 AND {ny} < 1e-8 THEN 0.0 ELSE "
            f"0.4 * (1 - {d} / ({nx} * {ny} + 1e-8)) + 0.3 * abs({nx} - {ny}) / (greatest({nx}, {ny}) + 1e-8) END")


# orders as scenes of 50 projects; scene ids repeat from project to project
PROJECTS = 50


def scene_key(order: str) -> list[Column]:
    key = F.col(order)
    return [(key % PROJECTS).alias("project"), F.floor(key / PROJECTS).alias("scene_id")]


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *scene_key("l_orderkey"), F.col("l_partkey").alias("segment_id"),
        F.col("l_linenumber").alias("bucket_idx"), (F.col("l_suppkey") * 100000000 + F.col("l_partkey")).alias("seq"),
        (1 - F.col("l_discount") * 5).alias("narrative_score"))


ASSIGNMENTS_SQL = """asg AS (
  SELECT l_orderkey AS scene_id, l_partkey AS segment_id, l_linenumber AS bucket_idx, l_suppkey * 100000000 + l_partkey AS seq,
         1 - l_discount * 5 AS narrative_score FROM lineitem)"""
