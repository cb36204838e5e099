"""Scalar functions bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolake.functions import scalars as s
from kinolake.functions import text as tx
from kinolake.functions import vectors as v
from kinolake.registry.base import (ASSIGNMENTS_SQL, MULTIPLIER_SQL, PENALTY_SQL, SEGMENTS_SQL, assignments,
                                    kinematic_sql, query, r6, segments, table)

EXIT = ["pan_exit_vel", "tilt_exit_vel", "zoom_exit_vel"]
ENTRY = ["pan_entry_vel", "tilt_entry_vel", "zoom_entry_vel"]
STD = ["pan_std_deriv", "tilt_std_deriv", "zoom_std_deriv"]
MONO = ["pan_monotonicity", "tilt_monotonicity", "zoom_monotonicity"]


def cols(names):
    return [F.col(n) for n in names]


@query("sc01_kinematic_cost", f"""WITH {SEGMENTS_SQL}
SELECT segment_id, round({kinematic_sql('s', 's')}, 6) + 0.0 AS cost FROM segs s""")
def kinematic_cost(spark, sf):
    return segments(spark, sf).select("segment_id", r6(s.kinematic_cost(cols(EXIT), cols(ENTRY))).alias("cost"))


def as_movements(df):
    """Segments with their movements nested: none, one or two by size of the segment."""
    one = F.struct(*[F.col(c) for c in [*ENTRY, *EXIT, *STD, *MONO]])
    two = F.struct(*[(F.col(c) * 2).alias(c) for c in [*ENTRY, *EXIT, *STD, *MONO]])
    moves = (F.when(F.col("start") % 3 == 0, F.array(one, two)).when(F.col("start") % 3 == 1, F.array(one)))
    empty = F.slice(F.array(one), 1, 0)
    return df.select("segment_id", F.coalesce(moves, empty).alias("camera_movements"))


@query("sc02_edge_velocities", f"""WITH {SEGMENTS_SQL}
SELECT segment_id, {", ".join(f"CASE WHEN start % 3 = 2 THEN 0.0 ELSE {c} END AS {c}" for c in ENTRY)},
 {", ".join(f"CASE start % 3 WHEN 0 THEN 2 * {c} WHEN 1 THEN {c} ELSE 0.0 END AS {c}" for c in EXIT)} FROM segs""")
def edge_velocities(spark, sf):
    m = as_movements(segments(spark, sf))
    into, out = (s.movement_velocity(F.col("camera_movements"), e) for e in ("entry", "exit"))
    return m.select("segment_id", *[c.alias(n) for c, n in zip(into, ENTRY)],
                    *[c.alias(n) for c, n in zip(out, EXIT)])


@query("sc03_segment_penalty", f"""WITH {SEGMENTS_SQL}
SELECT segment_id, round(CASE WHEN start % 3 = 2 THEN 0.0 ELSE {PENALTY_SQL} END, 6) + 0.0 AS penalty FROM segs""")
def segment_penalty(spark, sf):
    m = as_movements(segments(spark, sf))
    return m.select("segment_id", r6(s.segment_penalty(F.col("camera_movements"))).alias("penalty"))


@query("sc04_jaccard", """WITH t AS (SELECT doc_id, list_distinct([x FOR x IN regexp_split_to_array(lower(text), '\\s+') IF x <> '']) AS a,
 list_distinct([lower(lang), lower(source), 'de', 'la', 'the']) AS b FROM documents)
SELECT doc_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0
 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) + 0.0 AS score FROM t""")
def jaccard(spark, sf):
    d = table(spark, sf, "documents")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    tags = F.array("lang", "source", F.lit("De"), F.lit("La"), F.lit("The"))
    return d.select("doc_id", r6(v.jaccard(words, tags)).alias("score"))


@query("sc05_total_cost", f"""WITH {SEGMENTS_SQL}, {ASSIGNMENTS_SQL}
SELECT scene_id % 50 AS project, scene_id // 50 AS scene_id, segment_id, bucket_idx, seq, round({MULTIPLIER_SQL} * ({kinematic_sql('s', 's')} + {PENALTY_SQL}
  + 0.3 * (1 - narrative_score)), 6) + 0.0 AS cost FROM asg JOIN segs s USING (segment_id)""")
def total_cost(spark, sf):
    rows = assignments(spark, sf).join(segments(spark, sf), "segment_id")
    cost = s.total_cost(s.kinematic_cost(cols(EXIT), cols(ENTRY)), s.penalty_from_stats(cols(STD), cols(MONO)),
                        F.col("narrative_score"), F.col("rating"))
    return rows.select("project", "scene_id", "segment_id", "bucket_idx", "seq", r6(cost).alias("cost"))


@query("sc06_vector_measures", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v,
  lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS w FROM embeddings)
SELECT vec_id, round(list_dot_product(v, w), 6) + 0.0 AS dot,
  round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) + 0.0 AS cosine,
  round(sqrt(list_dot_product(v, v)), 6) + 0.0 AS norm,
  round(v[1] / sqrt(list_dot_product(v, v)), 6) + 0.0 AS first_unit FROM e""")
def vector_measures(spark, sf):
    from kinolake.operators import ordering as o
    e = table(spark, sf, "embeddings").withColumn("series", F.lit(0))
    e, w = o.neighbourhood(o.number_rows(e, ["series"], ["vec_id"], o.id_bucket(F.col("vec_id"))), ["series"], 0, 1)
    e = o.own_rows(e.withColumn("next", F.lead("embedding").over(w)))
    a, b = F.col("embedding"), F.col("next")
    return e.select("vec_id", r6(v.dot(a, b)).alias("dot"), r6(v.cosine(a, b)).alias("cosine"),
                    r6(v.array_norm(a)).alias("norm"), r6(F.get(v.l2_normalise(a), F.lit(0))).alias("first_unit"))


@query("sc07_magnitude_penalty", f"""WITH {SEGMENTS_SQL}, n AS (SELECT segment_id,
  sqrt({"+".join(f"{c}*{c}" for c in EXIT)}) AS a, sqrt({"+".join(f"{c}*{c}" for c in ENTRY)}) AS b FROM segs)
SELECT segment_id, CASE WHEN a >= 1e-9 AND b >= 1e-9 THEN round(exp(-abs(ln(b / a))), 6) END AS penalty FROM n""")
def magnitude_penalty(spark, sf):
    return segments(spark, sf).select("segment_id", r6(s.magnitude_penalty(cols(EXIT), cols(ENTRY))).alias("penalty"))


@query("sc08_decompose_matrix", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(l_quantity / 1000, 6) + 0.0 AS pan, round(l_tax * 100 / 500, 6) + 0.0 AS tilt,
  round(degrees(atan2(l_discount, 1 - l_tax)), 6) + 0.0 AS roll,
  round(sqrt((1 - l_tax) * (1 - l_tax) + l_discount * l_discount) - 1, 6) + 0.0 AS zoom FROM lineitem""")
def decompose_matrix(spark, sf):
    li = table(spark, sf, "lineitem")
    h = F.array(1 - F.col("l_tax"), -F.col("l_discount"), F.col("l_quantity"), F.col("l_discount"),
                1 - F.col("l_tax"), F.col("l_tax") * 100, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    parts = s.decompose_matrix(h, F.lit(1000), F.lit(500))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     *[r6(c).alias(n) for n, c in parts.items()])


@query("sc09_motion_category", """WITH m AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_id, CASE WHEN abs(k / 50 - 1) >= 0.5 AND value / 20 <= 1 THEN 'smooth sweep'
  WHEN abs(k / 50 - 1) >= 0.5 THEN 'sweep / speed bursts' WHEN value / 20 <= 1 THEN 'static'
  ELSE 'chaotic / handheld' END AS category FROM m""")
def motion_category(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", s.motion_category(k / 50 - 1, F.col("value") / 20).alias("category"))


@query("sc10_parse_timecode", """WITH m AS (SELECT event_id, event_type, value, event_id % 24 AS h, event_id % 60 AS m FROM events)
SELECT event_id, round(CASE event_type WHEN 'view' THEN h * 3600 + m * 60 + value WHEN 'click' THEN m * 60 + value
  WHEN 'signup' THEN value ELSE 0.0 END, 6) + 0.0 AS seconds FROM m""")
def parse_timecode(spark, sf):
    e = table(spark, sf, "events")
    h, m = (F.col("event_id") % 24).cast("string"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    x = F.col("value").cast("string")
    code = (F.when(F.col("event_type") == "view", F.concat_ws(":", h, m, x))
            .when(F.col("event_type") == "click", F.concat_ws(":", m, x))
            .when(F.col("event_type") == "signup", F.concat(x, F.lit("s"))).otherwise(F.col("event_type")))
    return e.select("event_id", r6(tx.parse_timecode(code)).alias("seconds"))


@query("sc11_format_time", """SELECT event_id,
  floor(value / 60)::BIGINT || ':' || lpad(floor(value % 60)::BIGINT::VARCHAR, 2, '0') AS duration,
  floor(value / 60)::BIGINT || ':' || lpad(floor(value % 60)::BIGINT::VARCHAR, 2, '0') || '.' ||
    lpad(floor((value % 1) * 100)::BIGINT::VARCHAR, 2, '0') AS stamp,
  printf('%02d:%06.3f', floor(floor(value) / 60)::BIGINT, value - floor(floor(value) / 60) * 60) AS clock FROM events""")
def format_time(spark, sf):
    x = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", tx.format_duration(x).alias("duration"), tx.format_timestamp(x).alias("stamp"),
        tx.format_clock(x).alias("clock"))


@query("sc12_parse_rate", """SELECT event_id, round(CASE event_type WHEN 'view' THEN (event_id % 61) * 1000 / 1001
  WHEN 'click' THEN value WHEN 'signup' THEN 0.0 ELSE 0.0 END, 6) + 0.0 AS fps FROM events""")
def parse_rate(spark, sf):
    e = table(spark, sf, "events")
    text = (F.when(F.col("event_type") == "view", F.concat((F.col("event_id") % 61 * 1000).cast("string"), F.lit("/1001")))
            .when(F.col("event_type") == "click", F.col("value").cast("string"))
            .when(F.col("event_type") == "signup", F.concat(F.col("value").cast("string"), F.lit("/0")))
            .otherwise(F.col("event_type")))
    return e.select("event_id", r6(tx.parse_rate(text)).alias("fps"))


@query("sc13_scaled_height", """SELECT p_partkey, CAST(floor(640 * (p_size / (p_size + p_retailprice / 100))) AS INT)
  + CAST(floor(640 * (p_size / (p_size + p_retailprice / 100))) AS INT) % 2 AS height FROM part""")
def scaled_height(spark, sf):
    p = table(spark, sf, "part")
    h = s.scaled_height(F.col("p_size") + F.col("p_retailprice") / 100, F.col("p_size").cast("double"), 640)
    return p.select("p_partkey", h.alias("height"))


@query("sc14_sample_time", "SELECT event_id, round((event_id + 1) / 4.0::DOUBLE, 6) + 0.0 AS seconds FROM events")
def sample_time(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(s.sample_time(F.col("event_id"), 4.0)).alias("seconds"))


@query("sc15_identifiers", """SELECT o_orderkey, substr(sha256(o_orderstatus || ':' || o_orderkey), 1, 8) AS segment_id,
  substr(md5(o_orderpriority), 1, 8) AS video_key,
  substr(md5(o_orderpriority || ':' || printf('%.3f', o_totalprice)), 1, 8) AS clip_key FROM orders""")
def identifiers(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", s.segment_id(F.col("o_orderstatus"), F.col("o_orderkey")).alias("segment_id"),
        s.short_id(F.col("o_orderpriority")).alias("video_key"),
        s.short_id(F.col("o_orderpriority"), F.col("o_totalprice")).alias("clip_key"))


@query("sc16_rational_time", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(round_even(l_quantity * 24.5::DOUBLE, 0) AS BIGINT) AS frame FROM lineitem""")
def rational_time(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.rational_time(F.col("l_quantity"), 24.5).alias("frame"))


ANSWERS_SQL = """ans AS (SELECT conv_id, turn, role, len(text) AS size FROM conversations)"""


@query("sc17_parse_fenced_json", """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE conv_id::VARCHAR END AS scene,
  CASE WHEN turn % 5 = 4 THEN NULL ELSE len(text) / 10 END AS score FROM conversations""")
def parse_fenced_json(spark, sf):
    c = responses(table(spark, sf, "conversations"))
    parsed = tx.parse_fenced_json(F.col("response"), "scene string, score double, text string")
    return c.select("conv_id", "turn", parsed["scene"].alias("scene"), parsed["score"].alias("score"))


def responses(conversations):
    """Each message as a model response: bare, fenced, unclosed fence, list, or broken."""
    body = F.to_json(F.struct(F.col("conv_id").cast("string").alias("scene"),
                              (F.length("text") / 10).alias("score"), "text"))
    kind = F.col("turn") % 5
    text = (F.when(kind == 0, body)
            .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(kind == 2, F.concat(F.lit("```\n"), body))
            .when(kind == 3, F.concat(F.lit("  ```json\n["), body, F.lit(",{}]\n```\n")))
            .otherwise(F.concat(F.lit("```json\n{\"scene\": "), F.col("text"))))
    return conversations.withColumn("response", text)


@query("sc18_unwrap_list", """SELECT conv_id, turn, b.i::BIGINT AS beat, CASE b.i WHEN 1 THEN role ELSE len(text)::VARCHAR END AS content
  FROM conversations, (VALUES (1), (2)) b(i)""")
def unwrap_list(spark, sf):
    c = table(spark, sf, "conversations")
    beats = F.to_json(F.array(F.struct(F.lit(1).alias("id"), F.col("role").alias("text")),
                              F.struct(F.lit(2).alias("id"), F.length("text").cast("string").alias("text"))))
    raw = F.when(F.col("turn") % 2 == 0, beats).otherwise(
        F.concat(F.lit('{"narration_segments": '), beats, F.lit("}")))
    rows = c.select("conv_id", "turn", F.explode(tx.unwrap_list(
        raw, "narration_segments", "struct<id:bigint,text:string>")).alias("b"))
    return rows.select("conv_id", "turn", F.col("b.id").alias("beat"), F.col("b.text").alias("content"))


@query("sc19_unwrap_description", """SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 1) THEN nullif(text, '') END AS description FROM conversations""")
def unwrap_description(spark, sf):
    c = table(spark, sf, "conversations")
    inner = F.to_json(F.struct(F.col("text").alias("description")))
    kind = F.col("turn") % 4
    raw = (F.when(kind == 0, inner).when(kind == 1, F.concat(F.lit('{"vlm": '), inner, F.lit("}")))
           .when(kind == 2, F.lit('{"vlm": {"description": ""}}')).otherwise(F.lit('{"summary": "x"}')))
    return c.select("conv_id", "turn", tx.unwrap_description(raw).alias("description"))


JUDGED = "quality * 0.6 + (doc_id % 5) * 0.1"


@query("sc20_story_decision", f"""SELECT doc_id, CASE WHEN 0.4 + quality * 0.2 - toxic * 0.1 < 0.5 THEN 'revise'
  WHEN {JUDGED} >= 0.7 OR doc_id % 4 >= 2 THEN 'approve' ELSE 'revise' END AS decision FROM labels""")
def story_decision(spark, sf):
    lab = table(spark, sf, "labels")
    context = 0.4 + F.col("quality") * 0.2 - F.col("toxic") * 0.1
    total = F.col("quality") * 0.6 + F.col("doc_id") % 5 * 0.1
    return lab.select("doc_id", s.story_decision(context, total, F.col("doc_id") % 4).alias("decision"))


@query("sc21_storyboard_decision", f"""SELECT doc_id, CASE WHEN {JUDGED} >= 0.7 THEN 'approve'
  WHEN doc_id % 4 >= 2 THEN 'escalate' ELSE 'revise' END AS decision FROM labels""")
def storyboard_decision(spark, sf):
    lab = table(spark, sf, "labels")
    total = F.col("quality") * 0.6 + F.col("doc_id") % 5 * 0.1
    return lab.select("doc_id", s.storyboard_decision(total, F.col("doc_id") % 4).alias("decision"))


@query("sc22_review_route", """SELECT d.doc_id, round(coalesce(quality * 0.9::DOUBLE, 0.5), 6) + 0.0 AS score,
  CASE WHEN NOT coalesce(toxic = 1, false) THEN 'persist' WHEN d.doc_id % 2 >= 1 THEN 'persist' ELSE 'reassemble' END AS route
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def review_route(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", r6(s.review_score(F.col("quality") * 0.9)).alias("score"),
                    s.review_route(F.col("toxic") == 1, F.col("doc_id") % 2).alias("route"))


@query("sc24_processing_status", """WITH p AS (SELECT o_orderkey,
  [x FOR x IN [CASE WHEN o_orderkey % 2 = 0 THEN 'downsampled' END, CASE WHEN o_orderkey % 3 = 0 THEN 'optical_flow' END,
   CASE WHEN o_orderstatus <> 'P' THEN 'segmented' END, CASE WHEN o_totalprice > 200000 THEN 'described' END] IF x IS NOT NULL] AS done FROM orders)
SELECT o_orderkey, array_to_string(done, ',') AS done, CAST(round(len(done) * 100 / 4) AS INT) AS percent,
  len(done) = 4 AS finished, done[-1] AS current_step FROM p""")
def processing_status(spark, sf):
    d = F.col("o_orderdate")
    steps = {"downsampled": F.when(F.col("o_orderkey") % 2 == 0, d),
             "optical_flow": F.when(F.col("o_orderkey") % 3 == 0, d),
             "segmented": F.when(F.col("o_orderstatus") != "P", d),
             "described": F.when(F.col("o_totalprice") > 200000, d)}
    done = s.completed_steps(steps)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.array_join(done, ",").alias("done"), s.processing_percent(done).alias("percent"),
        s.fully_processed(done).alias("finished"), s.current_step(done).alias("current_step"))


@query("sc26_relative_interval", f"""WITH {SEGMENTS_SQL}
SELECT segment_id, round(greatest((start + pan_entry_vel * 10 - start) / ("end" - start) * 100, 0.0), 6) + 0.0 AS left_percent,
  round(greatest((tilt_exit_vel * 10 + 0.05) / ("end" - start) * 100, 1.0), 6) + 0.0 AS width_percent FROM segs""")
def relative_interval(spark, sf):
    g = segments(spark, sf)
    child = F.col("start") + F.col("pan_entry_vel") * 10
    left, width = s.relative_interval(F.col("start"), F.col("end") - F.col("start"), child,
                                      child + F.col("tilt_exit_vel") * 10 + 0.05)
    return g.select("segment_id", r6(left).alias("left_percent"), r6(width).alias("width_percent"))


@query("sc27_media_url", """SELECT p_partkey, '/files/' || p_type || '/videos/' || p_brand || '/' || replace(p_name, ' ', '_')
   || '_downsampled.mp4' AS small, '/files/' || p_type || '/videos/' || p_brand || '/' || replace(p_name, ' ', '_')
   || CASE p_size % 3 WHEN 0 THEN '_original.MP4' WHEN 1 THEN '_ORIGINAL.mov' ELSE '' END AS original FROM part""")
def media_url(spark, sf):
    p = table(spark, sf, "part")
    suffix = F.when(F.col("p_size") % 3 == 0, "_original.MP4").when(F.col("p_size") % 3 == 1, "_ORIGINAL.mov").otherwise("")
    name = F.concat(F.translate("p_name", " ", "_"), suffix)
    args = (F.col("p_type"), F.col("p_brand"), name)
    return p.select("p_partkey", tx.media_url(*args, kind="downsampled").alias("small"),
                    tx.media_url(*args).alias("original"))


@query("sc30_pose_speed", """SELECT event_id, round(sqrt(2 * value * value + 3 * k * k + 1), 6) + 0.0 AS speed
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def pose_speed(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    x = F.col("value")
    return table(spark, sf, "events").select("event_id", r6(s.pose_speed([x, x, k, k, k, F.lit(1.0)])).alias("speed"))
