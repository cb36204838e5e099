"""Description operators bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolake.operators import describe as d
from kinolake.operators import ordering as o
from kinolake.plans import descriptions as ingest
from kinolake.registry.base import SEGMENTS_SQL, query, r6, segments, table
from kinolake.registry.scalars import responses


@query("pr03_extract_attrs", """SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS metrics_pan_rms, user_id AS nested_user, NULL::VARCHAR AS nested_gone FROM events""")
def extract_attrs(spark, sf):
    e = table(spark, sf, "events")
    a = d.extract_attrs(e, ["k", "metrics.pan.rms"], "event_id", "props")
    n = e.select("event_id", F.struct(F.col("user_id").alias("user")).alias("nested"))
    b = d.extract_attrs(n, ["nested.user", "nested.gone"], "event_id")
    return a.join(b, "event_id")


def lines(spark, sf):
    """Line items as descriptions of orders, in arrival order by unique key."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("seq"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("rating"))


def described_orders(spark, sf):
    """Orders as segments; those of status P have no description, and their lines are orphans."""
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P' OR o_totalprice > 250000").select(
        F.col("o_orderkey").alias("segment_id"), F.col("o_totalprice").alias("start"))


LINES_SQL = """seg AS (SELECT o_orderkey AS segment_id, o_totalprice AS start FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 250000),
  des AS (SELECT l_orderkey AS segment_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS seq, l_quantity AS quantity, l_returnflag AS rating,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS vlm_pos FROM lineitem)"""
ORDER = ["line", "part", "seq"]


@query("jn01_combined_view", f"WITH {LINES_SQL} SELECT s.*, d.vlm_pos, d.part, d.quantity, d.rating FROM seg s LEFT JOIN des d USING (segment_id)")
def combined_view(spark, sf):
    rows = d.combined_view(described_orders(spark, sf), lines(spark, sf), order=ORDER)
    return rows.select("segment_id", "start", "vlm_pos", "part", "quantity", "rating")


@query("jn01_nested_view", f"""WITH {LINES_SQL} SELECT s.segment_id, count(d.part) AS descriptions, coalesce(string_agg(d.part, ',' ORDER BY vlm_pos), '') AS parts
   FROM seg s LEFT JOIN des d USING (segment_id) GROUP BY s.segment_id""")
def nested_view(spark, sf):
    rows = d.nest_descriptions(described_orders(spark, sf), lines(spark, sf), ["quantity", "rating"], order=ORDER)
    return rows.select("segment_id", F.size("vlm").cast("bigint").alias("descriptions"),
                       F.array_join(F.transform("vlm", lambda x: x["part"].cast("string")), ",").alias("parts"))


@query("jn16_first_description", f"WITH {LINES_SQL} SELECT s.segment_id, d.part, d.rating FROM seg s LEFT JOIN des d ON d.segment_id = s.segment_id AND vlm_pos = 1")
def first_description(spark, sf):
    first = d.first_descriptions(lines(spark, sf), ["part", "rating"], order=ORDER)
    return described_orders(spark, sf).join(first, "segment_id", "left").select("segment_id", "part", "rating")


@query("pr06_flatten_movements", """SELECT o_orderkey, l_linenumber AS movement_id, l_partkey, l_suppkey, round(l_quantity / 3, 2) AS start_time, round(l_discount / 7, 4) AS pan_entry_vel,
   round(l_tax / 7, 3) AS pan_monotonicity FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def flatten_movements(spark, sf):
    li = table(spark, sf, "lineitem")
    move = F.struct(F.col("l_linenumber").alias("movement_id"), "l_partkey", "l_suppkey", (F.col("l_quantity") / 3).alias("start_time"),
                    (F.col("l_discount") / 7).alias("pan_entry_vel"), (F.col("l_tax") / 7).alias("pan_monotonicity"))
    nested = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(move).alias("camera_movements"))
    docs = table(spark, sf, "orders").select("o_orderkey").join(nested, "o_orderkey")
    return d.flatten_movements(docs, "camera_movements", ["o_orderkey"], {"start_time": 2, "pan_entry_vel": 4, "pan_monotonicity": 3})


@query("pr06_flatten_channels", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS pan_rms, l_tax AS pan_entry_vel, l_quantity AS tilt_rms, l_extendedprice AS tilt_entry_vel FROM lineitem""")
def flatten_channels(spark, sf):
    one = lambda a, b: F.struct(F.col(a).alias("rms"), F.col(b).alias("entry_vel"))
    li = table(spark, sf, "lineitem").withColumn("m", F.struct(one("l_discount", "l_tax").alias("pan"), one("l_quantity", "l_extendedprice").alias("tilt")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *d.flatten_channels(li, "m", ["pan", "tilt"], ["rms", "entry_vel"]))


@query("pr07_quality_rating", f"WITH {SEGMENTS_SQL} SELECT segment_id, coalesce(nullif(CASE WHEN start % 5 = 0 THEN NULL ELSE rating END, ''), 'good') AS rating FROM segs")
def quality_rating(spark, sf):
    g = segments(spark, sf)
    one = F.array(F.struct("rating"))
    vlm = F.when(F.col("start") % 5 == 0, F.slice(one, 1, 0)).otherwise(one)
    return g.select("segment_id", d.quality_rating(vlm).alias("rating"))


@query("pr08_search_text", r"""WITH t AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE text END AS body,
    [x FOR x IN [CASE WHEN lang <> 'fr' THEN source END, CASE WHEN lang = 'de' THEN lang END] IF x IS NOT NULL] AS hl, CASE WHEN lang = 'en' OR lang = 'fr' THEN [] ELSE [lang, source] END AS tags FROM documents)
  SELECT doc_id, md5(coalesce(nullif(array_to_string([x FOR x IN [body, array_to_string(CASE WHEN doc_id % 3 = 0 THEN [] ELSE hl END, ' '), array_to_string(tags, ' ')] IF x <> ''], ' '), ''), doc_id::VARCHAR)) AS digest FROM t""")
def search_text(spark, sf):
    doc = table(spark, sf, "documents")
    body = F.when(F.col("lang") == "en", "").otherwise(F.col("text"))
    none = F.array().cast("array<string>")
    highlights = F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.array(
        F.when(F.col("lang") != "fr", F.col("source")), F.when(F.col("lang") == "de", F.col("lang"))))
    tags = F.when(F.col("lang").isin("en", "fr"), none).otherwise(F.array("lang", "source"))
    return doc.select("doc_id", F.md5(d.search_text(body, highlights, tags, F.col("doc_id"))).alias("digest"))


@query("pr09_query_text", r"""SELECT item_id, md5(trim(array_to_string([x FOR x IN [CASE WHEN item_id % 2 = 0 THEN text ELSE '' END, text, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'sky sea' END] IF x <> ''], ' '))) AS digest FROM benchmark""")
def query_text(spark, sf):
    words = F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("sky"), F.lit("sea")))
    narration = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("")
    return table(spark, sf, "benchmark").select("item_id", F.md5(d.query_text(narration, F.col("text"), words)).alias("digest"))


@query("sc28_description_lines", f"""WITH {LINES_SQL} SELECT segment_id, vlm_pos, '[Segment ' || segment_id || ' | ' || printf('%.1f', quantity) || 's–' || printf('%.1f', quantity + seq) || 's] ' || rating || part AS text
   FROM seg JOIN des USING (segment_id)""")
def description_lines(spark, sf):
    rows = d.combined_view(described_orders(spark, sf), lines(spark, sf), order=ORDER).filter("vlm_pos IS NOT NULL")
    return rows.select("segment_id", "vlm_pos", d.description_line(
        F.col("segment_id"), F.col("quantity"), F.col("quantity") + F.col("seq"),
        F.concat("rating", F.col("part").cast("string"))).alias("text"))


@query("sc28_candidate_blocks", f"""WITH {LINES_SQL} SELECT s.segment_id AS scene_id, coalesce(string_agg(part || ' | ' || printf('%.1f', quantity) || 's | ' || rating || ' | ' ||
     CASE WHEN part % 2 = 0 THEN rating || seq ELSE '(no description)' END, chr(10) ORDER BY vlm_pos), '(none)') AS text FROM seg s LEFT JOIN des USING (segment_id) GROUP BY s.segment_id""")
def candidate_blocks(spark, sf):
    rows = d.combined_view(described_orders(spark, sf), lines(spark, sf), order=ORDER).withColumnRenamed("segment_id", "scene_id")
    note = F.when(F.col("part") % 2 == 0, F.concat("rating", F.col("seq").cast("string")))
    line = F.when(F.col("vlm_pos").isNotNull(), d.candidate_line(F.col("part"), F.col("quantity"), F.col("rating"), note))
    return d.text_block(rows.withColumn("text_line", line), ["scene_id"], "text_line", ["vlm_pos"], d.EMPTY_CANDIDATES)


@query("sc28_segment_index", """SELECT p_partkey, '{"segment_id":"' || p_brand || '","start":' || p_size || ',"end":' || (p_size + 2) || '}' AS item FROM part""")
def segment_index(spark, sf):
    return table(spark, sf, "part").select("p_partkey", d.segment_index_item(
        F.col("p_brand"), F.col("p_size"), F.col("p_size") + 2).alias("item"))


@query("sc28_beat_lines", "SELECT conv_id, turn, turn || '. ' || text AS line FROM conversations")
def beat_lines(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", d.beat_line(F.col("turn"), F.col("text")).alias("line"))


# conversations as videos of seven projects, messages as responses about their segments
INGEST_SQL = """seg AS (SELECT conv_id % 7 AS project, conv_id AS video_hash, conv_id * 1000 + turn AS segment_id, turn, turn % 5 <> 4 AS good FROM conversations),
  video AS (SELECT project, video_hash, bool_and(good) AS done FROM seg GROUP BY ALL)"""


def ingested(spark, sf):
    rows = responses(table(spark, sf, "conversations")).select(
        (F.col("conv_id") % 7).alias("project"), F.col("conv_id").alias("video_hash"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), F.col("turn").alias("seq"), "response")
    segs = rows.select("project", "video_hash", "segment_id")
    manifest = segs.select("project", "video_hash").distinct().withColumns({
        "processing": F.create_map(F.lit("segmented"), F.lit("earlier")), "config_hash": F.lit("old")})
    return ingest.ingest_descriptions(rows.select("segment_id", "seq", "response"), segs, manifest,
                                      "scene string, score double, text string", "scene", F.lit("now"), F.lit("new"))


@query("pl07_described_segments", f"""WITH {INGEST_SQL} SELECT video_hash, segment_id, CASE WHEN good THEN 1 END::BIGINT AS vlm_pos,
  CASE WHEN good THEN video_hash::VARCHAR END AS scene FROM seg""")
def described_segments(spark, sf):
    described, *_ = ingested(spark, sf)
    return described.select("video_hash", "segment_id", "vlm_pos", F.col("parsed.scene").alias("scene"))


@query("pl07_stamped_manifest", f"""WITH {INGEST_SQL} SELECT project, video_hash, CASE WHEN done THEN 'now' END AS described_at,
  'earlier' AS segmented_at, CASE WHEN done THEN 'new' ELSE 'old' END AS config_hash FROM video""")
def stamped_manifest(spark, sf):
    _, _, stamped, _ = ingested(spark, sf)
    return stamped.select("project", "video_hash", F.try_element_at("processing", F.lit("described")).alias("described_at"),
                          F.try_element_at("processing", F.lit("segmented")).alias("segmented_at"), "config_hash")


@query("pl07_ready_projects", f"WITH {INGEST_SQL} SELECT project, bool_and(done) AS ready, count(*) AS videos FROM video GROUP BY project")
def ready_projects(spark, sf):
    return ingested(spark, sf)[3]


@query("pl07_ingest_descriptions", """SELECT conv_id, turn, turn % 5 <> 4 AS accepted, CASE WHEN turn % 5 = 4 THEN 'invalid JSON' END AS reason,
   CASE WHEN turn % 5 <> 4 THEN len(text)::BIGINT END AS length FROM conversations""")
def ingest_descriptions(spark, sf):
    good, bad = d.ingest_responses(responses(table(spark, sf, "conversations")), "scene string, score double, text string", "scene")
    a = good.select("conv_id", "turn", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"),
                    F.length("parsed.text").cast("bigint").alias("length"))
    b = bad.select("conv_id", "turn", F.lit(False).alias("accepted"), "reason", F.lit(None).cast("bigint").alias("length"))
    return a.unionByName(b)
