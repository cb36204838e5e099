"""Timelines: suppliers as projects, their line items as entries, parts as segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolake.operators import ordering as o
from kinolake.operators import timeline as tl
from kinolake.plans import editing
from kinolake.registry.assembly import CHAINS_SQL, assignments, selections, targets
from kinolake.registry.base import SEGMENTS_SQL, kinematic_sql, query, rounded, scene_key, segments, table
from kinolake.session import write_once

# one scene per order of a supplier, its lines ordered by line number and part
ENTRIES_SQL = f"""{SEGMENTS_SQL}, ent AS (SELECT l_suppkey AS project, l_orderkey AS scene_id, l_orderkey AS scene_pos, l_linenumber AS bucket_idx, l_partkey AS segment_id,
    s."start", s."end", s."end" - s."start" AS duration, s.video_file, s.source_video,
    row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS link_pos,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS position
    FROM lineitem JOIN segs s ON s.segment_id = l_partkey),
  offs AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY project ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off,
    sum(duration) OVER (PARTITION BY project) AS total FROM ent)"""


def entries(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("project"), F.col("l_orderkey").alias("scene_id"), F.col("l_orderkey").alias("scene_pos"),
        F.col("l_linenumber").alias("bucket_idx"), F.col("l_partkey").alias("segment_id"))
    g = segments(spark, sf).select("segment_id", "start", "end", "video_file", "source_video")
    return li.join(g, "segment_id").withColumn("duration", F.col("end") - F.col("start"))


def longest(spark, sf):
    return o.longest_series(table(spark, sf, "lineitem"), ["l_suppkey"])


def positioned(spark, sf):
    return tl.positions(entries(spark, sf), ["scene_pos", "bucket_idx", "segment_id"], longest=longest(spark, sf))


KEY = ["project", "scene_id", "bucket_idx", "segment_id"]


@query("wn18_positions", f"WITH {ENTRIES_SQL} SELECT project, scene_id, bucket_idx, segment_id, position FROM ent")
def positions(spark, sf):
    return positioned(spark, sf).select(*KEY, "position")


@query("wn19_global_offsets", f'WITH {ENTRIES_SQL} SELECT project, position, off AS "offset", total AS total_duration FROM offs')
def global_offsets(spark, sf):
    return tl.global_offsets(positioned(spark, sf), longest=longest(spark, sf)).select("project", "position", "offset", "total_duration")


@query("sc25_playhead", f"""WITH {ENTRIES_SQL} SELECT project, position, round(off + greatest(bucket_idx - 4, 0), 6) + 0.0 AS global_second,
   round(least((off + greatest(bucket_idx - 4, 0)) / CASE WHEN total = 0 THEN 1 ELSE total END * 100, 100.0), 6) + 0.0 AS percent FROM offs""")
def playhead(spark, sf):
    rows = tl.playheads(positioned(spark, sf), F.col("start") + F.col("bucket_idx") - 4, longest=longest(spark, sf))
    return rounded(rows.select("project", "position", "global_second", "percent"), "global_second", "percent")


def scene_list(spark, sf):
    """Every order as a scene of the project named by its customer."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("scene_id"),
                                             F.col("o_orderkey").alias("scene_pos"))


@query("ag13_timeline_totals", f"""WITH {SEGMENTS_SQL} SELECT o_custkey AS project, o_orderkey AS scene_id, coalesce(sum(s."end" - s."start"), 0.0) AS total_duration, count(s.segment_id) AS segments
   FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN segs s ON s.segment_id = l_partkey GROUP BY ALL""")
def timeline_totals(spark, sf):
    owner = table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("scene_id"))
    rows = entries(spark, sf).drop("project").join(owner, "scene_id")
    return tl.timeline_totals(scene_list(spark, sf), rows)


@query("ag13_project_totals", f"""WITH {SEGMENTS_SQL} SELECT o_custkey AS project, coalesce(sum(s."end" - s."start"), 0.0) AS total_duration, count(s.segment_id)::BIGINT AS total_segments,
   count(DISTINCT o_orderkey) AS scenes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN segs s ON s.segment_id = l_partkey GROUP BY ALL""")
def project_totals(spark, sf):
    return tl.project_totals(timeline_totals(spark, sf))


LINKED_SQL = f"""{SEGMENTS_SQL}, edge AS (SELECT l_orderkey AS scene_id, arg_min(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS f,
    arg_max(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS l FROM lineitem GROUP BY l_orderkey),
  sc AS (SELECT o_custkey AS project, o_orderkey AS scene_id, f, l, lead(o_orderkey) OVER w AS next_scene, lead(f) OVER w AS next_f
    FROM orders LEFT JOIN edge ON edge.scene_id = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  bnd AS (SELECT project, sc.scene_id AS scene_id_a, next_scene AS scene_id_b, l AS segment_id_a, next_f AS segment_id_b, {kinematic_sql('a', 'b')} AS cost
    FROM sc JOIN segs a ON a.segment_id = l JOIN segs b ON b.segment_id = next_f)"""


def owned_lines(spark, sf):
    """Line items with the customer of their order as the project."""
    owner = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_custkey").alias("project"))
    return table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "scene_id").join(owner, "scene_id")


def linked_scenes(spark, sf):
    link = F.struct("l_linenumber", F.col("l_partkey").alias("segment_id"))
    links = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("scene_id")).agg(F.array_sort(F.collect_list(link)).alias("links"))
    return scene_list(spark, sf).join(links, "scene_id", "left")


def boundaries(spark, sf):
    return tl.scene_boundaries(linked_scenes(spark, sf), segments(spark, sf))


@query("jn09_scene_boundaries", f"WITH {LINKED_SQL} SELECT *  EXCLUDE (cost), round(cost, 6) + 0.0 AS kinematic_cost, cost > 0.6 AS flagged FROM bnd")
def scene_boundaries(spark, sf):
    return rounded(boundaries(spark, sf), "kinematic_cost")


@query("jn10_swap_candidates", f"""WITH {LINKED_SQL}, pool AS (SELECT o_custkey AS project, l_orderkey AS scene_id, l_partkey AS segment_id, min(l_linenumber) AS rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
  y AS (SELECT bnd.project, bnd.scene_id_a, bnd.scene_id_b, b.segment_id, p.rank, bnd.cost, {kinematic_sql('a', 'b')} AS swap FROM bnd JOIN pool p ON p.project = bnd.project AND p.scene_id = bnd.scene_id_b AND p.segment_id <> bnd.segment_id_b
     JOIN segs a ON a.segment_id = bnd.segment_id_a JOIN segs b ON b.segment_id = p.segment_id),
  z AS (SELECT *, row_number() OVER (PARTITION BY project, scene_id_a, scene_id_b ORDER BY round(swap, 9), rank, segment_id) AS k FROM y WHERE swap < cost)
  SELECT project, scene_id_a, scene_id_b, round(swap, 6) + 0.0 AS swap_cost, k::INT AS swap_no, segment_id FROM z WHERE k <= 3""")
def swap_candidates(spark, sf):
    pool = owned_lines(spark, sf).groupBy("project", "scene_id", F.col("l_partkey").alias("segment_id")).agg(
        (F.min("l_linenumber") * 100000000 + F.col("l_partkey")).alias("rank"))
    return rounded(tl.swap_candidates(boundaries(spark, sf), pool, segments(spark, sf)), "swap_cost")


@query("jn14_resolve_sources", """WITH m AS (SELECT p_brand AS h, min(p_partkey) AS k, arg_min(p_name, p_partkey) AS nm FROM part GROUP BY p_brand)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p.p_size > 40 THEN p.p_name WHEN m.k % 2 = 0 THEN 'file:///data/store/videos/' || replace(m.nm, ' ', '%20') || '/' || replace(p.p_brand, '#', '%23') || '~*.mp4'
    ELSE 'file:///raw/' || replace(p.p_brand, '#', '%23') || '%2Ba%2520b.mov' END AS source FROM lineitem JOIN part p ON p_partkey = l_partkey LEFT JOIN m ON m.h = p.p_brand""".replace("~*", "~%2A"))
def resolve_sources(spark, sf):
    p = table(spark, sf, "part")
    m = p.groupBy(F.col("p_brand").alias("video_hash")).agg(F.min("p_partkey").alias("k"), F.min_by("p_name", "p_partkey").alias("nm"))
    manifest = m.select(
        "video_hash", F.concat(F.lit("/raw/"), F.col("video_hash"), F.lit("+a%20b.mov")).alias("original_path"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("videos/"), F.col("nm"), F.lit("/"), F.col("video_hash"), F.lit("~*.mp4"))).alias("storage_key"))
    e = table(spark, sf, "lineitem").join(p.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    e = e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("source_video"),
                 F.col("p_name").alias("video_file"))
    return tl.resolve_sources(e, manifest, "/data/store").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "source")


ACTION_SQL = "CASE WHEN scene_id_b % 3 = 0 THEN 'transition' ELSE 'accept' END"
KIND_SQL = "CASE WHEN scene_id_b % 2 = 0 THEN 'dip_to_black' ELSE '' END"


def decisions(b):
    return b.select("project", "scene_id_a", "scene_id_b", F.when(F.col("scene_id_b") % 3 == 0, "transition").otherwise("accept").alias("action"),
                    F.when(F.col("scene_id_b") % 2 == 0, "dip_to_black").otherwise("").alias("transition_type"))


@query("sc23_stitch_action", f"""WITH {LINKED_SQL} SELECT o_custkey AS project, l_orderkey AS scene_id, l_linenumber, l_partkey AS segment_id, l_suppkey,
   CASE WHEN scene_id_b IS NOT NULL AND {ACTION_SQL} = 'transition' THEN coalesce(nullif({KIND_SQL}, ''), 'dissolve') ELSE 'cut' END AS stitch_action
   FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN bnd ON bnd.project = o_custkey AND scene_id_b = l_orderkey AND segment_id_b = l_partkey""")
def stitch_action(spark, sf):
    b = boundaries(spark, sf)
    e = owned_lines(spark, sf).select("project", "scene_id", "l_linenumber", F.col("l_partkey").alias("segment_id"), "l_suppkey")
    return tl.stitch_actions(e, b, decisions(b))


EXPORT_SQL = f"""{ENTRIES_SQL}, act AS (SELECT *, CASE WHEN scene_id % 3 = 0 THEN 'dissolve' WHEN scene_id % 3 = 1 THEN 'cut' ELSE '' END AS action FROM offs)"""


@query("sc31_export_items", f"""WITH {EXPORT_SQL}
  SELECT project, 'clip' AS kind, position * 3 + 1 AS sort_key, segment_id::VARCHAR AS name, scene_id, CAST(round_even("start" * 24.5::DOUBLE, 0) AS BIGINT) AS start_frame,
    CAST(round_even(("end" - "start") * 24.5::DOUBLE, 0) AS BIGINT) AS duration_frames, video_file AS source FROM act
  UNION ALL SELECT project, 'transition', position * 3, action, scene_id, 6, 6, NULL FROM act WHERE position > 1 AND action = 'dissolve'
  UNION ALL SELECT project, 'marker', min(position) * 3 - 1, 'Scene ' || scene_id, scene_id, CAST(round_even(min(off) * 24.5::DOUBLE, 0) AS BIGINT), 0, NULL FROM act GROUP BY project, scene_id""")
def export_items(spark, sf):
    rows = positioned(spark, sf).withColumns({
        "source": F.col("video_file"),
        "stitch_action": F.when(F.col("scene_id") % 3 == 0, "dissolve").when(F.col("scene_id") % 3 == 1, "cut").otherwise("")})
    return tl.export_items(rows, 24.5, longest=longest(spark, sf))


@query("sc28_timeline_lines", f"""WITH {SEGMENTS_SQL}, g AS (SELECT l_orderkey AS scene_id, string_agg(l_partkey || ' (' || s.video_file || ')', ' → ' ORDER BY l_linenumber, l_partkey) AS links,
     sum(s."end" - s."start") AS dur FROM lineitem JOIN segs s ON s.segment_id = l_partkey GROUP BY l_orderkey)
  SELECT o_orderkey AS scene_id, CASE WHEN links IS NULL THEN 'Scene ' || o_orderkey || ': (no chain selected)'
    ELSE 'Scene ' || o_orderkey || ' [' || o_orderpriority || '] — ' || printf('%.1f', dur) || 's — ' || links END AS line FROM orders LEFT JOIN g ON g.scene_id = o_orderkey""")
def timeline_lines(spark, sf):
    from kinolake.operators import describe as d
    g = segments(spark, sf).select("segment_id", "video_file", (F.col("end") - F.col("start")).alias("d"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scene_id"), "l_linenumber", F.col("l_partkey").alias("segment_id"))
    item = F.struct("l_linenumber", "segment_id", "video_file")
    chains = li.join(g, "segment_id").groupBy("scene_id").agg(F.array_sort(F.collect_list(item)).alias("_l"), F.sum("d").alias("d"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scene_id"), "o_orderpriority").join(chains, "scene_id", "left")
    links = F.transform("_l", lambda x: d.timeline_link(x["segment_id"], x["video_file"]))
    return rows.select("scene_id", d.timeline_line(F.col("scene_id"), F.col("o_orderpriority"), F.col("d"), links).alias("line"))


@query("sc28_boundary_lines", f"""WITH {LINKED_SQL} SELECT scene_id_a, 'Boundary ' || scene_id_a || '→' || scene_id_b || ': cost=' || printf('%.3f', cost) || ' flagged=' || CASE WHEN cost > 0.6 THEN 'True' ELSE 'False' END AS line FROM bnd""")
def boundary_lines(spark, sf):
    from kinolake.operators import describe as d
    return boundaries(spark, sf).select("scene_id_a", d.boundary_line(
        F.col("scene_id_a"), F.col("scene_id_b"), F.col("kinematic_cost"), F.col("flagged")).alias("line"))


@query("pl06_stitch_and_build_timeline", f"""WITH RECURSIVE {CHAINS_SQL}, n AS (SELECT scene_id, count(*) AS n FROM chains GROUP BY scene_id),
   w AS (SELECT o_orderkey % 50 AS project, o_orderkey AS scene_id, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 4 END END AS want FROM orders),
   sel AS (SELECT w.project, w.scene_id, c.ids FROM w LEFT JOIN n USING (scene_id) LEFT JOIN chains c ON c.scene_id = w.scene_id AND c.chain_no = CASE WHEN want < n THEN want WHEN want IS NOT NULL THEN 0 END),
   bn AS (SELECT *, ids[-1] AS l, lead(scene_id) OVER v AS nx, lead(ids[1]) OVER v AS nf FROM sel WINDOW v AS (PARTITION BY project ORDER BY scene_id)),
   fl AS (SELECT nx AS scene_id, nf AS segment_id FROM bn JOIN segs a ON a.segment_id = l JOIN segs b ON b.segment_id = nf WHERE {kinematic_sql('a', 'b')} > 0.6),
   ent AS (SELECT project, scene_id, unnest(ids) AS segment_id, unnest(range(len(ids))) AS link_pos FROM sel)
   SELECT e.project, e.scene_id // 50 AS scene_id, e.segment_id, row_number() OVER (PARTITION BY e.project ORDER BY e.scene_id, link_pos) AS position, coalesce(nullif(s.rating, ''), 'good') AS quality_rating,
     CASE WHEN fl.scene_id IS NOT NULL AND (e.scene_id // 50) % 3 = 0 THEN CASE WHEN (e.scene_id // 50) % 2 = 0 THEN 'dip_to_black' ELSE 'dissolve' END ELSE 'cut' END AS stitch_action
   FROM ent e JOIN segs s USING (segment_id) LEFT JOIN fl ON fl.scene_id = e.scene_id AND fl.segment_id = e.segment_id""")
def stitch_and_build_timeline(spark, sf):
    g = segments(spark, sf)
    scenes = table(spark, sf, "orders").select(*scene_key("o_orderkey"), F.col("o_orderkey").alias("scene_pos"))
    chosen = write_once(editing.assemble(scenes, assignments(spark, sf), g, targets(spark, sf), selections(spark, sf)), "chosen")
    made = tl.scene_boundaries(chosen, g)
    t = editing.build_timeline(chosen, g, decisions(made))
    return t.entries.select("project", "scene_id", "segment_id", "position", "quality_rating", "stitch_action")
