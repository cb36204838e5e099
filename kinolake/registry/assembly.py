"""Chains through buckets: orders as scenes, line items as assignments, parts as segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinolake.operators import assemble as a
from kinolake.plans import editing
from kinolake.registry.base import (ASSIGNMENTS_SQL, MULTIPLIER_SQL, PENALTY_SQL, SEGMENTS_SQL, assignments,
                                    kinematic_sql, query, r6, rounded, scene_key, segments, table)


def targets(spark, sf):
    ideal = 10.0 + F.col("o_orderkey") % 15
    return table(spark, sf, "orders").select(*scene_key("o_orderkey"), (ideal - 1.5).alias("min"),
                                             (ideal + 1.5).alias("max"), ideal.alias("ideal"))


def penalty_of(x: str) -> str:
    out = PENALTY_SQL
    for c in ("pan", "tilt", "zoom"):
        out = out.replace(f"{c}_std", f"{x}.{c}_std").replace(f"{c}_mono", f"{x}.{c}_mono")
    return out


COST = (f"{MULTIPLIER_SQL.replace('rating', 'b.rating')} * ({kinematic_sql('a', 'b')} + {penalty_of('b')} + 0.3 * (1 - b.narrative_score))")

NODES_SQL = f"""{SEGMENTS_SQL}, {ASSIGNMENTS_SQL}, uniq AS (SELECT scene_id, bucket_idx, segment_id, arg_max(narrative_score, seq) AS narrative_score FROM asg GROUP BY ALL),
  ranks AS (SELECT scene_id, bucket_idx, row_number() OVER (PARTITION BY scene_id ORDER BY bucket_idx) AS rank, count(*) OVER (PARTITION BY scene_id) AS last_rank
    FROM (SELECT DISTINCT scene_id, bucket_idx FROM asg)),
  nodes AS (SELECT u.*, r.rank, r.last_rank, s.* EXCLUDE (segment_id) FROM uniq u JOIN ranks r USING (scene_id, bucket_idx) JOIN segs s USING (segment_id))"""
EDGES_SQL = f"""{NODES_SQL}, edges AS (SELECT a.scene_id, a.segment_id AS from_id, a.bucket_idx AS from_bucket, b.segment_id, b.bucket_idx, b.rank, b."start", b."end", {COST} AS cost
    FROM nodes a JOIN nodes b ON a.scene_id = b.scene_id AND b.rank = a.rank + 1)"""
TARGETS_SQL = "tgt AS (SELECT o_orderkey AS scene_id, 10.0 + o_orderkey % 15 - 1.5 AS lo, 10.0 + o_orderkey % 15 + 1.5 AS hi, 10.0 + o_orderkey % 15 AS ideal FROM orders)"
PATHS_SQL = f"""{EDGES_SQL}, {TARGETS_SQL}, walk(scene_id, rank, last_rank, segment_id, cost, dur, ids, costs) AS (
    SELECT scene_id, rank, last_rank, segment_id, 0.0::DOUBLE, "end" - "start", [segment_id], [0.0::DOUBLE] FROM nodes WHERE rank = 1
    UNION ALL SELECT w.scene_id, e.rank, w.last_rank, e.segment_id, w.cost + e.cost, w.dur + e."end" - e."start", list_append(w.ids, e.segment_id), list_append(w.costs, e.cost)
      FROM walk w JOIN edges e ON e.scene_id = w.scene_id AND e.from_id = w.segment_id AND e.rank = w.rank + 1),
  paths AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY cost, ids) AS path_no FROM walk WHERE rank = last_rank) WHERE path_no <= 50),
  leveled AS (SELECT p.*, t.ideal, CASE WHEN dur >= lo AND dur <= hi THEN 0 WHEN abs(dur - (lo + hi) / 2) <= (hi - lo) / 2 * 1.2 THEN 1
     WHEN abs(dur - (lo + hi) / 2) <= (hi - lo) / 2 * 1.44 THEN 2 WHEN abs(dur - (lo + hi) / 2) <= (hi - lo) / 2 * 1.728 THEN 3 END AS lvl FROM paths p JOIN tgt t USING (scene_id)),
  ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY path_no) AS k FROM (SELECT *, min(lvl) OVER (PARTITION BY scene_id) AS best FROM leveled WHERE lvl IS NOT NULL)
     WHERE lvl = best) WHERE k <= 5),
  accepted AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY abs(dur - ideal), path_no) - 1 AS chain_no, cost AS total_cost, dur AS total_duration, abs(dur - ideal) AS duration_delta, ids, costs FROM ok)"""
GREEDY_SQL = f"""win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, bucket_idx ORDER BY narrative_score DESC, seq) AS rn FROM asg) WHERE rn = 1),
  won AS (SELECT w.scene_id, w.bucket_idx, w.narrative_score, s.*, lag(w.segment_id) OVER (PARTITION BY w.scene_id ORDER BY w.bucket_idx) AS prev FROM win w JOIN segs s USING (segment_id)),
  stepped AS (SELECT b.scene_id, b.bucket_idx, b.segment_id, b."end" - b."start" AS dur, CASE WHEN b.prev IS NULL THEN 0.0 ELSE {COST} END AS cost FROM won b LEFT JOIN segs a ON a.segment_id = b.prev),
  greedy AS (SELECT scene_id, 0 AS chain_no, sum(cost) AS total_cost, sum(dur) AS total_duration, abs(sum(dur) - max(ideal)) AS duration_delta,
     list(segment_id ORDER BY bucket_idx) AS ids, list(cost ORDER BY bucket_idx) AS costs FROM stepped JOIN tgt USING (scene_id) GROUP BY scene_id)"""
CHAINS_SQL = f"""{PATHS_SQL}, {GREEDY_SQL}, chains AS (SELECT *, 'path' AS origin FROM accepted UNION ALL
   SELECT *, 'greedy' FROM greedy WHERE scene_id NOT IN (SELECT scene_id FROM accepted))"""
CHAIN_OUT = """scene_id % 50 AS project, scene_id // 50 AS scene_id, chain_no::INT AS chain_no, round(total_cost, 6) + 0.0 AS total_cost, round(total_duration, 6) + 0.0 AS total_duration, round(duration_delta, 6) + 0.0 AS duration_delta,
   array_to_string(ids, '>') AS path, origin"""


def chain_out(chains):
    path = F.array_join(F.transform("segment_ids", lambda x: x.cast("string")), ">")
    return rounded(chains.select("project", "scene_id", "chain_no", "total_cost", "total_duration", "duration_delta",
                                 path.alias("path"), "origin"), "total_cost", "total_duration", "duration_delta")


@query("jn05_bucket_edges", f"WITH {EDGES_SQL} SELECT scene_id % 50 AS project, scene_id // 50 AS scene_id, from_id, from_bucket, segment_id, bucket_idx, round(cost, 6) + 0.0 AS cost FROM edges")
def bucket_edges(spark, sf):
    edges = a.bucket_edges(a.scene_nodes(assignments(spark, sf), segments(spark, sf)))
    return edges.select("project", "scene_id", "from_id", "from_bucket", "segment_id", "bucket_idx", r6("cost").alias("cost"))


@query("tk03_find_chains", f"WITH RECURSIVE {CHAINS_SQL} SELECT {CHAIN_OUT} FROM chains")
def find_chains(spark, sf):
    return chain_out(a.find_chains(assignments(spark, sf), segments(spark, sf), targets(spark, sf)))


@query("tk04_greedy_chain", f"WITH {SEGMENTS_SQL}, {ASSIGNMENTS_SQL}, {TARGETS_SQL}, {GREEDY_SQL} SELECT {CHAIN_OUT.replace('origin', chr(39) + 'greedy' + chr(39) + ' AS origin')} FROM greedy")
def greedy_chain(spark, sf):
    return chain_out(a.greedy_chains(assignments(spark, sf), segments(spark, sf), targets(spark, sf)))


@query("tk05_path_to_chain", f"""WITH RECURSIVE {CHAINS_SQL}, l AS (SELECT scene_id, chain_no, unnest(ids) AS segment_id, unnest(costs) AS edge_cost, unnest(range(len(ids))) AS link_pos FROM chains)
  SELECT scene_id % 50 AS project, scene_id // 50 AS scene_id, chain_no::INT AS chain_no, link_pos::INT AS link_pos, segment_id, round(edge_cost, 6) + 0.0 AS edge_cost, "start", "end", video_file FROM l JOIN segs USING (segment_id)""")
def path_to_chain(spark, sf):
    links = a.chain_links(a.find_chains(assignments(spark, sf), segments(spark, sf), targets(spark, sf)))
    return links.select("project", "scene_id", "chain_no", "link_pos", "segment_id", r6("edge_cost").alias("edge_cost"), "start", "end", "video_file")


def selections(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        *scene_key("o_orderkey"), (key % 4).cast("int").alias("chain_index"),
        F.when(key % 5 == 0, F.lit(1)).alias("override_index"))


@query("tk06_selected_chain", """WITH c AS (SELECT l_orderkey AS scene_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS chain_no, count(*) AS links FROM lineitem GROUP BY l_orderkey, l_linenumber),
   n AS (SELECT scene_id, count(*) AS n FROM c GROUP BY scene_id), w AS (SELECT o_orderkey AS scene_id, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 4 END END AS want FROM orders),
   p AS (SELECT w.scene_id, want, n, CASE WHEN want < n THEN want WHEN want IS NOT NULL THEN 0 END AS pick FROM w LEFT JOIN n USING (scene_id))
   SELECT p.scene_id % 50 AS project, p.scene_id // 50 AS scene_id, p.pick::INT AS chain_no, c.links, greatest(0, least(want, n - 1))::BIGINT AS clamped FROM p LEFT JOIN c ON c.scene_id = p.scene_id AND c.chain_no = p.pick""")
def selected_chain(spark, sf):
    w = Window.partitionBy(*a.SCENE).orderBy("l_linenumber")
    chains = table(spark, sf, "lineitem").groupBy(*scene_key("l_orderkey"), "l_linenumber").agg(
        F.count("*").alias("links")).select(*a.SCENE, (F.row_number().over(w) - 1).alias("chain_no"), "links")
    scenes = table(spark, sf, "orders").select(*scene_key("o_orderkey"))
    counts = chains.groupBy(*a.SCENE).agg(F.count("*").alias("n"))
    sel = selections(spark, sf)
    clamped = scenes.join(sel, [*a.SCENE], "left").join(counts, [*a.SCENE], "left").select(
        *a.SCENE, a.clamp_selection(F.col("chain_index"), F.col("override_index"), F.col("n")).cast("bigint").alias("clamped"))
    return a.selected_chain(scenes, chains, sel).join(clamped, [*a.SCENE])


@query("pl05_assemble", f"""WITH RECURSIVE {CHAINS_SQL}, n AS (SELECT scene_id, count(*) AS n FROM chains GROUP BY scene_id),
   w AS (SELECT o_orderkey AS scene_id, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 4 END END AS want FROM orders),
   p AS (SELECT w.scene_id, CASE WHEN want < n THEN want WHEN want IS NOT NULL THEN 0 END AS pick FROM w LEFT JOIN n USING (scene_id))
   SELECT p.scene_id % 50 AS project, p.scene_id // 50 AS scene_id, pick::INT AS chain_no, round(total_cost, 6) + 0.0 AS total_cost, array_to_string(ids, '>') AS path FROM p LEFT JOIN chains c ON c.scene_id = p.scene_id AND c.chain_no = p.pick""")
def assemble(spark, sf):
    scenes = table(spark, sf, "orders").select(*scene_key("o_orderkey"))
    rows = editing.assemble(scenes, assignments(spark, sf), segments(spark, sf), targets(spark, sf), selections(spark, sf))
    path = F.array_join(F.transform("segment_ids", lambda x: x.cast("string")), ">")
    return rows.select("project", "scene_id", "chain_no", r6("total_cost").alias("total_cost"), path.alias("path"))


@query("sc28_chain_blocks", f"""WITH RECURSIVE {CHAINS_SQL}, places AS (SELECT scene_id, rank - 1 AS pos, bucket_idx, 'path' AS origin FROM ranks
     UNION ALL SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY bucket_idx) - 1, bucket_idx, 'greedy' FROM won),
   links AS (SELECT scene_id, chain_no, total_cost, total_duration, origin, unnest(ids) AS segment_id, unnest(range(len(ids))) AS pos FROM chains),
   lines AS (SELECT scene_id, chain_no, chain_no || ' | cost=' || printf('%.3f', total_cost) || ' | ' || printf('%.1f', total_duration) || 's | '
       || string_agg('[b' || bucket_idx || '] ' || segment_id || ' (' || coalesce(substr(video_file, 1, 60), '') || ')', ' → ' ORDER BY pos) AS line
     FROM links JOIN places USING (scene_id, pos, origin) JOIN segs USING (segment_id) GROUP BY scene_id, chain_no, total_cost, total_duration)
   SELECT scene_id % 50 AS project, scene_id // 50 AS scene_id, string_agg(line, chr(10) ORDER BY chain_no) AS text FROM lines GROUP BY lines.scene_id""")
def chain_blocks(spark, sf):
    """Candidate chains of each scene as one text (at most five lines)."""
    from kinolake.operators import describe as d
    chains = a.find_chains(assignments(spark, sf), segments(spark, sf), targets(spark, sf))
    texts = F.transform("links", lambda x: d.link_text(x["bucket_idx"], x["segment_id"], x["video_file"]))
    lines = chains.withColumn("line", d.chain_line(F.col("chain_no"), F.col("total_cost"), F.col("total_duration"), texts))
    return d.text_block(lines, [*a.SCENE], "line", ["chain_no"], d.EMPTY_CHAINS)
