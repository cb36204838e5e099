"""Retrieval and vector operators: embeddings as segments and as scene queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from kinolake.operators import changepoints as cp
from kinolake.operators import ordering as o
from kinolake.operators import peaks as pk
from kinolake.operators import retrieve as rt
from kinolake.operators import signal as sg
from kinolake.plans.retrieval import candidate_pools
from kinolake.registry import partition_sql as ps
from kinolake.registry.base import query, r6, rounded, table
from kinolake.settings import EDITOR


def items(spark, sf):
    """Every embedding with words from the document of the same number."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    e = table(spark, sf, "embeddings").join(d, "vec_id", "left")
    return e.select(F.lit(0).alias("project"), "vec_id", "label", F.col("embedding").alias("vector"), "lang", "source")


def scenes(spark, sf):
    return items(spark, sf).select(
        "project", F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("scene_id"), F.col("vec_id").alias("scene_pos"),
        F.reverse("vector").alias("vector"),
        F.array(F.upper("lang"), F.concat(F.lit("L"), F.col("label").cast("string"))).alias("keywords"))


def segments(spark, sf):
    return items(spark, sf).select(
        "project", F.col("vec_id").alias("segment_id"), F.col("vec_id").alias("seg_pos"), "vector",
        F.array("lang", "source", F.concat(F.lit("l"), (F.col("vec_id") % 10).cast("string"))).alias("tags"))


ITEMS_SQL_K = """items AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len,
    [upper(lang), 'L' || label] AS kws, [lang, source, 'l' || (vec_id % 10)] AS tags FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
  pairs AS (SELECT a.vec_id AS scene, b.vec_id AS segment_id, list_dot_product(a.v, b.v) / (a.len * b.len) AS same, list_dot_product(list_reverse(a.v), b.v) / (a.len * b.len) AS emb,
    len(list_intersect([lower(x) FOR x IN a.kws], [lower(x) FOR x IN b.tags])) / len(list_distinct(list_concat([lower(x) FOR x IN a.kws], [lower(x) FOR x IN b.tags]))) AS kw FROM items a, items b),
  scored AS (SELECT *, 0.7 * emb + (1.0 - 0.7) * kw AS score FROM pairs),
  cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY round(score, 9) DESC, segment_id) AS rank FROM scored) WHERE rank <= {k}),
  pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY round(score, 9) DESC, scene) AS w FROM cand) WHERE w = 1)"""
ITEMS_SQL, FEW_SQL = ITEMS_SQL_K.replace("{k}", "15"), ITEMS_SQL_K.replace("{k}", "3")


def candidates(spark, sf, k=15):
    return rt.retrieve_candidates(scenes(spark, sf), segments(spark, sf), k=k)


@query("tk01_retrieve_candidates", f"""WITH {ITEMS_SQL} SELECT 's' || scene AS scene_id, segment_id, round(emb, 6) + 0.0 AS embedding_score, round(kw, 6) + 0.0 AS keyword_score,
   round(score, 6) + 0.0 AS combined_score, rank FROM cand""")
def retrieve(spark, sf):
    c = candidates(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))
    return rounded(c.drop("project", "scene_pos", "seg_pos"), "embedding_score", "keyword_score", "combined_score")


@query("jn04_score_pairs", f"""WITH {ITEMS_SQL} SELECT 's' || scene AS scene_id, count(*) AS pairs, round(avg(score), 6) + 0.0 AS mean_score, round(max(score), 6) + 0.0 AS top_score FROM scored GROUP BY scene""")
def score_pairs(spark, sf):
    s = rt.score_summary(scenes(spark, sf), segments(spark, sf))
    return rounded(s.drop("project"), "mean_score", "top_score")


@query("jn11_pairwise_similarity", f"""WITH {ITEMS_SQL}, p AS (SELECT * FROM pairs WHERE scene <> segment_id)
  SELECT scene AS vec_id, count(*) AS others, round(avg(same), 6) + 0.0 AS mean_similarity,
    arg_min(segment_id, struct_pack(a := -round(same, 9), b := segment_id)) AS nearest_id, round(max(same), 6) + 0.0 AS nearest_similarity FROM p GROUP BY scene""")
def pairwise_similarity(spark, sf):
    p = rt.similarity_profile(items(spark, sf).select("project", "vec_id", "vector"))
    return rounded(p.drop("project"), "mean_similarity", "nearest_similarity")


@query("jn15_resolve_contested", f"WITH {ITEMS_SQL} SELECT segment_id, 's' || scene AS scene_id, round(score, 6) + 0.0 AS combined_score FROM pool")
def resolve_contested(spark, sf):
    return rounded(rt.resolve_contested(candidates(spark, sf)).select("segment_id", "scene_id", "combined_score"), "combined_score")


@query("ag11_contested_count", f"""WITH {ITEMS_SQL}, c AS (SELECT segment_id, count(*) AS wanted FROM cand GROUP BY segment_id)
  SELECT (SELECT count(*) FROM c) AS segments, (SELECT count(*) FROM c WHERE wanted > 1) AS contested, (SELECT count(DISTINCT scene) FROM cand) AS scenes""")
def contested_count(spark, sf):
    return rt.contested_count(candidates(spark, sf)).drop("project")


@query("ag12_gap_report", f"""WITH {FEW_SQL}, n AS (SELECT i.vec_id, count(p.segment_id) AS size FROM items i LEFT JOIN pool p ON p.scene = i.vec_id GROUP BY i.vec_id)
  SELECT 's' || vec_id AS scene_id, size AS pool_size, 'Scene s' || vec_id || ' has only ' || size || ' candidate(s) after deduplication (minimum 3)' AS message FROM n WHERE size < 3""")
def gap_report(spark, sf):
    pools = rt.resolve_contested(candidates(spark, sf, 3))
    return rt.gap_report(scenes(spark, sf), pools).drop("project", "scene_pos")


@query("st02_unassigned", f"WITH {FEW_SQL} SELECT vec_id AS segment_id FROM items WHERE vec_id NOT IN (SELECT segment_id FROM pool)")
def unassigned(spark, sf):
    pools = rt.resolve_contested(candidates(spark, sf, 3))
    return rt.unassigned(segments(spark, sf), pools).select("segment_id")


# scenes take one after another: a recursive walk with the list of used segments
GAPS_SQL = f"""{FEW_SQL}, sized AS (SELECT i.vec_id AS scene, count(p.segment_id) AS size FROM items i LEFT JOIN pool p ON p.scene = i.vec_id GROUP BY i.vec_id),
  gaps AS (SELECT scene, 3 - size AS needed, row_number() OVER (ORDER BY scene) AS i FROM sized WHERE size < 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY round(score, 9) DESC, segment_id) AS place FROM scored
     WHERE segment_id NOT IN (SELECT segment_id FROM pool) AND scene IN (SELECT scene FROM gaps)),
  lists AS (SELECT g.i, g.scene, g.needed, list(r.segment_id ORDER BY place) AS l FROM gaps g JOIN ranked r USING (scene) GROUP BY ALL),
  walk(i, used, scene, got) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::BIGINT[] UNION ALL
     SELECT i, list_concat(used, picked), scene, picked FROM (SELECT w.used, l.i, l.scene, [s FOR s IN l.l IF NOT list_contains(w.used, s)][1:l.needed] AS picked
       FROM walk w JOIN lists l ON l.i = w.i + 1) x),
  added AS (SELECT scene, unnest(got) AS segment_id FROM walk WHERE scene IS NOT NULL)"""
SCORES_SQL = """round(emb, 6) + 0.0 AS embedding_score, round(kw, 6) + 0.0 AS keyword_score, round(score, 6) + 0.0 AS combined_score"""


@query("tk02_fill_gaps", f"""WITH RECURSIVE {GAPS_SQL} SELECT 's' || scene AS scene_id, segment_id, {SCORES_SQL} FROM added JOIN ranked USING (scene, segment_id)""")
def fill_gaps(spark, sf):
    pools = rt.resolve_contested(candidates(spark, sf, 3))
    added = rt.fill_gaps(pools, scenes(spark, sf), segments(spark, sf))
    return rounded(added.select("scene_id", "segment_id", "embedding_score", "keyword_score", "combined_score"),
                   "embedding_score", "keyword_score", "combined_score")


@query("pl04_candidate_pools", f"""WITH RECURSIVE {GAPS_SQL} SELECT 's' || scene AS scene_id, segment_id, {SCORES_SQL} FROM added JOIN ranked USING (scene, segment_id)
  UNION ALL SELECT 's' || scene, segment_id, {SCORES_SQL} FROM pool""")
def pools(spark, sf):
    settings = replace(EDITOR, candidates_per_scene=3)
    made = candidate_pools(scenes(spark, sf), segments(spark, sf), settings).pools
    return rounded(made.select("scene_id", "segment_id", "embedding_score", "keyword_score", "combined_score"),
                   "embedding_score", "keyword_score", "combined_score")


@query("jn03_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_name, c_nationkey FROM lineitem JOIN customer ON c_custkey = l_partkey")
def lookup(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # there are fewer customers than parts, so part numbers miss
    dim = table(spark, sf, "customer").select(F.col("c_custkey").alias("l_partkey"), "c_name", "c_nationkey")
    return rt.lookup(li, dim, "l_partkey")


@query("ag10_segments_per_video", """SELECT coalesce(nullif(CASE WHEN l_quantity > 40 THEN '' ELSE l_returnflag END, ''), nullif(CASE WHEN l_tax > 0.04 THEN '' ELSE l_linestatus END, ''), 'unknown') AS video,
   count(*) AS segments FROM lineitem GROUP BY 1""")
def segments_per_video(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") > 40, "").otherwise(F.col("l_returnflag")).alias("video_file"),
        F.when(F.col("l_tax") > 0.04, "").otherwise(F.col("l_linestatus")).alias("source_video"))
    return rt.segments_per_video(li)


@query("st03_tag_sets", r"""WITH t AS (SELECT doc_id, list_distinct([x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> '']) AS a, list_distinct([lang, source, 'de', 'la', 'the']) AS b FROM documents)
  SELECT doc_id, len(list_intersect(a, b))::INT AS common, len(list_distinct(list_concat(a, b)))::INT AS total FROM t""")
def tag_sets(spark, sf):
    d = table(spark, sf, "documents")
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    other = F.array("lang", "source", F.lit("de"), F.lit("la"), F.lit("the"))
    return d.select("doc_id", F.size(rt.tag_intersect(words, other)).alias("common"),
                    F.size(rt.tag_union(words, other)).alias("total"))


@query("ag15_mean_pool", """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) WHERE vec_id % 2 = 1 GROUP BY label, i),
  n AS (SELECT label, sqrt(sum(x * x)) AS len FROM m GROUP BY label)
  SELECT m.label, (m.i - 1)::INT AS dim, round(x / CASE WHEN len < 1e-9 THEN 1 ELSE len END, 6) + 0.0 AS v FROM m JOIN n USING (label)""")
def mean_pool(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("mask", (F.col("vec_id") % 2).cast("int"))
    p = rt.mean_pool(e, "label", "embedding", "mask", 64)
    return p.select("label", F.posexplode("vector").alias("dim", "v")).withColumn("v", r6("v"))


def series(spark, sf):
    """Embeddings as one vector series per label, ordered by number."""
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("video_id"), F.col("vec_id").alias("idx"), F.col("vec_id").cast("double").alias("timestamp"),
        F.col("embedding").alias("vector"))
    size = o.longest_series(e, ["video_id"])
    return sg.numbered(e, longest=size), size


SERIES_SQL = """ser AS (SELECT label AS video_id, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
   count(*) OVER (PARTITION BY label) AS n FROM embeddings)"""


@query("wn07_consecutive_distance", f"""WITH {SERIES_SQL}, p AS (SELECT a.video_id, a.pos, (a.vec_id + b.vec_id) / 2 AS t, a.v AS v, b.v AS w FROM ser a JOIN ser b ON b.video_id = a.video_id AND b.pos = a.pos + 1)
  SELECT video_id, pos, t AS "time", round(1 - list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) + 0.0 AS distance FROM p""")
def consecutive_distance(spark, sf):
    s, size = series(spark, sf)
    return rounded(rt.consecutive_distance(s, ["video_id"], longest=size), "distance")


@query("wn08_split_score", f"""WITH {SERIES_SQL}, x AS (SELECT s.video_id, s.pos, s.n, i, v[i] AS v FROM ser s, range(1, 65) r(i)),
  m AS (SELECT video_id, pos, n, i, avg(v) OVER (PARTITION BY video_id, i ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a,
    avg(v) OVER (PARTITION BY video_id, i ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS b FROM x)
  SELECT video_id, pos, round(CASE WHEN pos >= 10 AND pos < max(n) - 10 THEN 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) ELSE 0.0 END, 6) + 0.0 AS score FROM m GROUP BY video_id, pos""")
def split_score(spark, sf):
    s, size = series(spark, sf)
    return rounded(rt.split_score(s, ["video_id"], longest=size).select("video_id", "pos", "score"), "score")


SCORE_STEPS_SQL = """x AS (SELECT s.video_id, s.pos, s.n, i, v[i] AS v FROM ser s, range(1, 65) r(i)),
  m AS (SELECT video_id, pos, n, i, avg(v) OVER (PARTITION BY video_id, i ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a,
    avg(v) OVER (PARTITION BY video_id, i ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS b FROM x),
  sc AS (SELECT video_id, pos, CASE WHEN pos >= 10 AND pos < max(n) - 10 THEN 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) ELSE 0.0 END AS score FROM m GROUP BY video_id, pos)"""
SCORE_SQL = f"{SERIES_SQL}, {SCORE_STEPS_SQL}"


# tops of level stretches; the highest stays (of equals the last) and takes out those within ten rows; then prominence
PEAKS_SQL = """marked AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY pos) AS level FROM (SELECT *,
    CASE WHEN score = lag(score) OVER (PARTITION BY video_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM sc)),
  levels AS (SELECT video_id, level, (min(pos) + max(pos)) // 2 AS pos, any_value(score) AS score FROM marked GROUP BY ALL),
  tops AS (SELECT video_id, pos, score FROM (SELECT *, lag(score) OVER v AS l, lead(score) OVER v AS r FROM levels
    WINDOW v AS (PARTITION BY video_id ORDER BY level)) WHERE score > l AND score > r),
  nms AS (SELECT video_id, NULL::STRUCT(p BIGINT, h DOUBLE) AS kept, list(struct_pack(p := pos::BIGINT, h := score) ORDER BY score DESC, pos DESC) AS rest
      FROM tops GROUP BY video_id
    UNION ALL SELECT video_id, rest[1], list_filter(rest[2:], lambda t: abs(t.p - rest[1].p) >= 10) FROM nms WHERE len(rest) > 0),
  peak AS (SELECT video_id, kept.p AS pos, kept.h AS score FROM nms WHERE kept IS NOT NULL),
  base AS (SELECT p.video_id, p.pos, p.score, coalesce(max(CASE WHEN s.pos < p.pos AND s.score > p.score THEN s.pos END), -1) AS low,
    coalesce(min(CASE WHEN s.pos > p.pos AND s.score > p.score THEN s.pos END), 1000000000) AS high FROM peak p JOIN sc s USING (video_id) GROUP BY ALL),
  rise AS (SELECT b.video_id, b.pos, b.score, min(CASE WHEN s.pos <= b.pos THEN s.score END) AS before,
    min(CASE WHEN s.pos >= b.pos THEN s.score END) AS after FROM base b JOIN sc s ON s.video_id = b.video_id AND s.pos > low AND s.pos < high GROUP BY ALL)"""


@query("wn09_find_peaks", f"""WITH RECURSIVE {SCORE_SQL}, {PEAKS_SQL} SELECT video_id, pos, round(score, 6) AS score, round(score - greatest(before, after), 6) AS prominence
  FROM rise WHERE score - greatest(before, after) >= 0.05""")
def find_peaks(spark, sf):
    s, size = series(spark, sf)
    scores = rt.split_score(s, ["video_id"], longest=size)
    return rounded(pk.find_peaks(scores, ["video_id"], longest=size), "score", "prominence")


@query("wn11_kernel_change_points", f"""WITH RECURSIVE {SERIES_SQL}, {ps.partition_sql('cut', 'ser', ps.kernel('v'), [1.0], min_size=10, jump=1)}
  SELECT video_id, start_pos, end_pos FROM cut""")
def kernel_change_points(spark, sf):
    s, size = series(spark, sf)
    return cp.change_points(s, ["video_id"], ["vector"], "rbf", 1.0, min_size=10, jump=1, longest=size)


def keyframes_sql() -> str:
    step = """c{k} AS (SELECT video_id, pos FROM (SELECT s.video_id, s.pos, row_number() OVER (PARTITION BY s.video_id ORDER BY min(round(1 - list_dot_product(s.v, t.v), 9)) DESC, s.pos) AS rn
      FROM ser s JOIN ({chosen}) q ON q.video_id = s.video_id JOIN ser t ON t.video_id = q.video_id AND t.pos = q.pos
      WHERE NOT EXISTS (SELECT 1 FROM ({chosen}) u WHERE u.video_id = s.video_id AND u.pos = s.pos) GROUP BY s.video_id, s.pos) WHERE rn = 1)"""
    one = "SELECT * FROM c1"
    return f"""{SERIES_SQL}, c1 AS (SELECT video_id, pos FROM ser WHERE pos = n // 2), {step.format(k=2, chosen=one)},
      {step.format(k=3, chosen=one + " UNION ALL SELECT * FROM c2")}"""


@query("wn17_select_keyframes", f"WITH {keyframes_sql()} SELECT video_id, pos FROM c1 UNION ALL SELECT video_id, pos FROM c2 UNION ALL SELECT video_id, pos FROM c3")
def select_keyframes(spark, sf):
    s, _ = series(spark, sf)
    return rt.select_keyframes(s, ["video_id"]).select("video_id", "pos")


# axes are a rotation: squared lengths, their sum and the sum of squared variances do not depend on which one
PCA_SQL = """x AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)),
  c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM x),
  m AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS s FROM c a JOIN c b USING (vec_id) GROUP BY a.i, b.i),
  t AS (SELECT sum(s) FILTER (WHERE i = j) AS total, sum(s * s) AS squares FROM m)"""


@query("sc32_pca", f"""WITH {PCA_SQL} SELECT vec_id, 64 AS dims, round(sum(v * v), 6) + 0.0 AS energy,
  round(any_value(squares / (total * total)), 9) + 0.0 AS share_squares FROM c, t GROUP BY vec_id""")
def pca(spark, sf):
    out, share = rt.pca(table(spark, sf, "embeddings"), "embedding", 64)
    energy = F.aggregate("projection", F.lit(0.0), lambda s, x: s + x * x)
    return out.select("vec_id", F.size("projection").alias("dims"), r6(energy).alias("energy"),
                      F.round(F.lit(sum(x * x for x in share)), 9).alias("share_squares"))
