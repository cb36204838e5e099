"""Catalog operators bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolake.functions import scalars as s
from kinolake.operators import catalog as c
from kinolake.registry.base import query, r6, table


def orders(spark, sf):
    return table(spark, sf, "orders")


@query("src06_read_vectors", """SELECT vec_id, label, len(embedding)::INT AS dims, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings""")
def read_vectors(spark, sf):
    from kinolake.sources.readers import read_vectors as read
    v = read(spark, f"{sf}/embeddings.parquet")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("vec_id", "label", F.size("embedding").alias("dims"), r6(total).alias("total"))


PROBE_KINDS = 6


def probes(spark, sf):
    """Probe JSON built from parts: complete, container duration, and four kinds of failure."""
    p = table(spark, sf, "part")
    kind = F.col("p_partkey") % PROBE_KINDS
    size = F.col("p_size").cast("string")
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","r_frame_rate":"'), F.col("p_partkey").cast("string"),
                     F.lit('/1001","width":'), size, F.lit(',"height":360'))
    audio = F.lit('{"codec_type":"audio","duration":"9"}')
    text = (F.when(kind == 0, F.concat(F.lit('{"streams":['), audio, F.lit(","), video, F.lit(',"duration":"'),
                                       F.col("p_retailprice").cast("string"), F.lit('"}],"format":{"duration":"1"}}')))
            .when(kind == 1, F.concat(F.lit('{"streams":['), video, F.lit('}],"format":{"duration":"'), size, F.lit('.5"}}')))
            .when(kind == 2, F.concat(F.lit('{"streams":['), audio, F.lit("]}")))
            .when(kind == 3, F.concat(F.lit('{"streams":['), video, F.lit("}]}")))
            .when(kind == 4, F.concat(F.lit('{"streams":['), video)).otherwise(
                F.lit('{"streams":[{"codec_type":"video","r_frame_rate":"bad","width":4,"height":3,"duration":"2"}]}')))
    return p.select("p_partkey", text.alias("probe"))


@query("src07_probe_to_video", """SELECT p_partkey, round(CASE p_partkey % 6 WHEN 0 THEN p_retailprice WHEN 1 THEN p_size + 0.5 ELSE 2.0 END, 6) + 0.0 AS duration,
   round(CASE WHEN p_partkey % 6 = 5 THEN 0.0 ELSE p_partkey / 1001 END, 6) + 0.0 AS fps, CASE WHEN p_partkey % 6 = 5 THEN 4 ELSE p_size END AS width,
   CASE WHEN p_partkey % 6 = 5 THEN 3 ELSE 360 END AS height, CASE WHEN p_partkey % 6 = 5 THEN 'unknown' ELSE 'h264' END AS codec
   FROM part WHERE p_partkey % 6 IN (0, 1, 5)""")
def probe_to_video(spark, sf):
    videos, _ = c.probe_to_video(probes(spark, sf), "probe")
    return videos.withColumns({"duration": r6("duration"), "fps": r6("fps")})


@query("src07_probe_rejects", """SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN 'no video stream' WHEN 3 THEN 'missing duration' ELSE 'invalid JSON' END AS reason
   FROM part WHERE p_partkey % 6 IN (2, 3, 4)""")
def probe_rejects(spark, sf):
    return c.probe_to_video(probes(spark, sf), "probe")[1]


@query("src08_content_hash", """SELECT doc_id, substr(sha256(array_slice(encode(text), 1, 65536) || encode(strlen(text)::VARCHAR)), 1, 16) AS content_hash FROM documents""")
def content_hash(spark, sf):
    content = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").select(
        "doc_id", s.content_hash(content, F.octet_length(content)).alias("content_hash"))


@query("snk04_versions_enriched", """SELECT o_custkey AS project, o_orderkey AS version, nullif(substr(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || repeat(o_orderstatus, 130)
    WHEN o_orderstatus = 'O' THEN '' END, 1, 120), '') AS brief_snippet, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 7 END AS storyboard_version FROM orders""")
def versions_enriched(spark, sf):
    o = orders(spark, sf)
    versions = o.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("version"))
    brief = F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.repeat("o_orderstatus", 130))).otherwise("")
    docs = o.filter("o_orderstatus <> 'P'").select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("version"), brief.alias("user_brief"),
        (F.col("o_orderkey") % 7).alias("storyboard_version"))
    return c.enriched_versions(versions, docs, ["project", "version"])


@query("pr10_pending", """SELECT o_orderkey, 'new' AS mode FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
   UNION ALL SELECT o_orderkey, 'forced' FROM orders""")
def pending(spark, sf):
    items = orders(spark, sf).select("o_orderkey")
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    out = [c.pending(items, done, ["o_orderkey"], f).withColumn("mode", F.lit(n)) for f, n in ((False, "new"), (True, "forced"))]
    return out[0].unionByName(out[1])


def manifest(spark, sf):
    """Orders as manifest entries: completion per step, one configuration hash per video."""
    d = F.col("o_orderdate")
    steps = F.create_map(F.lit("segmented"), F.when(F.col("o_orderstatus") != "P", d),
                         F.lit("described"), F.when(F.col("o_totalprice") > 200000, d))
    hashes = F.create_map(F.lit("segmented"), F.col("o_orderpriority"), F.lit("described"), F.lit("1-URGENT"))
    return orders(spark, sf).select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("video_hash"),
                                    steps.alias("processing"), F.col("o_orderpriority").alias("config_hash"),
                                    hashes.alias("step_hashes"))


@query("pr11_step_current", """SELECT o_orderkey AS video_hash, o_orderstatus <> 'P' AND o_orderpriority = '2-HIGH' AS segmented_current,
   o_totalprice > 200000 AND o_orderpriority = '2-HIGH' AS described_current, o_totalprice > 200000 AND '1-URGENT' = '2-HIGH' AS described_per_step FROM orders""")
def step_current(spark, sf):
    m = manifest(spark, sf)
    given = F.lit("2-HIGH")
    return m.select("video_hash", c.step_is_current(m, "segmented", given).alias("segmented_current"),
                    c.step_is_current(m, "described", given).alias("described_current"),
                    c.step_is_current(m, "described", given, per_step=True).alias("described_per_step"))


@query("pr12_entries_subset", """SELECT o_orderkey, o_orderpriority, 'listed' AS mode FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
   UNION ALL SELECT o_orderkey, o_orderpriority, 'all' FROM orders""")
def entries_subset(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_orderpriority")
    listed = c.entries_subset(o, "o_orderpriority", ["1-URGENT", "5-LOW"], ordered=False).withColumn("mode", F.lit("listed"))
    return listed.unionByName(c.entries_subset(o, "o_orderkey", None, ordered=False).withColumn("mode", F.lit("all")))


@query("jn02_described_only", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def described_only(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    described = orders(spark, sf).filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return c.described_only(li, described, "l_orderkey")


@query("jn13_register", """WITH d AS (SELECT *, sha256(text) AS h FROM documents), seen AS (SELECT h, min(doc_id) AS doc_id FROM d WHERE lang = 'en' GROUP BY h),
   fresh AS (SELECT h, min(doc_id) AS doc_id FROM d WHERE h NOT IN (SELECT h FROM seen) GROUP BY h)
   SELECT substr(h, 1, 16) AS video_hash, doc_id FROM seen UNION ALL SELECT substr(h, 1, 16), doc_id FROM fresh""")
def register(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("video_hash"), "doc_id", "lang")
    seen = d.filter("lang = 'en'").groupBy("video_hash").agg(F.min("doc_id").alias("doc_id"))
    out = c.register(d.select("video_hash", "doc_id"), seen, "video_hash", ["doc_id"])
    return out.select(F.substring("video_hash", 1, 16).alias("video_hash"), "doc_id")


@query("ag14_all_described", "SELECT o_custkey AS project, bool_and(o_totalprice > 100000) AS ready, count(*) AS videos FROM orders GROUP BY o_custkey")
def all_described(spark, sf):
    o = orders(spark, sf).withColumnRenamed("o_custkey", "project")
    return c.all_described(o, "project", F.when(F.col("o_totalprice") > 100000, F.col("o_orderdate")))


@query("ag18_in_progress", """WITH t AS (SELECT o_custkey AS project, o_orderkey AS video FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice <= 200000),
   r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY video) AS rn FROM t)
   SELECT project, count(*) AS running, 'Video understanding still in progress for ' || count(*) || ' video(s) (' ||
     string_agg(CASE WHEN rn <= 3 THEN video::VARCHAR END, ', ' ORDER BY video) || '). Wait for processing to complete before starting storyboard or editing.' AS message
   FROM r GROUP BY project""")
def in_progress(spark, sf):
    o = orders(spark, sf)
    state = (F.when(F.col("o_orderpriority") == "1-URGENT", "STARTED").when(F.col("o_orderpriority") == "2-HIGH", "RETRY")
             .otherwise("PENDING"))
    tasks = o.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("video"), state.alias("state"))
    done = o.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("video"),
                    F.when(F.col("o_totalprice") > 200000, F.col("o_orderdate")).alias("described_at"))
    return c.in_progress(tasks, done, "project", "video")


@query("ag19_project_summary", """SELECT c_custkey AS project, c_mktsegment AS status, count(o_orderkey) AS video_count, coalesce(bool_or(o_orderstatus = 'F'), false) AS has_storyboard,
   coalesce(bool_or(o_orderstatus = 'O'), false) AS has_timeline FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
def project_summary(spark, sf):
    o = orders(spark, sf).withColumnRenamed("o_custkey", "project")
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("status"))
    outputs = o.select("project", F.when(F.col("o_orderstatus") == "F", "storyboard")
                       .when(F.col("o_orderstatus") == "O", "timeline").alias("category")).filter("category IS NOT NULL")
    return c.project_summary(projects, o, outputs, "project")


@query("tk08_newest_versions", "SELECT o_orderkey AS version, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def newest_versions(spark, sf):
    return c.newest_versions(orders(spark, sf).select(F.col("o_orderkey").alias("version"), "o_custkey"))


@query("st01_union_segments", """SELECT l_orderkey, l_partkey, 'a' AS origin FROM lineitem WHERE l_returnflag = 'A' UNION ALL
   SELECT l_orderkey, l_partkey, 'b' FROM lineitem WHERE l_linestatus = 'F'""")
def union_segments(spark, sf):
    li = table(spark, sf, "lineitem")
    part = lambda cond, n: li.filter(cond).select("l_orderkey", "l_partkey", F.lit(n).alias("origin"))
    return c.union_segments(part("l_returnflag = 'A'", "a"), part("l_linestatus = 'F'", "b"))


@query("st04_merge_results", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS generation,
   CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders""")
def merge_results(spark, sf):
    o = orders(spark, sf)
    old = o.select("o_orderkey", F.lit("old").alias("generation"), F.col("o_totalprice").alias("v"))
    new = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("new").alias("generation"), (F.col("o_totalprice") * 2).alias("v"))
    return c.merge_results(old, new, ["o_orderkey"])
