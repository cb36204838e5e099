"""Strings, decisions, manifests and stored files: value tables and temporary folders."""

import json
import math
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from kinolake.functions import scalars as s
from kinolake.functions import text as tx
from kinolake.operators import catalog as c
from kinolake.operators import describe as d
from kinolake.operators import motion as m
from kinolake.sources import readers, writers


def apply(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_times(spark):
    assert apply(spark, ["1:02:03.5", "02:03.25", "7.5s", "x", ""], tx.parse_timecode) == [3723.5, 123.25, 7.5, 0.0, 0.0]
    assert apply(spark, [0.0, 65.0, 3599.9], tx.format_duration, "double") == ["0:00", "1:05", "59:59"]
    assert apply(spark, [65.129, 0.999], tx.format_timestamp, "double") == ["1:05.12", "0:00.99"]
    assert apply(spark, [65.1294], tx.format_clock, "double") == ["01:05.129"]
    assert apply(spark, ["60000/1001", "30", "1/0", "a/b", "1/2/3"], tx.parse_rate) == [60000 / 1001, 30.0, 0.0, 0.0, 0.0]
    assert apply(spark, [0.5, 1.5, 2.5], lambda x: s.rational_time(x, 1.0), "double") == [0, 2, 2]


def test_fenced_json(spark):
    body = '{"a": 1}'
    texts = [body, f"```json\n{body}\n```", f"```\n{body}", f"```json\n[{body}, 2]\n```", "```json\n{broken", "not json", "[]", None]
    got = apply(spark, texts, lambda x: tx.parse_fenced_json(x, "a int")["a"])
    assert got == [1, 1, 1, 1, None, None, None, None]


def test_rejects_name_their_reason(spark):
    rows = spark.createDataFrame([(1, '{"scene": "x"}'), (2, "{"), (3, '{"other": 1}')], "i int, response string")
    good, bad = d.ingest_responses(rows, "scene string", "scene")
    assert [r.i for r in good.collect()] == [1]
    assert {r.i: r.reason for r in bad.collect()} == {2: "invalid JSON", 3: "missing scene"}


def test_names(spark):
    url = apply(spark, ["clip_original.MP4", "clip.mov"], lambda x: tx.media_url(F.lit("p"), F.lit("h"), x, "downsampled"))
    assert url == ["/files/p/videos/h/clip_downsampled.mp4", "/files/p/videos/h/clip.mov_downsampled.mp4"]
    assert apply(spark, ["/a b/c~+*.mp4"], tx.file_uri) == ["file:///a%20b/c~%2B%2A.mp4"]
    ids = apply(spark, [0, 1], lambda x: s.segment_id(F.lit("v"), x), "int")
    assert len(set(ids)) == 2 and all(len(i) == 8 for i in ids)


def test_steps(spark):
    row = spark.range(1)
    t = F.lit("t")
    none = F.lit(None).cast("string")
    for have, percent in (([], 0), (["downsampled"], 25), (["downsampled", "described"], 50), (list(s.PROCESSING_STEPS), 100)):
        done = s.completed_steps({k: t if k in have else none for k in s.PROCESSING_STEPS})
        got = row.select(done.alias("d"), s.processing_percent(done).alias("p"), s.fully_processed(done).alias("f"), s.current_step(done).alias("c")).first()
        assert (list(got.d), got.p, got.f, got.c) == (have, percent, percent == 100, have[-1] if have else None)


def test_manifest_cycle(spark):
    m0 = spark.createDataFrame([("p", "a", {"described": None}, None), ("p", "b", {"described": None}, None)],
                               "project string, video_hash string, processing map<string,timestamp>, config_hash string")
    done = spark.createDataFrame([("p", "a", "h1")], "project string, video_hash string, new_hash string").withColumn("completed_at", F.current_timestamp())
    m1 = c.mark_complete(m0, done, "described")
    now = {r.video_hash: r.ok for r in m1.select("video_hash", c.step_is_current(m1, "described", F.lit("h1")).alias("ok")).collect()}
    other = {r.ok for r in m1.select(c.step_is_current(m1, "described", F.lit("h2")).alias("ok")).collect()}
    assert now == {"a": True, "b": False} and other == {False}
    seen = spark.createDataFrame([("a", 0)], "h string, n int")
    new = spark.createDataFrame([("b", 5), ("a", 6), ("b", 4)], "h string, n int")
    assert sorted((r.h, r.n) for r in c.register(new, seen, "h", ["n"]).collect()) == [("a", 0), ("b", 4)]


def test_combined_view_cases(spark):
    segs = spark.createDataFrame([("a",), ("b",)], "segment_id string")
    desc = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("orphan", 1, "x")], "segment_id string, seq long, text string")
    flat = sorted((r.segment_id, r.vlm_pos, r.text) for r in d.combined_view(segs, desc).select("segment_id", F.coalesce("vlm_pos", F.lit(0)).alias("vlm_pos"), "text").collect())
    assert flat == [("a", 1, "first"), ("a", 2, "second"), ("b", 0, None)]
    docs = {r.segment_id: [x.text for x in r.vlm] for r in d.nest_descriptions(segs, desc, ["text"]).collect()}
    assert docs == {"a": ["first", "second"], "b": []}


def test_flow_and_bands(spark):
    v = spark.createDataFrame([(1, 2.0, 0.0), (1, 2.0, 0.0), (2, 0.0, 0.0)], "frame int, dx double, dy double")
    rows = {r.frame: r for r in m.flow_statistics(v, ["frame"]).collect()}
    assert rows[1].mean_magnitude == 2.0 and rows[1].coherence == pytest.approx(1.0) and rows[2].mean_magnitude == 0.0
    assert apply(spark, [10.0, 190.0, 300.0], lambda x: m.quality_band("brightness", x), "double") == ["very dark", None, "overexposed"]


# -- files ------------------------------------------------------------------

def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_media_listing_and_hash(spark, tmp_path):
    for name in ("b.MP4", "a.mov", "c.m4v", "d.mpv", "notes.txt"):
        put(str(tmp_path / name), name)
    put(str(tmp_path / "sub" / "deep.mp4"), "x")
    rows = readers.scan_media(spark, str(tmp_path), with_hash=True).collect()
    assert [r.name for r in rows] == ["a.mov", "b.MP4"]
    import hashlib
    assert rows[0].video_hash == hashlib.sha256(b"a.mov" + b"5").hexdigest()[:16]


def test_projects_and_segments(spark, tmp_path):
    root = str(tmp_path)
    put(f"{root}/beta/project.json", json.dumps({"name": "beta", "status": "ready"}, indent=2))
    put(f"{root}/alpha/project.json", json.dumps({"name": "alpha", "status": "new"}))
    put(f"{root}/bad/project.json", "{oops")
    rows = readers.scan_projects(spark, root, "name string, status string").collect()
    assert [r.name for r in rows] == ["alpha", "beta"]
    for video in ("v1", "v2"):
        put(f"{root}/alpha/videos/{video}/segments/segments.json", json.dumps([{"segment_id": video + "-0"}, {"segment_id": video + "-1"}]))
    put(f"{root}/alpha/videos/v1/descriptions/one.json", "{}")
    segs = readers.scan_segments(spark, f"{root}/alpha", "segment_id string").collect()
    assert sorted((r.video_hash, r.segment_id) for r in segs) == [("v1", "v1-0"), ("v1", "v1-1")]
    with pytest.raises(Exception):
        readers.read_typed(spark, f"{root}/bad/project.json", "name string").collect()
    with pytest.raises(Exception):
        readers.read_typed(spark, f"{root}/none.json", "name string")


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "timeline")
    one = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert [writers.save_versioned(one.withColumn("a", F.lit(i)), folder) for i in (1, 2, 3)] == [1, 2, 3]
    assert readers.read_version(spark, folder).first().a == 3
    assert readers.read_version(spark, folder, "v1").first().b is None
    with pytest.raises(FileNotFoundError):
        readers.read_version(spark, folder, 9)
    files = str(tmp_path / "docs")
    for name in ("v1.json", "v10.json", "v2.json.bak", "latest.json", "xv3.json"):
        put(f"{files}/{name}", "{}")
    assert [r.version for r in readers.list_versions(spark, files).collect()] == [1, 10]


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    folder = str(tmp_path / "boards")
    one = spark.createDataFrame([(i,) for i in range(20)], "a int")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: writers.save_versioned(one.withColumn("b", F.lit(i)), folder), range(8)))
    assert sorted(numbers) == list(range(1, 9))
    for i, n in enumerate(numbers):
        rows = readers.read_version(spark, folder, n)
        assert {r.b for r in rows.collect()} == {i} and rows.count() == 20


def test_a_failed_write_leaves_no_version(spark, tmp_path):
    folder = str(tmp_path / "boards")
    good = spark.range(3)
    assert writers.save_versioned(good, folder) == 1
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception):
        writers.save_versioned(bad, folder)
    assert readers.stored_versions(spark, folder) == [1] and not [f for f in os.listdir(folder) if f.startswith("_staged")]
    with pytest.raises(FileNotFoundError):
        readers.read_version(spark, str(tmp_path / "none"))
    assert writers.save_versioned(good, folder) == 2 and readers.read_version(spark, folder).count() == 3


def test_nan_becomes_null_at_any_depth(spark):
    bad = F.lit(math.inf)
    df = spark.range(1).select(F.struct(F.array(F.struct(bad.alias("x"), F.lit(1.5).alias("y"))).alias("l")).alias("s"),
                               F.create_map(F.lit("k"), bad).alias("m"), F.lit("t").alias("t"))
    row = writers.sanitise(df).first()
    assert row.s.l[0].x is None and row.s.l[0].y == 1.5 and row.m["k"] is None and row.t == "t"


def test_per_video_overwrite_keeps_other_videos(spark, tmp_path):
    path = str(tmp_path / "metrics")
    writers.write_per_video(spark.createDataFrame([("p", "a", 1), ("p", "b", 1)], "project string, video_id string, v int"), path)
    writers.write_per_video(spark.createDataFrame([("p", "a", 2)], "project string, video_id string, v int"), path)
    assert {(r.video_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}
