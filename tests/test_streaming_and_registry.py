"""Streams against their batch forms; the registry and its SQL on the smallest tables."""

import os
import random
import re
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as contract
from kinolake.streaming import incremental as inc

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SMOKE = ("sc01_kinematic_cost", "wn01_savgol", "ag05_movement_stats", "jn09_scene_boundaries", "tk04_greedy_chain",
         "tk01_retrieve_candidates", "sc31_export_items")


def stream_of(spark, batches, schema, folder):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


SAMPLES = "video_id long, idx long, timestamp double, pan double, ts timestamp"


def sample(video, idx, t):
    return (video, idx, float(t), float(idx), datetime.fromtimestamp(1e6 + t))


def test_pairs_in_any_order_within_the_lateness_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(7)
    rows = [sample(v, 1000 * v + i, 60 * i + rng.randint(0, 50)) for v in (1, 2, 3) for i in range(60)]
    rows += [sample(4, 4000, 5), sample(4, 4001, 5), sample(4, 4002, 3300)]  # equal times; silent for most of the stream
    arrival = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 900))
    batches = [arrival[i:i + 20] for i in range(0, len(arrival), 20)] + [[sample(9, 9999, 9000)]]
    s = stream_of(spark, batches, SAMPLES, str(tmp_path / "in"))
    got = {r.idx: r.prev_idx for r in inc.run_to_table(inc.stream_frame_pairs(s, "30 minutes"), "pairs").collect()}
    want = {}
    for v in (1, 2, 3, 4):
        order = [r[1] for r in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1]))]
        want |= dict(zip(order, [None, *order]))
    assert got == want


def test_samples_later_than_the_lateness_are_left_out(spark, tmp_path):
    batches = [[sample(1, 0, 0)], [sample(2, 1, 7200)], [sample(2, 2, 14400)], [sample(1, 3, 21600)], [sample(1, 4, 100)], [sample(3, 9, 99999)]]
    s = stream_of(spark, batches, SAMPLES, str(tmp_path / "in"))
    got = {r.idx: r.prev_idx for r in inc.run_to_table(inc.stream_frame_pairs(s, "1 minute"), "pairs").collect()}
    assert got == {0: None, 1: None, 2: 1, 3: 0}


def test_videos_of_a_bucket_keep_their_own_predecessors(spark, tmp_path):
    """One bucket for all videos, one of them without a number: state is arrays of the bucket, not rows per video."""
    rows = [[1, 0, 0], [2, 1, 1], [None, 2, 2], [1, 3, 3], [0, 4, 4]], [[2, 5, 4000], [None, 6, 4001], [1, 7, 4002], [1, 8, 4002]]
    batches = [[sample(*r) for r in part] for part in rows] + [[sample(9, 99, 9000)], [sample(9, 100, 20000)]]
    s = stream_of(spark, batches, SAMPLES, str(tmp_path / "in"))
    found = inc.run_to_table(inc.stream_frame_pairs(s, "1 minute", buckets=1), "pairs").collect()
    want = {0: (1, None), 1: (2, None), 2: (None, None), 3: (1, 0), 4: (0, None), 5: (2, 1), 6: (None, 2), 7: (1, 3), 8: (1, 7), 99: (9, None)}
    assert {r.idx: (r.video_id, r.prev_idx) for r in found} == want and all((r.prev_pan is None) == (r.prev_idx is None) for r in found)


def test_replayed_files_register_once(spark, tmp_path):
    path = str(tmp_path / "manifest")
    for run in range(2):  # a second run replays everything under a new checkpoint
        s = stream_of(spark, [[("a", 1), ("b", 2)], [("a", 3)]], "h string, n long", str(tmp_path / f"in{run}"))
        inc.stream_register(s, path, "h", "n", str(tmp_path / f"cp{run}")).awaitTermination()
    assert sorted((r.h, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_register_goes_on_after_a_restart(spark, tmp_path):
    path, source, checkpoint = (str(tmp_path / x) for x in ("manifest", "in", "cp"))
    for rows in ([("a", 1), ("a", 0), ("b", 2)], [("b", 3), ("c", 4)], [("c", 5)]):
        s = stream_of(spark, [rows], "h string, n long", source)
        inc.stream_register(s, path, "h", "n", checkpoint).awaitTermination()
    assert sorted((r.h, r.n) for r in spark.read.parquet(path).collect()) == [("a", 0), ("b", 2), ("c", 4)]
    assert not [f for f in os.listdir(path) if f.startswith("_staged")]


def test_registry_is_complete():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert all(callable(q) for q in queries.values())
    # the training-data operators are optional and have tests of their own
    own = {q for q in queries if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert own <= set(oracles)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", SMOKE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    rel = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(names)
    have = sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect())
    assert have == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0 and {"segment_id", "pan_entry_vel"} <= set(rows.columns)
