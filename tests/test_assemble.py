"""Costs and chains: hand-computed cases and enumeration of all paths."""

import itertools
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinolake.functions import scalars as s
from kinolake.operators import assemble as a
from kinolake.operators import timeline as tl
from kinolake.settings import EditorSettings

VEL = [f"{c}_{k}" for c in ("pan", "tilt", "zoom") for k in ("entry_vel", "exit_vel", "std_deriv", "monotonicity")]


def segment(sid, duration=5.0, rating="good", **kw):
    return {"segment_id": sid, "start": 0.0, "end": duration, "video_file": "f", "rating": rating,
            **{c: float(kw.get(c, 0.0)) for c in VEL}}


def frames(spark, segments, assignments, targets):
    seg = spark.createDataFrame(pd.DataFrame(segments))
    asg = spark.createDataFrame(assignments, "scene_id long, segment_id string, bucket_idx int, narrative_score double, seq long")
    tgt = spark.createDataFrame(targets, "scene_id long, min double, max double, ideal double")
    return asg.withColumn("project", F.lit(7)), seg, tgt.withColumn("project", F.lit(7))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lits(*xs):
    return [F.lit(float(x)) for x in xs]


def test_kinematic_cost(spark):
    assert value(spark, s.kinematic_cost(lits(0, 0, 0), lits(0, 0, 0))) == 0.0
    assert value(spark, s.kinematic_cost(lits(1, 0, 0), lits(-1, 0, 0), 1.0, 0.0)) == pytest.approx(2.0)
    assert value(spark, s.kinematic_cost(lits(1, 0, 0), lits(1, 0, 0), 0.4, 0.3)) == pytest.approx(0.0, abs=1e-7)


def test_penalty_and_multiplier(spark):
    assert value(spark, s.penalty_from_stats(lits(0, 0, 0), lits(1, 1, 1), 0.2, 0.5)) == pytest.approx(-0.5)
    assert value(spark, s.quality_multiplier(F.lit("Excellent"))) == 0.5
    assert value(spark, s.quality_multiplier(F.lit("odd"))) == 1.0
    assert value(spark, s.quality_multiplier(F.lit(None).cast("string"))) == 1.0


def test_two_buckets_within_range(spark):
    asg, seg, tgt = frames(spark, [segment("a"), segment("b")], [(1, "a", 0, 0.5, 1), (1, "b", 1, 0.5, 2)], [(1, 8.0, 12.0, 10.0)])
    got = a.find_chains(asg, seg, tgt).collect()
    assert len(got) == 1 and got[0].total_duration == 10.0 and got[0].origin == "path"


def test_out_of_range_falls_back_to_greedy(spark):
    asg, seg, tgt = frames(spark, [segment("a", 2.0)], [(1, "a", 0, 0.5, 1)], [(1, 100.0, 200.0, 150.0)])
    got = a.find_chains(asg, seg, tgt).collect()
    assert [x.origin for x in got] == ["greedy"] and got[0].links[0].segment_id == "a"


def test_unknown_segments(spark):
    asg, seg, tgt = frames(
        spark, [segment("a"), segment("b")],
        [(1, "a", 0, 0.5, 1), (1, "ghost", 1, 0.9, 2), (1, "b", 2, 0.5, 3), (2, "ghost", 0, 0.5, 1), (3, "ghost", 0, 0.9, 1), (3, "a", 0, 0.2, 2)],
        [(i, 0.0, 100.0, 10.0) for i in (1, 2, 3)])
    nodes = a.scene_nodes(asg, seg)
    assert a.bucket_edges(nodes).count() == 0  # the ghost bucket disconnects scene 1
    got = {r.scene_id: [x.segment_id for x in r.links] for r in a.find_chains(asg, seg, tgt).collect()}
    assert got == {1: ["a", "b"], 3: ["a"]}
    greedy = {r.scene_id for r in a.greedy_chains(asg, seg, tgt).collect()}
    assert greedy == {1}  # scene 3's winner is unknown, so its only bucket stays empty


def test_greedy_prefers_the_higher_score_and_the_first(spark):
    asg, seg, tgt = frames(spark, [segment("a"), segment("b"), segment("c")],
                           [(1, "a", 0, 0.2, 1), (1, "b", 0, 0.9, 2), (1, "c", 0, 0.9, 3)], [(1, 0.0, 1.0, 1.0)])
    assert a.greedy_chains(asg, seg, tgt).first().links[0].segment_id == "b"


def test_cheapest_chains_match_enumeration(spark):
    rng = np.random.default_rng(8)
    segs = [segment(f"s{i:02d}", float(rng.integers(2, 9)), str(rng.choice(["good", "excellent", "bad"])),
                    **{c: rng.normal() for c in VEL}) for i in range(12)]
    known = {x["segment_id"]: x for x in segs}
    asg, targets, seq = [], [], 0
    for scene in range(12):
        for bucket in range(int(rng.integers(1, 5))):
            for sid in rng.choice(sorted(known), size=int(rng.integers(1, 5)), replace=False):
                seq += 1
                asg.append((scene, str(sid), bucket * 2, float(rng.uniform()), seq))
        mid = float(rng.uniform(4, 25))
        targets.append((scene, mid - 2, mid + 2, mid))
    cfg = EditorSettings(chains_per_scene=2)

    def cost(x, y, score):
        v, w = (np.array([x[f"{c}_exit_vel"] for c in ("pan", "tilt", "zoom")]), np.array([y[f"{c}_entry_vel"] for c in ("pan", "tilt", "zoom")]))
        nv, nw = np.linalg.norm(v), np.linalg.norm(w)
        kin = 0.4 * (1 - v @ w / (nv * nw + 1e-8)) + 0.3 * abs(nv - nw) / (max(nv, nw) + 1e-8)
        pen = 0.2 * np.mean([y[f"{c}_std_deriv"] for c in ("pan", "tilt", "zoom")]) - 0.1 * np.mean([abs(y[f"{c}_monotonicity"]) for c in ("pan", "tilt", "zoom")])
        return {"good": 1.0, "excellent": 0.5, "bad": 5.0}[y["rating"]] * (kin + pen + 0.3 * (1 - score))

    got = a.find_chains(*frames(spark, segs, asg, targets), settings=cfg).toPandas()
    for scene, low, high, ideal in targets:
        buckets = {}
        for sc, sid, b, score, _ in asg:
            if sc == scene:
                buckets.setdefault(b, []).append((sid, score))
        paths = []
        for combo in itertools.product(*[buckets[b] for b in sorted(buckets)]):
            total = sum(cost(known[p[0]], known[q[0]], q[1]) for p, q in zip(combo, combo[1:]))
            paths.append((total, [p[0] for p in combo], sum(known[p[0]]["end"] for p in combo)))
        paths = sorted(paths, key=lambda p: (p[0], p[1]))[:20]
        want = []
        for step in range(4):
            half = 2 * 1.2 ** step
            want = [p for p in paths if ideal - half <= p[2] <= ideal + half][:2]
            if want:
                break
        have = got[got.scene_id == scene].sort_values("chain_no")
        if want:
            want.sort(key=lambda p: abs(p[2] - ideal))
            assert [[x.segment_id for x in r] for r in have.links] == [p[1] for p in want]
            np.testing.assert_allclose(have.total_cost, [p[0] for p in want], atol=1e-9)
        else:
            assert list(have.origin) == ["greedy"]


def test_selected_chain(spark):
    scenes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "scene_id long")
    chains = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], "scene_id long, chain_no int, name string")
    picks = spark.createDataFrame([(1, 0, 1), (2, 7, None), (4, 0, None)], "scene_id long, chain_index int, override_index int")
    scenes, chains, picks = (x.withColumn("project", F.lit(7)) for x in (scenes, chains, picks))
    got = {r.scene_id: r.name for r in a.selected_chain(scenes, chains, picks).collect()}
    assert got == {1: "b", 2: "c", 3: None, 4: None}


def test_projects_do_not_mix(spark):
    segs = [segment(x) for x in ("p1a", "p1b", "p2a", "p2b")]
    asg, seg, tgt = frames(spark, segs, [(1, "a", 0, 0.5, 1), (1, "b", 1, 0.5, 2)], [(1, 0.0, 100.0, 10.0)])
    both = F.explode(F.array(F.lit(1), F.lit(2)))
    asg = asg.withColumn("project", both).withColumn("segment_id", F.concat(F.lit("p"), "project", "segment_id"))
    tgt = tgt.withColumn("project", both)
    chains = a.find_chains(asg, seg, tgt)
    got = sorted((r.project, [x.segment_id for x in r.links]) for r in chains.collect())
    assert got == [(1, ["p1a", "p1b"]), (2, ["p2a", "p2b"])]
    assert sorted((r.project, r.from_id, r.segment_id) for r in a.bucket_edges(a.scene_nodes(asg, seg)).collect()) == [
        (1, "p1a", "p1b"), (2, "p2a", "p2b")]
    greedy = sorted((r.project, [x.segment_id for x in r.links]) for r in a.greedy_chains(asg, seg, tgt).collect())
    assert greedy == got
    flagged = spark.createDataFrame([(2, 1)], "project int, scene_id long")
    assert [r.project for r in a.only_scenes(chains, flagged).collect()] == [2]
    entries = asg.select("project", "scene_id", "segment_id")
    bounds = spark.createDataFrame([(1, 0, 1, "x", "p1a")], "project int, scene_id_a long, scene_id_b long, segment_id_a string, segment_id_b string")
    says = spark.createDataFrame([(1, 0, 1, "transition", ""), (2, 0, 1, "transition", "dip_to_black")],
                                 "project int, scene_id_a long, scene_id_b long, action string, transition_type string")
    acts = {r.segment_id: r.stitch_action for r in tl.stitch_actions(entries, bounds, says).collect()}
    assert acts == {"p1a": "dissolve", "p1b": "cut", "p2a": "cut", "p2b": "cut"}


def stored_bytes(spark):
    spark.range(1).checkpoint()
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_chains_store_nothing_and_travel_once(spark):
    rows = [(scene, f"s{(scene + b) % 7}", b, 0.1 * (scene % 5), scene * 10 + b) for scene in range(200) for b in range(3)]
    asg, seg, tgt = frames(spark, [segment(f"s{i}", 2.0 + i) for i in range(7)], rows, [(i, 0.0, 100.0, 10.0) for i in range(200)])
    before = stored_bytes(spark)
    found = a.find_chains(asg, seg, tgt)
    assert found.count() == 200
    assert stored_bytes(spark) - before < 2000  # the marker's own checkpoint
    paths = found.select("project", "scene_id", "chain_no", "segment_ids")
    plan = paths._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.count("video_file") == 1  # in the input alone
    assert [x.segment_id for x in found.filter("scene_id = 3").first().links] == ["s3", "s4", "s5"]


def test_chains_of_repeated_rows_and_missing_values(spark):
    asg, seg, tgt = frames(
        spark, [segment("a"), segment("b"), segment("c")],
        [(1, "a", None, 0.5, 1), (1, "b", 1, 0.9, 3), (1, "b", 1, None, 2), (1, None, 1, 0.1, 4), (None, "a", 0, 0.5, 5), (2, "c", 0, None, None)],
        [(1, 8.0, 12.0, 10.0), (1, 8.0, 12.0, 10.0), (2, 50.0, 60.0, 55.0), (2, 50.0, 60.0, 56.0), (3, 0.0, 9.0, 1.0), (None, 0.0, 9.0, 1.0)])
    got = sorted((r.scene_id, r.chain_no, r.origin, r.total_duration, r.duration_delta, [x.segment_id for x in r.links], r.segment_ids)
                 for r in a.find_chains(asg, seg, tgt).collect())
    assert got == [(1, 0, "path", 10.0, 0.0, ["a", "b"], ["a", "b"]), (1, 1, "path", 10.0, 0.0, ["a", "b"], ["a", "b"]),
                   (2, 0, "greedy", 5.0, 50.0, ["c"], ["c"]), (2, 0, "greedy", 5.0, 51.0, ["c"], ["c"])]
    last = a.find_chains(asg, seg, tgt).filter("scene_id = 1").first().links[1]
    assert last.edge_cost == pytest.approx(0.03)  # of the assignment with the last number
    twice = a.find_chains(asg, seg.unionByName(seg.filter("segment_id = 'b'")), tgt).filter("scene_id = 1").collect()
    assert [[x.segment_id for x in r.links] for r in twice] == [["a", "b", "b"]] * 4
