"""Gap filling where free segments run out, against scenes choosing one after another."""

import numpy as np

from kinolake.operators import retrieve as rt


def test_scenes_after_the_last_segment_are_not_listed(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vec = lambda i: rng.normal(size=4).tolist() if i % 4 else [1.0, 0.5, 0.0, 0.0]  # every fourth is alike
    segs = [(0, f"g{i}", i, vec(i), ["sea"] if i % 3 else []) for i in range(70)]
    scenes = [(0, f"s{j}", j, vec(j), ["Sea"] if j % 2 else None) for j in range(60)]
    seg_df = spark.createDataFrame(segs, "project int, segment_id string, seg_pos long, vector array<double>, tags array<string>")
    scene_df = spark.createDataFrame(scenes, "project int, scene_id string, scene_pos long, vector array<double>, keywords array<string>")
    pools = rt.resolve_contested(rt.retrieve_candidates(scene_df, seg_df, k=2)).localCheckpoint()
    have = pools.toPandas()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    free = [s for s in segs if s[1] not in set(have.segment_id)]
    want, needy = set(), 0
    for scene in scenes:
        need = 3 - int((have.scene_id == scene[1]).sum())
        words = {w.lower() for w in scene[4] or []}
        score = lambda s: round(0.7 * unit(s[3]) @ unit(scene[3]) + 0.3 * (bool(words & set(s[4])) * 1.0), 9)
        taken = sorted(free, key=lambda s: (-score(s), s[2]))[:max(need, 0)]
        want |= {(scene[1], s[1]) for s in taken}
        needy += bool(taken)
        free = [s for s in free if s not in taken]
    assert not free and needy < 50
    asked, plain = [], rt.retrieve_candidates

    def listed(scenes, *rest):
        asked.append(scenes.count())
        return plain(scenes, *rest)
    monkeypatch.setattr(rt, "retrieve_candidates", listed)
    added = rt.fill_gaps(pools, scene_df, seg_df, minimum=3).toPandas()
    assert set(zip(added.scene_id, added.segment_id)) == want
    assert asked[0] == needy and all(a < needy for a in asked[1:])
