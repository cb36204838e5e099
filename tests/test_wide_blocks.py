"""The best segments of a scene from blocks of any size."""

import numpy as np
import pandas as pd
import pytest

from kinolake.operators import retrieve as rt


@pytest.mark.parametrize("whole", [rt.SCENE_BLOCK << 14, 0])
def test_best_needs_no_frame_per_scene(spark, monkeypatch, whole):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(rt._Overlaps, "WHOLE", whole, raising=False)
    monkeypatch.setattr(rt, "SCENE_BLOCK", 16)
    monkeypatch.setattr(rt, "SEGMENT_BLOCK", 32)
    words = lambda: None if rng.random() < 0.1 else [str(w) for w in rng.choice(["Sea", "sky", "hill"], 2)]
    a = pd.DataFrame({"scene_id": [f"s{i}" for i in range(50)], "scene_pos": range(50),
                      "vector": [rng.integers(-2, 3, 3).astype(float) for _ in range(50)], "keywords": [words() for _ in range(50)]})
    b = pd.DataFrame({"segment_id": range(100, 300), "seg_pos": rng.permutation(200),
                      "vector": [rng.integers(-2, 3, 3).astype(float) for _ in range(200)], "tags": [words() for _ in range(200)]})
    scene_df = spark.createDataFrame([], "scene_id string, keywords array<string>")
    seg_df = spark.createDataFrame([], "segment_id long, tags array<string>")
    frames, real = [], pd.DataFrame
    best, _ = rt._best_of(scene_df, seg_df, 0.7, 4)
    monkeypatch.setattr(rt.pd, "DataFrame", lambda *x, **y: frames.append(1) or real(*x, **y))
    got = best(a, b)
    monkeypatch.undo()
    assert len(frames) == 1
    x, y = rt._unit(a["vector"]), rt._unit(b["vector"])
    sets = [[{w.lower() for w in s} if s is not None else set() for s in c] for c in (a["keywords"], b["tags"])]
    for i in range(50):
        score = [0.7 * x[i] @ y[j] + 0.3 * (len(sets[0][i] & t) / len(sets[0][i] | t) if sets[0][i] | t else 0.0) for j, t in enumerate(sets[1])]
        want = sorted(range(200), key=lambda j: (-round(score[j], 9), b["seg_pos"][j]))[:4]
        own = got[got.scene_id == f"s{i}"]
        assert sorted(own.segment_id) == sorted(b["segment_id"][want])
        assert own.combined_score.to_numpy() == pytest.approx(sorted([score[j] for j in want], reverse=True))
