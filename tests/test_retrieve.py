"""Retrieval against brute force, with blocks small enough to split every project."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinolake.operators import peaks as pk
from kinolake.operators import retrieve as rt
from kinolake.operators import signal as sg

WORDS = ["Sea", "sky", "Boat", "hill", "road"]


def jaccard(a, b):
    a, b = {x.lower() for x in a}, {x.lower() for x in b}
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v)
    segs, scenes = [], []
    for project, count in ((0, 90), (1, 7)):
        for i in range(count):
            segs.append((project, f"g{i}", i, unit(rng.normal(size=8)).tolist(), list(rng.choice(WORDS, size=rng.integers(0, 3)))))
        for j in range(11 if project == 0 else 3):
            scenes.append((project, f"s{j}", j, unit(rng.normal(size=8)).tolist(), list(rng.choice(WORDS, size=rng.integers(0, 3)))))
    segs[5] = (0, "g5", 5, segs[4][3], segs[4][4])  # a copy: ties keep segment order
    kind = "project int, {} string, {} long, vector array<double>, {} array<string>"
    return (segs, scenes, spark.createDataFrame(segs, kind.format("segment_id", "seg_pos", "tags")),
            spark.createDataFrame(scenes, kind.format("scene_id", "scene_pos", "keywords")))


def ranking(segs, scene, k):
    rows = []
    for p, sid, pos, vec, tags in segs:
        if p == scene[0]:
            score = 0.7 * float(np.dot(vec, scene[3])) + 0.3 * jaccard(tags, scene[4])
            rows.append((-round(score, 9), pos, sid))
    return [sid for _, _, sid in sorted(rows)[:k]]


def test_top_candidates(spark, data):
    segs, scenes, seg_df, scene_df = data
    got = rt.retrieve_candidates(scene_df, seg_df, k=6, scene_block=4, segment_block=16).toPandas()
    for scene in scenes:
        have = got[(got.project == scene[0]) & (got.scene_id == scene[1])].sort_values("rank")
        assert list(have.segment_id) == ranking(segs, scene, 6)
    assert not got["keyword_score"].isna().any()


def clustered(spark, seed=3, n=400):
    """Two projects of segments around few directions, one of them with most rows, and scenes near some of them."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 6))
    segs, scenes = [], []
    for i in range(n):
        p = int(i % 5 == 0)
        vec = middles[i % 12] + 0.05 * rng.normal(size=6) if i % 50 else np.zeros(6)
        tags = None if i % 40 == 7 else [str(x) for x in rng.choice(WORDS + [f"c{i % 12}", None], 2)]
        segs.append((p, f"g{i}", i, (vec / max(np.linalg.norm(vec), 1e-12)).tolist(), tags))
    segs += [(0, f"h{i}", 1000 + i, segs[1][3], segs[1][4]) for i in range(20)]  # ties
    for i in range(30):
        vec = middles[i % 12] + 0.05 * rng.normal(size=6) if i else np.zeros(6)
        scenes.append((i % 2, f"s{i}", i, vec.tolist(), [["Sea", f"C{i % 12}"], [], None, ["hill"]][i % 4]))
    seg_df = spark.createDataFrame(segs, "project int, segment_id string, seg_pos long, vector array<double>, tags array<string>")
    scene_df = spark.createDataFrame(scenes, "project int, scene_id string, scene_pos long, vector array<double>, keywords array<string>")
    return scene_df, seg_df


def test_bounds_open_few_blocks_and_lose_nothing(spark):
    scene_df, seg_df = clustered(spark)
    want = rt.retrieve_candidates(scene_df, seg_df, k=5)
    got, report = rt.open_blocks(scene_df, seg_df, "project", 0.7, 5, segment_block=16, scene_block=4)
    key = lambda df: sorted((r.project, r.scene_id, r.rank, r.segment_id, round(r.combined_score, 9)) for r in df.collect())
    assert key(got) == key(want)
    assert key(rt.retrieve_candidates(scene_df, seg_df, k=5, segment_block=16, plain_rows=10)) == key(want)
    opened = {r.project: r.opened / r.all_pairs for r in report.collect()}
    assert opened[0] < 0.5 and len(opened) == 2
    assert rt.open_blocks(scene_df, seg_df.limit(0), "project", 0.7, 5)[0].count() == 0


@pytest.mark.parametrize("plain", [rt.PLAIN_ROWS, 0])
def test_summaries_equal_all_pairs(spark, plain):
    scene_df, seg_df = clustered(spark, 4, 120)
    scenes, segs = scene_df.toPandas(), seg_df.toPandas()
    unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-9)
    for r in rt.score_summary(scene_df, seg_df, plain_rows=plain).collect():
        scene = scenes[(scenes.project == r.project) & (scenes.scene_id == r.scene_id)].iloc[0]
        own = segs[segs.project == r.project]
        score = [0.7 * unit(x) @ unit(scene.vector) + 0.3 * jaccard([w for w in t if w] if t is not None else [], [w for w in scene.keywords if w] if scene.keywords is not None else [])
                 for x, t in zip(own.vector, own.tags)]
        assert r.pairs == len(own) and r.mean_score == pytest.approx(np.mean(score), abs=1e-9) and r.top_score == pytest.approx(max(score), abs=1e-9)
    assert rt.score_summary(scene_df, seg_df, plain_rows=plain).count() == len(scenes)
    vectors = seg_df.select("project", F.col("seg_pos").alias("vec_id"), "vector")
    for r in rt.similarity_profile(vectors, plain_rows=plain).collect():
        own = segs[segs.project == r.project].set_index("seg_pos")
        same = np.round([unit(x) @ unit(own.vector[r.vec_id]) for x in own.vector], 9)
        rest = np.where(own.index == r.vec_id, -np.inf, same)
        assert r.others == len(own) - 1 and r.nearest_similarity == pytest.approx(rest.max(), abs=1e-8)
        assert rest[list(own.index).index(r.nearest_id)] == pytest.approx(rest.max(), abs=1e-8)
        assert r.mean_similarity == pytest.approx((same.sum() - same[list(own.index).index(r.vec_id)]) / (len(own) - 1), abs=1e-7)


def test_pools_and_gaps(spark, data):
    segs, scenes, seg_df, scene_df = data
    cand = rt.retrieve_candidates(scene_df, seg_df, k=4).cache()
    pools = rt.resolve_contested(cand).cache()
    assert pools.count() == cand.select("project", "segment_id").distinct().count()
    best = cand.toPandas().sort_values(["combined_score", "scene_pos"], ascending=[False, True]).drop_duplicates(["project", "segment_id"])
    have = pools.toPandas()
    assert set(zip(have.project, have.segment_id, have.scene_id)) == set(zip(best.project, best.segment_id, best.scene_id))
    # serial filling, scene by scene
    free = {p: [s for s in segs if s[0] == p and (p, s[1]) not in set(zip(have.project, have.segment_id))] for p in (0, 1)}
    want = set()
    for scene in sorted(scenes, key=lambda x: (x[0], x[2])):
        need = 6 - ((have.project == scene[0]) & (have.scene_id == scene[1])).sum()
        for sid in ranking(free[scene[0]], scene, max(need, 0)):
            want.add((scene[0], scene[1], sid))
            free[scene[0]] = [s for s in free[scene[0]] if s[1] != sid]
    added = rt.fill_gaps(pools, scene_df, seg_df, minimum=6).toPandas()
    assert set(zip(added.project, added.scene_id, added.segment_id)) == want and want
    # limited to each scene's own list, nothing is left to add
    assert rt.fill_gaps(pools, scene_df, seg_df, minimum=6, depth=4).count() == 0


def test_similarity_profile(spark, data):
    segs, _, seg_df, _ = data
    v = seg_df.select("project", F.col("seg_pos").alias("vec_id"), "vector")
    got = rt.similarity_profile(v).toPandas()
    m = np.array([s[3] for s in segs if s[0] == 0]); c = m @ m.T
    row = got[(got.project == 0) & (got.vec_id == 4)].iloc[0]
    assert row.nearest_id == 5 and row.mean_similarity == pytest.approx((c[4].sum() - 1) / 89)


@pytest.mark.parametrize("size,chunk", [(None, 65536), (400, 65536), (None, 30), (400, 25)])
def test_peaks(spark, size, chunk):
    rng = np.random.default_rng(9)
    shapes = [rng.integers(0, 9, size=300) / 4.0, np.arange(300) % 2 + np.arange(300) / 50.0, np.repeat(rng.integers(0, 4, 20), 15) / 1.0,
              -np.abs(np.arange(300) - 150.0) + 2.0 * (np.arange(300) % 3), np.zeros(300)]
    data = pd.concat([pd.DataFrame({"video_id": v, "pos": range(300), "n": 300, "score": x}) for v, x in enumerate(shapes)])
    got = pk.find_peaks(spark.createDataFrame(data), ["video_id"], 0.5, 6, longest=size, chunk_rows=chunk).toPandas()
    for video, part in data.groupby("video_id"):
        want = plain_peaks(part.score.to_numpy(), 0.5, 6)
        have = got[got.video_id == video].sort_values("pos")
        assert list(zip(have.pos, have.score, have.prominence.round(9))) == want
    assert pk.find_peaks(spark.createDataFrame(data).limit(0), ["video_id"], longest=size).count() == 0


def plain_peaks(x, prominence, distance):
    """The whole series at once: tops, suppression by falling height, valleys by scanning."""
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    keep = set(found)
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if p in keep:
            keep -= {q for q in found if q != p and abs(q - p) < distance}
    out = []
    for p in sorted(keep):
        left, right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p:] > x[p])
        low = x[left[-1] + 1 if len(left) else 0:p + 1].min()
        high = x[p:p + right[0] if len(right) else len(x)].min()
        if x[p] - max(low, high) >= prominence:
            out.append((p, x[p], round(x[p] - max(low, high), 9)))
    return out


def test_peaks_of_a_long_series(spark):
    """A million rows in chunks; the staircase passes its decisions through all of them."""
    n = np.arange(1_000_000)
    x = np.sin(n / 40.0) + n * 1e-6 + ((n * 2654435761) % 1000) / 1e4
    rows = spark.range(1_000_000).selectExpr(
        "1 AS video_id", "id AS pos", "1000000L AS n", "sin(id / 40.0D) + id * 1e-6D + ((id * 2654435761L) % 1000) / 1e4D AS score")
    got = pk.find_peaks(rows, ["video_id"], 0.5, 100).toPandas().sort_values("pos")
    assert len(got) > 3000 and got.pos.tolist() == long_peaks(x, 0.5, 100)


def long_peaks(x, prominence, distance):
    top = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1
    keep = np.ones(len(top), bool)
    for j in np.lexsort((top, x[top]))[::-1]:
        if keep[j]:
            a, b = np.searchsorted(top, top[j] - distance, "right"), np.searchsorted(top, top[j] + distance, "left")
            keep[a:j] = keep[j + 1:b] = False
    out = []
    for p in top[keep]:
        sides, step = [], 1
        for way in (-1, 1):
            reach = 1000
            while True:
                part = x[p::way][:reach] if way == 1 else x[p::-1][:reach]
                above = np.flatnonzero(part > x[p])
                if len(above) or reach >= len(x):
                    sides.append(part[:above[0] if len(above) else None].min())
                    break
                reach *= 10
        if x[p] - max(sides) >= prominence:
            out.append(int(p))
    return out


def test_vector_series(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(1, i, float(i), v.tolist()) for i, v in enumerate(x)], "video_id int, idx long, timestamp double, vector array<double>")
    for size in (None, 100):
        rows = sg.numbered(df, longest=size)
        score = rt.split_score(rows, ["video_id"], 10, longest=size).orderBy("pos").toPandas().score
        for t in range(60):
            l, r = x[max(t - 10, 0):t].mean(axis=0) if t else x[0], x[t:t + 10].mean(axis=0)
            want = 1 - l @ r / np.linalg.norm(l) / np.linalg.norm(r) if 10 <= t < 50 else 0.0
            assert score[t] == pytest.approx(want, abs=1e-9)
    keys = rt.select_keyframes(sg.numbered(df), ["video_id"]).toPandas().pos
    chosen = [30]
    for _ in range(2):
        gap = [(-1 if i in chosen else min(1 - x[i] @ x[c] for c in chosen)) for i in range(60)]
        chosen.append(int(np.argmax(gap)))
    assert sorted(keys) == sorted(chosen)


def test_pca_keeps_the_variance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4)) @ np.diag([5, 2, 1, 0.1]) + 7
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows + [(99, None, "x")], "i int, vector array<double>, projection string")
    out, share = rt.pca(frame, components=2)
    values, axes = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(share, (values[::-1] / values.sum())[:2])
    got = {r.i: r.projection for r in out.collect()}
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    np.testing.assert_allclose(np.array([got[i] for i in range(40)]), (x - x.mean(axis=0)) @ axes, atol=1e-9)
    assert got[99] is None
    out, share = rt.pca(frame.limit(0))
    assert out.collect() == [] and share == []
    out, share = rt.pca(frame.where("i = 3"))
    assert [r.projection for r in out.collect()] == [[]] and share == []


def test_mean_pool_masks_and_keeps_empty_documents(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 3.0], 0), (2, [1.0, 1.0], 0)]
    got = {r.doc: list(r.vector) for r in rt.mean_pool(spark.createDataFrame(rows, "doc int, v array<double>, m int"), "doc", "v", "m", 2).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0]}
