"""Ordered-series operators: chunked form against numpy, pandas and the single-task form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinolake.operators import motion as m
from kinolake.operators import ordering as o
from kinolake.operators import signal as sg

LENGTHS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 9, 6: 12, 7: 150}


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(5)
    frames = []
    for video, n in LENGTHS.items():
        t = np.cumsum(rng.choice([0.25, 0.25, 0.5, 3.0], size=n))
        frames.append(pd.DataFrame({"video_id": video, "idx": range(n), "timestamp": t, "pan": rng.normal(size=n).round(1),
                                    "tilt": rng.integers(0, 4, size=n).astype(float), "zoom": 1.0}))
    data = pd.concat(frames)
    return data, spark.createDataFrame(data.sample(frac=1, random_state=1)).cache()


def both(df, run):
    """Results of the chunked form with tiny chunks and of the single-task form."""
    chunked = run(o.number_rows(df, ["video_id"], ["timestamp", "idx"], o.time_bucket(F.col("timestamp"), 2.0)), None)
    plain = run(sg.numbered(df, longest=200), 200)
    out = []
    for result in (chunked, plain):
        pdf = result.toPandas()
        out.append(pdf.sort_values([c for c in ("video_id", "channel", "pos") if c in pdf]).reset_index(drop=True))
    pd.testing.assert_frame_equal(out[0][out[1].columns], out[1], check_dtype=False)
    return out[0]


def test_positions(samples):
    data, df = samples
    got = both(df, lambda d, size: d)
    for video, part in got.groupby("video_id"):
        want = data[data.video_id == video].sort_values(["timestamp", "idx"])
        assert list(part.pos) == list(range(len(want))) and list(part.idx) == list(want.idx)
        assert (part.n == len(want)).all()


def test_smoothing_is_a_local_polynomial_fit(samples):
    data, df = samples
    got = both(df, lambda d, size: sg.savgol(d, ["pan", "tilt"], chunk_rows=16, longest=size))
    for video, part in got.groupby("video_id"):
        x = data[data.video_id == video].sort_values("idx")["pan"].to_numpy()
        n = len(x)
        w = max(min(11, n if n % 2 else n - 1), 3)
        want = x.copy()
        if n >= max(w, 2):
            for i in range(n):
                start = min(max(i - w // 2, 0), n - w)
                fit = np.polyfit(np.arange(w), x[start:start + w], 2)
                want[i] = np.polyval(fit, i - start)
        np.testing.assert_allclose(part.pan, want, atol=1e-9)


def test_median_filter_pads_with_zeros(samples):
    data, df = samples
    got = both(df, lambda d, size: sg.median_filter(d, ["pan"], chunk_rows=16, longest=size))
    for video, part in got.groupby("video_id"):
        x = np.pad(data[data.video_id == video].sort_values("idx")["pan"].to_numpy(), 2)
        np.testing.assert_allclose(part.pan, [np.median(x[i:i + 5]) for i in range(len(x) - 4)])


def test_interpolation_matches_pandas(samples):
    data, df = samples
    got = both(df, lambda d, size: sg.interpolate_bad(d, ["pan"], F.col("tilt") < 2, bucket_rows=10, longest=size))
    for video, part in got.groupby("video_id"):
        rows = data[data.video_id == video].sort_values("idx")
        bad = rows.tilt < 2
        want = rows.pan.astype(float)
        if (~bad).sum() >= 2:
            want = want.mask(bad).interpolate("linear", limit_direction="both")
        np.testing.assert_allclose(part.pan, want.to_numpy())


def test_gradient_and_cumulative(samples):
    data, df = samples
    def run(d, size):
        d = sg.gradient(d, ["pan"], longest=size)
        return sg.cumulative_path(d, ["pan"], bucket_rows=7, longest=size)
    got = both(df, run)
    for video, part in got.groupby("video_id"):
        rows = data[data.video_id == video].sort_values("idx")
        x, t = rows.pan.to_numpy(), rows.timestamp.to_numpy()
        np.testing.assert_allclose(part.cum_pan, np.cumsum(x))
        if len(x) > 1:
            np.testing.assert_allclose(part.v_pan, np.gradient(x, np.median(np.diff(t))))


def average_ranks(x):
    return pd.Series(x).rank(method="average").to_numpy()


def spearman(x):
    if len(x) <= 2 or len(set(x)) == 1:
        return 0.0
    return np.corrcoef(np.arange(len(x)), average_ranks(x))[0, 1]


def test_rank_correlation(samples):
    data, df = samples
    got = both(df, lambda d, size: sg.rank_correlation(d, ["pan", "tilt", "zoom"], longest=size).withColumn("monotonicity", F.round("monotonicity", 9)))
    for _, row in got.iterrows():
        x = data[data.video_id == row.video_id].sort_values("idx")[row.channel].to_numpy()
        assert row.monotonicity == pytest.approx(spearman(x), abs=1e-8)


@pytest.mark.parametrize("edge,rows", [(m.edge_rows_movement, lambda n: max(1, int(np.ceil(n * 0.05)))),
                                       (m.edge_rows_channel, lambda n: max(1, n // 10))])
def test_interval_motion(samples, edge, rows):
    data, df = samples
    got = both(df, lambda d, size: m.interval_motion(d, ["video_id"], ["pan", "tilt", "zoom"], edge, size))
    assert set(got.video_id) == {v for v, n in LENGTHS.items() if n >= 2}
    for _, row in got.iterrows():
        part = data[data.video_id == row.video_id].sort_values("idx")
        x, t = part.pan.to_numpy(), part.timestamp.to_numpy()
        d = np.gradient(x, np.median(np.diff(t)))
        w = rows(len(x))
        want = [d[:w].mean(), d[-w:].mean(), np.abs(d).mean(), d.std(), spearman(x), np.sqrt((x * x).mean())]
        have = [row.pan_entry_vel, row.pan_exit_vel, row.pan_mean_abs_deriv, row.pan_std_deriv, row.pan_monotonicity, row.pan_rms]
        np.testing.assert_allclose(have, want, atol=1e-9)
        assert row.zoom_monotonicity == 0.0


def test_as_of_operators(samples):
    data, df = samples
    bounds = df.filter("idx % 4 = 1").select("video_id", F.col("timestamp").alias("time"))
    for size in (None, 500):
        got = sg.assign_by_boundaries(df, bounds, longest=size).toPandas()
        near = sg.nearest_sample(bounds.withColumn("time", F.col("time") + 0.6), df.filter("idx % 3 = 0"), longest=size).toPandas()
        for video, part in data.groupby("video_id"):
            cuts = part[part.idx % 4 == 1].timestamp.to_numpy()
            have = got[got.video_id == video].sort_values("idx").segment
            assert list(have) == [int((cuts < t).sum()) for t in part.sort_values("idx").timestamp]
            pool = part[part.idx % 3 == 0]
            for _, row in near[near.video_id == video].iterrows():
                gap = (pool.timestamp - row.time).abs()
                assert row.nearest_idx == pool.idx.iloc[int(np.argmin(gap.to_numpy()))]


def test_interval_join_is_half_open(samples):
    _, df = samples
    spans = df.groupBy("video_id").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    spans = spans.withColumn("scene_id", F.lit(0))
    inside = sg.frames_to_intervals(df, spans).groupBy("video_id").count().toPandas()
    closed = sg.frames_to_intervals(df, spans, closed_last=True).groupBy("video_id").count().toPandas()
    assert dict(zip(inside.video_id, inside["count"])) == {v: n - 1 for v, n in LENGTHS.items() if n > 1}
    assert dict(zip(closed.video_id, closed["count"])) == LENGTHS


def test_missing_columns_are_reported(samples):
    _, df = samples
    with pytest.raises(ValueError, match="missing input columns: camera_magnitude"):
        sg.signal_rows(df, ["pan", "camera_magnitude"])


def test_cross_channel_of_constant_channels(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 0.0, 2.0), (1, 1.0, 3.0, 0.0, 2.0), (1, 1.0, 4.0, 0.0, 2.0)],
                                 "video_id int, pan double, tilt double, zoom double, camera_magnitude double")
    got = m.cross_channel(rows, ["video_id"]).first()
    assert got.dominant_axis == "tilt" and got.pan_tilt_corr is None


def test_range_join_is_exact_and_linear(spark):
    rng = np.random.default_rng(5)
    edges = np.concatenate([[0.0], np.cumsum(rng.choice([0.01, 0.3, 2.0, 40.0], size=400))])
    spans = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    spans += [(1, 900, 5.0, 300.0), (1, 901, 7.0, 7.0), (2, 0, -3.0, 1.0), (1, 902, None, 4.0)]
    rows = [(1, float(t)) for t in rng.uniform(0, edges[-1], 3000)] + [(1, float(t)) for t in edges[:50]] + [(2, -3.0), (2, 1.0), (3, 0.0)]
    frames = spark.createDataFrame(rows, "video_id int, timestamp double")
    intervals = spark.createDataFrame(spans, "video_id int, scene_id int, start_time double, end_time double")
    got = sorted((r.video_id, r.timestamp, r.scene_id) for r in sg.frames_to_intervals(frames, intervals).collect())
    want = sorted((v, t, i) for v, t in rows for w, i, a, b in spans if v == w and a is not None and a <= t < b)
    assert got == want
    before = o.range_join(frames, intervals.filter("scene_id < 900"), ["video_id"], "timestamp", "start_time", "end_time", F.lit(True))
    levels = len({int(np.ceil(np.log2(b - a))) for _, i, a, b in spans if i < 900})
    assert before.count() <= 3 * levels * len(rows)
