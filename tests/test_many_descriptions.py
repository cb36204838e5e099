"""Numbering of descriptions where every segment has few."""

from kinolake.operators import describe as d


def test_short_segments_need_no_quantiles(spark):
    segs = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, 2.5)], "segment_id long, start double")
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 7, "c"), (9, 1, "x")], "segment_id long, seq int, word string")
    got = d.combined_view(segs, lines)
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r.segment_id, r.vlm_pos or 0, r.word) for r in got.collect())
    assert rows == [(1, 1, "a"), (1, 2, "b"), (2, 0, None), (3, 1, "c")]
