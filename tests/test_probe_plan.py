"""The plan of media probes."""

from kinolake.operators import catalog as c


def test_probe_is_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"streams":['), (2, '{"streams":[]}'), (3, None)], "k long, probe string")
    rejects = c.probe_to_video(df, "probe")[1]
    plan = rejects._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
    assert sorted(map(tuple, rejects.collect())) == [(1, "invalid JSON"), (2, "no video stream"), (3, "invalid JSON")]
