"""The stream returns every session of the events, those still open at its end too."""

from loomdex.queries import QUERIES
from loomdex.streaming import watch


def test_stream_has_all_sessions(spark):
    sf_dir = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = watch.sessions(events, "user_id", "ts", 6 * 3600)
    got = QUERIES["stream_sessions"](spark, sf_dir)
    key = lambda df: sorted((r.user_id, r.events) for r in df.select("user_id", "events").collect())
    assert key(got) == key(want)
