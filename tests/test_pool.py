"""A re-ranker's pool meets the chunks without moving their texts."""

from loomdex import record_queries

from .test_scan import plan_of


def test_pool_is_known_before_it_meets_the_chunks(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100kb")  # under the texts, over the hits
    try:
        pool = record_queries._pool(spark, "/root/testdata/sf0.001")
        plan = plan_of(pool)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" not in plan and pool.filter("rank = 1").count() > 0
