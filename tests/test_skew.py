from lakenote.operators import bloom, skew
from lakenote.operators.orphans import orphan_references
from pyspark.sql import functions as F


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(skew, "SALT_ROWS", 7)
    left = spark.createDataFrame([(i, "hot" if i < 100 else f"k{i % 10}" if i % 9 else None) for i in range(300)], "i int, k string")
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("low")).where("k <> 'k3'")
    assert skew.hot_keys(right, ["k"]).where("k = 'hot'").collect()[0].salts == 15
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right.drop("n"), "k", how).select("i", "k").collect()))
        assert sorted(map(str, skew.salted_join(left, right, ["k"], how=how).select("i", "k").collect())) == want, how
    assert skew.salted_join(left.limit(0), right, ["k"]).collect() == []


def test_joins_of_unknown_size_are_not_broadcast(spark):
    a = spark.range(5).select(F.explode(F.sequence(F.lit(1), F.col("id") + 1)).alias("k"))
    plan = skew.merge_join(a, a.withColumn("x", F.lit(1)), "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_orphans_of_a_hot_path_with_a_filter_that_is_too_large_to_send(spark, monkeypatch):
    links = spark.createDataFrame([(i % 50, "hot.md" if i % 3 else f"p{i}.md") for i in range(400)], "src_id bigint, dst_path string").withColumn("found_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    docs = spark.createDataFrame([(i, f"p{i}.md") for i in range(0, 400, 2)], "doc_id bigint, path string").withColumn("indexed_at", F.timestamp_seconds(F.lit(1_600_000_000)))
    removed = spark.createDataFrame([(1, "hot.md")], "doc_id bigint, path string")
    want = sorted(map(str, orphan_references(links, docs, removed).collect()))
    monkeypatch.setattr(skew, "SALT_ROWS", 5)
    monkeypatch.setattr(bloom, "MAX_BROADCAST", 0)
    assert sorted(map(str, orphan_references(links, docs, removed).collect())) == want and any("deleted" in x for x in want)
