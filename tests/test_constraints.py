"""Constraints of file tables: rows kept apart, counts of the pass that writes, row groups that readers skip."""

import random

from pyspark.sql import functions as F

from pressmill.operators.constraints import Rules, checked, kept, store

LINKS = "article_key string, feed_id string, n int, status string"


def test_rules_in_order(spark):
    rows = [("a", "x", 1, None), ("a", "x", 2, "s"), ("a", "y", 3, None), (None, "x", 4, None), ("b", None, 5, None), ("gone", "x", 6, None), ("b", "gone", 7, None), ("gone", "gone", 8, None), ("gone", "x", 9, None), (None, None, None, None)]
    articles, feeds = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "article_key string"), spark.createDataFrame([("x",), ("y",)], "feed_id string")
    rules = Rules(("n",), ("article_key", "feed_id"), {"article_key": articles, "feed_id": feeds}, {"status": F.lit("pending")})
    got = {r["n"]: (r["violation"], r["status"]) for r in checked(spark.createDataFrame(rows, LINKS), rules, F.col("n")).collect()}
    said = {1: None, 2: "key", 3: None, 4: "null article_key", 5: "null feed_id", 6: "reference article_key", 7: "reference feed_id", 8: "reference article_key", 9: "key", None: "null n"}
    assert {k: v for k, (v, _) in got.items()} == said
    assert got[1][1] == "pending" and got[2][1] == "s"
    pairs = Rules(references={"article_key,feed_id": spark.createDataFrame([("a", "x")], "article_key string, feed_id string")})
    assert {r["n"] for r in checked(spark.createDataFrame(rows, LINKS), pairs, F.col("n")).where("violation is null").collect()} == {1, 2, 4, 5, None}


def test_counts_of_the_pass_that_writes_are_those_of_a_loop(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", f"k{rng.randrange(40)}", None]), rng.choice(["x", "y", "z"]), i, None) for i in range(500)]
    rules = Rules((), ("article_key", "feed_id"), {"feed_id": spark.createDataFrame([("x",), ("y",)], "feed_id string")})
    counts = store(checked(spark.createDataFrame(rows, LINKS), rules, F.col("n")), rules, f"{tmp_path}/t")
    seen, expected = set(), dict.fromkeys(("kept", *rules.names), 0)
    for key, feed, *_ in rows:
        name = "null article_key" if key is None else "key" if (key, feed) in seen else "reference feed_id" if feed == "z" else "kept"
        seen.add((key, feed))
        expected[name] += 1
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert counts == expected and kept(stored).count() == expected["kept"] and stored.count() == 500
    assert {r["violation"]: r["count"] for r in stored.where("kept = 0").groupBy("violation").count().collect()} == {k: v for k, v in expected.items() if k != "kept" and v}
    none = store(checked(spark.createDataFrame([], LINKS), rules, F.col("n")), rules, f"{tmp_path}/none", ("status",))
    assert none == dict.fromkeys(expected, 0)


def test_readers_skip_by_status_and_time(spark, tmp_path):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("article_key"), F.when(F.col("id") % 50 == 7, "pending").otherwise("summarized").alias("processing_status"), ((F.col("id") * 7919) % 20_000).alias("published_at"))
    rules = Rules(key=("article_key",))

    def rows_read(path):
        df = spark.read.parquet(path).where("kept = 1 and processing_status = 'pending'").select("article_key")
        assert len(df.collect()) == 400
        return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    for path, by in (("plain", ()), ("sorted", ("processing_status", "published_at"))):
        assert store(checked(rows, rules, F.col("published_at")), rules, f"{tmp_path}/{path}", by)["kept"] == 20_000
    assert rows_read(f"{tmp_path}/sorted") * 5 < rows_read(f"{tmp_path}/plain")
