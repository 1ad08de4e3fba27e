"""Merges into bucketed tables: the rows of the pure functions, and no exchange on the stored side."""

import re

import pytest
from pyspark.sql import functions as F

from pressmill.operators import merge as M
from pressmill.plans.bucketed import BucketedTable

def at(day):
    return F.lit(f"2024-01-0{day}").cast("timestamp")


def sightings(spark, lo, hi, word):
    fields = {c: F.lit(word) for c in M.UPDATED} | {"authors": F.array(F.lit(word)), "published_at": at(1)}
    return spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("article_key"), *(v.alias(c) for c, v in fields.items()))


@pytest.fixture
def table(spark, tmp_path):
    first = M.upsert_articles(no_articles(spark), sightings(spark, 0, 300, "one"), at(1))
    table = BucketedTable(spark, f"articles_{tmp_path.name.lower()}", "article_key", f"file://{tmp_path}/t", 5)
    table.create(first.schema)
    table.create(first.schema)
    assert table.read().count() == 0
    table.merge(sightings(spark, 0, 300, "one"), lambda stored, new: M.upsert_articles(stored, new, at(1)))
    yield table
    spark.sql(f"DROP TABLE {table.name}")


def no_articles(spark):
    from pressmill.schemas import ARTICLES

    return spark.createDataFrame([], ARTICLES)


def shuffles_below_stored(df, name):
    """Exchanges of a plan that have the table's scan below them."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search(r"[A-Za-z]", x).start() if re.search(r"[A-Za-z]", x) else -1 for x in lines]
    scans = [i for i, x in enumerate(lines) if "FileScan" in x and name in x]
    assert scans
    above = []
    for scan in scans:
        low = depth[scan]
        for i in range(scan - 1, -1, -1):
            if 0 <= depth[i] < low:
                low = depth[i]
                above.append(lines[i])
    return [x for x in above if "Exchange" in x]


def test_merges(spark, table):
    before = [tuple(r) for r in table.read().collect()]
    expected = M.upsert_articles(table.read(), sightings(spark, 250, 400, "two"), at(2))
    expected = sorted(map(tuple, expected.collect()))
    table.merge(sightings(spark, 250, 400, "two"), lambda stored, new: M.upsert_articles(stored, new, at(2)))
    assert sorted(map(tuple, table.read().collect())) == expected and len(before) == 300 and len(expected) == 400
    for _ in range(3):
        table.merge(sightings(spark, 0, 0, "none"), lambda stored, new: M.upsert_articles(stored, new, at(1)))
    assert sorted(map(tuple, table.read().collect())) == expected


def test_no_exchange_on_the_stored_side(spark, table):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "37"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        new = table.placed(sightings(spark, 250, 400, "two"))
        stored = table.read()
        known = M.with_existing(new, stored)
        for df in (M.upsert_articles(stored, new, at(1)), known, M.new_keys(new, stored), M.update_status(stored, new.select("article_key", F.lit("done").alias("processing_status")), at(1))):
            assert shuffles_below_stored(df, table.name) == []
        # The test sees an exchange where there is one.
        assert shuffles_below_stored(stored.groupBy("url").count(), table.name)
        assert known.where("is_known").count() == 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
