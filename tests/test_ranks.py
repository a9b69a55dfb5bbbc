"""Numbers within a key against plain loops; a key with nearly all rows; no task with more than its share."""

import random

from pyspark.sql import functions as F

from pumpwise.operators import match, ranks
from pumpwise.operators.dedup import ordinal_ids


def test_numbers_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", "", None]), rng.choice([None, *range(6)]), f"n{rng.randrange(50)}", i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, x int, `na.me` string, i int").repartition(5)
    seen, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2], r[3])):
        seen[r[0]] = seen.get(r[0], 0) + 1
        want[r[3]] = seen[r[0]]
    got = ranks.number_rows(df, ["k"], ["x", "na.me", "i"], "number")
    assert got.columns == [*df.columns, "number"] and {r["i"]: r["number"] for r in got.collect()} == want
    assert {r["i"]: r["ordinal"] for r in ordinal_ids(df, ["k"], ["x", "na.me", "i"]).collect()} == {i: n - 1 for i, n in want.items()}
    assert ranks.number_rows(df.limit(0), ["k"], ["x"], "number").count() == 0


def test_a_key_with_nearly_all_rows_is_spread(spark):
    """What one task sorts is a range, not the key."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(40_000).select(F.when(F.col("id") % 50 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.col("id").alias("i"))
        sizes = [r["count"] for r in ranks.range_parts(df, ["k"], ["i"], "part").groupBy("part").count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2.5 * 40_000 / 16
        got = ranks.number_rows(df, ["k"], ["i"], "n").where("k = 'hot'")
        assert got.agg(F.count("n"), F.countDistinct("n"), F.min("n"), F.max("n")).first()[:] == (39_200, 39_200, 1, 39_200)
        assert got.where(F.col("n") != F.col("i") - F.floor((F.col("i") - 1) / 50)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_matching_with_a_hot_key(spark):
    places = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("p"))
    records = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise("").alias("k"), F.col("id").alias("r"))
    got = match.match_slots(places, records, ["k"], ["p"], ["r"], ["r"])
    assert got.where("matched AND p = r").count() == 3000
    assert match.unmatched_records(places, records, ["k"], ["p"], ["r"]).where("r >= 3000").count() == 2000
