"""Price changes pull by pull against the changes over all history at once."""

import random

import pytest
from pyspark.sql import functions as F

from pumpwise.plans import history


def test_pulls_equal_the_whole_history(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(40)}", rng.choice(["E5", "E10"]), pull, i, rng.choice([None, round(rng.uniform(1, 2), 3)])) for pull in range(5) for i in range(120)]
    df = spark.createDataFrame(rows, "station string, fuel string, pull int, i int, price double")
    want = {tuple(r) for r in history.price_changes(df, ["station", "fuel"], ["pull", "i"]).collect()}
    state, got = history.LatestPrices(spark, str(tmp_path / "latest"), ["station", "fuel"], buckets=4), []
    assert state.current() is None
    for pull in range(5):
        if pull == 3:  # a pull that fails leaves the state as it was; another session's catalog finds it by its commit
            with pytest.raises(Exception):
                state.apply(df.where("pull = 3").withColumn("price", F.raise_error(F.lit("broken")).cast("double")), ["pull", "i"])
            for t in spark.catalog.listTables():
                spark.sql(f"DROP TABLE IF EXISTS `{t.name}`") if t.name.startswith("latest_") else None
        got += [tuple(r) for r in state.apply(df.where(F.col("pull") == pull), ["pull", "i"]).collect()]
    assert len(got) == len(rows) and set(got) == want
    assert len([p for p in (tmp_path / "latest").iterdir() if p.name.startswith("latest_")]) <= 3
    assert state.current().count() == len({r[:2] for r in rows})


def test_the_state_is_not_shuffled(spark, tmp_path):
    state = history.LatestPrices(spark, str(tmp_path / "latest"), ["k"], buckets=4)
    pull = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("n"), F.lit(1.5).alias("price"))
    state.apply(pull, ["n"])
    changed = state.changes(pull.where("k < 50").withColumn("n", F.lit(2)), ["n"])
    plan = changed._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("Bucketed: true")] if "Bucketed: true" in plan else ""
    assert scan, plan
    # Between the join and the scan of the bucketed table there is no exchange.
    tail = plan[plan.rindex("SortMergeJoin"):]
    assert tail.count("Exchange") == 1, plan
    assert {r["previous"] for r in changed.collect()} == {1.5} and changed.where("delta = 0").count() == 50
