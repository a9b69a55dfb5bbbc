"""Keyword rules through the index of pieces against a loop over all rules and texts."""

import random

import pytest
from pyspark.sql import functions as F

from pumpwise.operators.keywords import BLOCK, by_keyword_table

TEXTS = "id int, text string, `a.b` string, digest string, piece int"
RULES = "rule_ord int, keyword string, value string, text string"


def looked_up(text, rules):
    hits = [(o, k.lower(), v) for o, k, v, _ in rules if o is not None and k is not None and k.lower() in text.lower()] if text is not None else []
    return min(hits, key=lambda h: (h[0], h[1], h[2] is not None, h[2] or ""))[2] if hits else None


@pytest.mark.parametrize("seed, empty_keyword", [(1, False), (2, False), (3, True)])
def test_equal_to_a_loop(spark, seed, empty_keyword):
    rng = random.Random(seed)
    word = (lambda n: "".join(rng.choice("abcAé .\n😀") for _ in range(n)))
    texts = [(i, word(rng.choice([0, 1, 3, 4, 9, 60])), "x", None, i) for i in range(60)] + [(60, None, "x", None, 1)]
    texts += texts[:5] * 3
    rules = [(rng.randint(0, 40) if rng.random() > 0.05 else None, word(rng.choice([1, 2, 3, 4, 5, 7])), rng.choice(["u", "v", "w"]), "t") for _ in range(30)]
    rules += [(5, None, "z", "t"), (2, "zzzz", "y", "t"), *rules[:4]] + ([(20, "", "all", "t")] if empty_keyword else [])
    got = by_keyword_table(spark.createDataFrame(texts, TEXTS), "text", spark.createDataFrame(rules, RULES), "fuel")
    assert got.columns == ["id", "text", "a.b", "digest", "piece", "fuel"]
    assert sorted((r["id"], r["fuel"] or "") for r in got.collect()) == sorted((t[0], looked_up(t[1], rules) or "") for t in texts)


def test_long_text_across_blocks(spark):
    """A keyword that lies across the cut between two blocks, at either side of it, and in the last characters."""
    base = "".join(random.Random(4).choice("abcd ") for _ in range(3 * BLOCK))
    for at in (BLOCK - 5, BLOCK - 3, BLOCK - 1, BLOCK, 2 * BLOCK + 2, 3 * BLOCK - 6):
        text = base[:at] + "Needle" + base[at + 6:]
        rules = spark.createDataFrame([(1, "needles", "no", ""), (2, "NEEDLE", "yes", ""), (3, "a", "late", "")], RULES)
        assert by_keyword_table(spark.createDataFrame([(1, text)], "id int, text string"), "text", rules, "v").first()["v"] == "yes"


def test_empty_tables_and_an_older_column(spark):
    texts, rules = spark.createDataFrame([(1, "abc", "old")], "id int, text string, v string"), spark.createDataFrame([(1, "b", "new", "")], RULES)
    assert [tuple(r) for r in by_keyword_table(texts, "text", rules, "v").collect()] == [(1, "abc", "new")]
    assert [tuple(r) for r in by_keyword_table(texts, "text", rules.limit(0), "v").collect()] == [(1, "abc", None)]
    assert by_keyword_table(texts.limit(0), "text", rules, "v").collect() == []


def test_pieces_meet_a_broadcast_index(spark):
    """Pieces of texts are filtered where they are made, by the index: no product but with the one row of the empty keyword, no Python."""
    texts = spark.range(50).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rules = spark.range(20).select(F.col("id").alias("rule_ord"), F.concat(F.lit("xt "), F.col("id").cast("string")).alias("keyword"), F.lit("v").alias("value"))
    plan = by_keyword_table(texts, "text", rules, "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") == 1
    assert "BroadcastHashJoin [piece" in plan and "LeftSemi, BuildRight" in plan
