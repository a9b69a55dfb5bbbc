"""Hard negatives: pruned search, edge rows and skew against plain loops, the query against its SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pumpwise.llm import hard_negatives
from pumpwise.llm.hard_negatives import SQL, Pruned, mine_hard_negatives, op12_hard_negatives


@pytest.mark.parametrize("kind", ["spread", "unit", "near", "zeros"])
def test_pruned_search_loses_no_pair(kind):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3000, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    if kind == "spread":
        rows *= rng.pareto(1.5, (3000, 1)) + 0.1
    if kind == "near":
        rows[:, 0] += 6
    if kind == "zeros":
        rows[::3] = 0
    rows = np.floor(256 * rows).astype(np.int64)
    queries = rows[::50]
    scores = queries @ rows.T
    for share in (0.999, 0.9, 0.5):
        least = np.quantile(scores, share, axis=1)
        search, found = Pruned(rows, queries), set()
        for q, r, s in search(least):
            assert (s == scores[q, r]).all()
            found |= set(zip(q.tolist(), r.tolist()))
        want = set(zip(*(x.tolist() for x in np.nonzero(scores >= least[:, None]))))
        assert found == want
    # Lengths and ranges prune: with lengths that differ, most products are never computed.
    search = Pruned(rows, queries)
    for _ in search(np.quantile(scores, 0.9995, axis=1)):
        pass
    if kind in ("spread", "near"):
        assert search.products < 0.6 * scores.size


def brute(rows):
    """rows: (id, label, vector), any of them bad; anchors have ids divisible by 10."""
    good = [
        (n, i, label, [math.floor(256 * x) for x in v]) for n, (i, label, v) in enumerate(rows)
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, label, v in good:
        if i % 10:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), j, same == label) for m, j, same, w in good if m != n]
        for s, p, _ in sorted(x for x in score if x[2])[:5]:
            band = sorted(x for x in score if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, p, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(band)]
    return sorted(out)


def test_edge_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)), rng.normal(size=6).round(3).tolist()) for i in range(300)]
    rows += [(int(i), 1, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0]) for i in range(300, 400)]  # ties: one vector a hundred times
    rows += [(410, 2, v) for v in ([0.5] * 6, [0.5] * 6)] + [(420, 7, [1.0] * 6), (430, 0, [0.0] * 6), (440, 1, [3.0, 1.0]), (450, 1, [])]
    rows += [
        (460, None, [1.0] * 6), (470, 1, None), (480, 1, [1.0, None]), (490, 1, [math.nan] * 6), (500, 1, [math.inf] * 6), (None, 1, [1.0] * 6),
        (510, 1, [-math.inf])
    ]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id bigint, label int, embedding array<float>, length string, `a.b` int")
    rows = [(i, label, v and [x if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    want = brute(rows)
    anchor = F.col("vec_id") % 10 == 0
    assert sorted(map(tuple, mine_hard_negatives(df, anchor).collect())) == want and len(want) > 500
    # Cells and blocks of a few rows give the same.
    monkeypatch.setattr(hard_negatives, "MOST_IN_CELL", 17)
    monkeypatch.setattr(hard_negatives, "LEAST_IN_CELL", 5)
    assert sorted(map(tuple, mine_hard_negatives(df, anchor).collect())) == want
    assert mine_hard_negatives(df.limit(0), anchor).count() == 0
    assert mine_hard_negatives(df.where("vec_id = 420"), anchor).count() == 0


def test_cells_are_bounded(spark, monkeypatch):
    """One label and one vector with most rows: no group of the search gets more than its share."""
    monkeypatch.setattr(hard_negatives, "MOST_IN_CELL", 64)
    monkeypatch.setattr(hard_negatives, "LEAST_IN_CELL", 64)
    sizes = spark.sparkContext.accumulator(0)
    inner = hard_negatives._negatives_in_cell

    def watched(anchors, rows):
        sizes.add(1 if rows.num_rows > 200 else 0)
        return inner(anchors, rows)

    monkeypatch.setattr(hard_negatives, "_negatives_in_cell", watched)
    df = spark.range(2000).select(
        F.col("id").alias("vec_id"), F.when(F.col("id") % 10 < 9, 1).otherwise(2).alias("label"),
        F.when(F.col("id") % 3 > 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.rand(1), F.rand(2))).alias("embedding")
    )
    assert mine_hard_negatives(df, F.col("vec_id") % 100 == 0).count() > 0 and sizes.value == 0


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    result = con.execute(SQL)
    df = op12_hard_negatives(spark, sf)
    assert [c[0] for c in result.description] == df.columns
    want = sorted(map(tuple, result.fetchall()))
    assert sorted(map(tuple, df.collect())) == want and want
