"""Hard negatives by exact inner products: length buckets, and sorted coordinate lists whose feasible ranges leave few candidates."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pumpwise.llm.common import Scratch, broadcast_up_to, read_table

#: Components are multiplied by this and rounded down to whole numbers.
SCALE = 256
#: Positives of an anchor, negatives of an anchor and positive, and the band of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Lengths in one bucket differ by at most this factor.
LENGTH_RATIO = 1.05
#: Rows and anchors that meet in one group: at most this many on average; as few as LEAST_IN_CELL so that about CELLS groups share the work.
MOST_IN_CELL, LEAST_IN_CELL, CELLS = 32_768, 1024, 48
#: Rows whose coordinate lists are sorted together, anchors whose products with them are held together.
ROWS_IN_LIST, ANCHORS_AT_ONCE = 1024, 4096
#: Coordinates of an anchor, the largest ones, whose ranges are intersected; a range that leaves more than this part of the rows is not worth it.
FOCUS, WORTH = 3, 0.5
#: What float arithmetic may add to a cosine.
_SLACK = 1e-6
MAX_BROADCAST_ROWS = 200_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of whole numbers; shorter lists are filled with zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat, width = lists.flatten().to_numpy(), int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats where every partial sum fits 53 bits, else in 64-bit whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


class Pruned:
    """Rows in lists of similar length, to be searched for all pairs with an inner product that reaches the query's least score."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray) -> None:
        width = max(rows.shape[1], queries.shape[1])
        self.rows, self.queries = _padded(rows, width), _padded(queries, width)
        lengths = np.sqrt((self.rows.astype(float) ** 2).sum(1))
        self.order, self.lengths = np.argsort(-lengths, kind="stable"), lengths
        self.query_lengths = np.sqrt((self.queries.astype(float) ** 2).sum(1))
        unit = self.queries / np.maximum(self.query_lengths, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.angles = np.arccos(np.clip(np.take_along_axis(unit, self.focus, 1), -1, 1))
        #: Products computed, for tests and tuning.
        self.products = 0

    def __call__(self, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) of all pairs with score >= least[query], list by list; the consumer may raise least between lists."""
        for a in range(0, len(self.order), ROWS_IN_LIST):
            at = self.order[a : a + ROWS_IN_LIST]
            longest = self.lengths[at[0]]
            reach = self.query_lengths * longest
            # The longest row decides whether a query meets this list at all, and how near to the query's direction a row must be.
            alive = np.flatnonzero(least <= reach * (1 + _SLACK))
            cosine = np.where(least[alive] > 0, least[alive] / np.maximum(reach[alive], 1e-300), -1.0)
            for b in range(0, len(alive), ANCHORS_AT_ONCE):
                part = slice(b, b + ANCHORS_AT_ONCE)
                yield from self._of_list(at, alive[part], cosine[part], least)

    def _of_list(
        self, at: np.ndarray, who: np.ndarray, cosine: np.ndarray, least: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows = self.rows[at]
        unit = rows / np.maximum(self.lengths[at], 1e-300)[:, None]
        # A row within an angle of the query is, in each coordinate, within that angle of the query's own.
        angle = np.arccos(np.clip(cosine, -1, 1))[:, None]
        low = np.cos(np.minimum(np.pi, self.angles[who] + angle)) - _SLACK
        high = np.cos(np.maximum(0, self.angles[who] - angle)) + _SLACK
        low[cosine < 0], high[cosine < 0] = -2, 2
        first, last = np.zeros(low.shape, np.int64), np.full(low.shape, len(at))
        lists = {}
        for f in np.unique(self.focus[who][cosine >= 0]).tolist():
            lists[f] = (by := np.argsort(unit[:, f], kind="stable"))
            mine = (self.focus[who] == f) & (cosine >= 0)[:, None]
            first[mine] = np.searchsorted(unit[by, f], low[mine], "left")
            last[mine] = np.searchsorted(unit[by, f], high[mine], "right")
        left = last - first
        fewest = left.min(axis=1, initial=len(at))
        few = fewest < WORTH * len(at)
        if len(whole := who[~few]):
            self.products += len(whole) * len(at)
            scores = _products(self.queries[whole], rows)
            q, r = np.nonzero(scores >= least[whole][:, None])
            yield whole[q], at[r], scores[q, r]
        for i in np.flatnonzero(few & (fewest > 0)).tolist():
            j = int(left[i].argmin())
            near = lists[int(self.focus[who[i], j])][first[i, j] : last[i, j]]
            for k, f in enumerate(self.focus[who[i]].tolist()):
                if k != j:
                    near = near[(unit[near, f] >= low[i, k]) & (unit[near, f] <= high[i, k])]
            self.products += len(near)
            scores = _products(self.queries[who[i] : who[i] + 1], rows[near])[0]
            good = scores >= least[who[i]]
            yield np.full(int(good.sum()), who[i]), at[near[good]], scores[good]


def _first(k: int, owner: np.ndarray, score: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Positions of the k best of each owner: higher scores first, then smaller ties; by owner and rank."""
    order = np.lexsort((*ties[::-1], -score, owner))
    starts = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def best_pairs(
    search: Pruned, k: int, ids: np.ndarray, row_ids: np.ndarray, allowed, owners: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, row, score) of the k best rows of each owner with low <= score <= high.

    An owner is served by the query owners[owner], which rise; allowed(query, row) tells which pairs count.  The k-th score found so far is the least
    score of what follows, so the longer rows' results prune the shorter rows.
    """
    queries = len(search.queries)
    floor = low.astype(float).copy()
    floor[low > high] = np.inf
    per_query = np.bincount(owners, minlength=queries)
    start = np.r_[0, np.cumsum(per_query)]
    least = np.full(queries, np.inf)
    np.minimum.at(least, owners, floor)
    o, r, s = (np.zeros(0, np.int64) for _ in range(3))
    for q, row, score in search(least):
        keep = allowed(q, row)
        q, row, score = q[keep], row[keep], score[keep]
        # Each pair for each owner of its query.
        n = per_query[q]
        own = np.repeat(start[q] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(q) else np.zeros(0, np.int64)
        row, score = np.repeat(row, n), np.repeat(score, n)
        keep = (score >= floor[own]) & (score <= high[own])
        if not keep.any():
            continue
        o, r, s = np.r_[o, own[keep]], np.r_[r, row[keep]], np.r_[s, score[keep]]
        best = _first(k, o, s, ids[r], row_ids[r])
        o, r, s = o[best], r[best], s[best]
        full = np.flatnonzero(np.bincount(o, minlength=len(owners)) == k)
        ends = np.searchsorted(o, full, "right") - 1
        floor[full] = np.maximum(floor[full], s[ends])
        least[:] = np.inf
        np.minimum.at(least, owners, floor)
    return o, r, s


def _positives_in_cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of one label in one cell for each of its anchors, but the anchor itself."""
    a, ids, own = anchors["rid"].to_numpy(), rows["id"].to_numpy(), rows["rid"].to_numpy()
    n = len(a)
    o, r, s = best_pairs(
        Pruned(_matrix(rows["vec"]), _matrix(anchors["vec"])), anchors["k"][0].as_py() if n else 0, ids, own, lambda q, row: a[q] != own[row],
        np.arange(n), np.full(n, -np.inf), np.full(n, np.inf)
    )
    return pa.table({"rid": a[o], "other": own[r], "id": ids[r], "score": s})


def _negatives_in_cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of other labels in one cell within the band of each anchor and positive."""
    a, ids, own = anchors["rid"].to_numpy(), rows["id"].to_numpy(), rows["rid"].to_numpy()
    label, theirs = anchors["label"].to_numpy(), rows["label"].to_numpy()
    lists = anchors["positives"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    owners = np.repeat(np.arange(len(a)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    place, low, high = (flat.field(x).to_numpy() for x in ("place", "low", "high"))
    o, r, s = best_pairs(
        Pruned(_matrix(rows["vec"]), _matrix(anchors["vec"])), anchors["k"][0].as_py() if len(a) else 0, ids, own,
        lambda q, row: label[q] != theirs[row], owners, low, high
    )
    return pa.table({"rid": a[owners[o]], "place": place[o], "other": own[r], "id": ids[r], "score": s})


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key over all cells; each task drops what cannot be among them before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "other")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _spread(n: int) -> int:
    """Rows in one cell of n."""
    return min(MOST_IN_CELL, max(LEAST_IN_CELL, math.ceil(n / CELLS)))


def _salt(of: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("cell"), of), n).cast("int")


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE
) -> DataFrame:
    """For each anchor and each of its positives the negatives by rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A vector's components are multiplied by scale and rounded down; scores are whole inner products and must fit 64 bits.  An
    anchor's positives are its best other rows of the same label, its negatives the best rows of other labels whose score is from low to high
    hundredths of the positive's; ties go to the smaller id.  is_anchor is a condition on the columns of vectors.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; of vectors of different widths the shorter ones
    count as filled with zeros.  Rows that repeat an id are rows of their own, also as anchors.  Anchors without another row of their label, and
    positives without a row in the band, give no rows; an empty table gives none.  Other columns are ignored.

    Rows are grouped by length into buckets of at most a factor of 1.05 and these into cells of bounded size, so that neither one length nor one label fills a
    task; anchors go in blocks to the cells of their label for the positives, and for the negatives to those whose lengths can
    reach the band.  In a cell, sorted coordinate lists and the anchor's feasible ranges in its largest coordinates
    leave the candidates, whose products are exact.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("length", F.sqrt(square)).withColumn(
        # A row of length 0 is in a bucket below all others.
        "bucket", F.when(F.col("length") > 0, F.floor(F.log("length") / math.log(LENGTH_RATIO))).otherwise(-1_000_000).cast("int")
    )
    # Written once: row numbers stay the same in all that follows, whatever executor is lost.
    rows = scratch.write(rows)
    counts = rows.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_anchor").alias("n_anchors"))
    counts = scratch.write(counts)
    of_bucket = counts.groupBy("bucket").agg(F.sum("n_rows").alias("n")).collect()  # of at most as many rows as doubles have lengths: 15 000
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum("n_anchors"), F.lit(0))).first()
    in_cell, in_block = _spread(total[0]), _spread(total[1])

    # Positives: the cells of a label are its buckets, split by row number.
    anchors_of = counts.groupBy("label").agg(F.ceil(F.sum("n_anchors") / in_block).cast("int").alias("n_blocks")).where("n_blocks > 0")
    cells = scratch.write(counts.join(anchors_of, "label").select("label", "bucket", F.ceil(F.col("n_rows") / in_cell).cast("int").alias("n_subs"), "n_blocks"))
    cells = broadcast_up_to(cells, MAX_BROADCAST_ROWS)
    anchors = scratch.write(rows.where("is_anchor"))
    key = ["label", "bucket", "sub", "block"]
    there = rows.join(cells, ["label", "bucket"]).select(
        "rid", "id", "vec", "label", "bucket", _salt("rid", F.col("n_subs")).alias("sub"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block")
    )
    here = anchors.drop("bucket").join(cells, "label").select(
        "rid", "vec", "label", "bucket", F.explode(F.sequence(F.lit(0), F.col("n_subs") - 1)).alias("sub"), _salt("rid", F.col("n_blocks")).alias("block"),
        F.lit(positives).alias("k")
    )
    found = here.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(_positives_in_cell, "rid long, other long, id long, score long")
    found = scratch.write(_ranked(found, ["rid"], positives))

    # Negatives: all labels of a bucket together, as far as the bucket's greatest length can reach the lowest band.
    score = F.col("score")
    band = F.struct(
        "place", F.col("id").alias("positive"), "score",
        # Rounded up and down by whole-number division, which rounds towards zero.
        F.expr(f"{low} * score div 100 + CASE WHEN {low} * score % 100 > 0 THEN 1 ELSE 0 END").alias("low"),
        F.expr(f"{high} * score div 100 - CASE WHEN {high} * score % 100 < 0 THEN 1 ELSE 0 END").alias("high"),
    )
    bands = found.groupBy("rid").agg(F.sort_array(F.collect_list(band)).alias("positives")).withColumn("lowest", F.array_min("positives.low"))
    anchors = scratch.write(anchors.select("rid", F.col("id").alias("anchor"), "label", "vec", "length").join(bands, "rid"))
    buckets = json.dumps([{"bucket": b, "n_subs": math.ceil(n / in_cell), "longest": LENGTH_RATIO ** (b + 1) if b > -1_000_000 else 0.0} for b, n in of_bucket])
    n_blocks = max(1, math.ceil(total[1] / in_block))
    reached = F.explode(F.from_json(F.lit(buckets), "array<struct<bucket: int, n_subs: int, longest: double>>"))
    here = anchors.select("rid", "label", "vec", "positives", "length", "lowest", reached.alias("b")).where(
        F.col("lowest") <= F.col("length") * F.col("b.longest") * (1 + _SLACK)
    ).select(
        "rid", "label", "vec", "positives", "b.bucket", F.explode(F.sequence(F.lit(0), F.col("b.n_subs") - 1)).alias("sub"),
        _salt("rid", F.lit(n_blocks)).alias("block"), F.lit(negatives).alias("k")
    )
    subs = F.from_json(F.lit(json.dumps({str(b): math.ceil(n / in_cell) for b, n in of_bucket})), "map<string, int>")
    there = rows.select(
        "rid", "id", "label", "vec", "bucket", _salt("rid", F.element_at(subs, F.col("bucket").cast("string"))).alias("sub"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    )
    key = ["bucket", "sub", "block"]
    found = here.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(_negatives_in_cell, "rid long, place int, other long, id long, score long")
    found = _ranked(found.withColumnRenamed("place", "positive_place"), ["rid", "positive_place"], negatives)
    named = anchors.select("rid", "anchor", F.explode("positives").alias("p")).select("rid", "anchor", F.col("p.place").alias("positive_place"), "p.positive", F.col("p.score").alias("positive_score"))
    return found.join(named, ["rid", "positive_place"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("place").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", score.alias("negative_score")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; rows whose id is divisible by 7 have the next label, modulo 10."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)])::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score
    FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS "rank",
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""
