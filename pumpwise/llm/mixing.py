"""Mixing sources to target weights: token budgets down a domain-language-source tree, seeded prefixes of the leaves."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import broadcast_up_to, checkpoint, free_name, read_table, text_or_empty, words_of

LEVELS = ("domain", "lang", "source")
#: Leaves up to this number are broadcast to the documents; a larger tree is joined by shuffle.
MAX_BROADCAST_LEAVES = 100_000
#: Hex digits of a document's key that name its bucket in the leaf's order: the bucket in which a budget ends is divided again.
BUCKET_DIGITS = (2, 4, 6)
#: Parameters of the registered query.
WEIGHTS = {"domain": {"dom0": 4, "dom1": 3, "dom2": 2, "dom3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
SHARE, MAX_EPOCHS, SEED = 0.6, 2, 42


def source_domain(source: str = "source") -> Column:
    """The domain of a source in the synthetic tables: five numbered sources to a domain."""
    return F.concat(F.lit("dom"), F.floor(F.regexp_extract(F.col(source), "([0-9]+)$", 1).try_cast("int") / 5).cast("string"))


def _leaf(level: str, domain: Column) -> Column:
    return F.coalesce((domain if level == "domain" else F.col(level)).cast("string"), F.lit("unknown"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """The weight of a child by its name; 1 where none is given."""
    given = [x for k, v in weights.get(level, {}).items() for x in (F.lit(k), F.lit(int(v)).cast("long"))]
    one = F.lit(1).cast("long")
    return F.coalesce(F.try_element_at(F.create_map(*given), F.col(level)), one) if given else one


def _fill(children: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Share each parent's budget among its children by weight, none beyond its cap; what one cannot take goes to the others.

    children: the parents' names, level, cap, w and budget (of the parent).  Adds
    alloc; all are whole numbers, and the allocs of a parent add up to
    min(budget, the sum of caps).
    """
    by = f"PARTITION BY {', '.join(parents) or '0'}"
    order = f"{by} ORDER BY cap / w, {level}"
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    left = children.where("w > 0")
    left = left.withColumn("money", F.expr(f"budget - coalesce(sum(cap) OVER ({order} {earlier}), 0L)"))
    left = left.withColumn("weights", F.expr(f"sum(w) OVER ({by}) - coalesce(sum(w) OVER ({order} {earlier}), 0L)"))
    # A child is full if an even split of what is left by weight would give it its cap or more; the full ones come first.
    left = left.withColumn("full", F.expr("cast(cap as decimal(38,0)) * weights <= cast(w as decimal(38,0)) * money"))
    first = f"first_value(CASE WHEN NOT full THEN struct(money, weights) END, true) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    left = left.withColumn("rest", F.expr(first))
    floor = "cast(cast(w as decimal(38,0)) * rest.money div rest.weights as bigint)"
    left = left.withColumn("alloc", F.expr(f"CASE WHEN full THEN cap ELSE {floor} END"))
    # Whole tokens lost by rounding down go to the first of those that are not full.
    lost = left.withColumn("lost", F.expr(f"rest.money - sum(CASE WHEN full THEN 0L ELSE alloc END) OVER ({by})"))
    turn = F.expr(f"sum(CASE WHEN full THEN 0 ELSE 1 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    lost = lost.withColumn("alloc", F.col("alloc") + F.when(~F.col("full") & (turn <= F.col("lost")), 1).otherwise(0))
    return lost.drop("money", "weights", "full", "rest", "lost")


def leaf_budgets(leaves: DataFrame, budget: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """Token budgets of the leaves.  leaves: domain, lang, source, tokens (of one epoch); adds alloc.

    The budget runs from the root to the leaves.  A node can take max_epochs times
    its tokens; since a parent never gets more than its children can take together,
    what a leaf lacks goes to its siblings first and only then, through the parent's
    own limit, to the parent's siblings.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    out, parents = None, []
    for level in LEVELS:
        below = leaves.groupBy(*parents, level).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        below = below.withColumn("budget", F.lit(budget).cast("long")) if out is None else below.join(out, parents)
        parents = [*parents, level]
        out = _fill(below, parents[:-1], level).select(*parents, F.col("alloc").alias("budget"))
    return leaves.join(out.withColumnRenamed("budget", "alloc"), list(LEVELS)).drop("cap")


def _key(epoch: Column, id_col: Column, seed: int) -> Column:
    """The place of a document in the seeded order of an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id_col.cast("string"), F.lit(""))))


def mixing_plan(
    docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int, seed: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per leaf: domain, lang, source, tokens, alloc, epochs (full ones), upto.

    In the epoch after the full ones, the leaf's documents with a key of at most
    upto are taken (none if it is null): the shortest prefix of the seeded order that
    reaches the budget.  Documents are summed by the first digits of their keys, then those of the bucket in which the budget ends by more
    digits, and only what is left of it then, one document in 16 million, is sorted: no task gets more than 256 sums of a leaf.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), *(_leaf(x, domain).alias(x) for x in LEVELS),
        F.size(words_of(text_or_empty(text_col))).cast("long").alias("n_tokens"),
    )
    rows = checkpoint(rows)
    keys = list(LEVELS)
    leaves = checkpoint(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")))
    budget = math.floor(share * (leaves.agg(F.sum("tokens")).first()[0] or 0))
    plan = leaf_budgets(leaves, budget, weights, max_epochs)
    plan = plan.withColumn("epochs", F.expr("CASE WHEN tokens > 0 THEN alloc div tokens ELSE 0L END"))
    plan = checkpoint(plan.withColumn("part", F.col("alloc") - F.col("epochs") * F.col("tokens")))

    open_leaves = broadcast_up_to(plan.where("part > 0").select(*keys, "epochs", "part"), MAX_BROADCAST_LEAVES)
    keyed = rows.join(open_leaves, keys).withColumn("key", _key(F.col("epochs"), F.col("id"), seed))
    leaf = f"PARTITION BY {', '.join(keys)}"
    edge = plan.where("part > 0").select(*keys, F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))

    def within(edge: DataFrame, digits: int) -> DataFrame:
        """The documents of each leaf's bucket, whose keys begin with prefix."""
        edge = broadcast_up_to(edge.withColumnRenamed("prefix", "head"), MAX_BROADCAST_LEAVES)
        return keyed.withColumn("head", F.substring("key", 1, digits)).join(edge, [*keys, "head"])

    above = 0
    for digits in BUCKET_DIGITS:
        sums = within(edge, above).groupBy(*keys, "part", "before", F.substring("key", 1, digits).alias("prefix")).agg(F.sum("n_tokens").alias("n"))
        sums = sums.withColumn("upto", F.expr(f"before + sum(n) OVER ({leaf} ORDER BY prefix)")).withColumn("start", F.expr("upto - n"))
        edge = checkpoint(sums.where("start < part AND part <= upto").select(*keys, "prefix", F.col("start").alias("before")))
        above = digits
    last = within(edge, above).groupBy(*keys, "part", "before", "key").agg(F.sum("n_tokens").alias("n"))
    last = last.withColumn("start", F.expr(f"before + sum(n) OVER ({leaf} ORDER BY key) - n"))
    ends = last.where("start < part").groupBy(*keys).agg(F.max("key").alias("upto"))
    return checkpoint(plan.drop("part").join(ends, keys, "left"))


def mix_sources(
    docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int, seed: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """docs with a column times: how often the mix takes each row; rows that it does not take are left out.

    The budget is the share of all tokens (words between white space), divided by
    leaf_budgets.  A leaf is taken whole for as many epochs as fit its budget, then as
    a prefix of the next epoch's order, which depends on seed, epoch and id only.  The
    last document of a prefix is taken whole, so that a leaf exceeds its budget by less than
    a document.  Rows with one id share a place and are taken together.  Null
    domain, lang or source is the child 'unknown'; a null id orders as ''; null texts have no tokens.  A
    leaf without tokens is not taken.  An empty table gives no rows.  All columns of docs stay, but for one named times, which is replaced.
    """
    plan = mixing_plan(docs, domain, weights, share, max_epochs, seed, id_col, text_col)
    leaf = {x: free_name(docs, f"__mix_{x}") for x in (*LEVELS, "epochs", "upto", "times")}
    times = leaf.pop("times")
    plan = broadcast_up_to(plan.where("alloc > 0").select(*(F.col(k).alias(v) for k, v in leaf.items())), MAX_BROADCAST_LEAVES)
    same = [_leaf(x, domain) == F.col(leaf[x]) for x in LEVELS]
    part = F.coalesce(_key(F.col(leaf["epochs"]), F.col(id_col), seed) <= F.col(leaf["upto"]), F.lit(False))
    joined = docs.join(plan, same[0] & same[1] & same[2]).withColumn(times, F.col(leaf["epochs"]) + part.cast("long"))
    taken = joined.where(F.col(times) > 0).drop(*leaf.values())
    return taken.drop("times").withColumnRenamed(times, "times")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, one row for each epoch that takes a document."""
    docs = read_table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, source_domain(), WEIGHTS, SHARE, MAX_EPOCHS, SEED)
    rows = mixed.select(
        "doc_id", *(_leaf(x, source_domain()).alias(x) for x in LEVELS), F.size(words_of(text_or_empty())).alias("n_tokens"), "times"
    )
    return rows.select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"))


def _sql_fill(name: str, source: str, parents: list[str], level: str) -> str:
    """The CTEs of one level of the tree."""
    p = ", ".join(parents)
    by = f"PARTITION BY {p}" if p else ""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    w = f"CASE {level} {cases} ELSE 1 END" if cases else "1"
    budget = source if not p else "min(u.budget)"
    join = f"JOIN {source} u USING ({p})" if p else ""
    cols = f"{p}, {level}" if p else level
    return f"""
{name}_a AS (SELECT {cols}, CAST(sum(cap) AS HUGEINT) AS cap, CAST({w} AS HUGEINT) AS w, CAST({budget} AS HUGEINT) AS budget FROM leaf {join} GROUP BY {cols}),
{name}_b AS (SELECT *, budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS money,
  sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM {name}_a),
{name}_c AS (SELECT *, cap * ws <= w * money AS full_, row_number() OVER ({by} ORDER BY cap / w, {level}) AS rn FROM {name}_b),
{name}_d AS (SELECT *, min(CASE WHEN NOT full_ THEN rn END) OVER ({by}) AS r0 FROM {name}_c),
{name}_e AS (SELECT *, max(CASE WHEN rn = r0 THEN money END) OVER ({by}) AS m0, max(CASE WHEN rn = r0 THEN ws END) OVER ({by}) AS w0 FROM {name}_d),
{name}_f AS (SELECT *, CASE WHEN full_ THEN cap ELSE w * m0 // w0 END AS part FROM {name}_e),
{name}_g AS (SELECT *, m0 - sum(CASE WHEN full_ THEN 0 ELSE part END) OVER ({by}) AS lost FROM {name}_f),
{name} AS (SELECT {cols}, CAST(part + CASE WHEN NOT full_ AND rn - r0 < lost THEN 1 ELSE 0 END AS HUGEINT) AS budget FROM {name}_g),"""


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('dom' || CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER) // 5 AS VARCHAR), 'unknown') AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS INTEGER) AS n_tokens
  FROM documents
),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
{_sql_fill("l1", f"(SELECT floor({SHARE}::DOUBLE * sum(tokens)) FROM leaf)", [], "domain")}
{_sql_fill("l2", "l1", ["domain"], "lang")}
{_sql_fill("l3", "l2", ["domain", "lang"], "source")}
plan AS (SELECT domain, lang, source, tokens, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM leaf JOIN l3 USING (domain, lang, source)),
k AS (SELECT d.*, p.epochs, p.budget - p.epochs * p.tokens AS part,
             md5('{SEED}:' || CAST(p.epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS key
      FROM d JOIN plan p USING (domain, lang, source) WHERE p.budget > 0),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) - n_tokens AS start FROM k),
t AS (SELECT *, epochs + CASE WHEN start < part THEN 1 ELSE 0 END AS times FROM s)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(CAST(times AS BIGINT))) AS BIGINT) AS epoch FROM t
"""
