"""Groups of linked rows: connected components of links, and one row of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwise.llm.common import Scratch, column, free_name, text_or_empty


def connected_components(links: DataFrame, owner: Scratch | None = None) -> DataFrame:
    """node, root of every node in links (a, b): the least node reachable.  Alternating large-star and small-star steps.

    Each step sends a node's neighbours to the least of them by joins and minima, so no neighbour list is gathered;
    steps end when the links no longer change.  Links of a node to itself are ignored; no links give no rows.  The table that the result
    reads is handed to owner, to be dropped with its own.
    After a few steps all of a component hang on its root.  Minima are written out before they are joined, so that both sides of
    a join are shuffled for it and Spark may split the root's rows over many tasks; under an aggregate it could not.
    """
    scratch = Scratch(links.sparkSession)
    links = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large)
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        hooked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = scratch.write(hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop_all_but_last()
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            if owner:
                owner.paths += scratch.paths
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now


def rooted(rows: DataFrame, distinct: DataFrame, roots: DataFrame, node: str, scratch: Scratch | None = None) -> DataFrame:
    """The rows with root (a node that names the component) and component_id (the least id in it).

    rows have a column node; distinct has each node once and least (its least id); roots are those of connected_components.
    Labels and least ids are written out, so that the rows of a large component, or of one node, may be split in the joins.
    """
    roots = roots.select(F.col("node").alias("__node"), "root")
    labelled = distinct.join(roots, F.col(node) == F.col("__node"), "left").select(node, "least", F.coalesce("root", node).alias("root"))
    scratch = scratch or Scratch(rows.sparkSession)
    least = scratch.write(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows.join(scratch.write(labelled.join(least, "root").select(node, "root", "component_id")), node)


#: What to_json needs to write every value in full.
_LOSSLESS = {
    "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def row_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits that tell apart rows of docs that differ in any column; moments differ by the microsecond."""
    others = [column(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in (id_col, text_col)]
    rest = F.md5(F.to_json(F.struct(*others), _LOSSLESS)) if others else F.lit("")
    id_, text = column(id_col), column(text_col)
    own = F.concat(id_.isNull().cast("string"), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"))
    return F.unhex(F.md5(F.concat(own, F.md5(text_or_empty(text_col)), F.lit(":"), text.isNull().cast("string"), F.lit(":"), rest)))


def one_of_each(docs: DataFrame, grouped: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their component, all columns as they are: of the rows with its least id, that of the least digest.

    grouped has id, digest (see row_digest), root and component_id of each row.  Of rows equal in all columns one is left.
    The tables in scratch, which grouped is made from, are dropped.
    """
    own = grouped.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "digest").agg(F.count(F.lit(1)).alias("n"))
    kept = scratch.write(own.groupBy("root").agg(F.min(F.struct("digest", "n")).alias("x")).select("x.digest", "x.n"))
    scratch.drop_all_but_last()
    name, wanted = free_name(docs, "__digest"), free_name(docs, "__digest_kept")
    keyed = docs.withColumn(name, row_digest(docs, id_col, text_col))

    def among(some: DataFrame) -> DataFrame:
        some = some.select(F.col("digest").alias(wanted))
        return keyed.join(some, F.col(name) == F.col(wanted), "left_semi")

    out = among(kept.where("n = 1"))
    if not (repeated := kept.where("n > 1")).isEmpty():
        out = out.unionByName(among(repeated).dropDuplicates([name]))
    return out.drop(name)
