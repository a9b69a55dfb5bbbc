"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import broadcast_up_to, checkpoint, free_name, join_on_id, let, read_table, text_or_empty

#: Words in a shingle, and the least share of an item's shingles that a document must hold.
WIDTH, CONTAINMENT = 5, 0.8
#: Whatever is neither a letter, a mark nor a digit separates words.
BETWEEN_WORDS = r"[^\p{L}\p{M}\p{N}]+"
#: Most rows of a broadcast table of ids, hashes or shingles (their bytes are bounded, too); larger ones are shuffled.
MAX_BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN_WORDS), "")


def shingles_of(text: Column, width: int = WIDTH, of: str = "text", shorter: Sequence[int] = ()) -> Column:
    """Shingles of a text, lower case, as strings or as 64-bit hashes of their words; with fewer words, the one whole sequence.

    The sequences of so many words as shorter names (each below width) come besides.
    """

    def sequences(ws: Column, n: int, least: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1)))
        one = (lambda x: F.xxhash64(x)) if of == "hash" else (lambda x: F.array_join(x, " "))
        return F.when(F.size(ws) >= least, F.transform(starts, lambda i: one(F.slice(ws, i, n)))).otherwise(F.array())

    def all_shingles(ws: Column) -> Column:
        own = sequences(ws, width, 1)
        return F.concat(own, *(sequences(ws, n, n) for n in shorter)) if shorter else own

    return let(_words(text), all_shingles)


def _short_lengths(items: DataFrame) -> list[int]:
    """The word counts below WIDTH that occur among items, WIDTH - 1 at most."""
    n = items.select(F.size(_words(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < WIDTH)).distinct()
    return sorted(r["n"] for r in n.collect())


def _needed(n: Column, containment: float) -> Column:
    """The least number of shingles that makes the containment."""
    return F.ceil(F.round(F.lit(containment) * n, 9)).cast("int")


def _wanted(items: DataFrame) -> DataFrame:
    """item, shingle and h (the hash of its words) of each distinct shingle of the rows with one item id."""
    both = F.arrays_zip(shingles_of(F.col("text")).alias("shingle"), shingles_of(F.col("text"), of="hash").alias("h"))
    return items.select("item", F.explode(both).alias("x")).select("item", "x.shingle", "x.h").distinct()


def _sketches(wanted: DataFrame, containment: float) -> DataFrame:
    """Bottom-k MinHash sketches: h, one row per hash that some item must find in a document.

    Items, all rows of one item id taken together, are partitioned by size, [2^p, 2^(p+1)) distinct shingles.  A document
    that holds ceil(t*n) of n shingles misses at most n - ceil(t*n) of them, so it
    holds one of any n - ceil(t*n) + 1.  The partition's upper bound in place of n fixes k.
    """
    ranked = wanted.withColumn("n", F.expr("count(*) OVER (PARTITION BY item)"))
    ranked = ranked.withColumn("rank", F.expr("row_number() OVER (PARTITION BY item ORDER BY h, shingle)"))
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("int") - 1
    return ranked.where(F.col("rank") <= upper - _needed(upper, containment) + 1).select("h").distinct()


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    short_inside: bool = False,
) -> DataFrame:
    """Pairs (document, item) where the document holds the containment of the item's distinct shingles.

    Returns id, item id, n_shingles, n_found, containment.  Candidate documents are
    those that hold a hash of an item's sketch (see _sketches), so that no pair
    is missed, whatever the document's length; the shingles themselves then
    decide.  Signatures of whole documents in bands would miss short items in long
    documents: their Jaccard similarity is close to 0.

    An item of fewer than WIDTH words is one shingle, that matches only a document of just these words;
    with short_inside, each such length that occurs is a size partition of its own: documents give their sequences of
    that length, too, and the item is found wherever its words follow each other.  The registered query and the pipeline do so.

    Shingles of documents are never shuffled if the sketches are small; candidate
    documents are few, and only their shingles that occur in an item are counted.
    Null or wordless texts match nothing; very long texts are taken whole.  Rows with one id count as one document,
    rows with one item id as one item, whose shingles are those of all its rows; null ids are ids too.  Repeated rows change nothing.  Without
    documents or without items there are no pairs.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    items = items.select(F.col(item_id_col).alias("item"), text_or_empty(item_text_col).alias("text"))
    shorter = _short_lengths(items) if short_inside else []

    wanted = checkpoint(_wanted(items))
    sketch = broadcast_up_to(checkpoint(_sketches(wanted, containment)), MAX_BROADCAST_ROWS)
    probes = docs.select("id", F.explode(shingles_of(F.col("text"), of="hash", shorter=shorter)).alias("h"))
    candidates = checkpoint(probes.join(sketch, "h", "left_semi").select("id").distinct())
    candidates = broadcast_up_to(candidates.withColumnRenamed("id", "found"), MAX_BROADCAST_ROWS)

    wanted = wanted.select("item", "shingle")
    sizes = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"))
    held = join_on_id(docs, candidates, "id", "found", "left_semi")
    held = held.select("id", F.explode(F.array_distinct(shingles_of(F.col("text"), shorter=shorter))).alias("shingle"))
    pairs = held.join(broadcast_up_to(wanted, MAX_BROADCAST_ROWS), "shingle").groupBy("id", "item")
    pairs = pairs.agg(F.count_distinct("shingle").alias("n_found"))
    sizes = sizes.withColumnRenamed("item", "sized")
    verified = join_on_id(pairs, sizes, "item", "sized", "inner")
    return verified.where(F.col("n_found") >= _needed(F.col("n_shingles"), containment)).select(
        F.col("id").alias(id_col), F.col("item").alias(item_id_col), "n_shingles", "n_found",
        (F.col("n_found") / F.col("n_shingles")).alias("containment"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs whose id is in no pair of contained_items, short items inside documents included; all columns as they are.

    Null and wordless texts stay.  Rows with one id are one document and go together; so do those with null ids.  Repeated rows stay or go
    alike; an empty table of docs gives an empty one, one of items leaves docs as they are.
    """
    name = free_name(docs, "__found")
    found = contained_items(docs, items, containment, id_col, text_col, short_inside=True).select(F.col(id_col).alias(name)).distinct()
    return join_on_id(docs, broadcast_up_to(checkpoint(found), MAX_BROADCAST_ROWS), id_col, name, "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item it holds, items of fewer than WIDTH words inside longer documents included."""
    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), short_inside=True)


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '')"


def _sql_grams(n: str) -> str:
    """The sequences of n words of ws; with fewer words, the one whole sequence."""
    return f"list_transform(range(1, greatest(len(ws) - {n} + 1, 1) + 1), lambda i: array_to_string(ws[i:i + {n} - 1], ' '))"


SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark
), b AS (SELECT DISTINCT item_id, unnest({_sql_grams(str(WIDTH))}) AS s FROM i WHERE len(ws) > 0
), n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1
), w AS (SELECT doc_id, {_WORDS} AS ws FROM documents
), d AS (
  SELECT doc_id, unnest({_sql_grams(str(WIDTH))}) AS s FROM w WHERE len(ws) > 0
  UNION
  SELECT doc_id, unnest({_sql_grams("k")}) FROM w JOIN (SELECT DISTINCT len(ws) AS k FROM i WHERE len(ws) BETWEEN 1 AND {WIDTH - 1}) ON len(ws) >= k
), f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found >= ceil(round({CONTAINMENT} * n_shingles, 9))
"""
