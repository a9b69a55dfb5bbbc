"""Sharding by extendible hashing: only buckets over the byte limit split on one more hash bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import checkpoint, read_table, text_or_empty

#: Bits of the hash that can address a bucket.
HASH_BITS = 60
#: The directory is first built this many bits deeper than evenly filled shards would need.
SPARE_BITS = 6
#: Depths of the directory that are sized in one shuffle.
LEVELS = 4
#: Bytes of text in a shard of the registered query.
SHARD_BYTES = 1 << 20


def _prefix(addr: Column, bits: Column | int) -> Column:
    """The first bits of a HASH_BITS-bit address."""
    return F.call_function("shiftright", addr, (F.lit(HASH_BITS) - bits).cast("int"))


def _name(node: Column, depth: Column) -> Column:
    return F.concat(F.lit("b"), F.when(depth > 0, F.lpad(F.bin(node), depth, "0")).otherwise(""))


def _directory(cells: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The bucket of each cell, at the least depth from low to high at which it fits, and the cells that no bucket fits.

    cells: cell (its high bits), bytes, docs; no cell twice.  The directory: cell, shard, depth, shard_bytes, shard_docs.  Only the
    buckets of cells that exist are looked at, LEVELS depths at a time from the deepest up: a shuffle brings the at most 2^(LEVELS-1)
    buckets below one bucket together, whose sizes at each depth are sums over them, and the sums go on to the next depths, which have
    2^LEVELS times fewer.  Then the buckets found above are handed down the same way.
    """
    base, blocks, bottom = cells, [], high
    while bottom >= low:
        top = max(low, bottom - LEVELS + 1)
        at = {d: f"n{d}" for d in range(top, bottom + 1)}
        shift = (lambda c, n: F.call_function("shiftright", F.col(c), F.lit(n)))
        sized = base.select("cell", "bytes", "docs", *(shift("cell", bottom - d).alias(n) for d, n in at.items()))
        found = F.lit(None)
        for d in range(bottom, top - 1, -1):
            over = f"OVER (PARTITION BY {', '.join(at[k] for k in range(top, d + 1))})"
            sized = sized.withColumn(f"s{d}", F.expr(f"struct({d} AS depth, {at[d]} AS node, sum(bytes) {over} AS bytes, sum(docs) {over} AS docs)"))
            size = F.col(f"s{d}")
            found = F.when((size["bytes"] <= limit) | (size["docs"] == 1), size).otherwise(found)
        blocks.append((checkpoint(sized.select("cell", found.alias("own"))), bottom, top))
        if top > low:
            base = checkpoint(base.groupBy(shift("cell", bottom - top + 1).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")))
        bottom = top - 1
    given = None
    for block, bottom, top in reversed(blocks):
        if given is not None:
            above = given.select(F.col("cell").alias("up"), F.col("own").alias("above"))
            block = block.withColumn("up", F.call_function("shiftright", F.col("cell"), F.lit(bottom - top + 1))).join(above, "up")
            block = block.select("cell", F.coalesce("above", "own").alias("own"))
        given = block
    given = checkpoint(given)
    named = given.where(F.col("own").isNotNull()).select(
        "cell", _name(F.col("own.node"), F.col("own.depth")).alias("shard"), "own.depth",
        F.col("own.bytes").alias("shard_bytes"), F.col("own.docs").alias("shard_docs"),
    )
    return named, given.where(F.col("own").isNull()).select("cell")


def extendible_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, shard, depth, n_bytes, shard_bytes, shard_docs.

    A document's address is 60 bits of the MD5 of its id and text.  shard is 'b'
    and the first depth bits of the address; depth is the smallest at which
    the bucket's texts (UTF-8) fit limit_bytes.  A document larger than the limit
    has a shard to itself.  Rows that share all 60 bits (repeated rows) cannot be told
    apart by hash; if they outgrow a shard they are dealt by number to shards
    'b<bits>-0', 'b<bits>-1', ..., each within the limit.

    Bytes are summed per hash cell before anything is shuffled, the buckets of all
    depths are sized from those sums (the directory has an entry per cell that exists, none per address), and documents join their cell's
    bucket on a uniform hash, so no key is hot.  Null texts count as empty, null ids as ''; very long texts count with all their bytes.  An
    empty table gives no rows.  Other columns are ignored.
    """
    text = text_or_empty(text_col)
    label = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.conv(F.substring(F.md5(label), 1, HASH_BITS // 4), 16, 10).cast("long").alias("addr"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total) / limit_bytes))) + SPARE_BITS)
    rows = rows.withColumn("cell", _prefix(F.col("addr"), bits))
    cells = checkpoint(rows.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")))
    directory, deep = _directory(cells, 0, bits, limit_bytes)
    placed = rows.join(directory, "cell").select("id", "shard", "depth", "n_bytes", "shard_bytes", "shard_docs")
    if not deep.isEmpty():
        placed = placed.unionByName(_deep_shards(rows.join(deep, "cell", "left_semi"), bits, limit_bytes))
    return placed.withColumnRenamed("id", id_col)


def _deep_shards(rows: DataFrame, bits: int, limit: int) -> DataFrame:
    """Shards for the few cells that are still too large after the first bits."""
    rows = checkpoint(rows.select("id", "addr", "n_bytes"))
    cells = rows.groupBy(F.col("addr").alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    directory, same = _directory(checkpoint(cells), min(bits + 1, HASH_BITS), HASH_BITS, limit)
    placed = rows.join(directory.withColumnRenamed("cell", "addr"), "addr").select("id", "shard", "depth", "n_bytes", "shard_bytes", "shard_docs")
    if same.isEmpty():
        return placed
    same = same.withColumnRenamed("cell", "addr")
    # Number the rows of an address without gathering them: by task, then within the task.
    same = checkpoint(rows.join(same, "addr").withColumn("row", F.monotonically_increasing_id()))
    same = same.withColumn("task", F.call_function("shiftright", F.col("row"), F.lit(33)))
    before = "sum(n) OVER (PARTITION BY addr ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    tasks = same.groupBy("addr", "task").agg(F.count(F.lit(1)).alias("n"))
    tasks = tasks.withColumn("before", F.coalesce(F.expr(before), F.lit(0)))
    most = same.groupBy("addr").agg(F.max("n_bytes").alias("most"))
    numbered = same.join(tasks, ["addr", "task"]).join(most, "addr")
    number = F.col("before") + F.expr("row_number() OVER (PARTITION BY addr, task ORDER BY row)") - 1
    per_shard = F.greatest(F.lit(1).cast("long"), F.expr(f"{limit}L div greatest(most, 1L)"))
    numbered = numbered.withColumn("page", F.floor(number / per_shard))
    sizes = numbered.groupBy("addr", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    name = F.concat(_name(F.col("addr"), F.lit(HASH_BITS)), F.lit("-"), F.col("page").cast("string"))
    overflow = numbered.join(sizes, ["addr", "page"])
    return placed.unionByName(
        overflow.select("id", name.alias("shard"), F.lit(HASH_BITS).alias("depth"), "n_bytes", "shard_bytes", "shard_docs")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, shards holding SHARD_BYTES of text at most."""
    return extendible_shards(read_table(spark, sf_dir, "documents"), SHARD_BYTES)


SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS addr
  FROM documents
), nodes AS (
  SELECT k.depth, addr >> ({HASH_BITS} - k.depth) AS node, CAST(sum(n_bytes) AS BIGINT) AS bytes, count(*) AS docs
  FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, {HASH_BITS + 1})) k GROUP BY ALL
), placed AS (
  SELECT d.doc_id, d.n_bytes, d.addr, min(n.depth) AS depth
  FROM d JOIN nodes n ON d.addr >> ({HASH_BITS} - n.depth) = n.node
  WHERE n.bytes <= {SHARD_BYTES} OR n.docs = 1 GROUP BY ALL
)
SELECT doc_id, 'b' || CASE WHEN placed.depth > 0 THEN lpad(bin(node), placed.depth, '0') ELSE '' END AS shard,
       placed.depth AS depth, n_bytes, bytes AS shard_bytes, docs AS shard_docs
FROM placed JOIN nodes ON nodes.depth = placed.depth AND nodes.node = placed.addr >> ({HASH_BITS} - placed.depth)
"""
