"""SimHash near-deduplication: fingerprints and a binary-trie self-join within a Hamming budget; components are those of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import ascii_lower, by_characters, checkpoint, read_table, text_or_empty
from pumpwise.llm.components import connected_components, rooted

#: Most differing bits of linked fingerprints; words of a shingle and seed of its hash in the registered query.
BUDGET = 3
WIDTH, SEED = 3, 42
#: Fixed by the 64-bit fingerprint: a trie is walked to these depths; up to half, half the budget (rounded down) may be spent.
DEPTHS = (8, 16, 24, 32, 48, 64)
_HALF = 32
#: Shingle hashes whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of a text that is lower-cased already; 0 without words.  A bit is 1 if over half the shingles' XXH64 have it."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts[: max(1, len(words) - width + 1)].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    hashes = np.array([hashed(line[a:b], seed) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed 64-bit number) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(text_or_empty(text_col)).alias("text"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_characters(batch):
                fps = np.array([fingerprint(t, width, seed) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(of_batches, f"id {kind}, fp bigint")


def _nodes(keys: DataFrame, above: int, depth: int) -> DataFrame:
    """The trie's nodes at a depth: up (their ancestor at the depth above), node, many (more than one key below)."""
    cut = (lambda d: F.shiftrightunsigned("key", 64 - d) if d else F.lit(0).cast("long"))
    return keys.groupBy(cut(above).alias("up"), cut(depth).alias("node")).agg((F.count(F.lit(1)) > 1).alias("many"))


def _masks(bits: int, most: int) -> list[list[int]]:
    """masks[e]: the bit patterns of that many bits with at most most - e ones."""
    return [[m for m in range(1 << bits) if m.bit_count() <= most - e] for e in range(most + 1)]


def _descend_dense(pairs: DataFrame | None, children: DataFrame, bits: int, most: int) -> DataFrame:
    """One step down where nearly all nodes exist: flip the bits that the budget still allows, keep the nodes that exist.

    pairs is None at the root, which is paired with itself.
    """
    low = (1 << bits) - 1
    masks = F.lit(None).cast("array<bigint>")
    for e, some in enumerate(_masks(bits, most)):
        masks = F.when(F.col("err") == e, F.array(*(F.lit(m).cast("long") for m in some))).otherwise(masks)
    own = children.select(F.col("up").alias("a"), F.col("node").alias("x"), "many")
    left = own.withColumns({"b": F.col("a"), "err": F.lit(0)}) if pairs is None else pairs.join(own, "a")
    left = left.select("a", "b", "x", "many", "err", F.explode(masks).alias("mask"))
    y = F.shiftleft("b", bits).bitwiseOR(F.col("x").bitwiseAND(F.lit(low)).bitwiseXOR(F.col("mask")))
    left = left.select(
        "x", y.alias("y"), "many", (F.col("err") + F.bit_count("mask")).alias("err"), (F.col("a") == F.col("b")).alias("same")
    )
    # Of the children of one node, each pair once; a child with itself only while it has two keys.
    left = left.where(~F.col("same") | (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & F.col("many")))
    return left.join(
        children.select(F.col("node").alias("y")), "y", "left_semi"
    ).select(F.col("x").alias("a"), F.col("y").alias("b"), "err")


def _descend_sparse(pairs: DataFrame, children: DataFrame, most: int) -> DataFrame:
    """One step down where few nodes are left: both sides' children, differing bits added up, those over the budget pruned."""
    left = children.select(F.col("up").alias("a"), F.col("node").alias("x"), "many")
    right = children.select(F.col("up").alias("b"), F.col("node").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & F.col("many")))
    # Bits above the children's depth were counted on the way, so all differing bits are those of x XOR y.
    both = both.withColumn("err", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))))
    return both.where(F.col("err") <= most).select(F.col("x").alias("a"), F.col("y").alias("b"), "err")


def close_pairs(keys: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Pairs (a < b as stored numbers) of distinct 64-bit keys that differ in at most budget bits, by a binary-trie self-join.

    keys has one column key without repeats.  Pairs of trie nodes are walked down
    together from the root; a pair whose paths differ in more bits than allowed is
    dropped, so is a node paired with itself once a single key is below it.
    Of two keys within the budget, one half differs in at most budget // 2 bits,
    so the walk is made twice, from either half, with that smaller budget in the first 32 levels: the number of
    node pairs stays near the number of keys.  A level is two equi-joins on node numbers; a
    node has at most 2^8 (2^16 below level 32) children, so no key of a join is unbounded.  Node pairs stay near the number of keys up to
    about 10^8 keys; beyond that nearly all 2^32 nodes of level 32 exist, and each half walks some 33 pairs for every node.
    """
    found = None
    for turn in (0, _HALF):
        turned = F.col("key") if not turn else F.shiftleft("key", turn).bitwiseOR(F.shiftrightunsigned("key", 64 - turn))
        trie = keys.select(turned.alias("key"))
        pairs, above = None, 0
        for depth in DEPTHS:
            children = _nodes(trie, above, depth)
            if depth <= _HALF:
                pairs = _descend_dense(pairs, children, depth - above, budget // 2)
            else:
                pairs = _descend_sparse(pairs, children, budget)
            if depth == _HALF:
                pairs = checkpoint(pairs)
            above = depth
        back = (lambda c: c if not turn else F.shiftleft(c, turn).bitwiseOR(F.shiftrightunsigned(c, 64 - turn)))
        a, b = back(F.col("a")), back(F.col("b"))
        pairs = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def near_duplicates(
    docs: DataFrame, budget: int = BUDGET, width: int = WIDTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the least id reachable over links).

    Texts are lower-cased in A-Z and cut at white space; rows link if their fingerprints differ in at most budget bits.
    Equal fingerprints are joined once, through one representative, so a group of
    copies costs no pairs.  A null text counts as empty; texts without words
    have fingerprint zero and link like others; very long texts are taken whole, bits being counted in slices.  Repeated rows give repeated
    results.  Null ids are no component_id unless a component has no other.  An empty table gives no rows; other columns are ignored.
    """
    rows = checkpoint(fingerprints(docs, width, seed, id_col, text_col))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(close_pairs(distinct.select(F.col("fp").alias("key")), budget))
    grouped = rooted(rows, distinct, roots, "fp")
    return grouped.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document: 3-word shingles, links at 3 or fewer differing bits."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
