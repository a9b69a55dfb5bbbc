"""Near-deduplication by Jaccard similarity: SimHash fingerprints joined by binary tries within a Hamming budget, then exact similarity of sets.

Several tries hold the same sets: trie t has t's own bits of the fingerprint on its first levels and the common bits below.  All are
walked together.  On the first levels the paths of a pair must be equal (an error there is left to the other tries), below them they may
differ in as many bits as the budget says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwise.llm.common import Scratch, ascii_lower, broadcast_up_to, by_characters, text_or_empty
from pumpwise.llm.components import connected_components, one_of_each, rooted, row_digest

#: Words of a shingle, least Jaccard similarity of linked texts, seed of all hashes.
WIDTH, SIMILARITY, SEED = 5, 0.8, 42
#: Words of 64 bits below the first levels of all tries.
WORDS = 3
#: How far the share of differing bits at a similarity may lie above that of its angle (sets of few shingles; measured), standard
#: deviations of that share that the budget allows, chance that a pair just at the similarity shares no node.
EXCESS, SPREAD, MISSED = 1.09, 5.5, 0.00003
#: Tries that are walked in one round, whose tables are dropped before the next.
TRIES_IN_ROUND = 24
#: Pairs whose sets are compared in one group, on average; sets whose fingerprints are compared with as many others in one group.  A
#: fingerprint is short, so many are compared in one group: fewer levels of equal paths, hence fewer tries, hence fewer rows to shuffle.
PAIRS_IN_CELL, SETS_IN_BLOCK = 500, 32_768
#: A group is hot if more than this part of SETS_IN_BLOCK is left to be compared by sets, or more than twice so many shingles.
LEFT_PART, SHINGLES_IN_BLOCK = 32, 1_000_000
#: Pairs of fingerprints compared at once.
_COMPARED = 250_000
#: The centres of stars are chosen in so many different orders.
_ORDERS = np.uint64(4)
#: Most rows of a broadcast table of digests.
MAX_BROADCAST_ROWS = 200_000
#: Shingle hashes whose bits are counted at once; a sum of bytes holds 255 of them.
_CHUNK = 255 * 4
#: The common bits as numbers.
FINGERPRINT = tuple(f"f{i}" for i in range(WORDS))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text that is lower-cased already; with fewer words, the one whole sequence."""
    words = text.encode("utf-8", "surrogatepass").split()
    own = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype="<u8")
    n = max(1, len(words) - width + 1) if words else 0
    hashes = own[:n]
    for i in range(1, min(width, len(words))):
        hashes = _mixed(hashes) + own[i : i + n]
    return np.unique(_mixed(hashes))


def _spread(h: np.ndarray) -> np.ndarray:
    """One-to-one numbers in which every bit depends on all bits of h (the last steps of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tries(rows: int, similarity: float = SIMILARITY) -> tuple[int, int, int]:
    """For so many sets: the levels of equal paths, the number of tries, and the budget of the common bits below.

    A node at that level holds SETS_IN_BLOCK // 4 sets if bits are even.  A bit differs with angle / pi, so two sets at the similarity share a
    node of one trie with (1 - angle / pi) ** depth, and there are as many tries as MISSED asks for: their number grows with the 0.25th power of rows.
    """
    differ = min(0.5, EXCESS * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    depth = max(0, math.ceil(math.log2(max(1, rows) / max(1, SETS_IN_BLOCK // 4))))
    shared, bits = (1 - differ) ** depth, 64 * WORDS
    turns = 1 if shared == 1 else math.ceil(math.log(MISSED) / math.log1p(-shared))
    return depth, turns, math.floor(bits * differ + SPREAD * math.sqrt(bits * differ * (1 - differ)))


def _twice_ones(hashes: np.ndarray, first: int, words: int) -> np.ndarray:
    """For each bit of the words from number first on: twice how many of the hashes have it."""
    seeds = np.arange(first + 1, first + words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(_spread(hashes[i : i + _CHUNK, None] + seeds).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return 2 * ones


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set of hashes, 64 bits a word: 1 where over half of its hashes have it.

    A hash has as many bits as asked for: word i is spread from it and i.  Ties, frequent in small sets, are broken by as many further
    words, and what ties again or is of a larger set by the bit's place: a member that breaks them would be another one in a similar set.
    """
    n, twice, tied = len(hashes), _twice_ones(hashes, 0, words), np.arange(64 * words) % 2 == 1
    if n % 2 == 0 and n <= 255:
        again = _twice_ones(hashes, words, words)
        tied = np.where(again == n, tied, again > n)
    return np.where(twice == n, tied, twice > n).astype(np.uint8)


def _split(bits: np.ndarray, depth: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """The common words of a fingerprint, and for each trie the number of the node at that depth; both signed."""
    common = np.packbits(bits[: 64 * WORDS]).view(np.int64)
    paths = bits[64 * WORDS : 64 * WORDS + turns * depth].reshape(turns, depth).astype(np.uint64)
    steps = np.uint64(1) << np.arange(depth, dtype=np.uint64)
    nodes = (np.arange(turns, dtype=np.uint64) << np.uint64(depth)) + (paths * steps).sum(axis=1, dtype=np.uint64)
    return common, nodes.view(np.int64)


def _words(depth: int, turns: int) -> int:
    return WORDS + math.ceil(turns * depth / 64)


def band_keys(hashes: np.ndarray, rows: int = 250_000) -> np.ndarray:
    """One signed 64-bit number per trie, of the set's node in it, as for so many sets; none for no shingles."""
    depth, turns, _ = tries(rows)
    return _split(fingerprint(hashes, _words(depth, turns)), depth, turns)[1] if len(hashes) else np.zeros(0, dtype=np.int64)


def _lowered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """digest, text (lower-cased) and id of each row."""
    return docs.select(
        row_digest(docs, id_col, text_col).alias("digest"), ascii_lower(text_or_empty(text_col)).alias("text"), F.col(id_col).alias("id")
    )


def _sketched(docs: DataFrame, width: int, id_col: str, text_col: str, depth: int, turns: int) -> DataFrame:
    """id, digest (of the row), key (128 bits of the set of shingles), size (of the set), buckets (nodes of the tries) and fingerprint of each row."""
    rows = _lowered(docs, id_col, text_col)
    words, nothing = _words(depth, turns), (np.zeros(WORDS, dtype=np.int64), [])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_characters(batch):
                sets = [shingle_hashes(t, width) for t in part.column(1).to_pylist()]
                split = [_split(fingerprint(s, words), depth, turns) if len(s) else nothing for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2), part.column(0), pa.array([xxhash.xxh128_digest(s.tobytes(), SEED) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array([b for _, b in split], pa.list_(pa.int64())),
                        *(pa.array([int(common[i]) for common, _ in split], pa.int64()) for i in range(WORDS)),
                    ],
                    names=["id", "digest", "key", "size", "buckets", *FINGERPRINT],
                )

    kind = rows.schema["id"].dataType.simpleString()
    common = ", ".join(f"{f} bigint" for f in FINGERPRINT)
    return rows.mapInArrow(of_batches, f"id {kind}, digest binary, key binary, size bigint, buckets array<bigint>, {common}")


def _sets(docs: DataFrame, digests: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """digest and the bytes of the sorted shingle hashes of the rows of docs that digests names; rows equal in all columns once a task."""
    named = broadcast_up_to(digests.withColumnRenamed("digest", "named"), MAX_BROADCAST_ROWS)
    rows = _lowered(docs, id_col, text_col).join(named, F.col("digest") == F.col("named"), "left_semi")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in by_characters(batch):
                new = {d: t for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if d not in seen}
                seen |= new.keys()
                sets = [shingle_hashes(t, width).tobytes() for t in new.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(sets, pa.binary())], names=["digest", "hashes"])

    return rows.select("digest", "text").mapInArrow(of_batches, "digest binary, hashes binary")


def similar_pairs(
    docs: DataFrame, sets: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH,
    id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None,
) -> DataFrame:
    """The pairs (a, b) of node numbers, without repeats, whose sets of shingles have at least that Jaccard similarity.

    sets has node and digest, that of a row of docs with the node's set.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    return _compared(docs, sets, scratch.write(pairs), similarity, width, id_col, text_col, scratch)


def _dealt(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """cell, a and b of each pair (a, b): a cell is compared in one group, and partners mostly stand in the same one.

    A set's label is the least number within two steps over pairs, which a star or a dense group shares.  Sets are dealt into blocks by their label,
    those of a label with many sets or pairs by hash into parts too, and a cell is what two blocks have in common.  So a set is sent
    about once, however many there are in all, and one with many partners to no more cells than its label has parts.
    """
    blocks = max(1, math.ceil(pairs.count() / PAIRS_IN_CELL))
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.min("other").alias("label")).select(F.col("node").alias("other"), F.least("node", "label").alias("label"))
    least = broadcast_up_to(scratch.write(least), MAX_BROADCAST_ROWS)
    labelled = scratch.write(both.join(least, "other").groupBy("node").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n")))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / (8 * PAIRS_IN_CELL)), F.ceil(F.sqrt(F.sum("n") / (128 * PAIRS_IN_CELL)))).cast("int")
    large = scratch.write(labelled.groupBy("label").agg(parts.alias("parts")).where("parts > 1"))
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    place = labelled.join(broadcast_up_to(large, MAX_BROADCAST_ROWS), "label", "left")
    place = place.select("node", F.pmod(F.xxhash64("label", part), F.lit(blocks)).alias("block"))
    place = broadcast_up_to(scratch.write(place), MAX_BROADCAST_ROWS)
    for c in "ab":
        pairs = pairs.join(place.select(F.col("node").alias(c), F.col("block").alias(f"block_{c}")), c)
    cell = F.least("block_a", "block_b") * blocks + F.greatest("block_a", "block_b")
    return scratch.write(pairs.select(cell.alias("cell"), "a", "b"))


def _compared(
    docs: DataFrame, sets: DataFrame, pairs: DataFrame, similarity: float, width: int, id_col: str, text_col: str, scratch: Scratch
) -> DataFrame:
    """See similar_pairs; pairs is a written table."""
    pairs = _dealt(pairs, scratch)
    wanted = pairs.select("cell", F.col("a").alias("node")).unionByName(pairs.select("cell", F.col("b").alias("node"))).distinct()
    wanted = scratch.write(wanted.join(sets.select("node", "digest"), "node"))
    own = _sets(docs, scratch.write(wanted.select("digest").distinct()), width, id_col, text_col)
    own = own.join(broadcast_up_to(wanted, MAX_BROADCAST_ROWS), "digest")
    both = pairs.select("cell", "a", "b", F.lit(None).cast("binary").alias("hashes")).unionByName(
        own.select("cell", F.col("node").alias("a"), F.col("node").alias("b"), "hashes")
    )

    def of_cell(table: pa.Table) -> pa.Table:
        own, asked, found = {}, [], []
        for a, b, hashes in zip(*(table.column(c).to_pylist() for c in ("a", "b", "hashes"))):
            if hashes is None:
                asked.append((a, b))
            elif a not in own:
                own[a] = np.frombuffer(hashes, dtype="<u8")
        for a, b in asked:
            x, y = own[a], own[b]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if shared >= similarity * (len(x) + len(y) - shared) - 1e-9:
                found.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return both.groupBy("cell").applyInArrow(of_cell, "a bigint, b bigint")


def _near(table: pa.Table, x: np.ndarray, y: np.ndarray, budget: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of rows from x and y that are within the budget, of different roots and of sizes that allow the similarity, in the order of x.

    A few rows of x at a time; if y is x, each pair once, i before j in x.
    """
    root, size = (table.column(c).to_numpy() for c in ("root", "size"))
    common = [table.column(f).to_numpy().view(np.uint64) for f in FINGERPRINT]
    step = max(1, _COMPARED // max(1, len(y)))
    for i in range(0, len(x), step):
        own, rest = x[i : i + step], y[i:] if y is x else y
        at, to = np.nonzero(sum(np.bitwise_count(f[own][:, None] ^ f[rest]) for f in common) <= budget)
        if y is x:
            at, to = at[to > at], to[to > at]
        a, b = own[at], rest[to]
        met = (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9)
        yield a[met], b[met]


def _stars(members: DataFrame, crowded: DataFrame, budget: int, similarity: float) -> DataFrame:
    """Those members that have a near one (see _near) in their bucket, with its centre: the node that it was found with, or itself.

    Members of crowded buckets (bucket, parts) are dealt into parts by hash and met inside their part only.  In turn each member that has no
    centre yet becomes that of all near ones after it that have none, so that a bucket of n members gives less than n pairs of a
    centre and a member.  Centres are taken in one of few orders, so that the tries find the same pairs, and yet not all depends on one centre.
    """
    dealt = members.join(broadcast_up_to(crowded, MAX_BROADCAST_ROWS), "bucket", "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("node", "bucket"), F.col("parts")), F.lit(-1)).cast("int")).drop("parts")

    def of_bucket(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        turns = _spread(table.column("bucket").to_numpy().view(np.uint64)) % _ORDERS
        x = np.argsort(_spread(node.view(np.uint64) ^ turns))
        keep, centre = np.zeros(len(x), dtype=bool), np.full(len(x), -1)
        for a, b in _near(table, x, x, budget, similarity):
            keep[a] = keep[b] = True
            ends = np.flatnonzero(np.append(a[1:] != a[:-1], True)) + 1 if len(a) else ()
            for low, high in zip((0, *ends), ends):
                if centre[a[low]] < 0:
                    found = b[low:high]
                    centre[found[centre[found] < 0]] = a[low]
        own = np.where(centre < 0, np.arange(len(x)), centre)
        return table.append_column("centre", pa.array(node[own], pa.int64())).take(np.flatnonzero(keep))

    common = ", ".join(f"{f} bigint" for f in FINGERPRINT)
    names = ["bucket", "part", "node", "root", "size", *FINGERPRINT]
    return dealt.select(*names).groupBy("bucket", "part").applyInArrow(
        of_bucket, f"bucket bigint, part int, node bigint, root bigint, size bigint, {common}, centre bigint"
    )


def _cells(members: DataFrame, crowded: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What is compared in crowded buckets: cells (bucket, cell, side, node, root, size, fingerprint) of two blocks, and what is too much for that.

    The members of a root with SETS_IN_BLOCK members or more are dealt into blocks of their own; blocks of one root are not compared with one
    another.  The second result is (node, root) of all members of the buckets that hold more than SETS_IN_BLOCK others.
    """
    large = scratch.write(roots.groupBy("root").count().where(F.col("count") >= SETS_IN_BLOCK).select(F.col("root").alias("own")))
    members = members.join(broadcast_up_to(crowded.select("bucket"), MAX_BROADCAST_ROWS), "bucket", "left_semi")
    members = members.join(large, F.col("root") == F.col("own"), "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    owns = scratch.write(members.groupBy("bucket", "own").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b")))
    mixed = owns.groupBy("bucket").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max(F.when(F.col("own") == -1, F.col("n"))).alias("few"))
    mixed = scratch.write(mixed.where("a < b").select("bucket", (F.coalesce("few", F.lit(0)) > SETS_IN_BLOCK).alias("hot")))
    place = owns.join(mixed.where("NOT hot"), "bucket", "left_semi")
    place = scratch.write(place.select("bucket", "own", F.ceil(F.col("n") / SETS_IN_BLOCK).cast("int").alias("parts")))
    blocks = place.select("bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left, right = (blocks.select("bucket", F.struct("own", "part").alias(c)) for c in "xy")
    cells = left.join(right, "bucket").where("x <= y AND (x.own <> y.own OR x.own = -1)")
    cells = scratch.write(cells.withColumn("cell", F.monotonically_increasing_id()))
    sides = [
        cells.where(which).select("bucket", "cell", F.lit(number).alias("side"), F.col(f"{side}.own").alias("own"), F.col(f"{side}.part").alias("part"))
        for number, (side, which) in enumerate((("x", "true"), ("y", "x <> y")))
    ]
    sides = scratch.write(sides[0].unionByName(sides[1]))
    dealt = members.join(place, ["bucket", "own"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.join(sides, ["bucket", "own", "part"]).select("bucket", "cell", "side", "node", "root", "size", *FINGERPRINT)
    return dealt, members.join(mixed.where("hot"), "bucket", "left_semi").select("node", "root")


def _crossing(
    docs: DataFrame, cells: DataFrame, hot: DataFrame, done: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, budget: int, width: int,
    id_col: str, text_col: str,
) -> DataFrame:
    """Links (a, b) between sets of one cell that are of different roots, enough to join all groups that are linked there.

    cells: bucket, cell, side, node, root, size, fingerprint; the members of one side are compared with those of the other or, if there is no
    other, with each other.  A cell gives the pairs that are within the budget; each, whatever the number of cells that it meets in, is compared by its
    sets once, and those in done (a, b) were.  Where too many members have a partner, they and the sets in hot (node, root) are joined
    by their rarest shingles, and the cell gives these members and no pairs.
    """

    def two_sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side = table.column("side").to_numpy()
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        return (x, y) if len(y) else (x, x)

    def of_cell(table: pa.Table) -> pa.Table:
        node, root, size = (table.column(c).to_numpy() for c in ("node", "root", "size"))
        keep, found, large = np.zeros(table.num_rows, dtype=bool), [], False
        for a, b in _near(table, *two_sides(table), budget, similarity):
            keep[a] = keep[b] = True
            large = large or keep.sum() > SETS_IN_BLOCK // LEFT_PART or size[keep].sum() > 2 * SHINGLES_IN_BLOCK
            found = [] if large else [*found, (node[a], node[b])]
        x, y = (node[keep], root[keep]) if large else (np.concatenate([f[i] for f in found] or [node[:0]]) for i in range(2))
        if not large:
            x, y = np.minimum(x, y), np.maximum(x, y)
        return pa.table({"a": x, "b": y, "large": np.full(len(x), large)})

    met = scratch.write(cells.groupBy("bucket", "cell").applyInArrow(of_cell, "a bigint, b bigint, large boolean"))
    pairs = met.where("NOT large").select("a", "b").distinct().join(done, ["a", "b"], "left_anti")
    hot = scratch.write(hot.unionByName(met.where("large").select(F.col("a").alias("node"), F.col("b").alias("root"))).distinct())
    links = _compared(docs, sets, scratch.write(pairs), similarity, width, id_col, text_col, scratch)
    if hot.isEmpty():
        return links
    return links.unionByName(_crossing_in_hot_buckets(docs, hot, sets, scratch, similarity, width, id_col, text_col))


def _crossing_in_hot_buckets(
    docs: DataFrame, hot: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, width: int, id_col: str, text_col: str
) -> DataFrame:
    """All links (a, b) between the given sets (node, root) that are of different roots, by prefixes of their rarest shingles.

    Shingles are ordered by the number of sets that hold them, those of one root alone before all others.  Two sets x and y, x not
    larger, that share the part similarity of their union share a shingle among the first |x| - 2 s / (1 + s) |x| + 1 of x and the first |y| - s |y| + 1 of y: the
    least shared one stands there, as at least so many shared ones follow it in either set.  Shingles of one root alone take up places but
    meet nobody, so what a template with different fillings, or a large group of copies, shares inside is never paired: where the
    own shingles of the members fill the first prefix, a template's cost is in proportion to its members.
    """
    named = scratch.write(hot.distinct().join(sets.select("node", "digest", "size"), "node"))
    own = _sets(docs, named.select("digest"), width, id_col, text_col)

    def as_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = pa.array([np.frombuffer(hashes, dtype="<i8")], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), numbers], names=["digest", "shingles"])

    own = own.mapInArrow(as_numbers, "digest binary, shingles array<bigint>").dropDuplicates(["digest"])
    own = scratch.write(own.join(named, "digest").select("node", "root", "size", "shingles"))
    shingles = own.select("node", "root", "size", F.explode("shingles").alias("shingle"))
    holders = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
    holders = scratch.write(holders.where("x < y").select("shingle", "n"))
    met = shingles.join(holders, "shingle").groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("met"))
    alone = F.col("size") - F.size("met")
    first, last = (F.col("size") - F.ceil(F.col("size") * s - 1e-9) + 1 for s in (2 * similarity / (1 + similarity), similarity))
    inside = F.slice("met", 1, F.greatest(last - alone, F.lit(0)).cast("int"))
    entries = met.select("node", "root", "size", (first - alone).alias("first"), F.posexplode(inside).alias("at", "entry"))
    entries = scratch.write(entries.select("node", "root", "size", F.col("entry.shingle").alias("shingle"), (F.col("at") < F.col("first")).alias("indexed")))
    small = entries.where("indexed").select("shingle", *(F.col(c).alias(f"{c}_x") for c in ("node", "root", "size")))
    larger = F.expr("root <> root_x AND (size_x < size OR size_x = size AND node_x < node)") & (F.col("size_x") >= similarity * F.col("size") - 1e-9)
    pairs = small.join(entries.drop("indexed"), "shingle").where(larger)
    pairs = pairs.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()
    return similar_pairs(docs, sets, pairs, similarity, width, id_col, text_col, scratch)


def _members(sets: DataFrame, roots: DataFrame, first: int, scratch: Scratch) -> DataFrame:
    """bucket, node, root, size and fingerprint of each set in each trie of a round."""
    some = F.slice("buckets", first + 1, TRIES_IN_ROUND).alias("buckets")
    rows = sets.select("node", "size", *FINGERPRINT, some).join(roots.select(F.col("node").alias("n"), "root"), F.col("node") == F.col("n"), "left")
    rows = scratch.write(rows.withColumn("root", F.coalesce("root", "node")).drop("n"))
    return rows.select("node", "root", "size", *FINGERPRINT, F.explode("buckets").alias("bucket"))


def _walked(
    docs: DataFrame, sets: DataFrame, roots: DataFrame, first: int, scratch: Scratch, similarity: float, budget: int, width: int, id_col: str,
    text_col: str,
) -> DataFrame:
    """roots (node, root) with the groups joined that are linked in the tries of the round that begins with number first."""
    # A bucket is what a trie holds below one node.  Its members' fingerprints are sent to it once; what comes back are the members within
    # the budget of another, and fewer pairs than members: that settles nearly all groups, large ones of copies among them.
    members = _members(sets, roots, first, scratch)
    crowded = members.groupBy("bucket").count().where(F.col("count") > SETS_IN_BLOCK)
    crowded = scratch.write(crowded.select("bucket", F.ceil(F.col("count") / SETS_IN_BLOCK).cast("int").alias("parts")))
    met = scratch.write(_stars(members, crowded, budget, similarity))
    stars = met.where("centre <> node").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    stars = scratch.write(stars)
    links = similar_pairs(docs, sets, stars, similarity, width, id_col, text_col, scratch)
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = scratch.write(connected_components(known.unionByName(links), scratch))

    # Then those that this leaves in different groups against each other; in buckets of several parts, all members.
    new = roots.select(F.col("node").alias("n"), F.col("root").alias("now"))
    cells = met.where("part = -1").join(new, F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("now", "root"))
    cells = cells.select("bucket", F.lit(-1).cast("long").alias("cell"), F.lit(0).alias("side"), "node", "root", "size", *FINGERPRINT)
    hot = met.limit(0).select("node", "root")
    if not crowded.isEmpty():
        more, hot = _cells(_members(sets, roots, first, scratch), crowded, roots, scratch)
        cells = cells.unionByName(more)
    more = scratch.write(_crossing(docs, cells, hot, stars, sets, scratch, similarity, budget, width, id_col, text_col))
    if more.isEmpty():
        return roots
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch)


def similar_groups(
    docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, digest, node (number of the row's set), root and component_id of each row; see keep_one_of_similar."""
    depth, turns, budget = tries(docs.count(), similarity)
    rows = scratch.write(_sketched(docs, width, id_col, text_col, depth, turns))
    sets = rows.select("key", "digest", "size", "buckets", *FINGERPRINT).dropDuplicates(["key"])
    sets = scratch.write(sets.withColumn("node", F.monotonically_increasing_id()))

    roots = docs.sparkSession.createDataFrame([], "node bigint, root bigint")
    for first in range(0, turns, TRIES_IN_ROUND):
        own = Scratch(docs.sparkSession)
        roots = own.write(_walked(docs, sets, roots, first, own, similarity, budget, width, id_col, text_col))
        own.drop_all_but_last()
        scratch.paths += own.paths
    rows = scratch.write(rows.select("id", "digest", "key").join(sets.select("key", "node"), "key").drop("key"))
    return rooted(rows, rows.groupBy("node").agg(F.min("id").alias("least")), roots, "node", scratch)


def keep_one_of_similar(
    docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs that stand for their group of near duplicates: the one with its least id; all columns as they are.

    Texts are lower-cased in A-Z and cut at white space; rows link if the Jaccard similarity of their sets of shingles
    is at least similarity, and groups are what is reachable over links.  Shingles are told apart by 64-bit hashes inside a pair, whole
    sets by 128 bits; rows of equal sets are joined once, through one representative.

    Every pair of sets that shares a node of a trie, is within the budget and not in one group already is compared, and none is capped: a
    group of n near copies costs about n comparisons of sets, with the centres of its buckets; only members of a bucket that are within the
    budget and that these leave in different groups are compared pairwise, once in all buckets, if they are at most a LEFT_PART of SETS_IN_BLOCK; more of them, and
    all members of buckets with more than SETS_IN_BLOCK sets outside large groups, are joined by the rarest of their shingles.

    Null and wordless texts are one group; very long texts are taken whole.  Null ids stand for a group only if it has no other.
    Of several rows with the least id, the one with the least digest of all columns stays, and of rows equal in all
    columns one.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    return one_of_each(docs, similar_groups(docs, scratch, similarity, width, id_col, text_col), scratch, id_col, text_col)
