"""From raw documents to training shards: quality, near duplicates, benchmark passages, mixture, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pumpwise.llm.common import Scratch, column, read_table
from pumpwise.llm.decontaminate import drop_contaminated
from pumpwise.llm.mixing import SEED, WEIGHTS, mix_sources, source_domain
from pumpwise.llm.quality import fit_quality, keep_good
from pumpwise.llm.sharding import SHARD_BYTES, extendible_shards
from pumpwise.llm.similar import keep_one_of_similar

#: Share of the remaining tokens that the mixture takes, none of them twice.
MIX_SHARE, MIX_EPOCHS = 0.8, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; it learns from the labelled ones among docs that are not held out.

    A null text is scored as an empty one, repeated rows are scored one by one, a score of just 0.5 is accepted; without labels of
    both kinds all documents stay.  An empty table gives an empty one.
    """
    return keep_good(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by a Jaccard similarity of 0.8 on shingles of five words.

    SimHash fingerprints propose the pairs, joined by binary tries within a Hamming budget that is set for that similarity, and the shingles
    decide.  Null and wordless texts are one group; of several rows with the least id that with
    the least digest stays, of wholly repeated rows one; null ids stand only for groups without other ids.  An empty table gives an empty one.
    """
    return keep_one_of_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and wordless texts hold none; rows with one id are one document and go together, those with null ids too.  Empty tables on
    either side leave docs as they are.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill the token budgets of their domain, language and source.

    Null names are the child 'unknown'; documents of a leaf without tokens (null texts alone) go.  Rows with one id share a place in the
    seeded order and are taken together, so there are no ties.  An empty table gives an empty one.
    """
    return mix_sources(docs, source_domain(), WEIGHTS, MIX_SHARE, MIX_EPOCHS, SEED).select(*map(column, docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document that is left: id, shard, depth, n_bytes, shard_bytes, shard_docs.

    Null texts have no bytes, null ids hash as ''; repeated rows that no hash bit tells apart are dealt by number.  An empty table gives an
    empty one.
    """
    return extendible_shards(docs, SHARD_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard),
]

#: The ranking is fitted numerically and the fingerprints are bits of XXH64 numbers, neither of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder before the next reads it, and dropped when that is done."""
    scratch, docs = Scratch(spark), read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop_all_but_last()
    return STAGES[-1][1](spark, docs, sf_dir)
