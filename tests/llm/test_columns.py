"""Every operator and stage on a table with columns that clash with its own, have dots, or differ by a microsecond."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pumpwise.llm import decontaminate, exact_dedup, html_text, langid, line_dedup, mixing, periodic, quality, secrets, sharding, simhash, similar
from pumpwise.llm.common import column, read_table

SF = "/root/testdata/sf0.001"
CLASHES = [
    "a.b", "__mix_lang", "__mix_times", "times", "__digest", "__digest_kept", "digest", "root", "node", "id", "h", "th", "key", "norm", "n", "shard", "epoch",
    "item", "score", "spans", "runs", "bucket", "domain", "we`ird", "struct.x.y"
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = read_table(spark, SF, "documents").where("doc_id < 60")
    for k, c in enumerate(CLASHES):
        rows = rows.withColumn(c, F.lit(k))
    return rows.withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000))).cache()


STAGES = {
    "quality": lambda d: quality.keep_good(d, quality.fit_quality(d, read_table(d.sparkSession, SF, "labels"))),
    "similar": similar.keep_one_of_similar,
    "decontaminate": lambda d: decontaminate.drop_contaminated(d, read_table(d.sparkSession, SF, "benchmark")),
    "mix": lambda d: mixing.mix_sources(d, mixing.source_domain(), mixing.WEIGHTS, 0.8, 1, 1),
}
OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup, "quality": lambda d: quality.quality_scores(d, None), "secrets": secrets.scan_secrets,
    "sharding": lambda d: sharding.extendible_shards(d, 20_000), "simhash": simhash.near_duplicates,
    "langid": lambda d: langid.identify_languages(d, langid.learn_languages(d)), "line_dedup": line_dedup.line_dedup,
    "html": lambda d: html_text.extract_text(d, "text", "main"), "periodic": periodic.find_periodic_runs,
    "contained": lambda d: decontaminate.contained_items(d, read_table(d.sparkSession, SF, "benchmark")),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_all_columns(docs, name):
    got = STAGES[name](docs)
    assert [c for c in got.columns if c != "times"] == [c for c in docs.columns if c != "times"]
    rows = got.select("doc_id", *(column(c).alias(f"x{k}") for k, c in enumerate(CLASHES)), "ts").collect()
    assert rows
    for r in rows:
        assert all(r[f"x{k}"] == k for k, c in enumerate(CLASHES) if c != "times" or name != "mix")


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_run(docs, name):
    got = OPERATORS[name](docs)
    assert got.count() == docs.count() or name == "contained"


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stages_run(docs, step):
    name, stage = corpus_pipeline.STAGES[step]
    got = stage(docs.sparkSession, docs, SF)
    assert got.count() > 0 and (name == "shard" or got.columns == docs.columns)


def test_rows_that_differ_by_a_microsecond(spark):
    """Two rows with the least id: the one with the least digest stays, whatever the order; a digest tells them apart."""
    from pumpwise.llm.components import row_digest

    micros = [F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")).alias("at"), F.timestamp_micros(F.lit(7) + F.col("id")).cast("timestamp_ntz").alias("ntz")]
    for moment in micros:
        rows = spark.range(3).select(F.lit(1).alias("doc_id"), F.lit("a b c").alias("text"), moment)
        assert rows.select(row_digest(rows)).distinct().count() == 3
        first = [similar.keep_one_of_similar(rows.repartition(n)).collect() for n in (1, 3)]
        assert first[0] == first[1] and len(first[0]) == 1
    nested = spark.sql("SELECT 1 AS doc_id, 'a' AS text, named_struct('x', CAST(NULL AS INT)) AS `p.q` UNION ALL SELECT 1, 'a', NULL")
    assert nested.select(row_digest(nested)).distinct().count() == 2
