"""Each stage of corpus_pipeline against brute force on what it gets, on a mixed small corpus."""

import random

import pytest
from test_native import brute_shards, grams
from test_similar import brute_kept

import corpus_pipeline
from pumpwise.llm import mixing, quality
from pumpwise.llm.common import Scratch, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Some documents of the small tables, with nulls, repeated rows, near copies and benchmark passages added."""
    sf = str(tmp_path_factory.mktemp("corpus"))
    source = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in read_table(spark, source, "documents").select(*COLUMNS).collect()]
    bench = [r["text"] for r in read_table(spark, source, "benchmark").collect()]
    rng = random.Random(8)
    for k in range(15):
        i, t, l, s, n = rng.choice(docs)
        docs.append((10_000 + k, t.replace(" ", "\n", 1), l, None, n))
        docs.append((20_000 + k, f"{t}\n{bench[k]}", None, s, n))
    docs += [docs[3], (30_000, None, None, None, None), (None, docs[5][1], "en", "src1", 5)]
    spark.createDataFrame(
        docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        read_table(spark, source, name).write.parquet(f"{sf}/{name}.parquet")
    return sf


def key(row):
    return str(tuple(row))


def test_stages(spark, corpus):
    before = read_table(spark, corpus, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = Scratch(spark).write(stage(spark, before, corpus))
        assert after.columns == COLUMNS
        old, new = before.collect(), after.collect()
        assert {key(r) for r in new} <= {key(r) for r in old} and 0 < len(new) < len(old), name
        if name == "quality":
            model = quality.fit_quality(before, read_table(spark, corpus, "labels"))
            classes = quality._classes()
            good = [r for r in old if model.score(quality.np.array([quality.features(r["text"] or "", classes)]))[0] >= 0.5]
            assert sorted(map(key, new)) == sorted(map(key, good))
        elif name == "near_dedup":
            numbered = sorted(old, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
            assert sorted(str(r["doc_id"]) for r in new) == sorted(map(str, brute_kept([(r["doc_id"], r["text"]) for r in numbered])))
        elif name == "decontaminate":
            items = [g for g in (grams(r["text"]) for r in read_table(spark, corpus, "benchmark").collect()) if g]
            clean = [r for r in old if not any(5 * len(grams(r["text"]) & g) >= 4 * len(g) for g in items)]
            assert sorted(map(key, new)) == sorted(map(key, clean)) and len(clean) < len(old)
        else:
            words = (lambda rows: sum(len((r["text"] or "").split()) for r in rows))
            plan = mixing.mixing_plan(before, mixing.source_domain(), mixing.WEIGHTS, corpus_pipeline.MIX_SHARE, 1, mixing.SEED).collect()
            assert sum(p["alloc"] for p in plan) == int(corpus_pipeline.MIX_SHARE * words(old))
            longest = max(len((r["text"] or "").split()) for r in old)
            for p in plan:
                own = [r for r in new if ((r["lang"] or "unknown"), (r["source"] or "unknown")) == (p["lang"], p["source"])]
                assert p["alloc"] <= words(own) < p["alloc"] + longest or p["alloc"] == words(own)
        kept.append(len(new))
        before = after
    rows = before.collect()
    shards = brute_shards([(r["doc_id"], r["text"]) for r in rows], corpus_pipeline.SHARD_BYTES)
    got = corpus_pipeline.STAGES[-1][1](spark, before, corpus).collect()
    assert sorted((str(r["doc_id"]), r["shard"]) for r in got) == sorted((str(i), s) for (i, _), s in shards.items())
    whole = corpus_pipeline.run(spark, corpus).collect()
    assert sorted(map(key, whole)) == sorted(map(key, got))


def test_stages_on_nothing_and_on_nulls(spark, corpus):
    """An empty table gives an empty one; a document of nulls passes or goes by the same rules as any other."""
    docs = read_table(spark, corpus, "documents")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), corpus).count() == 0, name
        left = stage(spark, nulls, corpus).count()
        # Equal rows are one near-duplicate group; a leaf without tokens is not mixed; the rest is clean.
        assert left == {"quality": 2, "near_dedup": 1, "decontaminate": 2, "mix": 0, "shard": 2}[name], name
