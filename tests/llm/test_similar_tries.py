"""near_dedup's candidates: SimHash fingerprints, tries and budget."""

import math
import random

import numpy as np
from test_dedup import table
from test_similar import brute_kept

import corpus_pipeline
from pumpwise.llm import similar


def random_pair(rng, shared, own, other):
    """Two sorted sets of hashes with so many shared and own ones."""
    hashes = rng.integers(0, 1 << 63, shared + own + other, dtype=np.uint64) * np.uint64(2)
    return np.sort(hashes[: shared + own]), np.sort(np.concatenate((hashes[:shared], hashes[shared + own :])))


def test_a_bit_is_what_over_half_of_the_hashes_have():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 18, 255, 256, 1021, 2042):
        hashes = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        ones = sum(similar.fingerprint(hashes[i : i + 1], 4).astype(int) for i in range(n))
        again, place = ones[128:], np.arange(128) % 2
        tied = np.where(2 * again == n, place, 2 * again > n) if n <= 255 else place
        assert (similar.fingerprint(hashes, 2) == np.where(2 * ones[:128] == n, tied, 2 * ones[:128] > n)).all()


def test_pairs_at_the_limit_are_in_the_budget_and_share_a_node():
    rng = np.random.default_rng(5)
    for rows in (1_000, 44_000, 220_000):
        depth, turns, budget = similar.tries(rows)
        bits = 64 * similar.WORDS
        assert (1 - (1 - 0.838**depth) ** turns) > 0.9999 and budget < bits / 3
        differ = []
        for shared, own, other in [(80, 10, 10), (80, 20, 0), (16, 2, 2)] * 60:
            x, y = (similar.fingerprint(s, similar._words(depth, turns)) for s in random_pair(rng, shared, own, other))
            differ.append((x != y).mean())
            assert (x != y)[:bits].sum() <= budget
            assert (similar._split(x, depth, turns)[1] == similar._split(y, depth, turns)[1]).any()
        assert abs(np.mean(differ) - math.acos(8 / 9) / math.pi) < 0.01


def test_the_fingerprints_decide_what_is_compared(spark, monkeypatch):
    """With tries of several levels all groups are found; without a budget only equal fingerprints, here of equal sets alone, are."""
    monkeypatch.setattr(similar, "SETS_IN_BLOCK", 64)
    rng, texts = random.Random(6), []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        texts += [(len(texts) + k, " ".join(words[: 80 - k])) for k in range(0, 12, 4)]
    assert similar.tries(len(texts))[0] > 2
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table(spark, texts), "").collect())
    assert got == brute_kept(texts) and len(got) == 60
    monkeypatch.setattr(similar, "tries", lambda *a, inner=similar.tries: (*inner(*a)[:2], 0))
    assert corpus_pipeline.near_dedup(spark, table(spark, texts), "").count() == len(texts)


def test_sets_are_sent_once_and_not_to_each_node_that_a_pair_shares(spark, monkeypatch):
    """Stars settle all groups, with fewer pairs than members, though the pairs meet in many tries; nothing is left to be sent to cells."""
    monkeypatch.setattr(similar, "SETS_IN_BLOCK", 64)
    rng, texts, sent, compared = random.Random(8), [], [], []
    for _ in range(50):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        texts += [(len(texts), " ".join(words)), (len(texts) + 1, " ".join(words[:-3]))]
    assert similar.tries(len(texts))[1] > 5
    sets, pairs = similar._sets, similar.similar_pairs
    monkeypatch.setattr(similar, "_sets", lambda docs, digests, *a: sent.append(digests.count()) or sets(docs, digests, *a))
    monkeypatch.setattr(similar, "similar_pairs", lambda docs, of, some, *a: compared.append(some.count()) or pairs(docs, of, some, *a))
    assert corpus_pipeline.near_dedup(spark, table(spark, texts), "").count() == 50
    assert compared == [50] and sent == [100, 0]


def test_tries_of_half_a_gigabyte_are_one_round():
    for rows, most in ((44_000, 12), (220_000, 21), (13_000_000, 71)):
        assert similar.tries(rows)[1] <= most
    assert similar.tries(220_000)[1] <= similar.TRIES_IN_ROUND


def test_crowded_buckets_are_dealt_into_parts(spark, monkeypatch):
    """Groups larger than a block, in buckets of several parts: blocks of large groups meet those of others, and nothing is lost."""
    monkeypatch.setattr(similar, "SETS_IN_BLOCK", 16)
    made, inner = [], similar._cells
    monkeypatch.setattr(similar, "_cells", lambda *a: made.append(inner(*a)) or made[-1])
    rng, texts = random.Random(10), []
    for n in (70, 25, 3):
        words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        for _ in range(n):
            some = list(words)
            some[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(some)))
    texts += [(len(texts) + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50))) for k in range(20)]
    rng.shuffle(texts)
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table(spark, texts), "").collect())
    assert got == brute_kept(texts) and made


def test_what_the_stars_compared_is_not_sent_again(spark, monkeypatch):
    """Pairs within the budget and below the similarity meet in many tries and stay apart; their sets are compared once in all."""
    rng, texts, sent = random.Random(14), [], []
    for _ in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        texts += [(len(texts), " ".join(words)), (len(texts) + 1, " ".join(words[:60] + [f"w{rng.randrange(10**6)}" for _ in range(12)]))]
    sets = similar._sets
    monkeypatch.setattr(similar, "_sets", lambda docs, digests, *a: sent.append(digests.count()) or sets(docs, digests, *a))
    assert corpus_pipeline.near_dedup(spark, table(spark, texts), "").count() == 20
    assert sent[0] > 0 and sent[1:] == [0]


def test_partners_stand_in_one_cell(spark, monkeypatch):
    """A star, a dense group and many pairs: each pair in one cell, and a set in about one, where blocks by hash made it about as many as partners."""
    monkeypatch.setattr(similar, "PAIRS_IN_CELL", 20)
    pairs = [(0, i) for i in range(1, 100)] + [(i, j) for j in range(1000, 1030) for i in range(1000, j)] + [(i, i + 1) for i in range(2000, 2400, 2)]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    cells = similar._dealt(frame, similar.Scratch(spark)).collect()
    assert sorted((r["a"], r["b"]) for r in cells) == sorted(pairs)
    nodes = {n for p in pairs for n in p}
    assert len({(r["cell"], n) for r in cells for n in (r["a"], r["b"])}) <= 1.2 * len(nodes)
    assert len({r["cell"] for r in cells}) > 10
