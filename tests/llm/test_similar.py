"""Near duplicates by Jaccard similarity, and the pipeline's stage, against brute force over all pairs."""

import random

from test_dedup import lower, table

import corpus_pipeline
from pumpwise.llm import similar


def brute_shingles(text):
    words = lower(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts, similarity=0.8):
    sets, least = [brute_shingles(t) for _, t in texts], list(range(len(texts)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    return [texts[i][0] for i in range(len(texts)) if find(i) == i]


def near_copies(rng):
    vocab = [f"w{i}" for i in range(300)]
    texts = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "a b c d e f g h i"), (5, "a b c d e f g h i j")]
    for n in (60, 120, 400):
        for _ in range(12):
            base = rng.choices(vocab, k=n)
            for edits in (0, *(rng.randint(0, 1 + n // 40) for _ in range(6))):
                words = list(base)
                for _ in range(edits):
                    words[rng.randrange(n)] = rng.choice(vocab)
                texts.append((len(texts), " ".join(words)))
    hub = rng.choices(vocab, k=80)  # one group in which not every pair is similar
    for _ in range(60):
        words = list(hub)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(80)] = rng.choice(vocab)
        texts.append((len(texts), " ".join(words)))
    return texts


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, monkeypatch):
    monkeypatch.setattr(similar, "PAIRS_IN_CELL", 50)
    texts = near_copies(random.Random(4))
    want = brute_kept(texts)
    assert len(want) < len(texts) / 2
    frame = table(spark, texts)
    got = corpus_pipeline.near_dedup(spark, frame, "")
    assert got.columns == frame.columns and sorted(r["doc_id"] for r in got.collect()) == want


def test_members_of_a_bucket_that_leaders_leave_apart(spark, monkeypatch):
    """Chains of edits: most pairs of a bucket are not similar, so groups are found between members, in blocks of a few sets."""
    monkeypatch.setattr(similar, "SETS_IN_BLOCK", 4)
    monkeypatch.setattr(similar, "PAIRS_IN_CELL", 20)
    rng, texts = random.Random(12), []
    for _ in range(4):
        words = [str(rng.random()) for _ in range(60)]
        for _ in range(40):
            words = list(words)
            words[rng.randrange(10)] = str(rng.random())
            texts.append((len(texts), " ".join(words)))
        texts += [(len(texts) + k, " ".join([*words[10:], *(str(rng.random()) for _ in range(14))])) for k in range(20)]
    rng.shuffle(texts)
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    seen = []
    crossing = similar._crossing
    monkeypatch.setattr(similar, "_crossing", lambda *a: seen.append(1) or crossing(*a))
    got = similar.keep_one_of_similar(table(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in got) == brute_kept(texts) and seen


def test_ties_between_rows_of_one_id(spark):
    """Of rows equal in id and text one stays, the same in any order; of wholly equal rows one; a column named like the operator's own stays."""
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "y", 2), (1, "a b c d e f", "y", 2), (2, "A b c d e f", "z", 3), (None, "a b c d e f", "n", 4)]
    kept = set()
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id int, text string, __digest string, n int")
        got = similar.keep_one_of_similar(frame).collect()
        assert len(got) == 1 and got[0]["doc_id"] == 1
        kept.add(tuple(got[0]))
    assert len(kept) == 1 and kept <= set(rows)
    twice = spark.createDataFrame([rows[1]] * 3, "doc_id int, text string, __digest string, n int")
    assert [tuple(r) for r in similar.keep_one_of_similar(twice).collect()] == [rows[1]]
    assert similar.keep_one_of_similar(twice.limit(0)).count() == 0


def test_sets_are_told_apart_by_all_bits(spark, monkeypatch):
    """Sets that agree in the first 64 bits of their keys are two sets."""
    digest = similar.xxhash.xxh128_digest
    monkeypatch.setattr(similar, "_sketched", lambda *a, f=similar._sketched: f(*a).withColumn("key", similar.F.expr("concat(X'0000000000000000', substr(key, 9))")))
    texts = [(i, f"{i} {i} {i} a b c {i}") for i in range(30)]
    got = similar.keep_one_of_similar(table(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(30)) and len(digest(b"x")) == 16


def test_bands_find_pairs_at_the_limit():
    """Pairs just above a similarity of 0.8 agree in a band."""
    rng, met, seen = random.Random(9), 0, 0
    while seen < 300:
        a = [str(rng.random()) for _ in range(100)]
        b = a[:-11] + [str(rng.random()) for _ in range(11)]  # 85 of 107 shingles, then one word less is changed: 86 of 106
        b[-11] = a[-11]
        x, y = brute_shingles(" ".join(a)), brute_shingles(" ".join(b))
        assert 0.8 <= len(x & y) / len(x | y) < 0.82
        k, m = (similar.band_keys(similar.shingle_hashes(" ".join(t))) for t in (a, b))
        seen, met = seen + 1, met + bool((k == m).any())
    assert met >= 299


def templates(rng, n, filled=60):
    """n texts of one template, not similar by 0.8, and for every 40th one that is similar to it and just not in its band order."""
    base = [f"t{i}" for i in range(300)]
    texts = []
    for k in range(n):
        words = base + [f"o{rng.randrange(10**9)}" for _ in range(filled)]
        texts.append((len(texts), " ".join(words)))
        if k % 40 == 0:
            words[-8:] = [f"o{rng.randrange(10**9)}" for _ in range(8)]
            texts.append((len(texts), " ".join(words)))
    return texts


def test_hot_buckets_by_prefixes(spark, monkeypatch):
    """With every crowded bucket a hot one the result is the same: small and large edits, a hub, templates with similar members."""
    monkeypatch.setattr(similar, "SETS_IN_BLOCK", 3)
    rng = random.Random(11)
    texts = near_copies(rng) + [(i + 10_000, t) for i, t in templates(rng, 80, 44)]
    # Fillings of 30 to 44 words: similarities of 0.77 to 0.83.
    texts += [(20_000 + i, " ".join([*(f"u{k}" for k in range(300)), *(f"p{rng.randrange(10**9)}" for _ in range(rng.randint(30, 44)))])) for i in range(60)]
    want = brute_kept(texts)
    got = corpus_pipeline.near_dedup(spark, table(spark, texts), "")
    assert sorted(r["doc_id"] for r in got.collect()) == want and len(want) < len(texts)


def test_a_template_costs_in_proportion(spark, monkeypatch):
    """Texts of one template meet in every bucket; the pairs that are compared after the leaders grow with the texts, not with their square."""
    monkeypatch.setattr(similar, "SETS_IN_BLOCK", 64)
    compared, inner = [], similar.similar_pairs

    def watched(docs, sets, pairs, *rest):
        compared.append(pairs.count())
        return inner(docs, sets, pairs, *rest)

    monkeypatch.setattr(similar, "similar_pairs", watched)
    made = []
    for n in (200, 400):
        compared.clear()
        texts = templates(random.Random(n), n)
        got = corpus_pipeline.near_dedup(spark, table(spark, texts), "")
        assert got.count() == n
        assert len(compared) == 2
        made.append(compared[1])
    assert made[1] <= 2.5 * max(made[0], 10)
