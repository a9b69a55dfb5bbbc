"""Exact, near and line deduplication against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from pumpwise.llm import line_dedup as line_dedup_module
from pumpwise.llm.exact_dedup import exact_dedup
from pumpwise.llm.line_dedup import line_dedup
from pumpwise.llm.simhash import close_pairs, connected_components, near_duplicates

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, id int, norm double"


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, None, "s", None, "h", 1, 0.5) for i, t in texts], schema)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, keep, weak):
    texts = [
        (3, "Ab"), (1, "aB"), (2, None), (7, ""), (5, "É"), (6, "é"), (None, "ab"), (9, "x" * 100_000), (8, "X" * 100_000), (9, "y"),
        (9, "y")
    ]
    weak_hash = {"content_hash": lambda c: F.lit("00")} if weak else {}  # all texts collide
    got = exact_dedup(table(spark, texts), keep=keep, **weak_hash).collect()
    want = []
    for i, t in texts:
        same = [j for j, u in texts if lower(u) == lower(t)]
        keep_id = {"min": min, "max": max}[keep](j for j in same if j is not None)
        want.append((i, keep_id, len(same), i == keep_id, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_exact_dedup_empty_and_null_ids(spark):
    assert exact_dedup(table(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in exact_dedup(table(spark, [(None, "a")])).collect()] == [(None, None, 1, True)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    least = {i: i for i, _ in fps}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_near_duplicates(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Éa", "STREET"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(40, 200))) for _ in range(25)]
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One two"), (5, "a\vb c\x1cd e")]
    for t in base:
        for _ in range(rng.randint(1, 5)):
            words = t.split()
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append((len(texts), rng.choice([" ", "\n", "  "]).join(words)))
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    comps = brute_components(fps)
    assert len(set(comps.values())) < len(texts) - 10
    got = near_duplicates(table(spark, texts)).collect()
    assert {tuple(r) for r in got} == {(i, f"{f:016x}", comps[i]) for i, f in fps}


def test_near_duplicates_edges(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    rows = near_duplicates(table(spark, [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, None)])).collect()
    assert Counter((r[0], r[2]) for r in rows) == Counter([(None, 4), (4, 4), (4, 4), (None, None)])


def test_close_pairs_finds_all(spark):
    rng = random.Random(1)
    keys = set()
    for _ in range(40):  # clusters of near keys, some across the sign bit, among random ones
        k = rng.getrandbits(64)
        keys |= {k} | {k ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(8)} | {rng.getrandbits(64)}
    keys |= {0, 1, 3, 7, 15, 2**63, 2**64 - 1}
    signed = (lambda x: x - 2**64 if x >= 2**63 else x)
    want = {tuple(sorted((signed(a), signed(b)))) for a in keys for b in keys if a < b and (a ^ b).bit_count() <= 3}
    got = close_pairs(spark.createDataFrame([(signed(k),) for k in keys], "key bigint")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_connected_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_connected_components_of_a_hub(spark):
    """One component of 30 000 nodes that hang on one root, and links between its leaves."""
    n = 30_000
    links = spark.range(1, n).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    links = links.unionByName(spark.range(1, n - 1, 7).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    links = links.unionByName(spark.range(n, 2 * n, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = connected_components(links).groupBy("root").count()
    assert {r["root"]: r["count"] for r in got.where("count > 2").collect()} == {0: n}
    assert got.where("count = 2").count() == n // 2


def brute_lines(texts, min_words):
    """(id, text) -> lines deleted, by comparing all runs of lines."""
    docs = sorted(set((i, t or "") for i, t in texts), key=lambda x: (x[0] is not None, x[0] or 0))
    runs = {}
    for d, (i, t) in enumerate(docs):
        lines = [(p, x.strip(" \t\r\v\f")) for p, x in enumerate(t.split("\n")) if x.strip(" \t\r\v\f")]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for _, x in lines[a:b]) >= min_words:
                    runs.setdefault(tuple(x for _, x in lines[a:b]), []).append((d, lines[a][0], lines[b - 1][0]))
    gone = {x: set() for x in docs}
    for places in runs.values():
        for d, a, b in sorted(places)[1:]:
            gone[docs[d]] |= set(range(a, b + 1))
    return gone


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices("abcdef", k=rng.randint(1, 6))) for _ in range(12)] + ["", "  "]
    texts = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)]
    passage = "\n".join(["p q r", "", "s t u v", "w x"])
    texts += [(100 + i, f"own{i}\n{passage}\ntail{i}") for i in range(20)] + [
        (100, f"own0\n{passage}\ntail0"), (500, None), (501, "\n\n"), (None, passage)
    ]
    gone = brute_lines(texts, 6)
    assert sum(map(len, gone.values())) > 100
    got = line_dedup(table(spark, texts), min_words=6).collect()
    want = []
    for i, t in texts:
        lines, off = (t or "").split("\n"), gone[i, t or ""]
        want.append((i, "\n".join(x for p, x in enumerate(lines) if p not in off), len(lines), sorted(off)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_lines_are_selected_by_winnowing(spark):
    """Far fewer lines are selected than there are, a window's least one each; equal windows in two places select the same line."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    block = [" ".join(rng.choices(words, k=6)) for _ in range(30)]
    own = [[" ".join(rng.choices(words, k=6)) for _ in range(40)] for _ in range(2)]
    texts = [(k, "\n".join([*own[k][:7], *block, *own[k][7:]])) for k in range(2)] + [(2, "short"), (3, None)]
    lines = line_dedup_module._lines(table(spark, texts), "doc_id", "text")
    got = {}
    for r in line_dedup_module.selected_lines(lines, 24).collect():
        got.setdefault(r["id"], set()).add(r["pos"])
    assert set(got) == {0, 1} and all(20 <= len(p) <= 40 for p in got.values())  # of 70 lines each
    inside = (lambda k: {p for p in got[k] if 7 + 3 <= p < 37 - 3})
    assert inside(0) == inside(1) and len(inside(0)) >= 6
    hashes = {k: spark.createDataFrame([(x,) for x in t.split("\n")], "s string").select(F.xxhash64("s")).collect() for k, t in texts[:2]}
    for k, h in hashes.items():
        assert got[k] == {min(range(i, i + 4), key=lambda j: h[j][0]) for i in range(len(h) - 3)}


def test_line_dedup_does_not_trust_selection_hashes(spark, monkeypatch):
    """With all line hashes equal, every line is its window's candidate or covered by one, and digests alone decide."""
    module = line_dedup_module
    monkeypatch.setattr(module, "_lines", lambda *a, f=module._lines: f(*a).withColumn("h", F.lit(7).cast("long")))
    texts = [(i, f"only {i} here\nsame words in both\nother {i % 2} {i}") for i in range(6)]
    gone = brute_lines(texts, 4)
    got = line_dedup(table(spark, texts), min_words=4).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in got} == {i: sorted(gone[i, t]) for i, t in texts} and any(gone.values())


def test_line_dedup_empty(spark):
    assert line_dedup(table(spark, [])).count() == 0
