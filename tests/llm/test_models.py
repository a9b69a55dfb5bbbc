"""Quality, secrets and languages: held-out accuracy, brute force, edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pumpwise.llm import langid, quality, secrets
from pumpwise.llm.common import read_table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, score double, label int, x string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, 0.0, 1, "x") for i, t in texts], DOCS)


def test_quality_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in quality.op2_quality(spark, SF).collect()}
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = [(r["doc_id"], r["quality"]) for r in read_table(spark, SF, "labels").collect() if got[r["doc_id"]]["held_out"]]
    for label in (0, 1):
        right = [got[i]["predicted"] == y for i, y in labels if y == label]
        assert sum(right) / len(right) > 0.95, label


def test_quality_learns_from_allowed_rows_only(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    flipped = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs.withColumn("lang", F.lit("q")), flipped)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_ranking_is_bradley_terry():
    """The weights are where the pairs' logistic loss has no slope."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    good = x @ [1.0, -2.0, 0.0] + rng.logistic(size=300) > 0
    m = quality.fit_ranking(x, good)
    assert m.weights[0] > 0.3 and m.weights[1] < -0.8 and abs(m.weights[2]) < 0.4
    assert ((m.score(x) >= 0.5) == good).mean() > 0.75
    assert quality.fit_ranking(x, good | True) is None and quality.fit_ranking(x[:0], good[:0]) is None


def test_quality_edges(spark):
    texts = [(1, None), (1, ""), (None, "a b"), (3, "w " * 50_000), (4, "퟿ \U0001f600")]
    model = quality.fit_ranking(np.array([[0.0] * 14, [1.0] * 14]), np.array([False, True]))
    for m in (model, None):
        got = quality.quality_scores(table(spark, texts), m).collect()
        assert Counter(r["doc_id"] for r in got) == Counter([1, 1, None, 3, 4]) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
        assert quality.quality_scores(table(spark, []), m).count() == 0
    no_labels = spark.createDataFrame([(1, None), (None, 1), (9, 3)], "doc_id bigint, quality int")
    assert quality.fit_quality(table(spark, texts), no_labels) is None


def brute_base(text):
    """The fixed patterns, by trying each start from left to right."""
    kinds = [("assign", r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?P<v>[A-Za-z0-9+/_.=-]+)", re.I | re.A, 8),
             ("access", r"(?P<v>AKIA[A-Z0-9]+)", 0, 16), ("hex", r"(?P<v>[0-9a-f]+)", 0, 32)]
    spans = []
    for rank, (kind, pattern, flags, least) in enumerate(kinds):
        at, p = 0, re.compile(pattern, flags)
        while at < len(text):
            m = p.match(text, at)
            if m and len(m["v"]) >= least:
                spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
            at = m.end() if m else at + 1
    return [s for *_, s in sorted(spans)]


RANDOM = ["ghp_16C7e42F292c6912E7710c838347Ae178B4a", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "dGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0"]
HARMLESS = [
    "internationalization_configuration_manager", "550e8400-e29b-41d4-a716-446655440000", "D41D8CD98F00B204E9800998ECF8427E",
    "2024-01-31-12345678901234567890", "Thththionwhstinererlyandoreble"
]


def test_secrets(spark):
    rng = random.Random(6)
    bits = [
        "token", "Secret", "PASSWORD", "api_key", "apikey", "ſecret", '"', "'", " ", "=", ":", "abc", "01234567", "f" * 40, "AKIA",
        "AKIAABCDEFGHIJKL", "é", "😀", "\n", "a1" * 20, "-", "/"
    ]
    texts = [(i, "".join(rng.choices(bits, k=rng.randint(0, 25)))) for i in range(300)]
    texts += [
        (400, None), (401, ""), (402, "x" * 200_000 + " token=abcdefgh"), (403, "token=abc secret=token:abcdefghij"),
        (None, "passwd: 12345678"), (404, "password = 'hunter2x' and"), (404, "password = 'hunter2x' and")
    ]
    got = secrets.scan_secrets(table(spark, texts)).collect()
    want = Counter()
    for i, t in texts:
        base = brute_base(t or "")
        want[i, ",".join(base), *(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))] += 1
    assert Counter((r["doc_id"], r["base_spans"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == want
    for r in got:  # the method adds spans, the base ones stay in place
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("random")] == [s for s in r["base_spans"].split(",") if s]
        assert sum(s.startswith("random") for s in spans) == r["n_random"]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    assert secrets.scan_secrets(table(spark, [])).count() == 0


def test_random_strings(spark):
    texts = [(i, f"é key is {s}, ok") for i, s in enumerate(RANDOM + HARMLESS)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(table(spark, texts)).collect()}
    for i, s in enumerate(RANDOM):
        assert got[i] == f"random:9:{9 + len(s)}"
    assert not any(got[len(RANDOM) + i] for i in range(len(HARMLESS)))


def test_op3_digest(spark):
    rows = secrets.op3_secrets(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in read_table(spark, SF, "documents").collect()}
    assert len(rows) == len(texts) and sum(r["n_assign"] for r in rows) > 5
    for r in rows:
        assert r["base_sha256"] == hashlib.sha256(",".join(brute_base(texts[r["doc_id"]])).encode()).hexdigest()


def test_languages_on_held_out_documents(spark):
    got = {r["doc_id"]: r for r in langid.op7_langid(spark, SF).collect()}
    docs = read_table(spark, SF, "documents").collect()
    out = [r for r in docs if got[r["doc_id"]]["held_out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.fixture(scope="module")
def model(spark):
    return langid.learn_languages(read_table(spark, SF, "documents"))


def test_languages_of_mixed_and_odd_texts(spark, model):
    en, fr = "the and of hendor thionin stereding eanthe the with of", "le de éaux queeau éenlaê deleaux les dans pour"
    texts = [(1, f"{en}. {fr}!"), (2, None), (3, " 12 ,;"), (None, en), (5, fr * 5000), (5, fr), (6, "\U00020000 漢字"), (7, "")]
    got = langid.identify_languages(table(spark, texts), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert [s.split(":")[0] for s in by[1]["spans"].split(",")] == ["en", "fr"]
    start = len(en) + 2
    assert by[1]["spans"] == f"en:0:{len(en)},fr:{start}:{start + len(fr)}"
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["spans"]) == ("und", 0.0, "") for i in (2, 3, 7))
    assert by[None]["lang_pred"] == "en" and by[5]["lang_pred"] == "fr" and by[6]["lang_pred"] in model.names and len(got) == 8
    assert langid.identify_languages(table(spark, []), model).count() == 0
    nothing = langid.learn_languages(table(spark, texts))
    assert nothing.names == () and {r["lang_pred"] for r in langid.identify_languages(table(spark, texts), nothing).collect()} == {"und"}


def test_scripts_narrow_the_candidates(spark):
    docs = [(i, "привет мир слово", "ru") for i in range(9)] + [(i, "hello world word", "en") for i in range(10, 19)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = langid.learn_languages(frame)
    got = langid.identify_languages(spark.createDataFrame([(1, "щъё zzz")], "doc_id bigint, text string"), model, penalty=1.0).first()
    assert got["spans"] == "ru:0:3,en:4:7"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, k, penalty = int(rng.integers(1, 6)), int(rng.integers(1, 4)), float(rng.choice([0.0, 0.7, 3.0]))
        scores = rng.normal(size=(3, 6, k))
        lengths = np.array([n, 6, 1])
        path = langid.viterbi(scores, lengths, penalty)
        for r, m in enumerate(lengths):
            value = (lambda p: sum(scores[r, t, s] for t, s in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:])))
            best = max(value(p) for p in np.ndindex(*[k] * int(m)))
            assert math.isclose(value(path[r, :m]), best, abs_tol=1e-9)
