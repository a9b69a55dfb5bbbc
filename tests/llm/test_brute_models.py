"""The learned operators and the random strings against plain loops."""

import math
import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from pumpwise.llm import langid, quality, secrets


def brute_features(text):
    """The features of a text, character by character and word by word."""
    words = text.split()
    if not words:
        return [0.0] * 14
    upper = lower = digits = stops = shouts = symbols = 0
    for c in text:
        if ord(c) >= 0x2000:
            lower += 1
        elif c.isspace():
            continue
        elif c.isalpha():
            upper, lower = upper + c.isupper(), lower + (not c.isupper())
        elif c.isdigit():
            digits += 1
        elif c in ".,;:?'\"()-":
            stops += 1
        elif c == "!":
            shouts += 1
        else:
            symbols += 1
    filled, n = upper + lower + digits + stops + shouts + symbols, len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    again = marked = shouted = 0
    for i, w in enumerate(words):
        again += i > 0 and words[i - 1] == w
        marked += not w[-1].isalnum() and w[-1] not in ".,;:?\"')"
        shouted += w.isupper() and len(w) > 1
    return [
        (upper + 1.2) / (upper + lower + 40), digits / (filled + 40), stops / (filled + 40), shouts / (filled + 40), symbols / (filled + 40),
        (filled + 40) / (n + 40 / 6), again / n, marked / n, math.log(len(set(words)) + 1) / math.log(n + 1), math.log(n),
        len(set(lines)) / len(lines), math.log(n / len(lines)), shouted / n, 1.0,
    ]


def test_features_against_loops():
    rng = random.Random(1)
    pool = list("aAzé É09.,!?#$%  \n\n\t-()") + ["Word ", "LOUD ", "word word ", "漢字", "\U0001f600", " "]
    for text in ["", " \n", "x", *("".join(rng.choices(pool, k=rng.randint(1, 200))) for _ in range(200))]:
        assert np.allclose(quality.features(text, quality._classes()), brute_features(text)), repr(text)


def test_the_loss_has_no_slope_at_the_weights():
    """Gradient of the mean logistic loss over the pairs, plus the ridge, summed pair by pair; the cut is the best of all quantiles."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)) * [1, 5, 0.1]
    good = x @ [1.0, -0.3, 4.0] + rng.logistic(size=120) > 0
    model = quality.fit_ranking(x, good)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6)
    pairs = quality.pair_differences(z, good)
    assert len(pairs) == quality.PARTNERS * len(x)
    slope = [quality.RIDGE * w for w in model.weights]
    for d in pairs:
        p = 1 / (1 + math.exp(sum(a * b for a, b in zip(d, model.weights))))
        slope = [s - p * v / len(pairs) for s, v in zip(slope, d)]
    assert max(map(abs, slope)) < 1e-9
    strength = [sum(a * b for a, b in zip(row, model.weights)) for row in z]

    def rate(cut):
        return sum(s < cut for s, g in zip(strength, good) if not g) / sum(~good) + sum(s >= cut for s, g in zip(strength, good) if g) / sum(good)

    assert rate(model.cut) >= max(rate(s) for s in [*strength, math.inf]) - 1e-12
    want = [1 / (1 + math.exp(model.cut - s)) for s in strength]
    assert np.allclose(model.score(x), want)
    # Every pair is one good document minus one bad one.
    good_rows, bad_rows = z[good], z[~good]
    for d in pairs[:: len(pairs) // 20]:
        assert any(np.allclose(d, g - bad_rows[np.argmin(np.abs(g - bad_rows - d).sum(axis=1))]) for g in good_rows)


def test_one_text_and_one_label_of_an_id(spark):
    docs = [(i, f"Word {i} and more, {'!' * (i % 5)}") for i in range(40)] + [(3, "Aaa first"), (3, "zzz last"), (None, "no id")]
    labels = [(i, i % 2) for i in range(40)] + [(3, 0), (3, 1), (None, 1), (5, 7), (6, None)]
    got, fit = [], quality.fit_ranking
    try:
        quality.fit_ranking = lambda x, good: got.append((x, good)) or fit(x, good)
        schema = "doc_id int, text string"
        quality.fit_quality(spark.createDataFrame(docs * 3, schema), spark.createDataFrame(labels, "doc_id int, quality int"))
    finally:
        quality.fit_ranking = fit
    least = defaultdict(list)
    for i, t in docs:
        least[i].append(t)
    import zlib

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    want = sorted((tuple(brute_features(min(least[i]))), 0 if i == 3 else i % 2) for i in ids)
    have = sorted((tuple(x), int(g)) for x, g in zip(*got[0]))
    assert len(have) == len(ids) and np.allclose([w[0] for w in want], [h[0] for h in have]) and [w[1] for w in want] == [h[1] for h in have]


@pytest.fixture(scope="module")
def encoding():
    return secrets.load_encoding(secrets.VOCABULARY)


def brute_random(text, base, encoding):
    """Strings of 20 or more characters of the alphabet, character by character, less the harmless kinds."""
    letters, spans, at = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), [], 0
    cost = (lambda s: len(encoding.encode_ordinary(s)))
    while at < len(text):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        s = text[at:end]
        if len(s) >= 20 and not any(a < end and at < b for a, b, _ in base):
            kinds = {"digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "mark" for c in s}
            hexes = set(s) <= set("0123456789abcdef") or set(s) <= set("0123456789ABCDEF")
            groups = s.split("-")
            uuid = [len(g) for g in groups] == [8, 4, 4, 4, 12] and all(c in "0123456789abcdefABCDEF" for g in groups for c in g)
            if kinds <= {"digit", "mark"} or uuid or hexes and len(s) in (32, 40, 56, 64, 96, 128):
                pass
            elif identifier(s):
                parts = [p for p in cut(s) if p.isalpha() and len(p) >= 3]
                whole = sum(map(len, parts))
                odd = 2 * whole >= len(s) and whole <= 2 * sum(map(cost, parts)) or any(len(p) >= 20 and len(p) <= 2 * cost(p) for p in parts)
                spans += [(at, end, "random")] * odd
            elif len(s) <= 2 * cost(s):
                spans.append((at, end, "random"))
        at = max(end, at + 1)
    return spans


def cut(s):
    parts = [""]
    for c in s:
        if c in "_/=+-":
            parts.append("")
        else:
            parts[-1] += c
    return [p for p in parts if p]


def identifier(s):
    """Words (one case, or a capital and small letters) and numbers of up to four digits, with separators between and after them."""

    def word(p):
        return p.isdigit() and len(p) <= 4 or p.isalpha() and (p.isupper() or p.islower() or p[0].isupper() and p[1:].islower())

    return s[0] not in "_/=+-" and all(word(p) for p in cut(s))


def test_random_spans_against_loops(encoding):
    rng = random.Random(5)
    some = "abcdefghijklmnopqrstuvwxyz"
    words = ["the", "configuration", "Manager", "HTTP", "2024", "value", "internationalization", "report"]

    def one():
        kind = rng.randrange(8)
        if kind == 0:
            return "".join(rng.choices(some + some.upper() + "0123456789+/", k=rng.randint(15, 60)))
        if kind == 1:
            return rng.choice("_-/").join(rng.choices(words, k=rng.randint(1, 6)))
        if kind == 2:
            return "".join(rng.choices("0123456789abcdef", k=rng.choice([20, 31, 32, 40, 64, 65])))
        if kind == 3:
            return "".join(rng.choices("0123456789-", k=30))
        if kind == 4:
            return "-".join("".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12))
        if kind == 5:
            return "".join(rng.choices(some, k=rng.randint(18, 30)))
        if kind == 6:
            return f"token={''.join(rng.choices(some, k=12))}"
        return "".join(rng.choices(words, k=3))

    found = 0
    for _ in range(400):
        text = rng.choice([" ", "\n", ", ", "é"]).join(one() for _ in range(rng.randint(1, 8)))
        base = sorted(secrets.base_spans(text))
        got = secrets.random_spans(text, base, encoding)
        assert got == brute_random(text, base, encoding), text
        found += len(got)
    assert found > 200
    # Overlapping base spans of any number.
    text = "x " + "A" * 30 + " y"
    assert secrets.random_spans(text, [(2, 3, "k")] * 9 + [(30, 33, "k")], encoding) == []


def brute_grams(word):
    """The buckets of a word's 2- and 3-grams, a blank being before and after it."""
    codes, out = [32, *map(ord, word), 32], Counter()
    for i in range(1, len(codes)):
        two = codes[i] * 0x9E3779B1 + codes[i - 1] * 0x85EBCA6B
        hashes = [two] if i == 1 else [two, two + codes[i - 2] * 0xC2B2AE35 + 3]
        for h in hashes:
            h %= 1 << 32
            out[((h ^ h >> 15) * 0x2C1B3C6D % (1 << 32)) >> 16] += 1
    return out


def brute_words(text):
    words, own = [], ""
    for i, c in enumerate(text.lower() + " "):
        if c.isalpha():
            own += c
        elif own:
            words.append((i - len(own), own))
            own = ""
    return words


@pytest.mark.parametrize("together", [1, 16])
def test_languages_against_loops(spark, monkeypatch, together):
    """Counts, word scores, the best path and the share of letters, over more languages than are counted at once."""
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", together)
    monkeypatch.setattr(langid, "SLICE", 300)
    rng = random.Random(2)
    sets = {"aa": "abcdé", "bb": "bcxyz", "cc": "дежзи", "dd": "abmno"}
    docs = [(i, " ".join("".join(rng.choices(sets[k], k=rng.randint(1, 7))) + rng.choice([",", "", "7"]) for _ in range(rng.randint(1, 30))), k)
            for i, k in enumerate(rng.choices(list(sets), k=80))] + [(200, None, "aa"), (201, "x y", None)]
    import zlib

    counts, scripts, total = defaultdict(Counter), defaultdict(set), Counter()
    for i, t, k in docs:
        if k and zlib.crc32(str(i).encode()) % 4 != 2:
            for _, w in brute_words(t or ""):
                counts[k] += brute_grams(w)
                scripts[k].add(w[0] in sets["cc"])
    for k in counts:
        total[k] = sum(counts[k].values())
    model = langid.learn_languages(spark.createDataFrame(docs, "doc_id int, text string, lang string"))
    assert model.names == tuple(sorted(counts))

    def weight(k, b):
        return math.log((counts[k][b] + 0.5) / (total[k] + 0.5 * 65536))

    for j, k in enumerate(model.names):
        for b in [*counts[k], 0, 1, 65535]:
            assert math.isclose(model.weights[b, j], weight(k, b), rel_tol=1e-5)

    texts = [(i, " ".join("".join(rng.choices(sets[k], k=rng.randint(1, 6))) for k in rng.choices(list(sets), k=rng.randint(1, 5)))) for i in range(40)]
    texts += [(99, "12 🙂"), (100, None)]
    got = {r["doc_id"]: r for r in langid.identify_languages(spark.createDataFrame(texts, "doc_id int, text string"), model, penalty=2.0).collect()}
    for i, t in texts:
        words = brute_words(t or "")
        if not words:
            assert tuple(got[i])[1:] == ("und", 0.0, "")
            continue
        score = [
            [sum(n * weight(k, b) for b, n in brute_grams(w).items()) if (w[0] in sets["cc"]) in scripts[k] else -50.0 * (1 + len(w)) for k in model.names]
            for _, w in words
        ]
        value = (lambda p: sum(s[x] for s, x in zip(score, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
        best = max(product(range(len(model.names)), repeat=len(words)), key=value)
        spans = []
        for (a, w), x in zip(words, best):
            if spans and spans[-1][0] == x:
                spans[-1][2] = a + len(w)
            else:
                spans.append([x, a, a + len(w)])
        assert got[i]["spans"] == ",".join(f"{model.names[x]}:{a}:{b}" for x, a, b in spans), t
        letters = Counter()
        for (_, w), x in zip(words, best):
            letters[x] += len(w)
        top = min(letters, key=lambda x: (-letters[x], x))
        assert got[i]["lang_pred"] == model.names[top] and math.isclose(got[i]["score"], letters[top] / sum(letters.values()))


def test_more_languages_than_a_byte_can_number(spark):
    docs = [(i, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i)}{chr(0x5E00 + i)}", f"l{i:03}") for i in range(400)]
    model = langid.learn_languages(spark.createDataFrame(docs, "doc_id int, text string, lang string"))
    assert len(model.names) > 256
    known = [d for d in docs if d[2] in model.names]
    got = langid.identify_languages(spark.createDataFrame([d[:2] for d in known], "doc_id int, text string"), model).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in got} == {(i, k) for i, _, k in known}
