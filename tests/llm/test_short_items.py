"""Benchmark items of fewer words than a shingle, inside longer documents."""

import random

from test_native import grams

from pumpwise.llm.decontaminate import contained_items, drop_contaminated


def test_short_items_are_found_inside_documents(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    items = [(n * 10 + k, " ".join(rng.choices(vocab, k=n))) for n in (1, 2, 4, 5, 9) for k in range(4)] + [(99, ""), (98, None)]
    docs = [(0, None), (1, ""), (2, items[4][1]), (3, "One, " + items[5][1].upper())]
    for i in range(10, 60):
        words = rng.choices(vocab, k=rng.choice([3, 6, 60]))
        if i % 3:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(items[:20])[1].split()
        docs.append((i, " ".join(words)))

    def holds(doc, item):
        ws, own = (doc or "").lower().replace(",", "").split(), (item or "").split()
        if len(own) < 5:
            return bool(own) and any(ws[i : i + len(own)] == own for i in range(len(ws)))
        return 5 * len(grams(doc) & grams(item)) >= 4 * len(grams(item))

    want = {(i, k) for i, t in docs for k, u in items if holds(t, u)}
    assert len({i for i, k in want if k < 50}) > 15
    frame, bench = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = contained_items(frame, bench, short_inside=True).collect()
    assert len(got) == len(want) and {tuple(r)[:2] for r in got} == want
    left = drop_contaminated(frame, bench).collect()
    assert sorted(r["doc_id"] for r in left) == sorted({i for i, _ in docs} - {i for i, _ in want})
