import random

import regex

from siftline.llm import decontaminate


def word_list(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def slow(docs, items, share=0.8, size=5):
    wanted, lengths = {}, set()
    for i, t in items:
        w = word_list(t)
        if i is not None and w:
            n = min(size, len(w))
            lengths.add(n)
            wanted.setdefault(i, set()).update(" ".join(w[p : p + n]) for p in range(len(w) - n + 1))
    out = set()
    for d, text in docs:
        w = word_list(text)
        held = {" ".join(w[p : p + n]) for n in lengths for p in range(len(w) - n + 1)}
        out |= {(d, i, len(s), len(s & held)) for i, s in wanted.items() if len(s & held) >= share * len(s) - 1e-9}
    return sorted(out, key=str)


def found(docs, items, **more):
    return sorted(((r.id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contained(docs, items, **more).collect()), key=str)


def test_equals_brute_force_in_both_ways_of_joining(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda n: [rng.choice(["der", "the", "of", "casa", "Über", "x9", "née", "run"]) + str(rng.randrange(60)) for _ in range(n)]
    items = [(i, " ".join(words(rng.randrange(1, 70)))) for i in range(40)] + [(40, None), (41, ""), (42, "One two."), (None, "null id of five words"), (43, "capital of France"), (44, "sole"), (45, "one item"), (45, "in two rows, the second of them longer")]
    docs = []
    for i in range(120):
        text = words(rng.randrange(0, 400))
        passage = (items[rng.randrange(40)][1]).split()
        if i % 3:
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = "edited"
        docs.append((i, " ".join(text[:50]) + "\n" + ", ".join(passage).upper() + " -- " + " ".join(text[50:])))
    docs += [(200, None), (201, ""), (202, "one: TWO"), (None, items[3][1]), (203, items[5][1]), (203, items[5][1]), (204, "... null id of five words ..."), (205, "What is the Capital: of France? A sole " + "word " * 300), (206, "one item in two rows, the second of them longer")]
    a = spark.createDataFrame([(*d, "k", 3) for d in docs], "doc_id bigint, text string, w string, h int")
    b = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, n_item int")
    want = slow(docs, items)
    assert len(want) > 60
    assert found(a, b) == want
    assert {(205, 43, 1, 1), (205, 44, 1, 1), (202, 42, 1, 1), (206, 45, 5, 5)} <= set(want)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert found(a, b) == want
    assert found(a.where("false"), b) == [] == found(a, b.where("false"))


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = lambda name, i: [(r[i], r.text) for r in spark.read.parquet(f"{d}/{name}.parquet").collect()]
    got = [(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.op8_decontaminate(spark, d).collect()]
    assert sorted(got, key=str) == slow(rows("documents", "doc_id"), rows("benchmark", "item_id"))
