import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siftline.llm import simhash
from siftline.llm.common import row_key
from siftline.llm.graph import components


def slow_fingerprint(text, n=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def slow_near(rows, radius=2):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for a, x in fps for b, y in fps if bin(x ^ y).count("1") <= radius]
    found = slow_components(pairs)
    return {i: (f"{fp:016x}", found[i]) for i, fp in fps}


def test_fingerprint_of_odd_texts():
    for text in [None, "", " \t\n", "One", "one TWO", "a b c", "É é É x y", "x " * 1000, "ab\x0bcd\x0cef gh" * 40]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, d).collect()}
    assert got == slow_near(rows)


def test_tiles_of_any_size_find_the_same_links(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) for c in centres for _ in range(60)}
    values |= {rng.getrandbits(64) for _ in range(100)}
    signed = [v - (v >> 63 << 64) for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    array = np.array(signed, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 2
    expected = slow_components((signed[i], signed[j]) for i, j in zip(*np.nonzero(near), strict=True) if i < j)
    for tile_rows, visitor_rows in [(1024, 4096), (7, 13)]:
        got = slow_components((r.a, r.b) for r in simhash.links(distinct, 2, tile_rows, visitor_rows).collect())
        assert got == expected


def test_nulls_ties_and_empty_tables(spark):
    schema = "doc_id bigint, text string, fp string, k int"
    rows = [(3, "same words in here", "x", 1), (1, "same words in here", "y", 2), (None, "same words in here", "z", 3),
            (7, None, "", 0), (5, "", "", 0), (None, "all alone with nobody near it", "", 0), (3, "same words in here", "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    got = defaultdict(list)
    for r in simhash.near_duplicates(docs).collect():
        got[r.id].append(r.component_id)
    assert got[3] == [1, 1] and got[1] == [1] and got[7] == [5] and got[5] == [5]
    assert sorted(got[None], key=str) == [1, None]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    odd = spark.createDataFrame([(500, 501), (501, 500), (600, 600), (None, 4)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(chain.union(odd)).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500, 600: 600}


def test_similar_texts_keep_one_of_each_group(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, family, i = [], {}, 0
    for f in range(40):
        base = [word() for _ in range(rng.randrange(150, 500))]
        for copy in range(4 if f % 2 else 1):
            words = list(base)
            for _ in range(copy * len(words) // 150):
                words[rng.randrange(len(words))] = word()
            rows.append((i, " ".join(words)))
            family[i] = f
            i += 1
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (903, "two words"), (904, "two words"), (904, "two words")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, k string, fp int")
    found = simhash.similar_texts(docs)
    keys = docs.select("doc_id", row_key("doc_id", "text").alias("k")).distinct()
    kept = [r.doc_id for r in keys.join(found.where("k = keeper"), "k").collect()]
    smallest = {f: min(i for i in family if family[i] == f) for f in set(family.values())}
    assert sorted(kept) == sorted([*smallest.values(), 900, 903])
    assert found.count() == keys.count()
    assert simhash.similar_texts(docs.where("false")).count() == 0


def test_similar_texts_are_exact_at_the_bound(spark):
    rng = random.Random(12)
    rows, alike = [], {}
    for f in range(300):
        # One end of a text differs: of n + d shingles n are shared, d = n / 4 at the bound, one more below it.
        n = rng.choice([4, 8, 40, 200, 400])
        extra = n // 4 + f % 2
        words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n + 4 + extra)]
        rows += [(2 * f, " ".join(words[: n + 4])), (2 * f + 1, " ".join(words))]
        alike[2 * f + 1] = not f % 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys = docs.select("doc_id", row_key("doc_id", "text").alias("k"))
    kept = {r.doc_id for r in keys.join(simhash.similar_texts(docs).where("k = keeper"), "k").collect()}
    assert {i for i in alike if i not in kept} == {i for i in alike if alike[i]}


def test_parts_of_a_group_find_the_same_links(spark, monkeypatch):
    rng = random.Random(13)
    rows, base = [], [f"w{i}" for i in range(120)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(w[x : x + 5]) for x in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    pairs = [(a, b) for a in sets for b in sets if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = slow_components(pairs)
    assert 1 < len(set(want.values())) < 60
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = {bytes(r.k): r.doc_id for r in docs.select("doc_id", row_key("doc_id", "text").alias("k")).collect()}
    for size in (2048, 9):
        monkeypatch.setattr(simhash, "GROUP_TEXTS", size)
        monkeypatch.setattr(simhash, "BAND_TEXTS", size)
        assert {ids[bytes(r.k)]: ids[bytes(r.keeper)] for r in simhash.similar_texts(docs).collect()} == want


def test_recall_of_pairs_at_the_bound(spark):
    """Pairs with a similarity of just 0.8, spread over the text: over nine in ten must be linked; it is nearly all."""
    rng = random.Random(14)
    rows, pairs = [], 2500
    for f in range(pairs):
        n = rng.randrange(60, 400)
        words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
        # Each changed word costs five shingles of either text: s shared and n - 4 - s lost on both sides.
        changed, other = 0, list(words)
        for at in range(rng.randrange(5, 10), n - 5, 5):
            shared = n - 4 - 5 * (changed + 1)
            if shared / (2 * (n - 4) - shared) < 0.8:
                break
            other[at] += "x"
            changed += 1
        rows += [(2 * f, " ".join(words)), (2 * f + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys = docs.select("doc_id", row_key("doc_id", "text").alias("k"))
    kept = {r.doc_id for r in keys.join(simhash.similar_texts(docs).where("k = keeper"), "k").collect()}
    assert all(2 * f in kept for f in range(pairs))
    assert sum(2 * f + 1 not in kept for f in range(pairs)) >= 0.99 * pairs
