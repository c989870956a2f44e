import hashlib
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import mixing


def h64(*values):
    """Spark's xxhash64 of ints (4 bytes, marked by a tuple), longs and strings."""
    out = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        out = xxhash.xxh64_intdigest(data, out)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def slow_targets(sizes, weights, share, most):
    """Shares by weight; what is above a cap is shared anew, over and over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = Fraction(share) * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(capped.values())
        parts = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if parts[s] > most * sizes[s]]
        if not above:
            return names, capped | parts
        capped |= {s: Fraction(most * sizes[s]) for s in above}


def permutation(n, *keys):
    def at(x):
        for r in range(mixing.ROUNDS):
            other = (signed(h64(*keys, (r,))) % n - x) % n
            x = other if h64(*keys, (r,), max(x, other)) & 1 else x
        return x

    found = [at(x) for x in range(n)]
    assert sorted(found) == list(range(n))
    return found


def slow(rows, weights, share, most, block, per_shard, seed=42):
    """The mix in plain loops: words taken of each row, as a multiset, and the slots."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    told = lambda v: b"\x00" if v is None else b"\x01" + str(v).encode()
    key = lambda i, t: hashlib.md5(told(i) + b"\x02" + told(t)).digest()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    names, goal = slow_targets(sizes, weights, share, most)
    def place(n):
        own = key(*rows[n][:2])
        return h64(own) >> 52, signed(h64(own)), own

    packed = {s: sorted((n for n, r in enumerate(rows) if r[2] == s), key=place) for s in names}
    streams = {s: [(n, at) for n in packed[s] for at in range(len(words(rows[n][1])))] for s in names}
    plans = {}
    for s in names:
        want, n = round(float(goal[s])), -(-sizes[s] // block)
        stream, got, slots = [streams[s][b * block : (b + 1) * block] for b in range(n)], 0, []
        code = "1" if s is None else "0" + s
        epoch = 0
        while got < want:
            for b in permutation(n, signed(h64((seed,), code)), epoch):
                if got < want:
                    slots.append(stream[b][: want - got])
                    got += len(slots[-1])
            epoch += 1
        plans[s] = slots
    total = sum(map(len, plans.values()))
    lots = [s for s in names for _ in plans[s]]
    draws = [lots[signed(h64((seed,), n // per_shard, (n % per_shard,))) % total] for n in range(total)]
    owed = [(s, j) for s in names for j in range(draws.count(s), len(plans[s]))]
    counted, surplus = Counter(), []
    chosen = [None] * total
    for n, s in enumerate(draws):
        j = counted[s]
        counted[s] += 1
        if j < len(plans[s]):
            chosen[n] = (s, j)
        else:
            surplus.append((names.index(s), j, n))
    for (_, _, n), to in zip(sorted(surplus), owed, strict=True):
        chosen[n] = to
    filled = {(n // per_shard, n % per_shard): plans[s][j] for n, (s, j) in enumerate(chosen)}
    taken = Counter(n for slot in filled.values() for n, _ in slot)
    texts = {place: [words(rows[n][1])[at] for n, at in slot] for place, slot in filled.items()}
    return sizes, goal, sorted(((i, len(words(t)), sizes[s], taken[n], s) for n, (i, t, s) in enumerate(rows)), key=str), texts


def check(spark, rows, weights, share, most, block, per_shard):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id bigint, text string, source string, size int, key string")
    mixed = mixing.mix(docs, weights, share, most, block, per_shard)
    sizes, goal, taken, texts = slow(rows, weights, share, most, block, per_shard)
    got = mixed.spans.groupBy("s", "key", "copy", "id", "size").agg(F.sum("n").alias("taken")).join(mixed.sources, "s").collect()
    assert {r.source: r.target for r in got} == {s: pytest.approx(float(t)) for s, t in goal.items()}
    # Rows that are equal but for their place may change places.
    assert sorted(((r.id, r.size, r.source_size, r.taken, r.source) for r in got), key=str) == taken
    by_source = Counter()
    for r in got:
        by_source[r.source] += r.taken
    assert all(by_source[s] == round(float(t)) for s, t in goal.items()) and all(r.taken <= most * r.size for r in got)
    assert {(r.shard, r.slot): r.words for r in mixing.mixed_texts(mixed, docs).collect()} == texts


def some_rows():
    text = lambda seed, n: " ".join(f"{seed}w{i}" for i in range(n))
    rows = [(i, f" {text(i, i * 7 % 23)}\t\n", ["a", "b", "é", None, "z"][i * i % 5]) for i in range(60)]
    rows += [(100, text("long", 900), "a"), (101, None, "b"), (102, "", "a"), (103, " \x0b\r", None), (None, text("n", 5), "a"), (None, text("n", 5), "b"), (104, "\x1c \x85 word", "y")]
    return rows + [(7, "one and the same row", "b")] * 9 + [(None, None, "a")] * 5


@pytest.mark.parametrize(("weights", "share", "most", "block", "per_shard"), [([3, 1, 2], 1.5, 2, 16, 8), ([1], 1.0, 1, 10, 4), ([1, 3], 0.4, 1, 9, 5), ([5, 1], 1.9, 2, 7, 3), ([1, 9], 2.5, 3, 64, 5), ([3, 1, 2], 2.0, 2, 2048, 512)])
def test_mix_equals_brute_force(spark, weights, share, most, block, per_shard):
    check(spark, some_rows(), weights, share, most, block, per_shard)


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    mixed = mixing.mix(docs, [3, 1])
    assert sorted((r.id, r.size, r.n, r.shard) for r in mixed.spans.collect()) == [(1, 0, 0, None), (2, 0, 0, None)] and mixed.slots.count() == 0
    assert mixing.mix(docs.where("false"), [3, 1]).spans.count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, [0, 1])


def test_many_equal_rows_and_counts_per_shard(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 4)
    check(spark, [(1, "a b c", "x")] * 50 + [(2, "d e", "y")] * 3, [1, 1], 1.2, 2, 4, 4)
    # Shards draw for themselves: with equal weights counts spread as they do by chance.
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    counts = mixing.mix(docs, [1, 1], 1.0, 2, 2, 64).slots.where("s = 0").groupBy("shard").count().collect()
    spread = sum((r["count"] - 32) ** 2 for r in counts) / len(counts)
    assert 8 < spread < 28  # 64 draws of 1 in 2 have a variance of 16


def test_query_equals_brute_force_and_reruns_agree(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = lambda: sorted(((r.doc_id, r["size"], r.source_size, r.taken, r.source) for r in mixing.op12_mixing(spark, d).collect()), key=str)
    assert found() == slow(rows, [3, 1, 2], 1.5, 2, mixing.BLOCK, mixing.SLOTS)[2] == found()
