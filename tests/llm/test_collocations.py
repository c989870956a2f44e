import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import collocations as co

LOWER = {c: c + 32 for c in range(65, 91)}


def slow(rows, min_count=10, share=50, most=2000):
    f, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                f.setdefault(lang, Counter()).update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        found, longest = [], Counter()
        for phrase, a in counts.items():
            words = phrase.split(" ")
            if len(words) < 2 or a < min_count:
                continue
            cuts = [(1_000_000 * a * a // (counts[" ".join(words[:k])] * counts[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.append((-score, -a, phrase.encode(), counts[" ".join(words[:k])], counts[" ".join(words[k:])]))
            for x in (words[:2], words[1:]) if len(words) == 3 else ():
                longest[" ".join(x)] = max(longest[" ".join(x)], a)
        kept = sorted(x for x in found if 100 * longest[x[2].decode()] < share * -x[1])
        out += [(lang, at, p.decode(), -a, left, right, totals[lang], -s) for at, (s, a, p, left, right) in enumerate(kept[:most], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def some_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", "new", "york", "NEW", "grüße", "日本", "x\x1cy", "\x85", "É"] + [f"w{rng.randrange(400)}"])
    text = lambda n: "".join(rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\r\n", "! "]) + word() for _ in range(n))
    rows = [(rng.choice(["en", "de", None, ""]), text(rng.randrange(60))) for _ in range(400)]
    rows += [("en", "new york city hall"), ("und", "a b c a b c. a b c"), ("en", None), (None, ""), ("fr", "peu"), ("en", " .,;:!?\n\t ")] * 12
    return rows + [("en", text(4000)), ("de", "na " * 3000 + "na"), ("en", "y" * 50_000 + " z")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, f int")


@pytest.mark.parametrize(("min_count", "share", "most", "cells"), [(10, 50, 2000, None), (1, 100, 7, 1 << 14), (3, 1, 2000, 1 << 16), (300, 50, 2000, None)])
def test_collocations_equal_brute_force(spark, min_count, share, most, cells):
    rows = some_rows()
    docs = table(spark, rows).repartition(5)
    assert got(co.collocations(docs, min_count, share, most, cells)) == slow(rows, min_count, share, most)


def test_small_bounds_change_nothing(spark, monkeypatch):
    rows = some_rows(2)
    want = slow(rows)
    # Tasks take their constants with their functions, so what is patched here reaches none; the counting itself is called instead.
    for name, value in {"WORDS": 50, "NUMBERED": 40, "PHRASES": 100, "SLICE": 64}.items():
        monkeypatch.setattr(co, name, value)
    total, words = Counter(), Counter()
    for lang, keys, counts, numbers, n in co.phrases(((lang or "und") if lang != "" else "", text or "") for lang, text in rows):
        words[lang] += n
        for key, f in zip(keys.tolist(), counts.tolist(), strict=True):
            ids = [i for i in (key >> 42, key >> 21 & (1 << 21) - 1, key & (1 << 21) - 1) if i]
            total[lang, b" ".join(numbers.words[i] for i in ids).decode()] += f
    assert {x[0]: x[6] for x in want}.items() <= words.items()
    for lang, _, phrase, a, left, right, _, _ in want:
        assert total[lang, phrase] == a and {left, right} <= set(total.values())


def test_a_sketch_never_counts_too_little(spark):
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(200))) for _ in range(60)]
    docs = table(spark, rows).select("lang", "text").repartition(4)
    bits = {r.block: np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8)) for r in co.reached(co.sketched(docs, 1 << 14, 10), 10).collect()}
    true = Counter(w for _, t in rows for w in t.split())
    numbers = co.Numbers()
    for word, n in true.items():
        cells = [int(x[0]) + row * (1 << 14) for row, x in enumerate(co.places("en", np.array([numbers[word.encode()]]), numbers, 1 << 14))]
        assert n < 10 or all(bits[c // co.BLOCK][c % co.BLOCK] for c in cells)
    rare = [w for w, n in true.items() if n < 5]
    kept = {r.phrase for r in co.survivors(docs, 10, 1 << 14).collect()}
    assert rare and not kept & set(rare) and {w for w, n in true.items() if n >= 10} <= kept


def test_scores_past_64_bits(spark):
    counts = [(10**15, 10**15 + 7, 3 * 10**15), (9_999_999_999_999_999, 9_999_999_999_999_999, 9_999_999_999_999_999), (10, 13, 7_000_000_000), (1, 1, 1)]
    rows = spark.createDataFrame(counts, "a long, l long, r long").select("*", co.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [(r.a, r.s) for r in rows] == [(a, 1_000_000 * a * a // (x * y)) for a, x, y in counts]


def test_empty_table_and_bounds(spark):
    docs = table(spark, some_rows())
    assert co.collocations(docs.where("false")).count() == 0 and co.collocations(docs.where("text IS NULL")).count() == 0
    assert [co.cells_for(n) for n in (0, 1 << 30, 1 << 60)] == [1 << 16, 1 << 26, 1 << 26]
    with pytest.raises(ValueError):
        co.collocations(docs, cells=1000)


def test_query_equals_brute_force_and_sql(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = got(co.op11_collocations(spark, d))
    assert found == slow(rows) and found
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    assert sorted(db.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({co.ORACLES['op11_collocations']})").fetchall()) == found
