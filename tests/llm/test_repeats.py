import hashlib
import random
import re
from collections import Counter

import numpy as np

from siftline.llm import repeats


def slow(rows, length=repeats.LENGTH):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone[:-1]])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted(
        ((r.id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in repeats.drop_repeats(docs).collect()),
        key=str,
    )


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéñßst") for _ in range(rng.randrange(1, 9))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    passages = [words(rng, 120) for _ in range(4)]
    exact, base = passages[0].encode()[:399].decode(errors="ignore"), words(rng, 300).split()
    rows = [(i, words(rng, 40) + passages[i % 4] + words(rng, 30) + passages[(i * i) % 3]) for i in range(24)]
    rows += [(100 + i, exact) for i in range(2)] + [(110, passages[1].encode()[:400].decode(errors="ignore") + "#")]
    for i in range(30):
        edited = list(base)
        for _ in range(rng.randrange(3)):
            edited[rng.randrange(300)] = words(rng, 1)
        rows.append((200 + i, " ".join(edited)))
    rows += [(300, "a" * 1200), (301, "ab" * 500), (302, "xyz" + "a" * 399), (303, None), (304, ""), (303, None)]
    rows += [(None, rows[3][1]), (305, rows[5][1]), (305, rows[5][1]), (306, words(rng, 3000))]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, k string, lo int")
    assert found(docs) == slow(rows)
    assert repeats.drop_repeats(docs.where("false")).count() == 0


def test_anchors_taken_apart_and_texts_in_stretches(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for module_value, value in [("INDEXED", 3), ("INDEXED", 1)]:
        monkeypatch.setattr(repeats, module_value, value)
        assert found(docs) == slow(rows)


def test_stretches_of_a_long_text(monkeypatch):
    import pyarrow as pa
    import zstandard

    rng = random.Random(9)
    data = words(rng, 4000).encode()
    packed = [zstandard.compress(t) for t in (data, b"short", b"")]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(packed, type=pa.binary())], names=["k", "packed"])

    def covered():
        pairs = [r for b in repeats._anchors(iter([batch]), True) for r in b.to_pylist()]
        anchors = pa.array([[r["a"] for r in pairs if r["k"] == k] for k in (1, 2, 3)], type=pa.list_(pa.int64()))
        rows = [r for b in repeats._placed(iter([batch.append_column("anchors", anchors)])) for r in b.to_pylist()]
        of_bytes = {(r["k"], p) for r in rows if r["kind"] == repeats.OF_BYTES for p in range(r["lo"], r["hi"] + 1)}
        of_words = {p for r in rows if r["kind"] == repeats.OF_WORDS for p in range(r["lo"], r["upto"])}
        return of_bytes, of_words

    whole = covered()
    monkeypatch.setattr(repeats, "CHUNK", 5000)
    monkeypatch.setattr(repeats, "CHUNK_WORDS", 333)
    assert covered() == whole == ({(1, p) for p in range(len(data) - repeats.LENGTH + 1)}, set(range(len(data))))


def slow_passages(rows, n=repeats.WORDS):
    windows, count = [], Counter()
    for _, text in rows:
        data = (text or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        windows.append([(at[i][0], at[i + n - 1][1]) for i in range(len(at) - n + 1)])
        count.update(data[lo:hi] for lo, hi in windows[-1])
    out = []
    for (i, text), some in zip(rows, windows, strict=True):
        data = (text or "").encode()
        out.append((i, [tuple(s) for s in repeats.joined_spans([(lo, hi) for lo, hi in some if count[data[lo:hi]] > 1])]))
    return sorted(out, key=str)


def test_passages_equal_brute_force(spark):
    rng = random.Random(8)
    short = [" ".join(rng.choice("abcdefghij") + rng.choice("klmno") for _ in range(n)) for n in (49, 50, 51, 70)]
    rows = [*corpus(), *[(400 + i, words(rng, 9) + " " + short[i % 4] + " " + words(rng, 7)) for i in range(12)], (420, short[3].replace(" ", "\n"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(((r.id, [(p.lo, p.hi) for p in r.passages]) for r in repeats.drop_repeats(docs).collect()), key=str)
    want = slow_passages(rows)
    assert got == want
    caught = {i for i, p in want if p}
    assert {401, 402, 403} <= caught and not caught & {400, 404, 408, 420}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = repeats.op5_repeats(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == slow(rows)
    assert {r.doc_id: r.n_passage_bytes for r in got} == {i: sum(hi - lo for lo, hi in p) for i, p in slow_passages(rows)}


def test_index_of_repetitive_texts():
    rng = random.Random(2)
    for trial in range(60):
        base = "".join(rng.choice("ab") for _ in range(60))
        texts = []
        for _ in range(rng.randrange(1, 8)):
            t = list(base[rng.randrange(30) :])
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice("abc")
            texts.append("".join(t).encode())
        length = rng.randrange(1, 25)
        index = repeats.RunIndex(texts)
        got = {p for lo, hi in zip(*index.long_matches(length), strict=True) for p in range(lo, hi + 1)}
        count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
        starts = np.cumsum([0, *map(len, texts)])
        assert got == {int(s) + p for s, t in zip(starts, texts, strict=False) for p in range(len(t) - length + 1) if count[t[p : p + length]] > 1}
        assert len(index.symbols) <= len(index.data)
