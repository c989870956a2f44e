import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from siftline.llm import fingerprints as fp


def expected(rows):
    ordered = sorted(rows)
    out = {}
    for at, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        tail = len(text) // 4
        edited = text[: len(text) - tail] + following[:tail]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, following)
    return out


def slow_pieces(paragraph):
    """A paragraph cut after each code point at which the hash of it and the two before says so."""
    out, begin, whole = [], 0, (1 << 32) - 1
    for at in range(len(paragraph)):
        c = [ord(paragraph[at - back]) if at >= back else 0 for back in range(3)]
        mixed = (c[0] * 0x9E3779B1 ^ c[1] * 0x85EBCA77 ^ c[2] * 0xC2B2AE3D) & whole
        mixed = (mixed ^ mixed >> 15) * 0x27D4EB2F & whole
        if (mixed >> 8) % fp.PIECE == 0 or at == len(paragraph) - 1:
            out.append(paragraph[begin : at + 1])
            begin = at + 1
    return out


def slow_fingerprint(text):
    entries = [0] * (fp.PARAGRAPH + fp.SIGNS)
    for paragraph in (text or "").split("\n"):
        digest = hashlib.shake_128(paragraph.encode()).digest(4 * fp.PARAGRAPH)
        for e in range(fp.PARAGRAPH):
            entries[e] += int.from_bytes(digest[4 * e : 4 * e + 4], "little")
        for piece in slow_pieces(paragraph):
            bits = xxhash.xxh3_128_digest(piece.encode())
            for e in range(fp.SIGNS):
                entries[fp.PARAGRAPH + e] += 1 if bits[e // 8] >> e % 8 & 1 else -1
    return [e % (1 << 32) for e in entries]


def slow_likeness(a, b):
    signed = lambda v: [x - (1 << 32) if x >> 31 else x for x in v[fp.PARAGRAPH :]]
    one, two = signed(a), signed(b)
    whole, apart = sum(x * x for x in one + two), sum((x - y) ** 2 for x, y in zip(one, two, strict=True))
    return 1.0 if a == b else 0.0 if not whole else min(1 - 1e-9, max(0.0, 1 - apart / whole))


def as_text(entries):
    return b"".join(e.to_bytes(4, "little") for e in entries).hex()


def checked(got, rows):
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        n, digest, edited, following = want[r[0]]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        own, changed, after = (slow_fingerprint(t) for t in (dict(rows)[r[0]], edited, following))
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(own), as_text(changed))
        assert (round(r.near_edited, 9), round(r.near_next, 9)) == (round(slow_likeness(own, changed), 9), round(slow_likeness(own, after), 9))


def test_adding_and_removing_in_any_order():
    rng = random.Random(7)
    parts = [" ".join(str(rng.random()) for _ in range(rng.randrange(9))) for _ in range(600)]
    whole = fp.text_fingerprint("\n".join(parts))
    assert np.array_equal(whole, fp.text_fingerprint("\n".join(parts[::-1])))
    grown = fp.text_fingerprint("\n".join(parts[:-3]))
    for p in parts[-3:]:
        grown = fp.added(grown, p)
    assert np.array_equal(whole, grown)
    assert np.array_equal(fp.removed(grown, parts[5]), fp.text_fingerprint("\n".join(parts[:5] + parts[6:])))
    assert not np.array_equal(whole, fp.text_fingerprint("\n".join([*parts[:-1], parts[0]])))
    assert np.array_equal(fp.read(fp.written(whole)), whole)


def test_many_equal_paragraphs_are_not_none():
    for n in (1 << 16, 1 << 17):
        many = fp.text_fingerprint("a\n" * n)
        assert many.any() and fp.likeness(many, fp.text_fingerprint("")) == 0.0
    assert not np.array_equal(fp.text_fingerprint(""), fp.text_fingerprint("\n"))


def test_an_insertion_is_local():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500))
    own = fp.text_fingerprint(text)
    for edited in ("x" + text, text[:1700] + " more words here" + text[1700:], text + "."):
        assert 0.95 < fp.likeness(own, fp.text_fingerprint(edited)) < 1


def test_likeness_is_near_the_true_share():
    parts = [f"piece {i} of a text" for i in range(400)]
    for shared in (0, 100, 200, 300, 400):
        other = parts[:shared] + [f"other {i} of a text" for i in range(400 - shared)]
        a, b = (Counter(p for x in some for p in slow_pieces(x)) for some in (parts, other))
        true = 2 * sum(a[p] * b[p] for p in a) / sum(n * n for n in [*a.values(), *b.values()])
        assert abs(fp.likeness(*(fp.text_fingerprint("\n".join(p)) for p in (parts, other))) - true) < 0.15


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = fp.op7_fingerprints(spark, d).collect()
    checked(got, rows)
    assert np.mean([r.near_edited for r in got]) > 0.6 and np.mean([r.near_next for r in got]) < 0.2


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, id int"
    rows = [(5, None), (-3, ""), (9, "x"), (11, "é字🎉z" * 9), (12, "a\n" * 50), (40, "same"), (41, "same"), (1 << 40, "y" * 20000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], schema)
    for ranges in (1, 3, 50):
        checked(fp.compared_with_next(docs, ranges).collect(), rows)
    assert fp.compared_with_next(docs.where("false")).count() == 0
    checked(fp.compared_with_next(docs.where("doc_id = 11")).collect(), [rows[3]])
    repeated = docs.union(docs).union(spark.createDataFrame([(None, "null id", 1)] * 2, schema))
    assert fp.compared_with_next(repeated, 5).count() == 18
