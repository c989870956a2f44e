import random
from functools import lru_cache

import public_tokenizers

from siftline.llm import tokencount as tc

PIECES = tc.read_pieces(public_tokenizers.path(tc.VOCABULARY))
RARE = min(PIECES.values()) - tc.SCALE


@lru_cache(100_000)
def slow(token):
    """Best score and, among the best, fewest pieces, over all cuts."""
    best = [(0, 0)]
    for end in range(1, len(token) + 1):
        size = len(token[end - 1].encode())
        options = [(best[end - 1][0] + size * RARE, -(best[end - 1][1] + size))]
        for begin in range(max(0, end - 40), end):
            if token[begin:end] in PIECES:
                options.append((best[begin][0] + PIECES[token[begin:end]], -(best[begin][1] + 1)))
        score, count = max(options)
        best.append((score, -count))
    return best[-1]


def expected(text):
    tokens = (text or "").split()
    found = [slow(tc.BEGIN + t) for t in tokens]
    return len(tokens), sum(n for _, n in found), sum(s for s, _ in found) / tc.SCALE


def test_counts_equal_brute_force_and_prefixes_are_shared():
    rng = random.Random(5)
    trie = tc.Trie(PIECES)
    tokens = ["".join(rng.choice("théngr字🎉a") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    tokens += [t[: rng.randrange(1, len(t) + 1)] for t in tokens]
    for t in tokens:
        score, count = slow(tc.BEGIN + t)
        assert trie[t] == (count, score)
    prefixes = {t[:n] for t in tokens for n in range(len(t) + 1)}
    assert trie.made == len(prefixes)


def test_a_trie_that_starts_afresh_counts_alike():
    small, large = tc.Trie(PIECES, 50, 10), tc.Trie(PIECES)
    tokens = [f"word{i % 97}ing{i % 7}" for i in range(2000)]
    assert [small[t] for t in tokens] == [large[t] for t in tokens]


def test_a_long_pre_token_makes_no_nodes():
    trie, large = tc.Trie(PIECES, 60, 10), tc.Trie(PIECES)
    tokens = ["thing" * 40, "the", "x" * 31, "字🎉" * 20, "thing" * 5]
    assert [trie[t] for t in tokens] == [large[t] for t in tokens] == [slow(tc.BEGIN + t)[::-1] for t in tokens]
    assert len(trie.score) <= 60


def test_query_and_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens, r.log_score) for r in tc.op2_token_counts(spark, d).collect()}
    assert got == {i: expected(t) for i, t in texts.items()}
    odd = [(None, "a b"), (1, None), (2, ""), (2, ""), (3, " \n\t"), (4, "x" * 20000), (5, "word " * 20000)]
    docs = spark.createDataFrame([(*r, 1) for r in odd], "doc_id bigint, text string, n_tokens int")
    rows = [(r.id, r.n_pretokens, r.n_tokens, r.log_score) for r in tc.token_counts(docs).collect()]
    assert sorted(rows, key=str) == sorted([(i, *expected(t)) for i, t in odd], key=str)
    assert tc.token_counts(docs.where("false")).count() == 0
