import hashlib
import random
import struct

import public_tokenizers
import tiktoken

from siftline.llm import bpe

RANKS = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def expected(text):
    ids = ENCODING.encode_ordinary(text or "")
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_pieces_equal_the_merges():
    codec, rng = bpe.Codec(RANKS, remembered=50), random.Random(1)
    for _ in range(2000):
        piece = "".join(rng.choice("abcdeinrst éß字🎉-='\x00") for _ in range(rng.randrange(1, 30)))
        assert b"".join(codec.tokens(piece.encode())) == piece.encode()
        assert [RANKS[t] for t in codec.tokens(piece.encode())] == ENCODING._encode_single_piece(piece.encode())


def test_long_pieces_take_linear_time():
    codec = bpe.Codec(RANKS)
    for piece in ["a" * 20000, "ab" * 10000, "-" * 20000, "aab" * 7000]:
        assert [RANKS[t] for t in codec.tokens(piece.encode())] == ENCODING.encode_ordinary(piece)


def test_digests_nulls_repeats_and_round_trip(spark):
    texts = [None, "", "The same\n\n  text's  here", "The same\n\n  text's  here", "ünïcode 字 🎉" * 50, "x" * 30000, " "]
    docs = spark.createDataFrame([(None if i == 6 else i, t, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = sorted(((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()))
    assert got == sorted(map(expected, texts))
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for t in texts)
    assert bpe.digests(docs.where("false")).count() == 0


def test_query_equals_tiktoken(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10_byte_bpe(spark, d).collect()}
    assert got == {i: expected(t) for i, t in texts.items()}
