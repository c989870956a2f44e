import hashlib

import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

import corpus_pipeline as cp
from siftline.llm import bpe, toxicity
from tests_llm_brute import jaccard, near_pairs, slow_contained, slow_lines


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns

    calm = cp.drop_toxic(spark, docs, d)
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    graded = docs.select("doc_id", toxicity.graded(F.col("text"), model)["p_toxic"].alias("p")).collect()
    assert sorted(r.doc_id for r in calm.collect()) == sorted(r.doc_id for r in graded if r.p < toxicity.REJECTED)
    assert calm.columns == columns

    rows = {r.doc_id: r for r in calm.collect()}
    cleaned = cp.drop_repeated_lines(spark, calm, d)
    expected = {i: t for i, t in slow_lines([(r.doc_id, r.text) for r in rows.values()]).items() if t == rows[i].text or t.strip()}
    got = {r.doc_id: r for r in cleaned.collect()}
    assert {i: r.text for i, r in got.items()} == expected and cleaned.columns == columns and cleaned.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert all(r.n_chars == (len(r.text) if r.text != rows[i].text else rows[i].n_chars) for i, r in got.items())

    apart = cp.drop_near_copies(spark, cleaned, d)
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    kept = {r.doc_id for r in apart.collect()}
    assert apart.columns == columns
    assert not [p for p in near_pairs({i: texts[i] for i in kept}, 0.8)]
    for i in set(texts) - kept:
        assert any(jaccard(texts[i], texts[j]) >= 0.8 for j in texts if j != i)

    clean = cp.drop_leaks(spark, apart, d)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaking = {i for i, *_ in slow_contained([(i, texts[i]) for i in kept], items)}
    assert {r.doc_id for r in clean.collect()} == kept - leaking and clean.columns == columns

    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in cp.run(spark, d).collect()}
    assert final == {i: (len(coder.encode_ordinary(texts[i])), hashlib.sha256(texts[i].encode()).hexdigest()) for i in kept - leaking}


def test_odd_rows_go_through_all_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    schema = StructType([*docs.schema.fields, StructField("k", StringType()), StructField("row", IntegerType())])
    odd = spark.createDataFrame(
        [
            (None, None, None, None, None, "a", 1),
            (None, "no id here at all", "en", "s", 17, "b", 2),
            (1, "another text with an id that is taken", "en", "s", 37, "c", 3),
            (1, "another text with an id that is taken", "en", "s", 37, "c", 3),
            (9001, "", "en", "s", 0, "d", 4),
            (9002, "word " * 60000, "en", "s", 300000, "e", None),
        ],
        schema,
    )
    for part in (odd, odd.where("false")):
        now = part
        for name, stage in cp.STAGES:
            now = stage(spark, now, d)
            assert name == "byte_bpe" or now.columns == part.columns
        found = sorted(((r.doc_id, r.n_tokens) for r in now.collect()), key=str)
        assert [i for i, _ in found] == ([1, 9001, 9002, None] if part is odd else [])


def test_words_of_the_regex_used_here():
    assert regex.findall(r"[\p{L}\p{N}]+", "Ab-9 é") == ["Ab", "9", "é"]
