"""From raw documents to encodable ones: toxicity, repeated lines, near copies, benchmark leaks, BPE.

Each stage takes what its predecessor kept. All but the last return the columns of the documents
they are given; decisions are made on whole rows, so rows with the same id and different texts,
null ids and repeated rows are each decided by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, decontaminate, lines, simhash, toxicity
from siftline.llm.common import row_key, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade stays below the operator's bound."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.graded(F.col("text"), model)["p_toxic"] < toxicity.REJECTED)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; documents of which nothing is left go.

    A text that loses no line stays as it is, null and empty ones included; ``n_chars``, if there
    is such a column, follows the text.
    """
    cleaned = lines.drop_lines(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    lost = F.col("n_dropped") > 0
    text = F.when(lost, F.col("kept_text")).otherwise(F.col("row.text"))
    kept = cleaned.where(~lost | (F.trim(F.regexp_replace("kept_text", r"\s+", " ")) != ""))
    changed = {"text": text} | ({"n_chars": F.when(lost, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id; of repeated rows one."""
    groups = simhash.similar_texts(docs)
    kept = groups.where(F.col("k") == F.col("keeper")).select("k")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("k"))
    # Rows of one key differ in their other columns alone; which stays is settled as they are added up, however many there are.
    one = keyed.join(kept, "k", "left_semi").groupBy("k").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than four fifths of every benchmark item."""
    leaks = decontaminate.contained(docs, table(spark, sf_dir, "benchmark")).select("k").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("k"))
    return keyed.join(leaks, "k", "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: A fitted classifier and fingerprints are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def forget(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again; what a stage wrote goes once the next has written."""
    folder = shared_folder(spark, "corpus_pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        if before:
            forget(spark, before)
        docs, before = spark.read.parquet(now), now
    return STAGES[-1][1](spark, docs, sf_dir)
