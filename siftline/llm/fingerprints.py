"""Document fingerprints that add up: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph is a line. Each is hashed to ``PARAGRAPH`` whole 32-bit numbers, and the fingerprint is their
sum, each entry modulo 2^32. The order of paragraphs does not matter, inserting or deleting one adds or subtracts its
vector, the fingerprint of two texts together is the sum of theirs, and texts with different paragraphs, or the
same ones in different numbers, have different sums but for a chance of 2^-1024.

Such sums say nothing of how much two texts share, so a second part of the fingerprint does: each paragraph is cut
where the hash of three neighbouring code points says so, which an insertion elsewhere does not move, and each piece is hashed to
``SIGNS`` entries of +1 or -1, which are summed modulo 2^32 as well. The squared length of the difference of two such
sums, over ``SIGNS``, estimates the sum of squares of the differences of the pieces' counts, and so the texts' likeness: twice the
sum of the products of their counts over the sums of their squares, which for pieces that stand once is twice what
both have over what either has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import arrow_rows, table

PARAGRAPH, SIGNS = 32, 128
#: Code points of a piece, on average.
PIECE = 24
#: Bytes of text of a range of ids.
RANGE_BYTES = 64 << 20
#: Rows that are added up at a time.
SLAB = 255
#: A byte's bits, each in a byte lane of a 64-bit word: 255 such words add up without a carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def paragraphs(text: str) -> list[str]:
    return text.split("\n")


def pieces(text: str) -> list[str]:
    """The paragraphs of a text cut by their content; empty ones are none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return []
    line_end = codes == 10
    # What stands before a paragraph has no part in where it is cut.
    mixed = codes * np.uint32(0x9E3779B1)
    mixed[1:] ^= codes[:-1] * ~line_end[:-1] * np.uint32(0x85EBCA77)
    mixed[2:] ^= codes[:-2] * ~(line_end[:-2] | line_end[1:-1]) * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x27D4EB2F)
    ends = np.flatnonzero((mixed >> np.uint32(8)) % np.uint32(PIECE) == 0) + 1
    ends = np.union1d(ends, np.flatnonzero(line_end))
    bounds = np.union1d(np.concatenate([[0], ends, [len(text)]]), np.flatnonzero(line_end) + 1).tolist()
    return [p for p in map(text.__getitem__, map(slice, bounds[:-1], bounds[1:])) if p != "\n"]


def encoded(part: str) -> bytes:
    return part.encode("utf-8", "surrogatepass")


def paragraph_sum(parts: list[str]) -> np.ndarray:
    """The sum, modulo 2^32, of the vectors of paragraphs."""
    total = np.zeros(PARAGRAPH, dtype=np.uint32)
    for at in range(0, len(parts), SLAB):
        some = b"".join([hashlib.shake_128(encoded(p)).digest(4 * PARAGRAPH) for p in parts[at : at + SLAB]])
        total += np.frombuffer(some, dtype="<u4").reshape(-1, PARAGRAPH).sum(axis=0, dtype=np.uint32)
    return total


def sign_sum(parts: list[str]) -> np.ndarray:
    """The sum, modulo 2^32, of the signs of pieces."""
    ones = np.zeros(SIGNS, dtype=np.int64)
    for at in range(0, len(parts), SLAB):
        bits = b"".join([xxhash.xxh3_128_digest(encoded(p)) for p in parts[at : at + SLAB]])
        rows = np.frombuffer(bits, dtype=np.uint8).reshape(-1, SIGNS // 8)
        ones += LANES[rows].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return (2 * ones - len(parts)).astype(np.uint32)


def text_fingerprint(text: str | None) -> np.ndarray:
    """``PARAGRAPH`` entries of the paragraphs, then ``SIGNS`` entries of their pieces; a null text is empty, which is one empty paragraph."""
    text = text or ""
    return np.concatenate([paragraph_sum(paragraphs(text)), sign_sum(pieces(text))])


def added(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint with a paragraph, of one line, more."""
    return fingerprint + text_fingerprint(paragraph)


def removed(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return fingerprint - text_fingerprint(paragraph)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: twice the products of the pieces' counts over their squares, as estimated from two fingerprints; 1 just for equal ones."""
    if np.array_equal(a, b):
        return 1.0
    signed = [v[PARAGRAPH:].view(np.int32).astype(np.float64) for v in (a, b, a - b)]
    squares = [float(v @ v) for v in signed]
    whole = squares[0] + squares[1]
    return 0.0 if whole == 0 else min(1.0 - 1e-9, max(0.0, 1.0 - squares[2] / whole))


def written(fingerprint: np.ndarray) -> str:
    return fingerprint.astype("<u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype="<u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``fingerprint`` (32-bit integers in hex) for each row; a null text is empty.

    Texts with the same paragraphs, in whatever order, have the same first part. Repeated rows and null ids stay; an empty
    table gives none; other columns are not read; a text is read whole, however long.
    """

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in source:
            yield key, written(text_fingerprint(text))

    narrow = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    return arrow_rows(narrow, rows, "id bigint, fingerprint string", [pa.int64(), pa.string()])


def _placed(bounds: np.ndarray):
    """Pandas UDF: the ranges that a row goes to: its own, and the one before if its id is the first of its own."""

    @F.pandas_udf("array<int>")
    def ranges(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy()
        own = np.searchsorted(bounds, values, side="right") - 1
        before = np.where(bounds[own] == values, (own - 1) % len(bounds), -1)
        return pd.Series([[int(r)] if b < 0 else [int(r), int(b)] for r, b in zip(own, before, strict=True)])

    return ranges


def with_next(docs: DataFrame, ranges: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows dealt in ``ranges`` ranges of ascending ids: ``range``, ``visits``, ``id``, ``text``; by default as many as hold ``RANGE_BYTES`` each.

    Each range's rows are sorted and followed by the first row of the range after it, for which
    ``visits`` is 1; after the last range the first one's comes. Spark's own range partitioning of the ids alone finds the ranges, and
    only the least id of each passes through the driver: 8 bytes for ``RANGE_BYTES`` of text. The texts are shuffled once, into as many tasks
    as there are ranges.
    """
    order: Column = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(order.alias("o"))
    if ranges is None:
        n_bytes = docs.agg(F.sum(F.octet_length(text_column))).head()[0] or 0
        ranges = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // RANGE_BYTES))
    firsts = ids.repartitionByRange(ranges, "o").groupBy(F.spark_partition_id()).agg(F.min("o").alias("o")).select("o").toPandas()["o"]
    bounds = np.sort(firsts.to_numpy(dtype=np.int64)) if len(firsts) else np.zeros(1, dtype=np.int64)
    placed = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), order.alias("o")
    ).select("id", "text", "o", F.posexplode(_placed(bounds)("o")).alias("visits", "range"))
    return (
        placed.withColumn("tie", F.xxhash64("text"))
        .repartition(ranges, "range")
        .sortWithinPartitions("range", "visits", "o", "tie")
        .select("range", "visits", "id", "text")
    )


def compared_with_next(docs: DataFrame, ranges: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses to the edited and to the next text.

    The edited text has the last quarter of its code points replaced by as many of the start of the
    next text, in order of ids; the last is followed by the first, a text alone by itself. Rows
    with the same id follow each other in an order that depends on their texts; null ids come
    first; null texts are empty; repeated rows stay repeated; an empty table gives none; other columns are not read. Rows
    with one id, or without, lie in one range, which one task reads in order.
    """

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        place, before, done = None, None, False
        for where, visits, key, text in source:
            text = text or ""
            now = (key, text, text_fingerprint(text))
            if where != place:
                place, before, done = where, None, False
            if done:
                continue  # only the first of the visiting rows follows the last of the range
            if before is not None:
                yield compared(*before, *now[1:])
            before, done = now, visits == 1

    def compared(key, text: str, print_: np.ndarray, following: str, following_print: np.ndarray) -> tuple:
        tail = len(text) // 4
        edited = text[: len(text) - tail] + following[:tail]
        edited_print = text_fingerprint(edited)
        return (
            key,
            len(text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            written(print_),
            written(edited_print),
            likeness(print_, edited_print),
            likeness(print_, following_print),
        )

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return arrow_rows(with_next(docs, ranges, id_column, text_column), rows, schema, types, 2048)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of every whole text of ``documents``."""
    return compared_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_fingerprints": op7_fingerprints}
ORACLES: dict[str, str] = {}
