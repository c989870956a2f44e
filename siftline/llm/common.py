"""What several corpus operators share: reading, cutting lineage, Arrow loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every whitespace-separated operator here calls white space.
ASCII_SPACE = r"[\x20\x09-\x0D]"
#: A key of a join is hot if it has over one in so many of the rows.
HOT_KEYS = 1000
#: ... or if it has over so many rows, however many there are in all: what one task may get of a key.
HOT_ROWS = 5_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # With one machine alone its own folder is shared.
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siftline-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(id_column: str, text_column: str) -> Column:
    """A key of 128 bits of a document's row: rows with the same id and the same text share it, nulls included."""
    told = lambda c: F.when(c.isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("\x01"), c))
    return F.unhex(F.md5(F.concat(told(F.col(id_column).cast("string")), F.lit("\x02"), told(F.col(text_column))).cast("binary")))


def joined_with_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str, values: list[str], spread: Column) -> DataFrame:
    """Inner join of ``left`` with ``values`` of ``right``, where a key may stand in any share of the rows.

    ``right`` has a row for each key and in ``n`` a count that grows with the key's rows in ``left``; it must
    be written, as it is read twice. Keys with over one in ``HOT_KEYS`` of all counts or over ``HOT_ROWS`` are hot, so no task gets more of one key
    at any size. They are fewer than ``HOT_KEYS`` and one for ``HOT_ROWS`` of all counts together (a million for 5 * 10^12), and broadcast;
    rows that these match pass the other keys' join dealt by ``spread`` instead of by the key. ``left`` is read once.
    """
    total = right.agg(F.sum(n)).head()[0] or 0
    is_hot = F.col(n) > min(total // HOT_KEYS, HOT_ROWS)
    hot = right.where(is_hot).select(*keys, F.lit(True).alias("__hot"), *[F.col(v).alias(f"__{v}") for v in values])
    # Always 0, but not to the optimizer: a constant would be folded out of the join, and hot rows be dealt by the key again.
    zero = (F.col(n) % 1).cast("long")
    rest = right.where(~is_hot).select(*keys, zero.alias("__part"), F.lit(True).alias("__met"), *values)
    marked = left.join(F.broadcast(hot), keys, "left")
    dealt = marked.withColumn("__part", F.when(F.col("__hot"), spread).otherwise(F.lit(0).cast("long")))
    met = dealt.join(rest, [*keys, "__part"], "left").where("__hot OR __met")
    return met.select(*[met[c] for c in left.columns], *[F.coalesce(F.col(f"__{v}"), F.col(v)).alias(v) for v in values])


def arrow_rows(
    df: DataFrame,
    rows: Callable[[Iterator[tuple]], Iterator[tuple]],
    schema: str,
    types: list[pa.DataType],
    batch: int = 4096,
) -> DataFrame:
    """``mapInArrow`` for a function from the partition's rows to result rows.

    The rows of a partition come one after another in the partition's order; results leave in
    batches of ``batch`` rows, so memory stays bounded by two batches.
    """
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 512).columns), strict=True)

        out: list[tuple] = []
        for r in rows(flat()):
            out.append(r)
            if len(out) >= batch:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns: Any = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names
        )

    return df.mapInArrow(run, schema)
