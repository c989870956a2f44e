"""State tables: written steps, histories, snapshots, replaced partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session without one gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siftline-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows written to the session's checkpoint folder and read again, so that plans of rounds stay short
    and lost executors cost no more than the round."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to as many partitions as the session shuffles to. Adaptive execution puts others together by their compressed bytes, and columns that compress
    well may take a hundred times as much once they are sorted or gathered; partitions of a given number it leaves alone. Not for keys that may have any share of the rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Rounds:
    """Tables that rounds of an iteration write to the shared folder, each of which can be removed once nothing reads it any more.

    Their files are removed with Hadoop's own calls, through the session's JVM: a classic session is needed, not one of Spark Connect.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.n = spark, f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}", 0
        self.places: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        place = f"{self.folder}/{self.n:05d}"
        df.write.parquet(place)
        kept = self.spark.read.schema(df.schema).parquet(place)
        self.places.append((kept, place))
        return kept

    def drop(self, *gone: DataFrame) -> None:
        for place in [p for df, p in self.places if any(df is g for g in gone)]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Writes rows in place of all rows of their partitions; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def next_version(rows: DataFrame, path: str, version: int) -> str:
    """A new version of a state table in a folder of its own; a reader of the last one is not disturbed."""
    target = f"{path}/version={version:06d}"
    rows.write.mode("errorifexists").parquet(target)
    return target


def tsv_line(values: list[Column]) -> Column:
    """Values with tabs between; tabs and line ends in values become blanks, null is empty."""
    flat = [F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), r"[\t\r\n]+", " ") for v in values]
    return F.concat_ws("\t", *flat)


def export_tsv(df: DataFrame, path: str) -> None:
    """A header and rows with tabs between; tabs and line ends in values become blanks."""
    header = df.sparkSession.createDataFrame([("\t".join(df.columns),)], "value string").coalesce(1)
    header.union(df.select(tsv_line([F.col(c) for c in df.columns]).alias("value"))).write.mode("overwrite").text(path)
