"""Reconciling scans as they arrive, and windowed counts of events, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.findings import reconciled

STATE = (
    "fingerprint string, rule_id string, file_path string, severity string, status string, status_manual boolean, "
    "remark string, first_at timestamp_ntz, last_at timestamp_ntz, resolved_at timestamp_ntz"
)


def latest_state(spark, path: str, version: int) -> DataFrame:
    """The state that the batch before wrote; empty before the first."""
    return spark.createDataFrame([], STATE) if version < 0 else spark.read.schema(STATE).parquet(f"{path}/version={version:06d}")


def reconcile_stream(scans: DataFrame, path: str, checkpoint: str, active_rules: DataFrame, failed_files: DataFrame | None = None) -> StreamingQuery:
    """Each micro-batch of ``scans`` (``fingerprint, rule_id, file_path, severity, pos, at``) is one scan: the state of
    the batch before is reconciled with it and written as the next version. A batch that is run again after a
    failure overwrites nothing: its version is replaced as a whole. Files that failed, and rules that are not active,
    leave what is known of them as it is, so late and lost results solve nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        failed = failed_files if failed_files is not None else spark.createDataFrame([], "file_path string")
        away = spark.createDataFrame([], "fingerprint string, kept_rule string")
        now = batch.agg(F.max("at")).head()[0]
        after = reconciled(latest_state(spark, path, number - 1), batch, failed, active_rules, away, F.lit(now).cast("timestamp_ntz"))
        after.drop("action").write.mode("overwrite").parquet(f"{path}/version={number:06d}")

    return scans.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, late: str, size: str, *keys: str) -> DataFrame:
    """Counts per window and key; events later than ``late`` behind the newest do not count. ``at`` is a timestamp."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"))
