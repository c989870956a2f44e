"""Scans that arrive over many batches and close once: marks in keyed state with a timer, findings staged beside it.

``marks`` is a stream of ``scan_id, mark, at, error``: START, END or FAIL. Keyed state holds a few values of each open scan, never its findings; a scan without an END in time is failed by a
timer on event time. ``findings`` is a stream of ``scan_id, fingerprint, rule_id, file_path, severity, pos``, staged by scan as they come; a row without a fingerprint says that its file failed.
Only when a scan's END has come is the state reconciled with all that is staged of it, so what comes late or never solves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.operators.findings import reconciled
from siftline.streaming.reconcile import STATE

STARTED, SUCCEEDED, FAILED = "STARTED", "SUCCEEDED", "FAILED"
#: In one moment a start comes before an end, and a failure before that.
MARKS = {"START": 0, "FAIL": 1, "END": 2}
CLOSING = "scan_id string, status string, at timestamp, started_at timestamp, error string"
HISTORY = f"{CLOSING}, n_new long, n_resolved long, version string, seq int"
FINDING = "scan_id string, fingerprint string, rule_id string, file_path string, severity string, pos long"
TIMED_OUT = "no end in time"


def stage(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes findings by scan and batch; a batch that is run again replaces what it wrote."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("scan_id").parquet(f"{path}/staged/batch={number:09d}")

    return findings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closings(marks: DataFrame, patience: str) -> DataFrame:
    """``scan_id, status, at, started_at, error``: a row when a scan starts and one when it closes, by its first END or FAIL, or FAILED when its last mark is ``patience`` behind the newest.

    An END without a START closes, too. Marks after the close are passed over, until the timer forgets the scan; ``close_scans`` passes over what comes after that.
    """
    wait = int(pd.Timedelta(patience) / pd.Timedelta(milliseconds=1))
    stamp = lambda ms: None if ms is None or ms < 0 else pd.Timestamp(ms, unit="ms")

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, started, last = state.get if state.exists else ("", -1, -1)
        out: list[tuple] = []
        if state.hasTimedOut:
            if status == STARTED:
                out.append((key[0], FAILED, stamp(last), stamp(started), TIMED_OUT))
                state.update((FAILED, started, last))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + wait)
            else:
                state.remove()
        else:
            rows = [r for pdf in frames for r in zip(pdf["at"], pdf["mark"], pdf["error"], strict=True) if r[1] in MARKS and not pd.isna(r[0])]
            for at, mark, error in sorted(rows, key=lambda r: (r[0], MARKS[r[1]])):
                ms = int(at.value // 1_000_000)
                last = max(last, ms)
                if status == "":
                    status, started = STARTED, ms
                    out.append((key[0], STARTED, stamp(ms), stamp(ms), None))
                if status == STARTED and mark != "START":
                    status = SUCCEEDED if mark == "END" else FAILED
                    out.append((key[0], status, stamp(ms), stamp(started), None if mark == "END" or pd.isna(error) else error))
            if status:
                state.update((status, started, last))
                state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["scan_id", "status", "at", "started_at", "error"])

    timed = marks.where("scan_id IS NOT NULL").withWatermark("at", patience)
    return timed.groupBy("scan_id").applyInPandasWithState(step, CLOSING, "status string, started long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The state that the last scan to succeed left, of batches before ``before`` if that is given."""
    done = history(spark, path).where("version IS NOT NULL")
    done = done if before is None else done.where(F.col("batch") < before)
    last = done.agg(F.max_by("version", F.struct("batch", "seq"))).head()[0]
    return spark.createDataFrame([], STATE) if last is None else spark.read.schema(STATE).parquet(f"{path}/state/{last}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """All rows of scans that started, succeeded or failed, by ``batch``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/history")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{HISTORY}, batch int")
    return spark.read.schema(f"{HISTORY}, batch int").parquet(f"{path}/history")


def staged(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    """What is staged of one scan; other scans' folders are not read. Empty if nothing is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/staged")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], FINDING)
    return spark.read.schema(f"{FINDING}, batch int").option("basePath", f"{path}/staged").parquet(f"{path}/staged").where(F.col("scan_id") == scan_id)


def close_scans(marks: DataFrame, path: str, checkpoint: str, active_rules: DataFrame, patience: str = "1 hour") -> StreamingQuery:
    """Writes the history of scans, and a new version of the state for each that succeeds. ``stage`` must be ahead of this: run it first.

    Scans that close in one batch are applied one after another in the order of their ends, as each is compared with what the one before has left; a scan that
    fails leaves the state as it is. A batch that is run again begins where the batches before it ended, and replaces its versions and its history.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # A few rows a scan, none of its findings.
        rows = sorted(batch.collect(), key=lambda r: (r.at, r.scan_id, r.status != STARTED))
        if not rows:
            return
        # A mark that comes after the timer has forgotten its scan opens none again: the history knows it.
        known = history(spark, path).where((F.col("batch") < number) & (F.col("status") != STARTED) & F.col("scan_id").isin([r.scan_id for r in rows]))
        over = {r.scan_id for r in known.select("scan_id").distinct().collect()}
        rows = [r for r in rows if r.scan_id not in over]
        state, told = current(spark, path, number), []
        none = spark.createDataFrame([], "fingerprint string, kept_rule string")
        for seq, row in enumerate(rows):
            new = resolved = version = None
            if row.status == SUCCEEDED:
                every, version = staged(spark, path, row.scan_id), f"version={number:09d}-{seq:04d}"
                found = every.where("fingerprint IS NOT NULL").select("fingerprint", "rule_id", "file_path", "severity", "pos")
                after = reconciled(state, found, every.where("fingerprint IS NULL").select("file_path"), active_rules, none, F.lit(row.at).cast("timestamp_ntz"))
                after.write.mode("overwrite").parquet(f"{path}/state/{version}")
                done = spark.read.parquet(f"{path}/state/{version}")
                counts = done.agg(F.count_if(F.col("action").isin("INSERTED", "REOPENED")), F.count_if(F.col("action") == "RESOLVED")).head()
                new, resolved, state = int(counts[0]), int(counts[1]), done.drop("action")
            told.append((row.scan_id, row.status, row.at, row.started_at, row.error, new, resolved, version, seq))
        spark.createDataFrame(told, HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{path}/history/batch={number:09d}")

    return closings(marks, patience).writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
