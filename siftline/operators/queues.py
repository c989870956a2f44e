"""Work queues: what is pending, in which order, how much of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.severity import severity_rank, verdict_is_safe


def pending_by_hash(items: DataFrame, done: DataFrame, key: str, digest: str) -> DataFrame:
    """Items that were never done, or done with another digest of their input."""
    return items.join(done.select(key, digest), [key, digest], "left_anti")


def pending_reviews(findings: DataFrame, most_failures: int = 3) -> DataFrame:
    """Findings with code to review, whose input is not the reviewed one, unless reviewing it failed too often.

    Columns: ``code, input_hash, reviewed_hash, failed_hash, failures``; failures count for the input that failed only.
    """
    given_up = F.col("failed_hash").eqNullSafe(F.col("input_hash")) & (F.coalesce("failures", F.lit(0)) >= most_failures)
    return findings.where((F.coalesce(F.trim("code"), F.lit("")) != "") & ~F.col("input_hash").eqNullSafe(F.col("reviewed_hash")) & ~given_up)


def wants_review(severities: list[str], extra_rules: list[str], secret: Column) -> Column:
    """Whether a finding is to be reviewed, by ``trace_safety``, ``severity``, ``rule_id``: secrets never, unclear
    verdicts always, safe ones never, else by severity or rule."""
    known_safe = F.coalesce(verdict_is_safe(F.col("trace_safety")), F.lit(False))
    return (
        F.when(secret, False)
        .when(F.col("trace_safety") == "UNKNOWN", True)
        .when(known_safe, False)
        .otherwise(F.coalesce(F.col("severity").isin(severities) | F.col("rule_id").isin(extra_rules), F.lit(False)))
    )


def limited_groups(df: DataFrame, group: Column, order: Column, wanted: int, most: int) -> DataFrame:
    """All rows of the first ``min(wanted, most)`` groups, groups in the order of their first rows.

    Rows without a group are each a group of their own. Firsts are found by a partial aggregation and
    a top-k, not by ranking all rows.
    """
    alone = F.when(group.isNull(), order.cast("string"))
    keyed = df.withColumn("__group", F.struct(group.alias("g"), alone.alias("alone"))).withColumn("__order", order)
    firsts = keyed.groupBy("__group").agg(F.min("__order").alias("__first")).orderBy("__first").limit(min(wanted, most))
    return keyed.join(F.broadcast(firsts.select("__group")), "__group", "left_semi").select(*df.columns)


def batched(df: DataFrame, key: list[str], order: Column, size: int = 10) -> DataFrame:
    """``batch`` from 0: so many rows of a key together."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    return df.withColumn("batch", F.floor(place / size).cast("int"))


def stale(df: DataFrame, made: str, seen: str) -> DataFrame:
    """Rows made never, or before what they are made from was last seen."""
    return df.where(F.col(made).isNull() | (F.col(seen) > F.col(made)))


def failure_kind(status: Column, error: Column) -> Column:
    """FATAL for refused credentials or requests, TRANSIENT for limits, server errors and time-outs, else CONTENT."""
    return (
        F.when(status.isin(401, 403, 404), "FATAL")
        .when((status == 429) | (status >= 500) | F.lower(error).rlike("timeout|timed out|connection"), "TRANSIENT")
        .otherwise("CONTENT")
    )


def stopped_at(results: DataFrame, worker: str, order: Column, failed: Column, most: int = 5) -> DataFrame:
    """Results up to the ``most``-th failure in a row of each worker, at which it stops."""
    run = F.sum(F.when(failed, 0).otherwise(1)).over(Window.partitionBy(worker).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    numbered = results.withColumn("__run", run)
    in_row = F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(worker, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counted = numbered.withColumn("__row", in_row)
    over = F.max(F.when(F.col("__row") >= most, 1).otherwise(0)).over(Window.partitionBy(worker).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("__over", F.coalesce(over, F.lit(0))).where("__over = 0").drop("__run", "__row", "__over")


def normalized_impact(impacts: DataFrame) -> DataFrame:
    """Impacts (``status, jump, risk, sources array<struct<url>>, changes array<struct<text, source_url>>``) made sound.

    Sources must be web addresses; changes must name one of them; a major jump is a high risk;
    an impact that is not analyzed, or has no source left, loses all. ``dropped`` counts the changes lost.
    """
    sources = F.filter("sources", lambda s: s["url"].rlike("^https?://"))
    urls = F.transform(sources, lambda s: s["url"])
    changes = F.filter("changes", lambda c: F.array_contains(urls, c["source_url"]))
    sound = (F.col("status") == "ANALYZED") & (F.size(sources) > 0)
    return impacts.select(
        *[c for c in impacts.columns if c not in ("risk", "sources", "changes")],
        F.when(sound, F.when(F.col("jump") == "MAJOR", "HIGH").otherwise(F.col("risk"))).alias("risk"),
        F.when(sound, sources).otherwise(F.filter("sources", lambda s: F.lit(False))).alias("sources"),
        F.when(sound, changes).otherwise(F.filter("changes", lambda c: F.lit(False))).alias("changes"),
        (F.size("changes") - F.when(sound, F.size(changes)).otherwise(0)).alias("dropped"),
    )


def screen_order(df: DataFrame) -> DataFrame:
    """Severity, score from high to low, system, CVE; whatever is missing last."""
    return df.orderBy(severity_rank(F.col("severity")), F.desc_nulls_last("cvss"), F.asc_nulls_last("system"), F.asc_nulls_last("cve"))
