"""Matching dependencies with advisories: version ranges, event lists, fixes, verdicts.

Versions come with their order-preserving keys (``functions.versions``), so a range is two plain
comparisons and every join is on the package. "Cannot decide" is null and stays null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.keyed import first_by_key

MOST_STEPS = 5


def scanned(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (``package, version``) with each CVE of theirs once (``cve, advisory_id``).

    ``advisories``: ``package, version, pos, advisory_id, aliases``. An advisory's CVE is its first alias that
    is one, else its id; only CVEs count; of several advisories for a CVE the first stays.
    """
    alias = F.get(F.filter("aliases", lambda a: a.startswith("CVE-")), F.lit(0))
    found = dependencies.join(advisories.withColumn("cve", F.coalesce(alias, F.col("advisory_id"))), ["package", "version"])
    return first_by_key(found.where(F.col("cve").startswith("CVE-")), ["package", "version", "cve"], F.col("pos")).select(
        *dependencies.columns, "cve", "advisory_id"
    )


def in_ranges(installed: DataFrame, ranges: DataFrame, key: list[str], version: str) -> DataFrame:
    """``installed`` with ``vulnerable`` (null without any range) and the ``range_pos`` of the first range it lies in.

    ``ranges``: the keys, ``pos`` and the keys of the bounds ``start_incl, start_excl, end_incl, end_excl``, null for no bound.
    Each different version of a package is compared once; repeated rows stay repeated.
    """
    v = F.col(version)
    bounds = [("start_incl", v >= F.col("start_incl")), ("start_excl", v > F.col("start_excl")), ("end_incl", v <= F.col("end_incl")), ("end_excl", v < F.col("end_excl"))]
    inside = reduce(lambda a, b: a & b, [F.col(name).isNull() | holds for name, holds in bounds])
    keys = [*key, version]
    found = installed.select(*keys).distinct().join(ranges, key).groupBy(*keys).agg(F.bool_or(inside).alias("vulnerable"), F.min(F.when(inside, F.col("pos"))).alias("range_pos"))
    return joined_back(installed, found, keys)


def joined_back(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the further columns of ``found``, which has a row for each key at most; null keys match."""
    other = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(other, same, "left").drop(*[f"__{k}" for k in keys])


def event_ranges(events: Column) -> Column:
    """An event list as ranges, an array of structs ``start, fixed, last``.

    Each event introduces, fixes, or names the last affected version. A range that is open at the end of
    the list has neither of the two; an end without a start means nothing, a second start takes the first one's place.
    """
    text = lambda: F.lit(None).cast("string")
    none = F.array().cast("array<struct<start:string,fixed:string,last:string>>")

    def step(state: Column, e: Column) -> Column:
        starts = e["introduced"].isNotNull()
        ends = ~starts & state["open"].isNotNull() & (e["fixed"].isNotNull() | e["last_affected"].isNotNull())
        last = F.when(e["fixed"].isNull(), e["last_affected"])
        closed = F.array(F.struct(state["open"].alias("start"), e["fixed"].alias("fixed"), last.alias("last")))
        return F.struct(
            F.when(starts, e["introduced"]).when(ends, text()).otherwise(state["open"]).alias("open"),
            F.when(ends, F.concat(state["out"], closed)).otherwise(state["out"]).alias("out"),
        )

    def finish(state: Column) -> Column:
        rest = F.array(F.struct(state["open"].alias("start"), text().alias("fixed"), text().alias("last")))
        return F.when(state["open"].isNotNull(), F.concat(state["out"], rest)).otherwise(state["out"])

    return F.aggregate(events, F.struct(text().alias("open"), none.alias("out")), step, finish)


def event_range_text(start: Column, fixed: Column, last: Column) -> Column:
    # Fixed value: how a range without a fix reads.
    unfixed = " (수정 버전 미공개)"
    return F.concat(F.lit(">= "), start, F.coalesce(F.concat(F.lit(", < "), fixed), F.concat(F.lit(", <= "), last), F.lit(unfixed)))


def in_event_ranges(installed: DataFrame, ranges: DataFrame, key: list[str], version: str) -> DataFrame:
    """As ``in_ranges`` for ``event_ranges`` exploded to ``pos, start, start_key, fixed_key, last_key``; a start of "0" is before all."""
    bounded = ranges.select(
        *key, "pos", F.when(F.col("start") != "0", F.col("start_key")).alias("start_incl"), F.lit(None).cast("string").alias("start_excl"),
        F.col("last_key").alias("end_incl"), F.col("fixed_key").alias("end_excl"),
    )
    return in_ranges(installed, bounded, key, version)


def lowest_above(installed: DataFrame, candidates: DataFrame, key: list[str]) -> DataFrame:
    """``installed`` (keys, ``major, version_key``) with the lowest candidate of the same major above it, ``fix``; null without one.

    ``candidates``: keys, ``candidate, candidate_major, candidate_key``. Both go through one window from high to low, in which the
    candidate seen last is the lowest above; equal candidates come after what they equal. Repeated rows stay repeated.
    """
    c = candidates.select(*key, F.col("candidate_major").alias("major"), F.col("candidate_key").alias("version_key"), F.col("candidate").alias("__candidate"))
    both = installed.withColumn("__candidate", F.lit(None).cast("string")).unionByName(c.where("__candidate IS NOT NULL AND version_key IS NOT NULL"), allowMissingColumns=True)
    falling = Window.partitionBy(*key, "major").orderBy(F.desc_nulls_first("version_key"), F.col("__candidate").isNotNull(), F.desc("__candidate"))
    seen = F.last("__candidate", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("fix", seen).where("__candidate IS NULL").select(*installed.columns, "fix")


def fix_chain(installed: DataFrame, steps: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """Follows the next fix from version to version: ``package, version, chain, status, target``.

    ``steps`` has for each affected (``package, version``) its ``next`` lowest fix of the same line, or null; a version
    that is not there is clean. CLEAN, with the clean version as ``target``; NO_SAME_LINE_FIX where the line ends;
    MAX_DEPTH_REACHED after ``most`` steps. The joins are ``most`` in number, whatever the data.
    """
    now = installed.select("package", "version", F.array("version").alias("chain"), F.col("version").alias("at"), F.lit(None).cast("string").alias("status"))
    table = steps.select("package", F.col("version").alias("at"), "next", F.lit(True).alias("affected"))
    for _ in range(most):
        joined = now.join(table, ["package", "at"], "left")
        status = F.coalesce("status", F.when(F.col("affected").isNull(), "CLEAN").when(F.col("next").isNull(), "NO_SAME_LINE_FIX"))
        goes = status.isNull()
        now = joined.select(
            "package", "version",
            F.when(goes, F.array_append("chain", F.col("next"))).otherwise(F.col("chain")).alias("chain"),
            F.when(goes, F.col("next")).otherwise(F.col("at")).alias("at"), status.alias("status"),
        )
    last = now.join(table, ["package", "at"], "left")
    status = F.coalesce("status", F.when(F.col("affected").isNull(), "CLEAN").otherwise("MAX_DEPTH_REACHED"))
    return last.select("package", "version", "chain", status.alias("status"), F.when(status == "CLEAN", F.col("at")).alias("target"))


def assessed(vulnerable: Column, fix: Column, fix_exists: Column) -> Column:
    """A verdict without a person: NOT_VULNERABLE outside all ranges, FIXABLE inside with a fix that is or may be
    published, else null: to be assessed. A failed look-up counts as published."""
    return F.when(vulnerable.isNull(), None).when(~vulnerable, "NOT_VULNERABLE").when(fix.isNotNull() & F.coalesce(fix_exists, F.lit(True)), "FIXABLE")


def best_score(metrics: Column) -> tuple[Column, Column]:
    """Base score and severity from a map of version to ``array<struct<type, score, severity>>``.

    The newest version with data counts, in it the first primary entry, else the first. 0.0 and null without any.
    """
    # Versions from newest to oldest, and the word for a primary entry.
    versions, primary = ["V40", "V31", "V30", "V3", "V2"], "Primary"
    of = [F.try_element_at(metrics, F.lit(v)) for v in versions]
    entry = F.coalesce(*[F.coalesce(F.get(F.filter(e, lambda x: x["type"] == primary), F.lit(0)), F.get(e, F.lit(0))) for e in of])
    return F.coalesce(entry["score"], F.lit(0.0)), entry["severity"]


def english(descriptions: Column) -> Column:
    """The first English text of ``array<struct<lang, value>>``, else empty."""
    return F.coalesce(F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))["value"], F.lit(""))
