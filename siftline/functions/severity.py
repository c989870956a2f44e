"""Severities and trace verdicts as ranks, so that order and worst-of are plain comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from high to low, analyzer levels, verdicts from safe to worst.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
ANALYZER_LEVELS = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
VERDICTS = ["XML_FIXED", "SESSION_OVERWRITE", "SERVER_SET", "UNKNOWN", "BYPASSABLE", "CLIENT"]
WORST_SAFE = "SERVER_SET"


def ranked(value: Column, order: list[str]) -> Column:
    """Position in ``order``; past the end for anything else, null included."""
    position = F.array_position(F.array(*[F.lit(x) for x in order]), value).cast("int")
    return F.when(F.coalesce(position, F.lit(0)) > 0, position - 1).otherwise(len(order))


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL to 3 for LOW in any case, 4 for others and null."""
    return ranked(F.upper(severity), SEVERITIES)


def severity_of_level(level: Column) -> Column:
    """The severity of an analyzer's level; other levels stay as they are."""
    out = None
    for name, severity in ANALYZER_LEVELS.items():
        out = F.when(level == name, severity) if out is None else out.when(level == name, severity)
    return out.otherwise(level)


def verdict_rank(verdict: Column) -> Column:
    """0 for the safest verdict to 5 for the worst; null for anything else."""
    rank = ranked(verdict, VERDICTS)
    return F.when(rank < len(VERDICTS), rank)


def verdict_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in VERDICTS]), rank)


def verdict_is_safe(verdict: Column) -> Column:
    return verdict_rank(verdict) <= VERDICTS.index(WORST_SAFE)


def verdict_severity(verdict: Column) -> Column:
    rank = verdict_rank(verdict)
    return F.when(rank >= VERDICTS.index("BYPASSABLE"), "HIGH").when(rank == VERDICTS.index("UNKNOWN"), "MEDIUM").when(rank.isNotNull(), "LOW")
