"""Versions in prose: which releases lie on the way from one version to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a version reads in a text, which suffixes mark a final release, how many minor lines to try after a jump.
VERSION = r"(?<![\w.])v?(\d+(?:\.\d+)+)(?:[.-]?([A-Za-z]+)\.?(\d*))?(?![\w])"
FINAL = ["", "final", "release", "ga"]
LINES_TRIED = 10


def version_numbers(text: Column) -> Column:
    """The numbers of the first version in a text, three at least; null without one, and where a number has more than 18 digits or so."""
    found = F.regexp_extract(text, VERSION, 1)
    numbers = F.transform(F.split(found, r"\."), lambda x: x.try_cast("long"))
    padded = F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(3) - F.size(numbers), F.lit(0))))
    return F.when((found != "") & ~F.exists(numbers, lambda x: x.isNull()), padded)


def relevant(text: Column, start: Column, end: Column) -> Column:
    """Whether the release that a text names matters on the way from ``start`` to ``end`` (arrays of numbers).

    Arrays compare from left to right, and a line is an array's first two numbers. A final release matters above ``start`` and up to
    ``end``, a patch of the old line only where that is the line of ``end``, too. A release before the final one matters as the first
    of a later line.
    """
    n, start, end = version_numbers(text), start.cast("array<long>"), end.cast("array<long>")
    later = F.slice(n, 1, 2) > F.slice(start, 1, 2)
    in_reach = F.when(F.slice(start, 1, 2) == F.slice(end, 1, 2), F.lit(True)).otherwise(later)
    final = F.lower(F.regexp_extract(text, VERSION, 2)).isin(FINAL)
    opens_line = later & (F.slice(n, 1, 2) <= F.slice(end, 1, 2)) & ~F.exists(F.slice(n, F.lit(3), F.size(n)), lambda x: x != 0)
    return F.coalesce(F.when(final, (n > start) & (n <= end) & in_reach).otherwise(opens_line), F.lit(False))


def lines_between(start: Column, end: Column, tried: int = LINES_TRIED) -> Column:
    """The lines after that of ``start`` up to that of ``end``, as texts; how many minor lines an earlier major had is not known, so ``tried`` are."""
    a, b, c, d = start[0], start[1], end[0], end[1]
    # Of each major from the first to the last: its minors from one after the start's, or 0, to the end's, or as many as are tried.
    first = lambda major: F.when(major == a, b + 1).otherwise(0)
    last = lambda major: F.when(major == c, d).otherwise(first(major) + tried - 1)
    named = lambda major: F.transform(F.sequence(first(major), F.greatest(first(major), last(major))), lambda m: F.when(m <= last(major), F.concat_ws(".", major.cast("string"), m.cast("string"))))
    return F.when(a <= c, F.array_compact(F.flatten(F.transform(F.sequence(a, F.greatest(a, c)), named)))).otherwise(F.array().cast("array<string>"))
