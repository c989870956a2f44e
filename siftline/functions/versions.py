"""Version order and version parts.

Maven's order is not the order of strings. ``version_key`` gives each version a string whose plain
order is Maven's, so range predicates, minima and joins stay native; it is computed on distinct
versions only. Versions of numbers alone have a native key as well.
"""

from __future__ import annotations

import re
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Maven's qualifiers from low to high, "" being the release, and their other names.
QUALIFIERS = ["alpha", "beta", "milestone", "rc", "snapshot", "", "sp"]
ALIASES = {"cr": "rc", "ga": "", "final": "", "release": ""}
SHORT = {"a": "alpha", "b": "beta", "m": "milestone"}

RELEASE = QUALIFIERS.index("")
_PART = re.compile(r"(\d+)|([^\d.\-]+)|([.\-])")


def _elements(version: str) -> list[tuple]:
    """Parts of a version: ('n', number), ('q', name) and ('-',) where a list of its own begins."""
    out: list[tuple] = []
    before = "."
    for m in _PART.finditer(version.lower()):
        number, name, sign = m.groups()
        if sign:
            if before in ".-":  # nothing between two signs counts as 0
                out.append(("n", 0))
            if sign == "-":
                out.append(("-",))
            before = sign
        elif number is not None:
            if before == "q":
                out.append(("-",))
            out.append(("n", int(number)))
            before = "n"
        else:
            if before == "n":
                out.append(("-",))
            follows_digit = m.end() < len(version) and version[m.end()].isdigit()
            name = SHORT.get(name, name) if follows_digit else name
            out.append(("q", ALIASES.get(name, name)))
            before = "q"
    return out


def _is_empty(element: tuple) -> bool:
    return element in (("n", 0), ("q", ""))


def _trimmed(elements: list[tuple]) -> list[tuple]:
    """Without zeros and releases at the end of each list."""
    out: list[tuple] = []
    for e in elements:
        if e == ("-",):
            while out and _is_empty(out[-1]):
                out.pop()
        out.append(e)
    while out and (_is_empty(out[-1]) or out[-1] == ("-",)):
        out.pop()
    return out


def maven_key(version: str | None) -> str | None:
    """A string that sorts as the version does; null for null."""
    if version is None:
        return None
    key = []
    elements = _trimmed(_elements(version.strip()))
    for e, following in pairwise([*elements, ("n", 0)]):
        if e == ("-",):
            if following[0] == "n":
                key.append("5")  # a list of numbers: above the end and all names, below a number
        elif e[0] == "n":
            digits = str(e[1])
            key.append(f"6{len(digits):04d}{digits}" if e[1] else "60000")
        elif e[1] in QUALIFIERS:
            rank = QUALIFIERS.index(e[1])
            key.append(f"{'1' if rank < RELEASE else '3'}{rank}")
        else:
            key.append(f"4{e[1]}\x01")
    return "|".join([*key, "2"])


@F.pandas_udf(StringType())
def version_key(versions: pd.Series) -> pd.Series:
    """``maven_key`` for a column; each different version of a batch is read once."""
    keys = {v: maven_key(v) for v in versions.dropna().unique()}
    return pd.Series([keys.get(v) for v in versions], dtype=object)


def with_version_keys(df: DataFrame, **keys: str) -> DataFrame:
    """``df`` with columns of keys: ``new_column="version_column"``.

    Versions repeat a lot, so keys are made for the distinct ones and joined back.
    """
    for name, column in keys.items():
        distinct = df.select(F.col(column).alias(f"__{name}")).distinct()
        made = distinct.withColumn(name, version_key(F.col(f"__{name}")))
        df = df.join(made, df[column].eqNullSafe(made[f"__{name}"]), "left").drop(f"__{name}")
    return df


def major(version: Column) -> Column:
    """The digits of what stands before the first dot or hyphen; -1 if there are none."""
    first = F.split(version, r"[.\-]")[0]
    return F.coalesce(F.regexp_replace(first, "[^0-9]", "").try_cast("int"), F.lit(-1))


def numeric_parts(version: Column) -> Column:
    """The numbers that a version begins with, each of nine digits at most, up to the first other part."""
    tokens = F.split(F.trim(version), r"[.\-]")
    bad = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(r"^\d{1,9}$"), -1).otherwise(i)), lambda i: i >= 0)
    length = F.when(F.size(bad) > 0, F.get(bad, F.lit(0))).otherwise(F.size(tokens))
    return F.transform(F.slice(tokens, F.lit(1), length), lambda t: t.cast("int"))


def numeric_key(parts: Column) -> Column:
    """A text that sorts as numbers of at most nine digits do, zeros at the end left out."""
    length = F.array_max(F.transform(parts, lambda x, i: F.when(x > 0, i + 1).otherwise(0)))
    return F.array_join(F.transform(F.slice(parts, F.lit(1), F.coalesce(length, F.lit(0))), lambda x: F.lpad(x.cast("string"), 9, "0")), ".")


def jump_class(parts_from: Column, parts_to: Column, higher: Column) -> Column:
    """MAJOR, MINOR or PATCH by the first number that differs; UNKNOWN without numbers or if not ``higher``."""
    part = lambda parts, i: F.coalesce(F.get(parts, F.lit(i)), F.lit(0))
    known = (F.size(parts_from) > 0) & (F.size(parts_to) > 0) & higher
    return (
        F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN")
        .when(part(parts_from, 0) != part(parts_to, 0), "MAJOR")
        .when(part(parts_from, 1) != part(parts_to, 1), "MINOR")
        .otherwise("PATCH")
    )


def range_text(start_including: Column, start_excluding: Column, end_including: Column, end_excluding: Column) -> Column:
    """How a range reads; a range with a start only ends in a comma and a blank."""
    # Fixed value: how a range without bounds reads.
    unbounded = "(버전 제한 없음)"
    shown = lambda sign, c: F.coalesce(F.when(F.trim(c) != "", F.concat(F.lit(sign), c)), F.lit(""))
    start = F.concat(shown(">= ", start_including), shown("> ", start_excluding))
    whole = F.concat(start, F.when(start != "", ", ").otherwise(""), shown("<= ", end_including), shown("< ", end_excluding))
    return F.when(whole == "", unbounded).otherwise(whole)
