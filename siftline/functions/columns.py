"""Columns of a line, counted from 1, in bytes and in characters (of UTF-16, as editors and parsers of Java count them)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: A character that takes two in UTF-16, and what stands in for its second.
WIDE, SECOND = r"[\x{10000}-\x{10FFFF}]", "\x00"
# Fixed value: the legacy code page.
LEGACY = "cp949"


def byte_column(line: Column, column: Column) -> Column:
    """The column in bytes of UTF-8 of a column in characters; past the end that of the end. In the middle of a wide character its first half counts as one byte."""
    doubled = F.regexp_replace(F.replace(line, F.lit(SECOND), F.lit(" ")), f"({WIDE})", f"$1{SECOND}")
    before = F.substring(doubled, F.lit(1), F.greatest(column - 1, F.lit(0)).cast("int"))
    half = F.when(before.rlike(f"{WIDE}$"), 3).otherwise(0)
    return F.octet_length(F.replace(before, F.lit(SECOND), F.lit(""))) - half + 1


def char_column(line: Column, column: Column) -> Column:
    """The column in characters of a column in bytes of UTF-8; null where no character begins there, or past the byte after the end."""
    data = line.cast("binary")
    here = F.conv(F.hex(F.substring(data, column.cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = (column >= 1) & (column <= F.octet_length(line) + 1) & ~F.coalesce(here.between(0x80, 0xBF), F.lit(False))
    before = F.when(inside, F.substring(data, F.lit(1), (column - 1).cast("int"))).try_cast("string")
    return F.char_length(before) + F.regexp_count(before, F.lit(WIDE)) + 1


def _units(text: str) -> list[str]:
    """A text's characters, a wide one twice: what comes after it has the second place, and the first is a half."""
    return [part for c in text for part in ((c, "") if ord(c) > 0xFFFF else (c,))]


@F.pandas_udf(IntegerType())
def legacy_byte_column(line: pd.Series, column: pd.Series) -> pd.Series:
    """As ``byte_column`` for the legacy code page, in which what it lacks is one byte."""
    size = lambda text, c: 1 + sum(len(u.encode(LEGACY, "replace")) for u in _units(text)[: max(int(c) - 1, 0)])
    return pd.Series([None if t is None or pd.isna(c) else size(t, c) for t, c in zip(line, column, strict=True)], dtype="Int32")


@F.pandas_udf(IntegerType())
def legacy_char_column(line: pd.Series, column: pd.Series) -> pd.Series:
    """As ``char_column`` for the legacy code page."""

    def place(text: str, wanted: int) -> int | None:
        at = 1
        for i, unit in enumerate(_units(text), 1):
            if unit and at >= wanted:
                return i if at == wanted else None
            at += len(unit.encode(LEGACY, "replace"))
        return len(_units(text)) + 1 if at == wanted else None

    return pd.Series([None if t is None or pd.isna(c) else place(t, int(c)) for t, c in zip(line, column, strict=True)], dtype="Int32")
