"""Operators by key: first, newest, upsert, diffs, ordinal matches. "First" always means by an order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in ``order``. Null keys are keys."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def newest_by_key(df: DataFrame, keys: list[str], at: str, *ties: Column) -> DataFrame:
    """The row with the latest ``at``; rows without come last, ties go by ``ties``."""
    return first_by_key(df, keys, F.col(at).desc_nulls_last(), *ties)


def latest_reused(df: DataFrame, known: DataFrame, keys: list[str], at: str, values: list[str], *ties: Column) -> DataFrame:
    """``df`` with ``values`` of the latest row in ``known`` that has the same keys; null where there is none."""
    latest = newest_by_key(known, keys, at, *ties).select(*keys, *values)
    return df.join(latest, keys, "left")


def numbered(df: DataFrame, keys: list[str], *order: Column, name: str = "ordinal") -> DataFrame:
    """Which row of its key each is, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def placed(df: DataFrame, keys: list[str], order: list[Column], block: Column, name: str = "place") -> DataFrame:
    """Which row of its key each is in ``order``, from 1, where a key may have any share of the rows.

    ``block`` must fall with the order: rows of a higher block come first, those without a block last. A block is ranked by itself, and
    begins after as many rows as the blocks before it have, which are counted first.
    """
    # One key for window and join, so that rows are dealt once; nulls within it are equal.
    marked = df.withColumn("__key", F.struct(*keys, block.alias("__block")))
    sizes = marked.groupBy("__key").agg(F.count("*").alias("__n"))
    of_key = Window.partitionBy(*[F.col(f"__key.{k}") for k in keys]).orderBy(F.desc_nulls_last("__key.__block"))
    before = F.sum("__n").over(of_key.rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__key", F.coalesce(before, F.lit(0)).alias("__before"))
    ranked = marked.withColumn(name, F.row_number().over(Window.partitionBy("__key").orderBy(*order)))
    return ranked.join(starts, "__key").select(*df.columns, (F.col(name) + F.col("__before")).alias(name))


def summed_before(df: DataFrame, keys: list[str], order: list[str], block: Column | None, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the same key that come before in ``order``; rows that tie in it must be one.

    With a ``block``, which must not fall along the order, a key may have any share of the rows: a block is added up by itself, and begins at the sum of those before it.
    """
    so_far = lambda by, what, *along: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if block is None:
        return df.withColumn(name, so_far(keys, value, *order))
    marked = df.withColumns({"__block": block, "__value": value})
    sums = marked.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    starts = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__of"), so_far(keys, "__sum", "__block").alias("__start"))
    same = F.col("__block").eqNullSafe(F.col("__of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    within = marked.withColumn("__within", so_far([*keys, "__block"], "__value", *order))
    return within.join(starts, same).select(*df.columns, (F.col("__start") + F.col("__within")).alias(name))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], left_order: Column, right_order: Column, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the row of ``right`` with the same ordinal in its key, where both sides
    have as many rows of the key; else null. ``matched`` says which."""
    by_key = Window.partitionBy(*keys)
    a = numbered(left, keys, left_order, name="__at").withColumn("__n", F.count("*").over(by_key))
    b = numbered(right, keys, right_order, name="__at").withColumn("__n", F.count("*").over(by_key))
    b = b.select(*keys, "__at", "__n", *values, F.lit(True).alias("matched"))
    return a.join(b, [*keys, "__at", "__n"], "left").withColumn("matched", F.coalesce("matched", F.lit(False))).drop("__at", "__n")


def set_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``change``: NEW, GONE or KEPT for each key of either side."""
    a = before.select(*keys).distinct().withColumn("__a", F.lit(1))
    b = after.select(*keys).distinct().withColumn("__b", F.lit(1))
    change = F.when(F.col("__a").isNull(), "NEW").when(F.col("__b").isNull(), "GONE").otherwise("KEPT")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def upserted(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``state`` with ``rows`` put in by key: rows replace, other state stays. Both have the same columns;
    keys match null-safely; ``changed`` marks rows that are new or differ, so that only these need be written."""
    values = [c for c in state.columns if c not in keys]
    s, r = state.alias("s"), rows.alias("r")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = s.withColumn("__s", F.lit(True)).alias("s").join(r.withColumn("__r", F.lit(True)).alias("r"), condition, "full")
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}"))
    new = F.col("r.__r").isNotNull()
    return joined.select(
        *[F.when(new, F.col(f"r.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in state.columns],
        (new & ~(F.col("s.__s").isNotNull() & same)).alias("changed"),
    )


def replaced_children(children: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All children of the parents in ``new`` are replaced by theirs in ``new``; others stay."""
    return children.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def one_by_one(condition_columns: dict[str, object]) -> Column:
    """An optional filter: equality with each value given; None means no condition."""
    out = F.lit(True)
    for name, value in condition_columns.items():
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def searched(df: DataFrame, contains: dict[str, str | None], among: dict[str, list | None]) -> DataFrame:
    """Rows that contain each keyword, whatever its case, and have one of the values wherever some are given."""
    for name, keyword in contains.items():
        if keyword:
            df = df.where(F.lower(name).contains(keyword.lower()))
    for name, values in among.items():
        if values:
            df = df.where(F.col(name).isin(values))
    return df
