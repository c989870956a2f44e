"""Views and edits of findings: what a screen shows, what people change, what a reviewer is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import blank_to_null


def edited(state: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``state`` (``status, remark``) after people's ``edits`` (key, ``status, remark``; null for no change, a blank remark for none).

    ``changed`` marks rows that differ. Solving by hand pins, opening by hand unpins (``status_manual``).
    Edits of keys that are not there are for ``unknown_edits``.
    """
    e = edits.select(key, F.col("status").alias("__status"), F.col("remark").alias("__remark"), F.lit(True).alias("__edit"))
    joined = state.join(e, key, "left")
    status = F.coalesce("__status", "status")
    remark = F.when(F.col("__remark").isNotNull(), blank_to_null(F.col("__remark"))).otherwise(F.col("remark"))
    moved = F.col("__status").isNotNull() & ~F.col("__status").eqNullSafe(F.col("status"))
    new = {"status": status, "remark": remark, "status_manual": F.when(moved, status != "OPEN").otherwise(F.col("status_manual"))}
    return joined.select(
        *[new.get(c, F.col(c)).alias(c) for c in state.columns],
        (F.col("__edit").isNotNull() & (moved | ~remark.eqNullSafe(F.col("remark")))).alias("changed"),
    )


def unknown_edits(state: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Edits of keys that the state lacks: with any of these no edit is to be made."""
    return edits.join(state.select(key), key, "left_anti")


def verdict_shown(input_hash: Column, reviewed_hash: Column, verdict: Column, failures: Column, most: int = 3) -> Column:
    """A review's verdict while it is of the code as it is, else PENDING or, after too many failures, GIVEN_UP."""
    current = input_hash.eqNullSafe(reviewed_hash) & verdict.isNotNull()
    return F.when(current, verdict).when(F.coalesce(failures, F.lit(0)) >= most, "GIVEN_UP").when(input_hash.isNotNull(), "PENDING")


def context_lines(facts: DataFrame, group: str, order: list[str], text: str, most_lines: int = 40, most_chars: int = 300) -> DataFrame:
    """The first lines of each group that a reviewer is told, each cut to a length."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return facts.withColumn("place", place).where(F.col("place") <= most_lines).withColumn(text, F.substring(text, 1, most_chars))


def by_prefix(items: DataFrame, rules: DataFrame, column: str, prefix: str) -> DataFrame:
    """``items`` with each rule whose prefix they begin with.

    An item is looked up once for each length that prefixes have, by equality; lengths are no more than the longest prefix has.
    """
    lengths = sorted(r[0] for r in rules.select(F.length(prefix)).distinct().collect())
    starts = F.array(*[F.when(F.length(column) >= n, F.substring(column, 1, n)) for n in lengths])
    return items.select(*items.columns, F.explode(F.filter(starts, lambda s: s.isNotNull())).alias(prefix)).join(rules, prefix)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading folders two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] == p["y"]) & p["x"].isNotNull())
    first_other = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.lit(False))
    return F.when(first_other == 0, F.size(same)).otherwise(first_other - 1).cast("int")


def resolved_files(uses: DataFrame, files: DataFrame) -> DataFrame:
    """``uses`` (``from_path, name``) with the ``path`` that a bare file name stands for.

    The file itself if it has the name, the only file of the name, else the one that shares most folders; null in a tie.
    """
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    joined = uses.join(named, "name", "left").withColumn("score", F.when(F.col("path") == F.col("from_path"), 1_000).otherwise(common_prefix(F.col("from_path"), F.col("path"))))
    by_use = Window.partitionBy("from_path", "name")
    ranked = joined.withColumn("best", F.max("score").over(by_use)).where("score = best OR path IS NULL")
    counted = ranked.withColumn("n", F.count("*").over(by_use)).withColumn("first", F.row_number().over(by_use.orderBy("path")))
    return counted.where("first = 1").select("from_path", "name", F.when(F.col("n") == 1, F.col("path")).alias("path"))


def latest_page(df: DataFrame, at: str, ties: list[str], most: int = 500) -> DataFrame:
    """The latest ``most`` rows, those without a time last; a top-k, so no task has more than as many of each other."""
    return df.orderBy(F.desc_nulls_last(at), *ties).limit(most)


def granted(grants: DataFrame, programs: DataFrame) -> DataFrame:
    """``user_id, program_id, buttons``: what users may press in each program: what both the grant and the program have; only active ones of either count.

    ``grants``: ``user_id, program_id, buttons, active``; ``programs``: ``program_id, buttons, active``. Buttons are in the grant's order; none is an empty array.
    """
    own = grants.where("active").select("user_id", "program_id", "buttons")
    open_ = programs.where("active").select("program_id", F.col("buttons").alias("of_program"))
    return own.join(open_, "program_id").select("user_id", "program_id", F.array_intersect("buttons", "of_program").alias("buttons"))
