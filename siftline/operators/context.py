"""Code beside a finding: related methods within a budget, the statement around a line, the prefix that names share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import sets_secret

# How many related pieces, lines of each and lines in all are sent, and what stands for those that are left out.
ITEMS, EACH, TOTAL = 8, 40, 240
LEFT_OUT, LEFT_OUT_END = "    // … (이하 ", "줄 생략)"
# Fixed value: the tags of mapper statements.
STATEMENTS = ["select", "insert", "update", "delete", "sql", "statement", "procedure"]


def related_code(candidates: DataFrame, items: int = ITEMS, each: int = EACH, total: int = TOTAL) -> DataFrame:
    """``finding, rank, path, first, code, reason``: the pieces of code that go with each finding, in their order.

    ``candidates``: ``finding, pos, path, first, lines`` (the piece's lines), ``overlaps`` (with what is sent anyway), ``reason``. Test code, pieces that overlap, that are empty, or that set a secret
    anywhere are dropped whole; of those that begin at one line of a path the first stays. Then ``items`` are taken, ``each`` lines of one at most, until ``total`` lines are reached; the piece that
    reaches it is cut short, and a line says how much of a piece is left out, which counts, too. Only the last can be cut by the total, so running sums tell what all have.
    """
    test = F.col("path").startswith("src/test/") | F.col("path").contains("/src/test/")
    fit = candidates.where(~F.coalesce(F.col("overlaps"), F.lit(False)) & ~test & (F.size("lines") > 0) & ~F.exists("lines", sets_secret))
    narrow = fit.groupBy("finding", "path", "first").agg(F.min_by(F.struct("reason", "lines"), "pos").alias("piece"), F.min("pos").alias("pos"))
    in_order = Window.partitionBy("finding").orderBy("pos", "path", "first")
    ranked = narrow.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= items)
    n = F.size("piece.lines")
    cost = F.least(n, F.lit(each)) + F.when(n > each, 1).otherwise(0)
    before = F.coalesce(F.sum(cost).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.least(n, F.lit(each), F.lit(total) - F.col("before")).cast("int")
    rest = F.when(n > taken, F.array(F.concat(F.lit(LEFT_OUT), (n - taken).cast("string"), F.lit(LEFT_OUT_END)))).otherwise(F.array().cast("array<string>"))
    within = ranked.withColumn("before", before).where(F.col("before") < total)
    return within.select("finding", "rank", "path", "first", F.array_join(F.concat(F.slice("piece.lines", F.lit(1), taken), rest), "\n").alias("code"), "piece.reason")


def enclosing_statements(lines: DataFrame, hits: DataFrame, tags: list[str] = STATEMENTS) -> DataFrame:
    """``hit, first, last``: the lines of the statement around each hit; null outside of one.

    ``lines``: ``file, line, text``, counted from 1; ``hits``: ``hit, file, start, end``. Going up from the start, an opening tag must come before a line with a closing one, and the start's own line may
    close. The statement ends where the same tag closes next, the opening line included, and must reach the hit's end. Tags are known in any case. Nothing is nested, as statements are
    not: the nearest tags count. Windows are per file, and per file and tag.
    """
    names = "|".join(tags)
    marked = lines.select(
        "file", "line", F.nullif(F.lower(F.regexp_extract("text", rf"(?i)<({names})\b", 1)), F.lit("")).alias("tag"),
        F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"</({names})\s*>"), F.lit(1))).alias("closes"),
    )
    so_far = Window.partitionBy("file").orderBy("line")
    close_line = F.when(F.size("closes") > 0, F.col("line"))
    known = marked.select(
        "file", "line", F.last(F.when(F.col("tag").isNotNull(), F.struct("line", "tag")), ignorenulls=True).over(so_far).alias("opened"),
        F.last(close_line, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1)).alias("above"),
        F.last(close_line, ignorenulls=True).over(so_far).alias("here"), F.max("line").over(Window.partitionBy("file")).alias("n"),
    )
    sized = hits.join(lines.groupBy("file").agg(F.max("line").alias("n")), "file", "left")
    at = sized.select("hit", "file", "start", "end", F.least("start", "n").alias("line"))
    placed = at.join(known, ["file", "line"], "left")
    closed = F.when(F.col("start") > F.col("n"), F.col("here")).otherwise(F.col("above"))
    inside = F.col("opened").isNotNull() & (closed.isNull() | (closed <= F.col("opened.line")))
    found = placed.select("hit", "file", "end", F.when(inside, F.col("opened.line")).alias("first"), F.when(inside, F.col("opened.tag")).alias("tag"))
    ends = marked.select("file", F.explode("closes").alias("tag"), "line", F.lit(1).alias("closing"))
    begins = marked.where("tag IS NOT NULL").select("file", "tag", "line", F.lit(0).alias("closing"))
    upward = Window.partitionBy("file", "tag").orderBy(F.desc("line"), F.desc("closing"))
    nearest = ends.union(begins).withColumn("last", F.last(F.when(F.col("closing") == 1, F.col("line")), ignorenulls=True).over(upward)).where("closing = 0").select("file", "tag", F.col("line").alias("first"), "last")
    whole = found.join(nearest, ["file", "tag", "first"], "left")
    fits = F.col("last") >= F.col("end")
    return whole.select("hit", F.when(fits, F.col("first")).alias("first"), F.when(fits, F.col("last")).alias("last"))


def common_camel_prefix(names: DataFrame, key: str, name: str) -> DataFrame:
    """``key, prefix``: what all names of a key begin with, cut back to whole words in camel case; null if nothing is left.

    The least and the greatest name have in common what all have. If some name goes on with no capital after that, the prefix loses its last, broken word. A single
    name is its own prefix; null names are passed over.
    """
    some = names.where(F.col(name).isNotNull()).select(F.col(key).alias("__key"), F.col(name).alias("__name"))
    ends = some.groupBy("__key").agg(F.min("__name").alias("a"), F.max("__name").alias("b"))
    lengths = F.sequence(F.lit(0), F.least(F.length("a"), F.length("b")))
    same = F.array_max(F.filter(lengths, lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)))
    shared = ends.select(F.col("__key").alias("__of"), F.substring("a", F.lit(1), same).alias("shared"))
    after = F.substring("__name", F.length("shared") + 1, F.lit(1))
    broken = some.join(shared, F.col("__key").eqNullSafe(F.col("__of"))).groupBy("__of", "shared").agg(F.bool_or((after != "") & ~after.rlike(r"^\p{Lu}$")).alias("broken"))
    whole = F.when(F.col("broken"), F.regexp_replace("shared", r"\p{Lu}?[^\p{Lu}]*$", "")).otherwise(F.col("shared"))
    return broken.select(F.col("__of").alias(key), F.nullif(whole, F.lit("")).alias("prefix"))
