"""Trees and graphs: dependency trees as text, ancestors, closures, sections and budgets.

Rows of a tree come in the order in which it is printed, parents first, with their depth from 1; ``tree`` says which
tree a row is of. Windows are per tree, so trees are dealt over the cluster and none is larger than its document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.keyed import summed_before
from siftline.sources.state import Rounds, written

COORDINATE = r"^((?:\|  |   )*)(?:\+- |\\- )([^:]+):([^:]+)"


def tree_lines(texts: DataFrame, tree: str, text: str) -> DataFrame:
    """``tree, pos, line`` and, where a line is a node, ``depth`` and ``coordinate``; line 0 is the root."""
    lines = texts.select(F.col(tree).alias("tree"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    node = (F.col("pos") > 0) & F.col("line").rlike(COORDINATE)
    depth = (F.length(F.regexp_extract("line", COORDINATE, 1)) / 3 + 1).cast("int")
    coordinate = F.concat(F.regexp_extract("line", COORDINATE, 2), F.lit(":"), F.regexp_extract("line", COORDINATE, 3))
    return lines.select("tree", "pos", "line", F.when(node, depth).alias("depth"), F.when(node, coordinate).alias("coordinate"))


def dependencies(lines: DataFrame, column: str) -> DataFrame:
    """``group_id, artifact_id, version`` of lines ``g:a:packaging[:classifier]:version:scope``, their first word; others go."""
    parts = F.split(F.split(F.trim(column), r"\s+")[0], ":")
    sized = lines.select(parts.alias("p")).where(F.size("p").between(5, 6) & ~F.exists("p", lambda x: x == ""))
    return sized.select(F.col("p")[0].alias("group_id"), F.col("p")[1].alias("artifact_id"), F.element_at("p", -2).alias("version"))


def top_level_cause(nodes: DataFrame) -> DataFrame:
    """``cause``: the last row of depth 1 at or above each row of its tree, by ``pos``."""
    so_far = Window.partitionBy("tree").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn("cause", F.last(F.when(F.col("depth") == 1, F.col("coordinate")), ignorenulls=True).over(so_far))


def causes(nodes: DataFrame) -> DataFrame:
    """The cause of each coordinate of a tree; of a repeated one the last place counts."""
    placed = top_level_cause(nodes.where("coordinate IS NOT NULL")).where("cause IS NOT NULL")
    return placed.groupBy("tree", "coordinate").agg(F.max_by("cause", "pos").alias("cause"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """``path``: the positions from depth 1 down to each row.

    A row's parent is the nearest row above with a smaller depth. The rows of a tree are gone through once, with the rows on the way down to the last one at hand;
    only positions and depths go there, and a tree is one document, whose paths must fit in memory.
    """
    real = nodes.where("depth IS NOT NULL")
    types = dict(nodes.dtypes)

    def paths(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        way: list[int] = []
        depths: list[int] = []
        found = []
        for pos, depth in zip(rows["pos"].tolist(), rows["depth"].tolist(), strict=True):
            while depths and depths[-1] >= depth:
                way.pop()
                depths.pop()
            way.append(pos)
            depths.append(depth)
            found.append(list(way))
        return rows[["tree", "pos"]].assign(path=found)

    schema = f"tree {types['tree']}, pos {types['pos']}, path array<{types['pos']}>"
    by_row = real.select("tree", "pos", "depth").distinct().groupBy("tree").applyInPandas(paths, schema)
    return real.join(by_row, ["tree", "pos"])


def pruned(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of each tree that lie on the way to a target (``tree, coordinate``), and its first row; all rows of
    a tree without any target."""
    on_path = ancestors(nodes).join(targets, ["tree", "coordinate"], "left_semi").select("tree", F.explode("path").alias("pos")).distinct()
    hit = on_path.select("tree").distinct().withColumn("hit", F.lit(True))
    kept = nodes.join(on_path.withColumn("kept", F.lit(True)), ["tree", "pos"], "left").join(hit, "tree", "left")
    return kept.where(F.col("hit").isNull() | F.col("kept") | (F.col("pos") == 0)).drop("hit", "kept")


def closure(edges: DataFrame, starts: DataFrame, cut: Callable[[DataFrame], DataFrame] = written, most: int | None = None) -> DataFrame:
    """``start, node, depth``: all nodes that edges (``src, dst``) reach, with the least number of steps; starts reach themselves.

    Rounds of joins over the nodes found last, until there are none, or after ``most`` steps; cycles end as known nodes are not followed again.
    """
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    newest = seen
    for depth in count(1) if most is None else range(1, most + 1):
        found = newest.join(edges, newest.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        newest = cut(found.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        seen = cut(seen.unionByName(newest))
    return seen


def sections(lines: DataFrame, doc: str, pos: str, line: str, heading: Column) -> DataFrame:
    """``section`` of each line, counted from 1 at the first heading; 0 before it."""
    so_far = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(so_far).cast("int"))


def within_budget(rows: DataFrame, group: str, order: list[str], size: str, most: int, block: Column | None = None) -> DataFrame:
    """Rows that still fit when each group's rows are taken in order and those that would exceed ``most`` are skipped.

    Rows that share group and order are one item, of their summed size; sizes are not negative, and a null one is 0. In a round each group takes the longest run of what is
    left that fits, which a running sum tells; of the rest only items as small as the room that is left stay, so the item that did not fit is gone, and there are as many rounds as
    skipped items are smaller than all skipped before. Items go through as sizes alone. ``block`` (see ``keyed.summed_before``) deals groups with a large share of all rows out.
    """
    keys, rounds = [group, *order], Rounds(rows.sparkSession, "within_budget")
    items = rows.groupBy(*keys).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("__size")).where(F.col("__size") <= most).withColumn("__room", F.lit(most).cast("long"))
    open_, taken = rounds.keep(items), []
    while not open_.isEmpty():
        summed = rounds.keep(summed_before(open_, [group], order, block, F.col("__size"), "__before"))
        fits = F.col("__before") + F.col("__size") <= F.col("__room")
        took = summed.where(fits)
        taken.append(took.select(*keys))
        used = took.groupBy(F.col(group).alias("__group")).agg(F.sum("__size").alias("__used"))
        left = summed.where(~fits).join(used, F.col(group).eqNullSafe(F.col("__group")), "left").withColumn("__room", F.col("__room") - F.coalesce("__used", F.lit(0)))
        open_ = rounds.keep(left.where("__size <= __room").select(*keys, "__size", "__room"))
    kept = reduce(DataFrame.union, taken) if taken else open_.select(*keys)
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys])
    return rows.alias("r").join(kept.alias("k"), same, "left_semi")
