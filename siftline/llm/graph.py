"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of ``links`` (``a``, ``b``) reaches.

    Each round a node takes the smallest root among its neighbours', then its root's root, so a
    chain shrinks to half and better; rounds end when no root changes. Roots are written to the
    shared checkpoint folder after each round. Nodes without a link do not appear; links to
    itself, repeated links and an empty table are fine; links with a null end are left out.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    roots = cut(roots)
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lower = roots.join(near, "node").select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root")
        )
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = cut(lower.join(above, "root").select("node", "was", F.least("root", "above").alias("root")))
        roots = step.select("node", "root")
        if step.where(F.col("root") < F.col("was")).isEmpty():
            return roots
