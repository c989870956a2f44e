"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

A document's failures are a mask with a bit for each filter, so all that any order does to a part of the documents is in
the counts of its masks. Masks are counted by Spark. Then the orders are walked by adjacent transpositions: each order comes from
the one before by one swap of neighbours, which changes two steps alone; these are read anew from the mask counts, and
what a filter removes is added up along the walk (its Shapley value times the number of orders).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import ASCII_SPACE, arrow_rows, table

#: Failure conditions over ``text`` (never null) and ``words`` (its words, repeats included), by the filter's letter.
FILTERS = {
    "A": "size(words) < 50",
    "B": "100L * size(array_distinct(words)) < 65L * size(words)",
    "C": "100L * length(regexp_replace(text, '[^A-Z]+', '')) > 5L * length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}
#: The filter of texts that a smaller id has already.
COPIES = "E"

COUNTED = ("n", "good", "toxic")
STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def masks(docs: DataFrame, filters: dict[str, str], id_column: str, text_column: str, part_column: str) -> DataFrame:
    """``id, part, key, mask, n``: the rows of each id, part and text (by its SHA-256), and which filters it fails."""
    texts = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    taken = texts.withColumn("words", F.array_remove(F.split("text", f"{ASCII_SPACE}+", -1), ""))
    mask = sum((F.when(F.expr(fails), 1 << bit).otherwise(0) for bit, fails in enumerate(filters.values())), F.lit(0))
    keyed = taken.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.alias("mask"))
    return keyed.groupBy("id", "part", "key", "mask").agg(F.count("*").alias("n"))


def cells(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, str] = FILTERS,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """``part, mask, n, good, toxic``: the documents of each part by the filters that they fail, and the labelled ones among them.

    The bits of ``mask`` are ``filters`` in their order; the next bit is set where a smaller id has the same text. Rows with the
    same id do not copy each other; a null id copies nothing and is copied by none, and has no label. A null text is
    empty, a null part is ''. Of several labels of an id any counts. Texts are read once, whole; a very long one must
    fit in memory with its words. An empty table gives none; other columns are not read.

    Copies of one text fail the same filters but the last, so they are counted, not joined: a text's rows are added up before
    the shuffle by text, together with what stands at its least id.
    """
    rows = masks(docs, filters, id_column, text_column, part_column)
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("is_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("is_toxic"),
    )
    # Rows without an id match no label and are dealt by their text.
    dealt = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("key")).otherwise(F.lit(0).cast("long")))
    marked = dealt.join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    counted = marked.withColumns({"good": F.col("n") * F.coalesce("is_good", F.lit(0)), "toxic": F.col("n") * F.coalesce("is_toxic", F.lit(0))})
    named = F.when(F.col("id").isNotNull(), F.struct("id", *COUNTED))
    # Rows of one id have one label, but may differ in their part; those of a part are one row here.
    held = counted.groupBy("key", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in COUNTED], F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(named).alias("first")
    )
    least = held.withColumn("least", F.min("first.id").over(Window.partitionBy("key")))
    original = {c: F.when(F.col("first.id") == F.col("least"), F.col(f"first.{c}")).otherwise(0) for c in COUNTED}
    original["n"] = original["n"] + F.col("nameless")
    split = F.array(
        F.struct("mask", *[v.alias(c) for c, v in original.items()]),
        F.struct(F.col("mask").bitwiseOR(1 << len(filters)).alias("mask"), *[(F.col(c) - v).alias(c) for c, v in original.items()]),
    )
    return least.select("part", F.inline(split)).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTED])


def walk(letters: str, counts: np.ndarray) -> Iterator[tuple]:
    """``order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of every order and step.

    ``counts[mask]`` has the documents, the good and the toxic ones of each mask.
    """
    size, every = len(letters), np.arange(len(counts))
    failing = [counts[(every >> f) & 1 == 1, 0].sum() for f in range(size)]
    order = list(range(size))

    def step(at: int) -> tuple:
        """What is kept after a step, and what it removes, from the masks that no earlier filter has removed."""
        earlier = sum(1 << f for f in order[:at])
        here = every & earlier == 0
        fails = here & ((every >> order[at]) & 1 == 1)
        return counts[here & ~fails, 0].sum(), *counts[fails].sum(axis=0)

    now, shapley, visited = [step(at) for at in range(size)], [0] * size, []
    for swap in [None, *plain_changes(size)]:
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            now[swap], now[swap + 1] = step(swap), step(swap + 1)
        for f, (_, removed, _, _) in zip(order, now, strict=True):
            shapley[f] += int(removed)
        visited.append((tuple(order), tuple(now)))
    for order_, steps in visited:
        name = "".join(letters[f] for f in order_)
        for at, (f, (kept, removed, good, toxic)) in enumerate(zip(order_, steps, strict=True), 1):
            yield name, at, int(kept), int(removed), int(failing[f] - removed), int(counts[1 << f, 0]), int(good), int(toxic), shapley[f]


def plain_changes(n: int) -> Iterator[int]:
    """Places to swap with the next, one after another, so that all orders of ``n`` things are visited once."""
    if n < 2:
        return
    others = plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1)
        if (at := next(others, None)) is None:
            return
        yield at + 1
        yield from range(n - 1)
        if (at := next(others, None)) is None:
            return
        yield at


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """The steps of all orders of ``letters`` for each part of what ``cells`` returns, zeros included.

    There is a row for each mask of a part at most, so a part is walked in memory, whatever its documents; parts are dealt out.
    Orders are n! and masks 2^n: made for some seven filters at most.
    """
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("cells"))

    def walked(rows: Iterator[tuple]) -> Iterator[tuple]:
        for part, held in rows:
            counts = np.zeros((1 << len(letters), len(COUNTED)), dtype=np.int64)
            for cell in held:
                counts[cell["mask"]] = [cell[c] for c in COUNTED]
            for found in walk(letters, counts):
                yield part, *found

    return arrow_rows(by_part, walked, STEP, [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over whole ``documents``, by source."""
    counted = cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(counted, "".join(FILTERS) + COPIES)


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLES = {
    "op13_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ), marks AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id
        ), masked AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
            FROM texts LEFT JOIN marks USING (doc_id)
        ), cells AS (
            SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
        ), orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ), steps AS (
            SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier
            FROM orders, (SELECT unnest(range(1, 6)) AS step)
        ), counted AS (
            SELECT part, filter_order, step, bit,
                coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept,
                coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS removed,
                coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0) AS redundant,
                coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS good_lost,
                coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS toxic_lost
            FROM cells, steps GROUP BY part, filter_order, step, bit
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            sum(removed) OVER (PARTITION BY part, bit) AS shapley
        FROM counted
    """
}
