"""Benchmark decontamination: which documents contain which benchmark items.

Containment search with size-partitioned MinHash, in DataFrame functions only. Items are put in
classes by the number of their different shingles, sizes within a class being less than a quarter apart.
An item's sketch is its shingles with the least hashes, as many as its class needs: a document that holds the
demanded share of an item misses fewer shingles than the sketch has, so it holds one of the sketch at
least, and the search loses nothing. Documents too short for a class are not compared with it.
The pairs found are then verified by counting the item's shingles in the document, as words, not hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import cut, row_key, table

#: What stands between words, once the text is in lower case.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Bytes of sketches, shingles or candidates up to which that side of a join is sent to all executors; a row counts for ``ROW_BYTES`` beside its words.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def words(text: Column) -> Column:
    """The words of a text in lower case; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def starts(n: Column, size: Column) -> Column:
    """Where shingles begin; none for texts with fewer words than ``size``."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size))


def taken(words_: Column, at: Column, size: Column, most: int) -> list[Column]:
    return [F.when(i < size, F.get(words_, at + i)) for i in range(most)]


def shingle(words_: Column, at: Column, size: Column, most: int) -> Column:
    return F.concat_ws(" ", *taken(words_, at, size, most))


def hashed(words_: Column, at: Column, size: Column, most: int) -> Column:
    """A hash of the same words; codegen'd, without building the string."""
    return F.xxhash64(*taken(words_, at, size, most))


def bounded(side: DataFrame, told: str | None = None) -> DataFrame:
    """``side``, to be broadcast if its counted bytes are few (``told``: a text column); else it is shuffled like the other side."""
    own = F.coalesce(F.octet_length(told), F.lit(0)) if told else F.lit(0)
    n_bytes = side.agg(F.sum(own + ROW_BYTES)).head()[0] or 0
    return F.broadcast(side) if n_bytes <= BROADCAST_BYTES else side


def item_shingles(items: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """``item_id``, ``n_item`` (different shingles), ``size`` (in words), ``shingle``, ``h``, once each.

    An item of fewer words than ``size`` is one shingle of its own length.
    """
    texts = items.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("item_id"), words(F.col(text_column)).alias("w"))
    sized = texts.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(size)))
    each = sized.select("item_id", "w", "size", F.explode(starts(F.size("w"), F.col("size"))).alias("at"))
    own = F.col("w"), F.col("at"), F.col("size"), size
    different = each.select("item_id", "size", shingle(*own).alias("shingle"), hashed(*own).alias("h")).distinct()
    sizes = different.groupBy("item_id").agg(F.count("*").alias("n_item"))
    return different.join(sizes, "item_id").select("item_id", "n_item", "size", "shingle", "h")


def sketches(shingles: DataFrame, share: float) -> DataFrame:
    """``item_id``, ``h`` of each item's least hashes, ``least`` shingles that a document needs for its class."""
    # Class c holds sizes from 1.25^c up to 1.25^(c+1).
    class_ = F.floor(F.log(1.25, F.col("n_item") + 1e-9))
    sized = shingles.withColumn("low", F.ceil(F.pow(F.lit(1.25), class_) - 1e-9)).withColumn(
        "high", F.ceil(F.pow(F.lit(1.25), class_ + 1) + 1e-9)
    )
    # A document with the share of n shingles misses n - ceil(share * n) at most; of all n of the class this is the most.
    enough = (F.col("high") - F.floor(F.col("high") * share - 1e-9)).cast("int") + 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64("h"), "h", "shingle"))
    return (
        sized.withColumn("rank", rank)
        .where(F.col("rank") <= enough)
        .select("item_id", "h", F.ceil(F.col("low") * share - 1e-9).alias("least"))
        .distinct()
    )


def contained(
    docs: DataFrame,
    items: DataFrame,
    share: float = 0.8,
    size: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """``k`` (``common.row_key``), ``id``, ``item_id``, ``n_item``, ``n_shared``, ``containment`` of all pairs with ``share`` or more.

    Words are runs of letters and digits in lower case. Containment is the share of the item's
    different ``size``-word shingles that the document holds; an item of fewer words is one shingle of its own
    length, which any document may hold. A text without words, or null,
    holds and is held by nothing. Rows with the same id and text give one pair; items with the
    same id are one item, items without an id are left out; null ids of documents stay; a table that is empty gives no pairs; other
    columns are not read. The joins with the items are broadcast joins as long as these are small by count,
    shuffled ones beyond; no document is longer than its array of words.
    """
    shingles = cut(item_shingles(items, size, item_id_column, item_text_column))
    # The lengths of shingles, ``size`` of them at most.
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect()) or [size]
    probe = bounded(cut(sketches(shingles, share)))
    texts = docs.select(row_key(id_column, text_column).alias("k"), F.col(id_column).alias("id"), words(F.col(text_column)).alias("w"))

    def placed(length: int) -> Column:
        at = F.coalesce(starts(F.size("w"), F.lit(length)), F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(F.lit(length).alias("size"), p.alias("at")))

    def each(rows: DataFrame, *columns: Column | str) -> DataFrame:
        """The shingles of rows, of all lengths that items have."""
        if len(sizes) == 1:
            return rows.select(*columns, "w", F.lit(sizes[0]).alias("size"), F.explode(starts(F.size("w"), F.lit(sizes[0]))).alias("at"))
        places = [placed(n) for n in sizes]
        return rows.select(*columns, "w", F.explode(F.flatten(F.array(*places))).alias("p")).select(*columns, "w", "p.size", "p.at")

    own = F.col("w"), F.col("at"), F.col("size"), size
    # How many shingles a text has at most.
    n = sum((F.greatest(F.size("w") - x + 1, F.lit(0)) for x in sizes), F.lit(0))
    found = (
        each(texts.withColumn("n", n), "k", "id", "n")
        .select("k", "id", "n", hashed(*own).alias("h"))
        .join(probe, "h")
        .where("n >= least")
        .select("k", "id", "item_id")
        .distinct()
    )
    candidates = cut(found)
    rows = candidates.select("k").distinct()
    kept = texts.join(bounded(rows), "k", "left_semi")
    held = each(kept, "k", "id").select("k", "id", shingle(*own).alias("shingle"))
    wanted = bounded(shingles.select("item_id", "n_item", "shingle"), "shingle")
    pairs = held.join(wanted, "shingle").groupBy("k", "id", "item_id", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("n_shared") >= F.col("n_item") * share - 1e-9)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ``documents`` and ``benchmark`` items of which the document holds four fifths or more."""
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_item", "n_shared", "containment")


QUERIES = {"op8_decontaminate": op8_decontaminate}

ORACLES = {
    "op8_decontaminate": r"""
        WITH texts AS (
            SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
            UNION ALL
            SELECT 1, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark
        ), items AS (
            SELECT id, w, least(len(w), 5) AS size FROM texts WHERE kind = 1 AND len(w) > 0
        ), lengths AS (
            SELECT DISTINCT size FROM items
        ), wanted AS (
            SELECT DISTINCT id, array_to_string(list_slice(w, p, p + size - 1), ' ') AS s
            FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM items)
        ), held AS (
            SELECT DISTINCT id, array_to_string(list_slice(w, p, p + size - 1), ' ') AS s
            FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM texts JOIN lengths ON kind = 0 AND len(w) >= size)
        ), sizes AS (
            SELECT id AS item_id, count(*) AS n_item FROM wanted GROUP BY id
        ), shared AS (
            SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM held d JOIN wanted b ON d.s = b.s GROUP BY 1, 2
        )
        SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
        FROM shared JOIN sizes USING (item_id) WHERE n_shared >= n_item * 0.8 - 1e-9
    """
}
