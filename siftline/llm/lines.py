"""Line deduplication: lines that many documents share go, and stay in one document only.

Lines are exploded with their positions, normalised and hashed. A hash that stands in enough
distinct documents is dropped everywhere but in the largest document id that holds it, and the
remaining lines of each document are put together again in order of position. Only positions
travel: the hashes of all lines are shuffled, the texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import cut, joined_with_hot, row_key, table

#: The characters stripped at both ends of a line: space and U+0009 to U+000D.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, id_column: str, text_column: str) -> DataFrame:
    """``k`` of each row that loses lines, with the sorted positions of these lines."""
    # The key is made once a row, before its lines are taken apart.
    keyed = docs.select(row_key(id_column, text_column).alias("k"), F.col(id_column).alias("id"), F.split(F.col(text_column), "\n", -1).alias("lines"))
    lines = keyed.select("k", "id", F.posexplode("lines").alias("pos", "line")).select("k", "id", "pos", line_key(F.col("line")).alias("key"))
    hashed = lines.where(F.char_length("key") >= min_chars).select(
        "k", F.col("id").alias("doc"), "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")
    )
    common = (
        hashed.select("h1", "h2", "doc")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= min_docs)
    )
    held = joined_with_hot(hashed, cut(common), ["h1", "h2"], "n", ["keeper"], F.xxhash64("k", "pos"))
    # A null id is one document more, below all others.
    return held.where("NOT doc <=> keeper").groupBy("k").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def drop_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with columns ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    A line's key is the line stripped of ASCII white space, A-Z in lower case. Keys of
    ``min_chars`` code points or more that stand in ``min_docs`` documents or more lose all their
    lines, but in the largest id that holds the key. A null or empty text is one empty line and
    stays empty. Rows with the same id are one document when documents are counted, and so are
    all rows with a null id, which counts as the smallest; ids may be of any type with an order. Columns of ``docs`` with the names of
    the added ones are replaced; any others are allowed; repeated rows stay repeated; an empty table gives none.
    A line that very many documents hold is not joined in one task; a text's lines must fit in memory.
    """
    gone = repeated_lines(docs, min_chars, min_docs, id_column, text_column)
    whole = docs.select(F.struct(*docs.columns).alias("__row"), row_key(id_column, text_column).alias("__k"))
    text = F.coalesce(F.col("__row")[text_column], F.lit(""))
    lines = F.split(text, "\n", -1)
    dropped = F.coalesce("__dropped", F.array().cast("array<int>"))
    staying = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    kept = F.when(F.size(dropped) > 0, F.array_join(F.transform(staying, lambda at: F.get(lines, at)), "\n")).otherwise(text)
    return whole.join(gone.withColumnsRenamed({"k": "__k", "dropped": "__dropped"}), "__k", "left").select(
        *[F.col("__row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")],
        F.size(lines).cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what is left of every whole text of ``documents``."""
    kept = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup}

ORACLES = {
    "op6_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), lines AS (
            SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), common AS (
            SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone
            FROM keyed LEFT JOIN common USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """
}
