"""Texts: fingerprints of lines, secrets, origins, pages, sections, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import CODE_SECRET, COMMENT_SECRET, CONFIG_SECRET, MASK, assigns_secret, html_text, masked, normalized
from siftline.operators.findings import equal_key, fingerprinted, same_origin_key
from siftline.operators.keyed import placed
from siftline.operators.trees import sections, within_budget
from siftline.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", normalized(F.col("line")))


def _block() -> Column:
    """What is in order of documents is numbered and added up in blocks of these."""
    return F.floor(F.col("doc_id") / 4096)


def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's fingerprint: source, normalised line, and which of its equals in the source it is."""
    found = fingerprinted(_lines(spark, sf_dir), ["source", "line"], F.struct("doc_id", "pos"), _block())
    return found.select("doc_id", "pos", "occurrence", "fingerprint")


def q_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that their source has more than once, with their numbers."""
    lines = _lines(spark, sf_dir).select("source", "doc_id", "pos", equal_key("source", "line").alias("key"))
    more = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = placed(lines, ["key"], [F.col("doc_id"), F.col("pos")], -_block()).join(more, "key")
    return found.select("source", "doc_id", "pos", (F.col("place") - 1).cast("int").alias("occurrence"), "n")


def q_mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with code that sets a secret, as all their lines read after masking."""
    docs = table(spark, sf_dir, "documents").where(assigns_secret(F.col("text")))
    hidden = F.array_join(F.transform(F.split("text", "\n", -1), masked), "\n")
    return docs.select("doc_id", F.sha2(hidden, 256).alias("masked_sha256"))


def q_mask_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the full masking rules change."""
    lines = _lines(spark, sf_dir).withColumn("masked", masked(F.col("line")))
    return lines.where("masked <> line").select("doc_id", "pos", "masked")


def q_secret_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line that sets a secret, which are not to be sent anywhere."""
    return table(spark, sf_dir, "documents").where(assigns_secret(F.col("text"))).select("doc_id")


def q_same_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source with the same first line: how many, and the first of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", same_origin_key(F.col("source"), F.col("lang"), F.col("text")).alias("key"))
    return docs.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1").select("first_doc", "n")


def q_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.sha2(html_text(F.col("html")), 256).alias("text_sha256"), F.length(html_text(F.col("html"))).alias("n"))


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number from JSON; 0 where the JSON cannot be read or lacks it."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props")).alias("props"))
    return events.select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0).cast("long")).alias("k"))


def q_section_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sections: a line that is short begins one."""
    cut = sections(_lines(spark, sf_dir), "doc_id", "pos", "line", F.length("line") < 40)
    return cut.where("section > 0").groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def q_budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language's documents in order, those that still fit in 20,000 characters."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.length("text").cast("long").alias("size"))
    return within_budget(docs, "lang", ["doc_id"], "size", 20_000, _block())


QUERIES = {
    f.__name__: f
    for f in (q_fingerprint, q_occurrence, q_mask_secrets, q_mask_lines, q_secret_blocks, q_same_origin, q_html_text, q_json_props, q_section_slice, q_budget_greedy)
}

_LINES = r"""
    s AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
    l AS (SELECT doc_id, source, CAST(unnest(range(len(l))) AS INT) AS pos, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS line FROM s)
"""
_NUMBERED = f"{_LINES}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY source, line ORDER BY doc_id, pos) - 1 AS INT) AS occurrence, count(*) OVER (PARTITION BY source, line) AS n FROM l)"

# The masking rules for DuckDB, which has no back references: a quoted piece is of one of two kinds, whose quotes are marked first.
_QUOTE = "'"
_CONFIG, _COMMENT, _CODE = (pattern.replace(_QUOTE, _QUOTE * 2) for pattern in (CONFIG_SECRET, COMMENT_SECRET, CODE_SECRET))
_MASKED = rf"""
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(line, '("(?:[^"\\]|\\.)*")|(''(?:[^''\\]|\\.)*'')', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'),
        chr(1) || '"[^' || chr(2) || ']*' || chr(2) || chr(3), '"{MASK}"', 'g'),
        chr(1) || chr(2) || '''[^' || chr(3) || ']*' || chr(3), '''{MASK}''', 'g'),
        '{_CONFIG}', '\1{MASK}', 'g'),
        '{_COMMENT}', '\1{MASK}', 'g')
"""

ORACLES = {
    "q_fingerprint": f"WITH {_NUMBERED} SELECT doc_id, pos, occurrence, sha256(source || chr(10) || line || chr(10) || occurrence) AS fingerprint FROM n",
    "q_occurrence": f"WITH {_NUMBERED} SELECT source, doc_id, pos, occurrence, n FROM n WHERE n > 1",
    "q_mask_secrets": rf"""
        SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda line: {_MASKED}), chr(10))) AS masked_sha256 FROM documents
        WHERE regexp_matches(text, '{_CODE}')
    """,
    "q_mask_lines": f"WITH {_LINES}, m AS (SELECT doc_id, pos, line, {_MASKED} AS masked FROM l) SELECT doc_id, pos, masked FROM m WHERE masked <> line",
    "q_secret_blocks": f"""
        SELECT doc_id FROM documents
        WHERE regexp_matches(text, '{_CODE}')
    """,
    "q_same_origin": r"""
        WITH k AS (SELECT doc_id, source || '|' || coalesce(lang, '') || '|' || nullif(trim(string_split(text, chr(10))[1]), '') AS key FROM documents)
        SELECT min(doc_id) AS first_doc, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1
    """,
    "q_json_props": """
        SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) END AS k FROM events
    """,
    "q_section_slice": f"""
        WITH {_LINES}, c AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
        SELECT doc_id, CAST(section AS INT) AS section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM c WHERE section > 0 GROUP BY doc_id, section
    """,
    "q_budget_greedy": """
        WITH RECURSIVE d AS (SELECT lang, doc_id, length(text) AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
        w AS (
            SELECT lang, doc_id, size, i, size <= 20000 AS kept, CASE WHEN size <= 20000 THEN size ELSE 0 END AS total FROM d WHERE i = 1
            UNION ALL
            SELECT d.lang, d.doc_id, d.size, d.i, w.total + d.size <= 20000, CASE WHEN w.total + d.size <= 20000 THEN w.total + d.size ELSE w.total END
            FROM w JOIN d ON d.lang = w.lang AND d.i = w.i + 1
        )
        SELECT lang, doc_id, size FROM w WHERE kept
    """,
    "q_html_text": r"""
        WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
        c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
        d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '') AS t FROM c)
        SELECT page_id, sha256(t) AS text_sha256, CAST(length(t) AS INT) AS n FROM d
    """,
}
