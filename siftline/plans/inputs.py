"""Inputs of reviews and checks of what comes back: hashes, slices, changes, summaries, mapper values, release sections, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.inputs import change_counts, changed_values, input_hash, line_starts_first, origin_members, overlaid, refusal, trace_target
from siftline.sources.tables import table


def q_input_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's review is of; some have no label, evidence or related code."""
    k = F.col("doc_id")
    label, evidence, related = F.when(k % 3 != 0, F.col("lang")), F.when(k % 2 == 0, F.lit("a.java:1\nb.xml:2")), F.when(k % 5 == 0, F.lit("r.java:3\nx"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", input_hash(F.lit("rule"), F.col("source"), F.col("text"), label, evidence, related).alias("input_hash"))


def q_origin_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines about a hit for the first five documents of a source, else the hit's line alone."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("code"), F.lit(10).alias("code_start"), (F.col("doc_id") % 30 + 10).cast("int").alias("start_line"))
    found = origin_members(docs, "source", "doc_id")
    return found.select("doc_id", "slice_start", F.sha2("slice", 256).alias("slice_sha256"))


def q_change_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that orders propose, an order's lines being its changes: how many are sound."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    coordinate = F.when(k % 7 == 0, "no coordinate").when(k % 7 == 1, None).otherwise(F.concat(F.lit("g:a"), k.cast("string")))
    via = F.when(k % 5 == 0, "COPY").when(k % 5 == 1, "BOM").otherwise("DIRECT")
    changes = table(spark, sf_dir, "lineitem").select("l_orderkey", coordinate.alias("coordinate"), F.lit("1").alias("before"), F.when(n % 4 == 0, " ").otherwise("2").alias("after"), via.alias("via"))
    return change_counts(changes, "l_orderkey")


def q_summary_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as summaries: which are refused, and why."""
    k = F.col("doc_id")
    text = F.when(k % 11 == 0, "  ").otherwise(F.col("text"))
    why = refusal(k % 13 != 0, text, F.when(k % 3 != 0, "h"))
    return table(spark, sf_dir, "documents").select("doc_id", why.alias("why")).where("why IS NOT NULL")


def q_trace_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 4 == 0, F.concat(F.lit("${p"), k.cast("string"), F.lit("}"))).when(k % 4 == 1, "#id:VARCHAR#").when(k % 4 == 2, "$name$").otherwise("none")
    evidence = F.concat(F.lit("A.java:1 ${first}\nm.xml:2 "), value, F.lit(" (WHERE)"))
    return table(spark, sf_dir, "part").select("p_partkey", trace_target(evidence).alias("target"))


def q_section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as sections of release notes; every third part begins a release line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    placed = line_starts_first(lines, "l_orderkey", "l_linenumber", F.col("l_partkey") % 3 == 0)
    return placed.select("l_orderkey", "l_linenumber", F.col("place"))


def q_rule_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as systems with types as values: common values, their own, and those after an edit."""
    common = spark.createDataFrame([("sink", ["exec", "query"]), ("login", ["signIn"])], "kind string, values array<string>")
    kind = F.when(F.col("p_size") % 2 == 0, "sink").otherwise("extra")
    own = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("system"), kind.alias("kind")).agg(F.collect_set("p_type").alias("values"))
    whole = overlaid(common, own, "system", "kind", "values")
    edited = changed_values(F.col("values"), F.array(F.lit("added"), F.lit("exec")), F.array(F.lit("exec")))
    return whole.select("system", "kind", F.array_join("values", ",").alias("before"), F.array_join(edited, ",").alias("after"))


QUERIES = {f.__name__: f for f in (q_input_hash, q_origin_slices, q_change_list, q_summary_bounds, q_trace_target, q_section_order, q_rule_overlay)}

ORACLES = {
    "q_input_hash": """
        SELECT doc_id, sha256('rule' || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '') || chr(0)
            || CASE WHEN doc_id % 3 <> 0 THEN coalesce(lang, '') ELSE '' END || chr(0)
            || CASE WHEN doc_id % 2 = 0 THEN 'a.java:1' || chr(10) || 'b.xml:2' ELSE '' END
            || CASE WHEN doc_id % 5 = 0 THEN chr(0) || 'r.java:3' || chr(10) || 'x' ELSE '' END) AS input_hash FROM documents
    """,
    "q_origin_slices": """
        WITH d AS (SELECT doc_id, doc_id % 30 AS hit, string_split(text, chr(10)) AS l, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
        s AS (SELECT *, greatest(0, hit - 8) AS b, least(len(l), hit + 9) AS e FROM d)
        SELECT doc_id, CAST(CASE WHEN place <= 5 AND b < e THEN 10 + b ELSE hit + 10 END AS INT) AS slice_start,
            CASE WHEN place <= 5 AND b < e THEN sha256(array_to_string(l[b + 1:e], chr(10))) END AS slice_sha256 FROM s
    """,
    "q_change_list": """
        WITH c AS (SELECT l_orderkey, l_partkey % 7 > 1 AND l_linenumber % 4 <> 0 AND l_partkey % 5 <> 0 AS good FROM lineitem)
        SELECT l_orderkey, count(*) FILTER (good) AS kept, count(*) FILTER (NOT good) AS dropped FROM c GROUP BY l_orderkey
    """,
    "q_summary_bounds": r"""
        WITH d AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE coalesce(text, '') END, '^\s+|\s+$', '', 'g') AS t FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'UNKNOWN' WHEN t = '' THEN 'EMPTY' WHEN length(t) > 1000 THEN 'TOO_LONG' ELSE 'NO_HASH' END AS why
        FROM d WHERE doc_id % 13 = 0 OR t = '' OR length(t) > 1000 OR doc_id % 3 = 0
    """,
    "q_trace_target": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '${p' || p_partkey || '}' WHEN 1 THEN '#id:VARCHAR#' WHEN 2 THEN '$name$' END AS target FROM part
    """,
    "q_section_order": """
        SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey % 3 = 0) DESC, l_linenumber) AS INT) AS place FROM lineitem
    """,
    "q_rule_overlay": """
        WITH own AS (SELECT p_brand AS system, CASE WHEN p_size % 2 = 0 THEN 'sink' ELSE 'extra' END AS kind, p_type AS v FROM part),
        v AS (SELECT * FROM own UNION SELECT system, kind, c FROM (SELECT DISTINCT system FROM own), (VALUES ('sink', 'exec'), ('sink', 'query'), ('login', 'signIn')) t(kind, c)),
        e AS (SELECT * FROM v UNION SELECT system, kind, 'added' FROM v),
        a AS (SELECT system, kind, string_agg(v, ',' ORDER BY v) AS before FROM v GROUP BY ALL)
        SELECT system, kind, before, string_agg(v, ',' ORDER BY v) FILTER (v <> 'exec') AS after FROM e JOIN a USING (system, kind) GROUP BY ALL
    """,
}
