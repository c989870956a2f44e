"""What reviewers see and do: edits, stale verdicts, context lines, prefix rules, releases on the way, stopped workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.releases import relevant, version_numbers
from siftline.operators.queues import batched, stopped_at
from siftline.operators.views import by_prefix, context_lines, edited, verdict_shown
from siftline.sources.tables import table


def q_manual_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after edits by hand; only what differs counts as changed."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("OPEN")
    state = orders.select("o_orderkey", status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "old").alias("remark"), F.lit(False).alias("status_manual"))
    k = F.col("o_orderkey")
    edits = orders.where("o_orderkey % 4 = 0").select(
        "o_orderkey", F.when(k % 8 == 0, "RESOLVED").when(k % 12 == 0, "OPEN").alias("status"), F.when(k % 5 == 0, " ").when(k % 7 == 0, "new").alias("remark")
    )
    return edited(state, edits, "o_orderkey")


def q_verdict_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    now = F.when(k % 7 != 0, F.sha2("text", 256))
    reviewed = F.sha2(F.when(k % 3 == 0, F.upper("text")).otherwise(F.col("text")), 256)
    shown = verdict_shown(now, reviewed, F.when(k % 2 == 0, "SAFE"), (k % 5).cast("int"))
    return docs.select("doc_id", shown.alias("verdict"))


def q_context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    found = context_lines(docs, "source", ["doc_id"], "text")
    return found.select("source", "doc_id", "place", F.sha2("text", 256).alias("told_sha256"))


def q_prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("Brand#1", "r1"), ("Brand#11", "r2"), ("Brand#2", "r3"), ("Brand#55x", "r4")], "prefix string, rule string")
    return by_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), rules, "p_brand", "prefix").select("p_partkey", "rule")


def q_releases_on_the_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases that matter when going from 2.3.1 to 5.2.0."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.concat(F.lit("Release v"), F.concat_ws(".", (F.col("p_size") % 7).cast("string"), (k % 5).cast("string"), (k % 3).cast("string")), F.when(k % 4 == 0, "-RC1").otherwise(""), F.lit(" notes"))
    start, end = (F.array(*map(F.lit, v)) for v in ((2, 3, 1), (5, 2, 0)))
    rows = part.select("p_partkey", text.alias("text"))
    return rows.where(relevant(F.col("text"), start, end)).select("p_partkey", F.array_join(version_numbers(F.col("text")), ".").alias("version"))


def q_stopped_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events up to the third in a row that is an error or a signup."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").isin("error", "signup").alias("failed"))
    return stopped_at(events, "user_id", F.col("event_id"), F.col("failed"), 3).select("user_id", "event_id")


def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return batched(orders, ["o_custkey"], F.col("o_orderkey"), 2).select("o_orderkey", "batch")


QUERIES = {f.__name__: f for f in (q_manual_edit, q_verdict_shown, q_context_lines, q_prefix_rules, q_releases_on_the_way, q_stopped_workers, q_batches)}

ORACLES = {
    "q_manual_edit": """
        WITH s AS (
            SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' ELSE 'OPEN' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'old' END AS remark,
                o_orderkey % 4 = 0 AS e, CASE WHEN o_orderkey % 8 = 0 THEN 'RESOLVED' WHEN o_orderkey % 12 = 0 THEN 'OPEN' END AS es,
                CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 7 = 0 THEN 'new' END AS er FROM orders
        ), n AS (
            SELECT k, status AS was, remark AS wr, e, e AND es IS NOT NULL AND es <> status AS moved, CASE WHEN e THEN coalesce(es, status) ELSE status END AS status,
                CASE WHEN e AND er IS NOT NULL THEN nullif(trim(er), '') ELSE remark END AS remark FROM s
        )
        SELECT k AS o_orderkey, status, remark, CASE WHEN moved THEN status <> 'OPEN' ELSE false END AS status_manual, e AND (moved OR remark IS DISTINCT FROM wr) AS changed FROM n
    """,
    "q_verdict_shown": """
        SELECT doc_id, CASE
            WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 AND sha256(text) = sha256(CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END) THEN 'SAFE'
            WHEN doc_id % 5 >= 3 THEN 'GIVEN_UP' WHEN doc_id % 7 <> 0 THEN 'PENDING' END AS verdict FROM documents
    """,
    "q_context_lines": """
        SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS place, sha256(substring(text, 1, 300)) AS told_sha256
        FROM documents QUALIFY place <= 40
    """,
    "q_prefix_rules": """
        SELECT p_partkey, rule FROM part JOIN (VALUES ('Brand#1', 'r1'), ('Brand#11', 'r2'), ('Brand#2', 'r3'), ('Brand#55x', 'r4')) r(prefix, rule) ON starts_with(p_brand, prefix)
    """,
    "q_releases_on_the_way": """
        WITH v AS (SELECT p_partkey, p_size % 7 AS a, p_partkey % 5 AS b, p_partkey % 3 AS c, p_partkey % 4 <> 0 AS final FROM part),
        k AS (SELECT *, a * 10000 + b * 100 + c AS n, a * 100 + b AS l FROM v)
        SELECT p_partkey, a || '.' || b || '.' || c AS version FROM k WHERE CASE WHEN final THEN n > 20301 AND n <= 50200 AND l > 203 ELSE c = 0 AND l > 203 AND l <= 502 END
    """,
    "q_stopped_workers": """
        WITH e AS (SELECT user_id, event_id, event_type IN ('error', 'signup') AS f FROM events),
        r AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e),
        n AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS k FROM r),
        s AS (SELECT user_id, min(event_id) AS stop FROM n WHERE k >= 3 GROUP BY user_id)
        SELECT user_id, event_id FROM n LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id <= stop
    """,
    "q_batches": """
        SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 2 AS INT) AS batch FROM orders WHERE o_orderstatus = 'P'
    """,
}
