"""Scans against state: first and newest rows, reuse, diffs, reconciliation, ordinal matches, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.text import digest, normalized
from siftline.operators.findings import confusion, reconciled, worst_of
from siftline.operators.keyed import first_by_key, latest_reused, newest_by_key, set_diff, zipped
from siftline.operators.queues import limited_groups, pending_by_hash
from siftline.sources.tables import table


def q_first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("key", digest(normalized(F.lower("text"))))
    return first_by_key(docs, ["key"], F.col("doc_id")).select("doc_id", "key")


def q_newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.when(F.col("event_id") % 11 != 0, F.col("ts")))
    return newest_by_key(events, ["user_id", "event_type"], "at", F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


def q_latest_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    assessed = events.where("event_id % 3 = 0").select("user_id", "event_type", "ts", F.col("event_id").alias("from_event"), F.col("value").alias("reused"))
    wanted = events.where("event_id % 3 <> 0").select("event_id", "user_id", "event_type")
    found = latest_reused(wanted, assessed, ["user_id", "event_type"], "ts", ["from_event", "reused"], F.desc("from_event"))
    return found.select("event_id", "from_event", "reused")


def q_scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    year = lambda y: orders.where(F.year("o_orderdate") == y).select("o_custkey")
    return set_diff(year(1997), year(1998), ["o_custkey"])


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """A known state and a scan, made of parts: some known only, some found only, some both."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    fields = {
        "fingerprint": F.concat(F.lit("f"), k.cast("string")),
        "rule_id": F.concat(F.lit("r"), (k % 9).cast("string")),
        "file_path": F.concat(F.lit("src/"), (k % 23).cast("string"), F.lit(".java")),
        "severity": F.when(F.col("p_size") > 30, "HIGH").otherwise("LOW"),
    }
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    existing = part.where(k % 4 != 0).select(
        *[v.alias(n) for n, v in fields.items()],
        F.when(k % 7 == 0, "RESOLVED").when(k % 7 == 1, "FALSE_POSITIVE").otherwise("OPEN").alias("status"),
        (k % 13 == 0).alias("status_manual"),
        F.when(k % 17 == 0, "seen").alias("remark"),
        day("2024-01-01").alias("first_at"), day("2024-02-01").alias("last_at"),
        F.when(k % 7 == 0, day("2024-02-01")).alias("resolved_at"),
    )
    detected = part.where(k % 3 != 0).select(*[v.alias(n) for n, v in fields.items()], k.alias("pos"))
    failed = part.select(fields["file_path"].alias("file_path")).where("file_path = 'src/5.java'").distinct()
    active = part.select(fields["rule_id"].alias("rule_id")).where("rule_id <> 'r8'").distinct()
    away = part.where(k % 21 == 0).select(fields["fingerprint"].alias("fingerprint"), F.lit("r1").alias("kept_rule"))
    return existing, detected, failed, active, away


def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a scan and what became of each finding."""
    return reconciled(*_snapshots(spark, sf_dir), F.lit("2024-03-01").cast("timestamp_ntz"))


def q_reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = q_reconcile(spark, sf_dir)
    return after.groupBy("action", "status").agg(F.count("*").alias("n"))


def q_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    errors = events.where("event_type = 'error'").select("user_id", "day", "event_id")
    clicks = events.where("event_type = 'click'").select("user_id", "day", F.col("event_id").alias("click_id"))
    found = zipped(errors, clicks, ["user_id", "day"], F.col("event_id"), F.col("click_id"), ["click_id"])
    return found.select("event_id", "click_id", "matched")


def q_verdict_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts before and after, matched by ordinal in their key; new ones only where they are risky."""
    events = table(spark, sf_dir, "events")
    verdict = F.when(F.col("value") > 50, "CLIENT").when(F.col("value") > 20, "UNKNOWN").otherwise("SERVER_SET")
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    before = events.where("event_id % 2 = 0").select("user_id", "event_type", place.alias("ordinal"), verdict.alias("before"))
    after = events.where("event_id % 2 = 1").select("user_id", "event_type", place.alias("ordinal"), verdict.alias("after"))
    joined = after.join(before, ["user_id", "event_type", "ordinal"], "left")
    changed = (F.col("before") != F.col("after")) | (F.col("before").isNull() & (F.col("after") != "SERVER_SET"))
    return joined.where(changed)


def q_worst_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst verdict of each user, with the first evidence for it."""
    events = table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type") == "error", "CLIENT").when(F.col("event_type") == "signup", "UNKNOWN").otherwise("SERVER_SET")
    rows = events.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("key"), verdict.alias("verdict"), "event_id", F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("evidence"))
    return worst_of(rows, ["key"], "verdict", "event_id", "evidence")


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flagged = docs.where("doc_id % 19 <> 0").select("doc_id", F.col("text").rlike("idiot|stupid|moron|loser").alias("flagged"))
    return confusion(flagged, labels, "doc_id", F.col("flagged"), F.col("toxic") == 1)


def q_queue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty groups of a queue, whole: groups come in the order of their first rows."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return limited_groups(orders.select("o_orderkey", "o_custkey"), F.col("o_custkey"), F.col("o_orderkey"), 20, 200)


def q_pending_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is not the one that was reviewed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), digest(F.col("text")).alias("hash"))
    reviewed = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select(
        F.col("doc_id").alias("id"), digest(F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text"))).alias("hash")
    )
    return pending_by_hash(docs, reviewed, "id", "hash")


def q_asymmetric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's status after all events: errors open, purchases solve, a signup after that pins what it finds."""
    events = table(spark, sf_dir, "events")
    latest = lambda kind: F.max(F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    last = events.groupBy("user_id").agg(latest("error").alias("e"), latest("purchase").alias("p"), latest("signup").alias("s"))
    opened = F.col("e").isNotNull() & (F.col("p").isNull() | (F.col("e") > F.col("p")))
    status = F.when(opened, "OPEN").when(F.col("p").isNotNull(), "RESOLVED").otherwise("NONE")
    latest_change = F.greatest(F.coalesce("e", "p"), F.coalesce("p", "e"))
    return last.select("user_id", status.alias("status"), F.coalesce(F.col("s") > latest_change, F.lit(False)).alias("pinned"))


QUERIES = {
    f.__name__: f
    for f in (
        q_first_wins_dedupe, q_newest_per_key, q_latest_reuse, q_scan_diff, q_reconcile, q_reconcile_counts, q_positional_zip, q_verdict_diff,
        q_worst_of, q_confusion, q_queue_groups, q_pending_by_hash, q_asymmetric_status,
    )
}

_STATE = """
    e AS (
        SELECT p_partkey AS k, CASE WHEN k % 7 = 0 THEN 'RESOLVED' WHEN k % 7 = 1 THEN 'FALSE_POSITIVE' ELSE 'OPEN' END AS status, k % 13 = 0 AS manual,
            CASE WHEN k % 17 = 0 THEN 'seen' END AS remark FROM part WHERE p_partkey % 4 <> 0
    ), p AS (
        SELECT p_partkey AS k, 'r' || (p_partkey % 9) AS rule_id, 'src/' || (p_partkey % 23) || '.java' AS file_path, CASE WHEN p_size > 30 THEN 'HIGH' ELSE 'LOW' END AS severity,
            e.k IS NOT NULL AS known, p_partkey % 3 <> 0 AS found, status AS was, coalesce(manual, false) AS manual, remark
        FROM part LEFT JOIN e ON p_partkey = e.k WHERE p_partkey % 4 <> 0 OR p_partkey % 3 <> 0
    ), a AS (
        SELECT *, CASE
            WHEN found AND NOT known THEN 'INSERTED' WHEN found AND was = 'RESOLVED' AND NOT manual THEN 'REOPENED' WHEN found THEN 'REFRESHED'
            WHEN k % 21 = 0 THEN CASE WHEN was = 'OPEN' AND NOT manual THEN 'MERGED' ELSE 'KEPT' END
            WHEN file_path = 'src/5.java' OR rule_id = 'r8' THEN 'KEPT' WHEN was = 'OPEN' AND NOT manual THEN 'RESOLVED' ELSE 'KEPT' END AS action FROM p
    ), s AS (
        SELECT 'f' || k AS fingerprint, rule_id, file_path, severity,
            CASE WHEN action IN ('INSERTED', 'REOPENED') THEN 'OPEN' WHEN action IN ('RESOLVED', 'MERGED') THEN 'RESOLVED' ELSE was END AS status, manual AS status_manual,
            CASE WHEN action = 'MERGED' THEN concat_ws(' / ', remark, '같은 위치의 r1 탐지와 한 건으로 합침') ELSE remark END AS remark,
            CASE WHEN action = 'INSERTED' THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-01-01' END AS first_at,
            CASE WHEN found THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-02-01' END AS last_at,
            CASE WHEN action IN ('RESOLVED', 'MERGED') THEN TIMESTAMP '2024-03-01' WHEN action IN ('INSERTED', 'REOPENED') THEN NULL
                WHEN k % 7 = 0 THEN TIMESTAMP '2024-02-01' END AS resolved_at, action FROM a
    )
"""

ORACLES = {
    "q_first_wins_dedupe": r"""
        WITH d AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM documents)
        SELECT min(doc_id) AS doc_id, key FROM d GROUP BY key
    """,
    "q_newest_per_key": """
        SELECT user_id, event_type, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN event_id % 11 <> 0 THEN ts END DESC NULLS LAST, event_id DESC) = 1
    """,
    "q_latest_reuse": """
        WITH l AS (
            SELECT user_id, event_type, event_id AS from_event, value AS reused FROM events WHERE event_id % 3 = 0
            QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) = 1
        )
        SELECT event_id, from_event, reused FROM events LEFT JOIN l USING (user_id, event_type) WHERE event_id % 3 <> 0
    """,
    "q_scan_diff": """
        WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998)
        SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey,
            CASE WHEN a.o_custkey IS NULL THEN 'NEW' WHEN b.o_custkey IS NULL THEN 'GONE' ELSE 'KEPT' END AS change
        FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
    """,
    "q_reconcile": f"WITH {_STATE} SELECT * FROM s",
    "q_reconcile_counts": f"WITH {_STATE} SELECT action, status, count(*) AS n FROM s GROUP BY action, status",
    "q_positional_zip": """
        WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
        a AS (SELECT user_id, day, event_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, day) AS n FROM e WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id, day ORDER BY event_id)),
        b AS (SELECT user_id, day, event_id AS click_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, day) AS n FROM e WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id, day ORDER BY event_id))
        SELECT event_id, click_id, click_id IS NOT NULL AS matched FROM a LEFT JOIN b USING (user_id, day, i, n)
    """,
    "q_verdict_diff": """
        WITH e AS (
            SELECT user_id, event_type, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id) AS ordinal,
                CASE WHEN value > 50 THEN 'CLIENT' WHEN value > 20 THEN 'UNKNOWN' ELSE 'SERVER_SET' END AS v FROM events
        )
        SELECT a.user_id, a.event_type, CAST(a.ordinal AS INT) AS ordinal, a.v AS after, b.v AS before FROM (SELECT * FROM e WHERE side = 1) a
        LEFT JOIN (SELECT * FROM e WHERE side = 0) b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.ordinal = b.ordinal
        WHERE b.v <> a.v OR (b.v IS NULL AND a.v <> 'SERVER_SET')
    """,
    "q_worst_of": """
        WITH r AS (
            SELECT user_id * 100 + day(ts) AS key, event_id, CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 3 ELSE 2 END AS rank FROM events
        )
        SELECT key, CASE rank WHEN 5 THEN 'CLIENT' WHEN 3 THEN 'UNKNOWN' ELSE 'SERVER_SET' END AS verdict, 'event ' || event_id AS evidence
        FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC, event_id) = 1
    """,
    "q_confusion": """
        WITH p AS (SELECT doc_id, regexp_matches(text, 'idiot|stupid|moron|loser') AS f FROM documents WHERE doc_id % 19 <> 0)
        SELECT count(*) FILTER (f AND toxic = 1) AS tp, count(*) FILTER (f AND toxic <> 1) AS fp, count(*) FILTER (NOT f AND toxic = 1) AS fn,
            count(*) FILTER (NOT f AND toxic <> 1) AS tn, count(*) FILTER (f IS NULL) AS unknown FROM labels LEFT JOIN p USING (doc_id)
    """,
    "q_queue_groups": """
        WITH g AS (SELECT o_custkey, min(o_orderkey) AS f FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey ORDER BY f LIMIT 20)
        SELECT o_orderkey, o_custkey FROM orders JOIN g USING (o_custkey) WHERE o_orderstatus = 'P'
    """,
    "q_pending_by_hash": """
        WITH r AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0)
        SELECT doc_id AS id, sha256(text) AS hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = d.doc_id AND r.h = sha256(d.text))
    """,
    "q_asymmetric_status": """
        WITH l AS (
            SELECT user_id, max(ROW(ts, event_id)) FILTER (event_type = 'error') AS e, max(ROW(ts, event_id)) FILTER (event_type = 'purchase') AS p,
                max(ROW(ts, event_id)) FILTER (event_type = 'signup') AS s FROM events GROUP BY user_id
        )
        SELECT user_id, CASE WHEN e IS NOT NULL AND (p IS NULL OR e > p) THEN 'OPEN' WHEN p IS NOT NULL THEN 'RESOLVED' ELSE 'NONE' END AS status,
            coalesce(s > CASE WHEN p IS NULL OR e > p THEN e ELSE p END, false) AS pinned FROM l
    """,
}
