"""State and review records over whole tables: advisories matched, names resolved, edits upserted, reviews chosen, rules changed, hierarchies, grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.severity import verdict_severity
from siftline.operators.advisories import assessed, scanned
from siftline.operators.findings import best_ranked, resolved_names, retired
from siftline.operators.keyed import replaced_children, upserted
from siftline.operators.queues import failure_kind, pending_reviews, stale, wants_review
from siftline.operators.tracing import callers, inherited_methods, key_origins, overwrite_changes, statement_verdict
from siftline.operators.views import granted, latest_page, resolved_files
from siftline.sources.tables import table


def _text(name: str):
    return F.col(name).cast("string")


def q_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What order lines have of parts as dependencies, parts as advisories with or without a CVE."""
    lines = table(spark, sf_dir, "lineitem").select(_text("l_partkey").alias("package"), (F.col("l_suppkey") % 4).cast("string").alias("version")).distinct()
    k = F.col("p_partkey")
    aliases = F.when(k % 3 == 0, F.array(F.lit("GHSA-x"), F.concat(F.lit("CVE-2024-"), (k % 50).cast("string")))).otherwise(F.array(F.lit("GHSA-y")))
    advisories = table(spark, sf_dir, "part").select(_text("p_partkey").alias("package"), F.explode(F.array(*map(F.lit, "01"))).alias("version"), F.col("p_size").alias("pos"), F.when(k % 5 == 0, F.concat(F.lit("CVE-2023-"), (k % 9).cast("string"))).otherwise("OSV-1").alias("advisory_id"), aliases.alias("aliases"))
    return scanned(lines, advisories).select("package", "version", "cve", "advisory_id")


def q_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    verdict = assessed(F.when(k % 7 != 0, k % 2 == 0), F.when(k % 3 != 0, "1.2"), F.when(k % 5 != 0, k % 4 == 0))
    return orders.select("o_orderkey", verdict.alias("verdict"))


def q_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names of parts, and the one full name that ends with each."""
    part = table(spark, sf_dir, "part")
    full = part.select(F.concat_ws(".", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit(".")), (F.col("p_partkey") % 40).cast("string")).alias("full")).distinct()
    uses = part.select("p_partkey", F.concat_ws(".", F.split_part("p_name", F.lit(" "), F.lit(2)), (F.col("p_partkey") % 50).cast("string")).alias("name"))
    return resolved_names(uses, full, "name").select("p_partkey", "name", "full")


def q_resolved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file of a name a document means: the nearest by folders, or none in a tie."""
    part = table(spark, sf_dir, "part")
    files = part.select(F.concat_ws("/", "p_type", F.replace("p_brand", F.lit("#"), F.lit("")), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".java"))).alias("path")).distinct()
    uses = part.select(F.concat_ws("/", "p_type", F.lit("Brand1"), F.lit("X.java")).alias("from_path"), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".java")).alias("name")).distinct()
    return resolved_files(uses, files)


def q_best_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return best_ranked(parts, ["p_brand"], F.col("p_size"))


def q_retired_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    found = orders.select(k.alias("fingerprint"), F.col("o_orderpriority").alias("rule_id"), F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("OPEN").alias("status"), (k % 5 == 0).alias("status_manual"), F.when(k % 2 == 0, "seen").alias("remark"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"))
    gone = spark.createDataFrame([("1-URGENT", "rule retired"), ("9-NONE", "x")], "rule_id string, reason string")
    done = retired(found, gone, F.lit("2024-05-01").cast("timestamp_ntz"))
    return done.select("fingerprint", "status", "remark", F.col("resolved_at").isNotNull().alias("solved"))


def q_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' state with the last order's status put in."""
    orders = table(spark, sf_dir, "orders")
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "F").alias("status"))
    newest = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return upserted(state, newest, ["k"])


def q_replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = lines.where("l_orderkey % 5 = 0 AND l_partkey % 2 = 0").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"), "l_partkey")
    return replaced_children(lines, new, ["l_orderkey"])


def q_review_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order lines are to be reviewed, and which of them are still to do."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    marked = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(k % 4 == 0, "UNKNOWN").when(k % 4 == 1, "SERVER_SET").when(k % 4 == 2, "CLIENT").alias("trace_safety"),
        F.when(s % 2 == 0, "HIGH").otherwise("LOW").alias("severity"), (k % 6).cast("string").alias("rule_id"), F.when(k % 11 != 0, F.concat(F.lit(" "), k.cast("string"))).otherwise(" ").alias("code"),
        (k % 3).cast("string").alias("input_hash"), F.when(s % 3 != 0, (s % 3).cast("string")).alias("reviewed_hash"), F.when(s % 5 < 3, (s % 5).cast("string")).alias("failed_hash"), (s % 6).cast("int").alias("failures"),
    )
    chosen = marked.where(wants_review(["HIGH"], ["3"], k % 13 == 0))
    return pending_reviews(chosen).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def q_stale_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    made = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("made"), F.max("ts").alias("seen"))
    return stale(made, "made", "seen").select("user_id")


def q_failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 401, 403, 404, 429, 500, 503)]), (k % 7 + 1).cast("int"))
    kinds = table(spark, sf_dir, "events").select(failure_kind(status, F.when(k % 3 == 0, "Read timed out").when(k % 3 == 1, "bad JSON")).alias("kind"), "event_type")
    return kinds.groupBy("kind", "event_type").agg(F.count("*").alias("n"))


def q_verdict_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of statements from their direct and generic routes, and the severity of each."""
    k = F.col("o_orderkey")
    name = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("CLIENT", "SERVER_SET", "UNKNOWN", "SESSION_OVERWRITE", "none")]), (n % 5 + 1).cast("int"))
    told = table(spark, sf_dir, "orders").select("o_orderkey", statement_verdict(name(k), name(F.floor(k / 5)), k % 17 == 0).alias("verdict"))
    return told.select("o_orderkey", "verdict", verdict_severity(F.col("verdict")).alias("severity"))


def q_inherited_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as types that extend the one of a third of their number; who calls the nearest method of that name."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    extends = part.where("p_partkey >= 3").select(k.alias("type"), F.floor(k / 3).alias("parent"))
    methods = part.where("p_partkey % 4 = 1").select("p_type", k.alias("owner")).select(F.col("p_type").alias("method"), "owner")
    calls = table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("type"), F.lit("ECONOMY").alias("method")).distinct()
    return callers(calls, inherited_methods(extends, methods)).groupBy("owner", "method").agg(F.count("*").alias("n_callers"))


def q_key_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("annotation"), F.col("l_linestatus").alias("first_param"), (F.col("l_suppkey") % 3).cast("string").alias("container"), (F.col("l_partkey") % 20).cast("string").alias("map_key")).distinct()
    part = table(spark, sf_dir, "part")
    rules = part.where("p_size > 25").select(F.lit("R").alias("annotation"), F.lit("F").alias("first_param"), (F.col("p_partkey") % 2).cast("string").alias("container"), (F.col("p_size") % 20).cast("string").alias("map_key"))
    return key_origins(lines, rules).groupBy("annotation", "first_param", "verdict").agg(F.count("*").alias("n"))


def q_overwrite_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of suppliers drafted from order lines, against those that parts have."""
    drafted = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 0").select((F.col("l_suppkey") % 60).cast("string").alias("target"), (F.col("l_partkey") % 30).cast("string").alias("key"), (F.col("l_linenumber") > 6).alias("session"))
    existing = table(spark, sf_dir, "part").where("p_size % 3 = 0").select((F.col("p_partkey") % 50).cast("string").alias("target"), (F.col("p_size") % 30).cast("string").alias("key"))
    return overwrite_changes(drafted, existing)


def q_latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 500 events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return latest_page(events, "ts", ["event_id"]).select("event_id", "user_id")


def q_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, their nation's suppliers as programs; what they may press in each."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    flags = lambda k: F.filter(F.array(*[F.when(k % n != 0, F.lit(b)) for n, b in ((2, "READ"), (3, "WRITE"), (5, "PRINT"))]), lambda b: b.isNotNull())
    grants = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("program_id"), flags(F.col("c_custkey")).alias("buttons"), (F.col("c_custkey") % 11 != 0).alias("active"))
    programs = supplier.groupBy(F.col("s_nationkey").alias("program_id")).agg(F.min("s_suppkey").alias("k")).select("program_id", flags(F.col("k") + 1).alias("buttons"), (F.col("k") % 6 != 0).alias("active"))
    return granted(grants, programs).select("user_id", "program_id", F.array_join("buttons", ",").alias("buttons"))


def q_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of conversations by role, as what calls used by label."""
    talk = table(spark, sf_dir, "conversations")
    return talk.groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("used"), F.sum(F.when(F.col("turn") % 2 == 0, F.length("text")).otherwise(0)).alias("of_even"))


QUERIES = {
    f.__name__: f
    for f in (q_scanned, q_assessed, q_resolved_names, q_resolved_files, q_best_ranked, q_retired_rules, q_upserted, q_replaced_children, q_review_choice, q_stale_summaries, q_failure_kinds, q_verdict_severity,
              q_inherited_callers, q_key_origins, q_overwrite_changes, q_latest_page, q_granted, q_token_usage)
}

ORACLES = {
    "q_scanned": """
        WITH d AS (SELECT DISTINCT l_partkey AS k, l_suppkey % 4 AS v FROM lineitem)
        SELECT k::VARCHAR AS package, v::VARCHAR AS version, CASE WHEN k % 3 = 0 THEN 'CVE-2024-' || k % 50 ELSE 'CVE-2023-' || k % 9 END AS cve, CASE WHEN k % 5 = 0 THEN 'CVE-2023-' || k % 9 ELSE 'OSV-1' END AS advisory_id
        FROM d JOIN part ON p_partkey = k WHERE v < 2 AND (k % 3 = 0 OR k % 5 = 0)
    """,
    "q_assessed": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 <> 0 THEN 'NOT_VULNERABLE'
            WHEN o_orderkey % 3 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 4 = 0) THEN 'FIXABLE' END AS verdict FROM orders
    """,
    "q_resolved_names": """
        WITH f AS (SELECT DISTINCT replace(lower(p_brand), '#', '') || '.' || replace(p_name, ' ', '.') || '.' || p_partkey % 40 AS full FROM part),
        u AS (SELECT p_partkey, split_part(p_name, ' ', 2) || '.' || p_partkey % 50 AS name FROM part),
        e AS (SELECT array_to_string(string_split("full", '.')[-2:], '.') AS name, count(*) AS n, min("full") AS "full" FROM f GROUP BY 1)
        SELECT p_partkey, u.name, e."full" FROM u LEFT JOIN e ON e.name = u.name AND n = 1
    """,
    "q_resolved_files": """
        WITH f AS (SELECT DISTINCT p_type AS t, replace(p_brand, '#', '') AS b, replace(p_name, ' ', '') || '.java' AS name FROM part),
        u AS (SELECT DISTINCT p_type AS t, replace(p_name, ' ', '') || '.java' AS name FROM part),
        m AS (SELECT u.t, u.name, f.t || '/' || f.b || '/' || f.name AS path, CASE WHEN f.t <> u.t THEN 0 WHEN f.b = 'Brand1' THEN 2 ELSE 1 END AS score FROM u JOIN f USING (name)),
        b AS (SELECT t, name, arg_max(path, score) AS path, max(score) AS best FROM m GROUP BY t, name),
        n AS (SELECT b.t, b.name, b.path, count(*) AS n FROM b JOIN m ON m.t = b.t AND m.name = b.name AND m.score = b.best GROUP BY ALL)
        SELECT t || '/Brand1/X.java' AS from_path, name, CASE WHEN n = 1 THEN path END AS path FROM n
    """,
    "q_best_ranked": "SELECT p_partkey, p_brand, p_size FROM part QUALIFY p_size = min(p_size) OVER (PARTITION BY p_brand)",
    "q_retired_rules": """
        WITH o AS (SELECT *, o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_orderkey % 5 <> 0 AS hit, CASE WHEN o_orderkey % 2 = 0 THEN 'seen' END AS r FROM orders)
        SELECT o_orderkey AS fingerprint, CASE WHEN hit OR o_orderstatus = 'F' THEN 'RESOLVED' ELSE 'OPEN' END AS status, CASE WHEN hit THEN concat_ws(' / ', r, 'rule retired') ELSE r END AS remark, hit AS solved FROM o
    """,
    "q_upserted": """
        WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'F' END AS status FROM customer), n AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey)
        SELECT coalesce(s.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.status ELSE s.status END AS status, n.k IS NOT NULL AND (s.k IS NULL OR s.status IS DISTINCT FROM n.status) AS changed FROM s FULL JOIN n ON n.k = s.k
    """,
    "q_replaced_children": """
        WITH n AS (SELECT l_orderkey, l_linenumber + 100 AS l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 5 = 0 AND l_partkey % 2 = 0)
        SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n
    """,
    "q_review_choice": """
        SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
        WHERE l_partkey % 13 <> 0 AND (l_partkey % 4 = 0 OR (l_partkey % 4 <> 1 AND (l_suppkey % 2 = 0 OR l_partkey % 6 = 3)))
            AND l_partkey % 11 <> 0 AND NOT (l_suppkey % 3 <> 0 AND l_partkey % 3 = l_suppkey % 3) AND NOT (l_suppkey % 5 < 3 AND l_partkey % 3 = l_suppkey % 5 AND l_suppkey % 6 >= 3)
    """,
    "q_stale_summaries": """
        WITH m AS (SELECT user_id, max(ts) FILTER (event_type = 'signup') AS made, max(ts) AS seen FROM events GROUP BY user_id) SELECT user_id FROM m WHERE made IS NULL OR seen > made
    """,
    "q_failure_kinds": """
        WITH e AS (SELECT event_type, event_id % 7 AS s, event_id % 3 = 0 AS t FROM events)
        SELECT CASE WHEN s IN (1, 2, 3) THEN 'FATAL' WHEN s > 3 OR t THEN 'TRANSIENT' ELSE 'CONTENT' END AS kind, event_type, count(*) AS n FROM e GROUP BY ALL
    """,
    "q_verdict_severity": """
        WITH o AS (SELECT o_orderkey AS k, [5, 2, 3, 1, NULL][o_orderkey % 5 + 1] AS d, [5, 2, 3, 1, NULL][(o_orderkey // 5) % 5 + 1] AS g, o_orderkey % 5 <> 4 OR true AS given FROM orders),
        r AS (SELECT k, CASE WHEN k % 17 = 0 THEN 0 WHEN g = 5 AND d < 5 THEN 4 ELSE greatest(coalesce(d, -1), coalesce(g, -1)) END AS r FROM o)
        SELECT k AS o_orderkey, CASE r WHEN 0 THEN 'XML_FIXED' WHEN 1 THEN 'SESSION_OVERWRITE' WHEN 2 THEN 'SERVER_SET' WHEN 3 THEN 'UNKNOWN' WHEN 4 THEN 'BYPASSABLE' WHEN 5 THEN 'CLIENT' END AS verdict,
            CASE WHEN r >= 4 THEN 'HIGH' WHEN r = 3 THEN 'MEDIUM' WHEN r >= 0 THEN 'LOW' END AS severity FROM r
    """,
    "q_inherited_callers": """
        WITH RECURSIVE up AS (
            SELECT p_partkey AS type, p_partkey AS up_to, 0 AS depth FROM part UNION ALL SELECT type, up_to // 3, depth + 1 FROM up WHERE up_to >= 3
        ), near AS (
            SELECT type, arg_min(up_to, depth) AS owner FROM up JOIN part ON p_partkey = up_to WHERE up_to % 4 = 1 AND p_type = 'ECONOMY' GROUP BY type
        )
        SELECT owner, 'ECONOMY' AS method, count(DISTINCT l_orderkey) AS n_callers FROM lineitem JOIN near ON type = l_partkey WHERE l_linenumber < 3 GROUP BY owner
    """,
    "q_key_origins": """
        WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_suppkey % 3 AS c, l_partkey % 20 AS m FROM lineitem),
        r AS (SELECT DISTINCT p_partkey % 2 AS c, p_size % 20 AS m FROM part WHERE p_size > 25)
        SELECT l_returnflag AS annotation, l_linestatus AS first_param, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND r.m IS NOT NULL THEN 'SESSION_OVERWRITE' ELSE 'CLIENT' END AS verdict, count(*) AS n
        FROM l LEFT JOIN r ON r.c = l.c AND r.m = l.m GROUP BY ALL
    """,
    "q_overwrite_changes": """
        WITH d AS (SELECT l_suppkey % 60 AS t, l_partkey % 30 AS k, bool_or(l_linenumber > 6) AS s FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY ALL),
        e AS (SELECT DISTINCT p_partkey % 50 AS t, p_size % 30 AS k FROM part WHERE p_size % 3 = 0)
        SELECT CASE WHEN s AND d.t NOT IN (SELECT t FROM e) THEN 'ADD_OVERWRITE' WHEN s THEN 'ADD_KEYS' ELSE 'REMOVE_KEYS' END AS change, d.t::VARCHAR AS target, d.k::VARCHAR AS key, s AS automatic
        FROM d LEFT JOIN e ON e.t = d.t AND e.k = d.k WHERE s = (e.k IS NULL)
    """,
    "q_latest_page": "SELECT event_id, user_id FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 500",
    "q_granted": """
        WITH p AS (SELECT s_nationkey AS n, min(s_suppkey) AS k FROM supplier GROUP BY s_nationkey)
        SELECT c_custkey AS user_id, c_nationkey AS program_id, concat_ws(',', CASE WHEN c_custkey % 2 <> 0 AND (k + 1) % 2 <> 0 THEN 'READ' END, CASE WHEN c_custkey % 3 <> 0 AND (k + 1) % 3 <> 0 THEN 'WRITE' END,
            CASE WHEN c_custkey % 5 <> 0 AND (k + 1) % 5 <> 0 THEN 'PRINT' END) AS buttons FROM customer JOIN p ON n = c_nationkey WHERE c_custkey % 11 <> 0 AND k % 6 <> 0
    """,
    "q_token_usage": "SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS used, CAST(sum(CASE WHEN turn % 2 = 0 THEN length(text) ELSE 0 END) AS BIGINT) AS of_even FROM conversations GROUP BY role",
}
