"""Lists and indicators: owners with open items, rates, matrices, orders, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.severity import ranked
from siftline.functions.text import rounded_rate
from siftline.operators.keyed import one_by_one, placed, searched
from siftline.sources.state import tsv_line
from siftline.sources.tables import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def q_open_by_owner_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    opened = orders.where(F.col("o_orderstatus") == "O").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return (
        customer.join(opened, "c_custkey", "left")
        .select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_open"))
        .orderBy(F.desc("n_open"), "c_custkey")
        .limit(5)
    )


def q_open_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every owner with the count of open items, 0 included."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    opened = orders.where(F.col("o_orderstatus") == "O").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return customer.join(opened, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_open"))


def q_severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen's order: rank, price from high to low with nulls last, key; each row with its place among those of its rank."""
    orders = table(spark, sf_dir, "orders")
    ordered = orders.select("o_orderkey", ranked(F.col("o_orderpriority"), PRIORITIES).alias("severity_rank"), "o_totalprice")
    return placed(ordered, ["severity_rank"], [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], F.floor(F.col("o_totalprice") / 1000))


def q_kpi_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    is_open, is_closed = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    counts = orders.agg(
        F.count_if(is_open).alias("n_open"),
        F.count_if(is_closed).alias("n_closed"),
        F.count_if(is_open & (F.col("o_orderpriority") == "1-URGENT")).alias("n_urgent"),
    )
    whole = F.col("n_open") + F.col("n_closed")
    return counts.select(
        "n_open",
        "n_closed",
        rounded_rate(F.col("n_urgent"), F.col("n_open"), 0).alias("urgent_rate"),
        F.when(F.col("n_open") == 0, 100).otherwise(rounded_rate(F.col("n_closed"), whole, 100)).cast("int").alias("closed_rate"),
    )


def q_status_severity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def q_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings, the share of high ones and the share dealt with, per nation; with whether any was seen."""
    supplier, lineitem = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    by_supplier = lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count_if(F.col("l_returnflag") == "N").alias("n_open"),
        F.count_if((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("n_high"),
        F.count("*").alias("n"),
    )
    sums = supplier.join(by_supplier, "s_suppkey", "left").groupBy("s_nationkey").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_open", "n_high", "n")]
    )
    return sums.select(
        "s_nationkey",
        "n_open",
        rounded_rate(F.col("n_high"), F.col("n_open"), 0).alias("high_rate"),
        rounded_rate(F.col("n") - F.col("n_open"), F.col("n"), 0).alias("handled_rate"),
        (F.col("n") > 0).alias("scanned"),
    )


def q_optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    wanted = one_by_one({"o_orderstatus": "O", "o_orderpriority": None, "o_custkey": None})
    return orders.where(wanted).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


def q_not_in_3vl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a priority are in no list and not out of one either."""
    orders = table(spark, sf_dir, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return orders.where(~F.col("p").isin("1-URGENT", "2-HIGH")).groupBy("p").agg(F.count("*").alias("n"))


def q_null_safe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing key matches a missing key only."""
    orders = table(spark, sf_dir, "orders")
    key = F.nullif("o_orderpriority", F.lit("3-MEDIUM"))
    a = orders.where("o_orderstatus = 'O'").groupBy(key.alias("ka")).agg(F.count("*").alias("n_open"))
    b = orders.where("o_orderstatus = 'P'").groupBy(key.alias("kb")).agg(F.count("*").alias("n_pending"))
    return a.join(b, a.ka.eqNullSafe(b.kb), "full").select(F.coalesce("ka", "kb").alias("key"), "n_open", "n_pending")


def q_semi_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only items whose owner is still there."""
    orders = table(spark, sf_dir, "orders")
    there = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return orders.join(there, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def q_anti_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different keys without a result, or whose result says to try again."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    done = orders.where((F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % 5 != 0)).select(F.col("o_orderkey").alias("l_orderkey"))
    return lineitem.select("l_orderkey").distinct().join(done, "l_orderkey", "left_anti")


def q_contains_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return searched(part, {"p_type": "Econ", "p_name": ""}, {"p_size": [1, 5, 9, 13, 21, 40], "p_brand": []}).select("p_partkey", "p_type", "p_size")


def q_range_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.functions.text import capped_range

    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50 + 1).cast("int").alias("first"), F.col("p_size").alias("size"))
    last = F.col("first") + F.col("size") * 4
    hit = F.col("first") + (F.col("p_partkey") % (F.col("size") * 4 + 1)).cast("int")
    start, end = capped_range(F.col("first"), last, hit, hit, 80)
    return part.select("p_partkey", start.alias("range_start"), end.alias("range_end"))


def q_export_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines with tabs: tabs and line ends in values become blanks."""
    docs = table(spark, sf_dir, "documents")
    line = tsv_line([F.col(c) for c in ("doc_id", "lang", "source", "text")])
    return docs.select("doc_id", F.sha2(line, 256).alias("line_sha256"))


def q_listagg_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's different parts in order, in one line with their number."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    listed = part.groupBy("p_brand").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("p_type")).alias("types"))
    return listed.select("p_brand", "n", F.concat(F.col("n").cast("string"), F.lit(": "), F.array_join("types", ", ")).alias("note"))


QUERIES = {
    f.__name__: f
    for f in (
        q_open_by_owner_top5, q_open_by_owner, q_severity_order, q_kpi_rates, q_status_severity_matrix, q_dashboard, q_optional_filter, q_not_in_3vl,
        q_null_safe_key, q_semi_apps, q_anti_pending, q_contains_search, q_range_cap, q_export_tsv, q_listagg_note,
    )
}

_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END"

ORACLES = {
    "q_open_by_owner_top5": """
        SELECT c_custkey, c_name, count(o_orderkey) AS n_open
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O'
        GROUP BY c_custkey, c_name ORDER BY n_open DESC, c_custkey LIMIT 5
    """,
    "q_open_by_owner": """
        SELECT c_custkey, count(o_orderkey) AS n_open
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey
    """,
    "q_severity_order": f"""
        SELECT o_orderkey, {_RANK} AS severity_rank, o_totalprice,
            row_number() OVER (PARTITION BY {_RANK} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders
    """,
    "q_kpi_rates": """
        WITH c AS (
            SELECT count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_closed,
                count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS n_urgent FROM orders
        )
        SELECT n_open, n_closed, CAST(CASE WHEN n_open = 0 THEN 0 ELSE round(n_urgent * 100 / n_open) END AS INT) AS urgent_rate,
            CAST(CASE WHEN n_open = 0 THEN 100 ELSE round(n_closed * 100 / (n_open + n_closed)) END AS INT) AS closed_rate FROM c
    """,
    "q_status_severity_matrix": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "q_dashboard": """
        WITH c AS (
            SELECT s_nationkey, count(*) FILTER (l_returnflag = 'N') AS n_open,
                count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS n_high, count(l_suppkey) AS n
            FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_nationkey
        )
        SELECT s_nationkey, n_open, CAST(CASE WHEN n_open = 0 THEN 0 ELSE round(n_high * 100 / n_open) END AS INT) AS high_rate,
            CAST(CASE WHEN n = 0 THEN 0 ELSE round((n - n_open) * 100 / n) END AS INT) AS handled_rate, n > 0 AS scanned FROM c
    """,
    "q_optional_filter": "SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last_key FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
    "q_not_in_3vl": """
        SELECT p, count(*) AS n FROM (SELECT nullif(o_orderpriority, '5-LOW') AS p FROM orders)
        WHERE p NOT IN ('1-URGENT', '2-HIGH') GROUP BY p
    """,
    "q_null_safe_key": """
        WITH o AS (SELECT *, nullif(o_orderpriority, '3-MEDIUM') AS k FROM orders),
        a AS (SELECT k AS ka, count(*) AS n_open FROM o WHERE o_orderstatus = 'O' GROUP BY k),
        b AS (SELECT k AS kb, count(*) AS n_pending FROM o WHERE o_orderstatus = 'P' GROUP BY k)
        SELECT coalesce(ka, kb) AS key, n_open, n_pending FROM a FULL JOIN b ON ka IS NOT DISTINCT FROM kb
    """,
    "q_semi_apps": """
        SELECT o_orderstatus, count(*) AS n FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) GROUP BY 1
    """,
    "q_anti_pending": """
        SELECT DISTINCT l_orderkey FROM lineitem WHERE NOT EXISTS (
            SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P' AND o_orderkey % 5 <> 0)
    """,
    "q_contains_search": "SELECT p_partkey, p_type, p_size FROM part WHERE contains(lower(p_type), 'econ') AND p_size IN (1, 5, 9, 13, 21, 40)",
    "q_range_cap": """
        WITH p AS (
            SELECT p_partkey, CAST(p_partkey % 50 + 1 AS INT) AS a, CAST(p_partkey % 50 + 1 + p_size * 4 AS INT) AS b,
                CAST(p_partkey % 50 + 1 + p_partkey % (p_size * 4 + 1) AS INT) AS hit FROM part
        ), s AS (
            SELECT p_partkey, b, CASE WHEN b - a + 1 <= 80 THEN a ELSE least(greatest(a, hit - 40), greatest(a, b - 79)) END AS range_start, b - a + 1 <= 80 AS fits FROM p
        )
        SELECT p_partkey, range_start, CASE WHEN fits THEN b ELSE range_start + 79 END AS range_end FROM s
    """,
    "q_export_tsv": r"""
        SELECT doc_id, sha256(concat_ws(chr(9), CAST(doc_id AS VARCHAR), lang, source, regexp_replace(coalesce(text, ''), '[\t\r\n]+', ' ', 'g'))) AS line_sha256
        FROM documents
    """,
    "q_listagg_note": """
        SELECT p_brand, count(*) AS n, CAST(count(*) AS VARCHAR) || ': ' || string_agg(p_type, ', ' ORDER BY p_type) AS note
        FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand
    """,
}
