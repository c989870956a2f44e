"""Programs as tables: value origins by frames of calls, puts that must have run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.frames import framed_origins
from siftline.operators.statements import key_verdicts, puts_before
from siftline.sources.state import Rounds
from siftline.sources.tables import table


#: Kinds of values in ``q_framed_origins``: those of calls, what methods return, parameters; then those that it does not list, and sites.
LETTERS = "xrpanc"


def q_framed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as methods that return their parameter, a constant, or what another returns for it; order lines as calls with their order as argument.

    Values are numbers until they are judged: the place of their letter in ``LETTERS``, and above it their key; lines' keys have as many places an order as line numbers span."""
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    orders = table(spark, sf_dir, "orders")
    least, most = lines.agg(F.min("l_linenumber"), F.max("l_linenumber")).head()
    least, span = least or 0, (most or 0) - (least or 0) + 1
    numbered = lambda letter, key: key.cast("bigint") * len(LETTERS) + LETTERS.index(letter)
    of = lambda letter, name: numbered(letter, F.col(name))
    at = F.col("l_orderkey") * span + (F.col("l_linenumber") - least)
    returned, param, called = of("r", "s"), of("p", "s"), of("n", "s")
    nested = supplier.where("s % 3 = 2").withColumn("t", F.floor(F.col("s") / 2))
    flows = supplier.where("s % 3 = 0").select(returned.alias("dst"), param.alias("src")).union(nested.select(returned, called))
    value, site = numbered("x", at), numbered("c", at)
    returns = lines.select(value.alias("dst"), of("r", "l_suppkey").alias("src"), site.alias("site")).union(nested.select(called, of("r", "t"), called))
    arguments = lines.select(of("p", "l_suppkey").alias("param"), of("a", "l_orderkey").alias("src"), site.alias("site")).union(nested.select(of("p", "t"), param, called))
    status = F.when(F.col("o_orderstatus") == "F", "CLIENT").when(F.col("o_orderstatus") == "O", "SERVER_SET")
    origins = (
        orders.select(of("a", "o_orderkey").alias("node"), status.alias("verdict")).where("verdict IS NOT NULL")
        .union(supplier.where("s % 3 = 1").select(returned, F.lit("SERVER_SET")))
        .union(supplier.where("s % 10 = 0").select(param, F.lit("CLIENT")))
        .withColumn("evidence", F.lit(None).cast("string"))
    )
    letter = F.expr(f"pmod(node, {len(LETTERS)})")
    found = framed_origins(flows, returns, arguments, origins, steps=False).where(letter < LETTERS.index("a")).withColumns({"letter": letter, "key": F.expr(f"(node - pmod(node, {len(LETTERS)})) div {len(LETTERS)}")})
    line = F.concat(F.lit("x"), F.expr(f"(key - pmod(key, {span})) div {span}").cast("string"), F.lit(":"), (F.expr(f"pmod(key, {span})") + least).cast("string"))
    named = F.when(F.col("letter") == LETTERS.index("x"), line).otherwise(F.concat(F.when(F.col("letter") == LETTERS.index("r"), "r").otherwise("p"), F.col("key").cast("string")))
    return found.select(named.alias("node"), "verdict")


def q_must_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as methods whose line numbers are statements, each in the one of half its number; what the last of each reads from a map."""
    line, parent = F.col("l_linenumber"), F.floor(F.col("l_linenumber") / 2).cast("int")
    key = lambda at: F.col("l_orderkey") * 8 + at
    single = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_partkey").alias("l_partkey"))
    lines = single.withColumns({"n": line, "up": parent, "q": (F.col("l_quantity") % 7).cast("int")})
    kind = F.element_at(F.array(*[F.lit(k) for k in ("BLOCK", "IF", "TRY", "WHILE", "RETURN", "EXPRESSION", "EXPRESSION")]), F.col("q") + 1)
    above = lines.select("l_orderkey", F.col("n").alias("up"), F.when(F.col("n") == 1, "BLOCK").otherwise(kind).alias("above"))
    first = F.col("n") % 2 == 0
    role = F.when(F.col("above") == "IF", F.when(first, "THEN").otherwise("ELSE")).when(F.col("above") == "TRY", F.when(first, "TRY").otherwise("CATCH"))
    rounds = Rounds(spark, "q_must_put")
    statements = rounds.keep(lines.join(above, ["l_orderkey", "up"], "left").select(
        F.col("l_orderkey").alias("method"), key(F.col("n")).alias("stmt"), F.when(F.col("above").isNotNull(), key(F.col("up"))).alias("parent"), F.col("n").alias("pos"),
        F.when(F.col("n") == 1, "BLOCK").when(role == "CATCH", "CATCH").otherwise(kind).alias("kind"), role.alias("role"),
        F.when(F.col("l_partkey") % 3 < 2, F.array(F.concat(F.lit("k"), (F.col("l_partkey") % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("puts"),
    ))
    last = statements.groupBy(F.col("method").alias("l_orderkey")).agg(F.max("pos").alias("n"))
    uses = rounds.keep(last.select(F.col("l_orderkey").alias("use"), key(F.col("n")).alias("stmt"), F.explode(F.array(F.lit("k0"), F.lit("k1"))).alias("key")))
    before = puts_before(statements, uses)
    values = statements.select(F.col("stmt").alias("put"), F.explode("puts").alias("key"), F.when(F.col("stmt") % 2 == 0, "SERVER_SET").otherwise("CLIENT").alias("verdict"))
    carried = uses.select("use", "key", F.lit("BYPASSABLE").alias("verdict"))
    return key_verdicts(before, values, carried)


QUERIES = {f.__name__: f for f in (q_framed_origins, q_must_put)}

ORACLES = {
    "q_framed_origins": """
        WITH RECURSIVE down AS (
            SELECT s_suppkey AS s, s_suppkey AS t FROM supplier UNION SELECT s, t // 2 FROM down WHERE t % 3 = 2
        ), passing AS (
            SELECT s, t % 3 = 0 AS passes FROM down WHERE t % 3 <> 2
        ), up AS (
            SELECT s_suppkey AS s, s_suppkey AS c FROM supplier
            UNION SELECT s, s_suppkey FROM up JOIN supplier ON s_suppkey // 2 = c AND s_suppkey % 3 = 2 WHERE c % 10 <> 0
        ), args AS (
            SELECT l_orderkey, l_linenumber, l_suppkey, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 2 ELSE 3 END AS rank
            FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
        ), called AS (
            SELECT l_suppkey AS c, max(rank) AS rank FROM args GROUP BY l_suppkey
        ), params AS (
            SELECT s, coalesce(max(CASE WHEN up.c % 10 = 0 THEN 5 ELSE rank END), 3) AS rank FROM up LEFT JOIN called ON called.c = up.c GROUP BY s
        ), found AS (
            SELECT 'x' || l_orderkey || ':' || l_linenumber AS node, CASE WHEN passes THEN rank ELSE 2 END AS rank FROM args JOIN passing ON s = l_suppkey
            UNION ALL SELECT 'r' || s, CASE WHEN passes THEN rank ELSE 2 END FROM params JOIN passing USING (s)
            UNION ALL SELECT 'p' || s, rank FROM params
            WHERE s % 3 <> 1 OR s % 10 = 0 OR s IN (SELECT c FROM called) OR s IN (SELECT s_suppkey // 2 FROM supplier WHERE s_suppkey % 3 = 2)
        )
        SELECT node, CASE max(rank) WHEN 5 THEN 'CLIENT' WHEN 2 THEN 'SERVER_SET' ELSE 'UNKNOWN' END AS verdict FROM found GROUP BY node
    """,
    "q_must_put": """
        WITH raw AS (
            SELECT l_orderkey AS m, l_linenumber AS n, l_linenumber // 2 AS up, CAST(min(l_quantity) AS INT) % 7 AS q,
                CASE WHEN min(l_partkey) % 3 < 2 THEN ['k' || min(l_partkey) % 3] ELSE [] END AS puts FROM lineitem GROUP BY l_orderkey, l_linenumber
        ), s AS (
            SELECT x.m, x.n, CASE WHEN y.n IS NOT NULL THEN x.up END AS up, x.puts, CASE WHEN y.n = 1 OR y.n IS NULL THEN 'BLOCK' ELSE ['BLOCK', 'IF', 'TRY', 'WHILE', 'RETURN', 'E', 'E'][y.q + 1] END AS above,
                CASE WHEN x.n = 1 THEN 'BLOCK' WHEN y.n > 1 AND y.q = 2 AND x.n % 2 = 1 THEN 'CATCH' ELSE ['BLOCK', 'IF', 'TRY', 'WHILE', 'RETURN', 'E', 'E'][x.q + 1] END AS kind
            FROM raw x LEFT JOIN raw y ON y.m = x.m AND y.n = x.up
        ), leaf AS (
            SELECT *, CASE WHEN kind = 'E' THEN puts ELSE [] END AS keys, kind = 'RETURN' AS ends FROM s
        ), both_of AS (
            SELECT p.m, p.n, p.kind, p.puts, a.keys AS ak, b.keys AS bk, coalesce(a.ends, false) AS ae, coalesce(b.ends, false) AS be, a.n IS NOT NULL AND b.n IS NOT NULL AS two
            FROM s p LEFT JOIN leaf a ON a.m = p.m AND a.n = 2 * p.n LEFT JOIN leaf b ON b.m = p.m AND b.n = 2 * p.n + 1 WHERE p.n IN (2, 3)
        ), middle AS (
            SELECT m, n, CASE kind WHEN 'E' THEN puts WHEN 'BLOCK' THEN list_concat(coalesce(ak, []), coalesce(bk, [])) WHEN 'TRY' THEN coalesce(ak, [])
                WHEN 'IF' THEN CASE WHEN NOT two THEN [] WHEN ae THEN bk WHEN be THEN ak ELSE list_intersect(ak, bk) END ELSE [] END AS keys,
                CASE kind WHEN 'RETURN' THEN true WHEN 'BLOCK' THEN ae OR be WHEN 'TRY' THEN ae WHEN 'IF' THEN two AND ae AND be ELSE false END AS ends FROM both_of
        ), folded AS (
            SELECT m, n, keys, ends FROM middle UNION ALL SELECT m, n, keys, ends FROM leaf WHERE n > 3
        ), step AS (
            SELECT s.m, s.n, s.up, CASE WHEN s.above = 'WHILE' OR (s.n > 3 AND t.kind = 'CATCH') THEN [] WHEN s.above = 'IF' AND t.kind = 'IF' THEN CASE WHEN o.ends THEN ['*'] ELSE coalesce(o.keys, []) END ELSE ['*'] END AS open
            FROM s LEFT JOIN s t ON t.m = s.m AND t.n = s.up LEFT JOIN folded o ON o.m = s.m AND o.n = CASE WHEN s.n % 2 = 0 THEN s.n + 1 ELSE s.n - 1 END AND o.n > 1
        ), puts AS (
            SELECT m, n, unnest(puts) AS key FROM s WHERE kind = 'E'
        ), reach AS (
            SELECT p.m, p.n, p.key, a.up AS shared FROM puts p JOIN step a ON a.m = p.m AND a.n = p.n WHERE a.up IS NOT NULL
            UNION SELECT p.m, p.n, p.key, b.up FROM puts p JOIN step a ON a.m = p.m AND a.n = p.n JOIN step b ON b.m = a.m AND b.n = a.up
            WHERE b.up IS NOT NULL AND (list_contains(a.open, '*') OR list_contains(a.open, p.key))
        ), uses AS (
            SELECT z.m, z.last, a.up AS u1, b.up AS u2, unnest(['k0', 'k1']) AS key FROM (SELECT m, max(n) AS last FROM s GROUP BY m) z
            JOIN s a ON a.m = z.m AND a.n = z.last LEFT JOIN s b ON b.m = z.m AND b.n = a.up
        ), pairs AS (
            SELECT u.m, u.key, p.n, CASE WHEN p.n % 2 = 0 THEN 2 ELSE 5 END AS rank, EXISTS (
                SELECT 1 FROM reach r WHERE r.m = u.m AND r.n = p.n AND r.key = p.key AND (r.shared = u.last OR r.shared = u.u1 OR r.shared = u.u2)) AS must
            FROM uses u JOIN puts p ON p.m = u.m AND p.key = u.key AND p.n < u.last
        ), worst AS (
            SELECT m, key, max(rank) AS rank, bool_or(must) AS covered FROM pairs GROUP BY m, key
        )
        SELECT u.m AS use, u.key, coalesce(covered, false) AS covered,
            CASE CASE WHEN covered THEN rank ELSE greatest(4, coalesce(rank, 4)) END WHEN 5 THEN 'CLIENT' WHEN 4 THEN 'BYPASSABLE' ELSE 'SERVER_SET' END AS verdict
        FROM uses u LEFT JOIN worst w ON w.m = u.m AND w.key = u.key
    """,
}
