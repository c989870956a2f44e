"""What stands around findings: related code, statements, prefixes, sinks, guards, columns, notes by rank of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.columns import byte_column, char_column
from siftline.functions.text import CODE_SECRET, CONFIG_SECRET
from siftline.operators.context import common_camel_prefix, enclosing_statements, related_code
from siftline.operators.notes import first_with_documents, repository_releases, rule_documents
from siftline.operators.sinks import guard_candidates, sink_verdicts
from siftline.sources.tables import table


def q_related_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pieces of code, their sentences as lines; a finding has the documents with the same rest of their number."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    candidates = docs.select(
        (k % 97).alias("finding"), k.alias("pos"), F.concat(F.when(k % 13 == 0, "src/test/").otherwise("src/"), F.col("source")).alias("path"), (k % 7).cast("int").alias("first"),
        F.split("text", r"\. |\n", -1).alias("lines"), (k % 11 == 0).alias("overlaps"), F.col("lang").alias("reason"),
    )
    return related_code(candidates).select("finding", "rank", "path", "first", F.sha2("code", 256).alias("code_sha256"), "reason")


#: Tags that pages have, in place of statements.
_TAGS = ["div", "article", "ul", "p", "h1"]


def q_enclosing_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a line for each tag; what every fifth line, and the one after it, stand in."""
    pages = table(spark, sf_dir, "pages")
    lines = pages.select("page_id", F.posexplode(F.split(F.replace("html", F.lit(">"), F.lit(">\n")), "\n", -1)).alias("at", "text")).select(F.col("page_id").alias("file"), (F.col("at") + 1).alias("line"), "text")
    hits = lines.where("line % 5 = 0").select(F.concat_ws(":", F.col("file").cast("string"), F.col("line").cast("string")).alias("hit"), "file", F.col("line").alias("start"), (F.col("line") + 1).alias("end"))
    return enclosing_statements(lines, hits, _TAGS)


def q_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the getters made of the names of a type's parts begin with, by size of the part."""
    part = table(spark, sf_dir, "part")
    word = lambda at: F.initcap(F.split_part("p_name", F.lit(" "), F.lit(at)))
    tail = F.when(F.col("p_partkey") % 4 == 0, "er").otherwise("")
    names = part.select(F.concat_ws(":", word(1), (F.col("p_size") % 8).cast("string")).alias("key"), F.concat(F.lit("get"), word(1), tail, word(2), F.when(F.col("p_size") % 2 == 0, word(1)).otherwise("Id")).alias("name"))
    return common_camel_prefix(names, "key", "name")


def _address(k: Column) -> tuple[Column, Column]:
    first = F.when(k % 3 == 0, F.concat(F.lit("https://h"), (k % 5).cast("string"), F.lit("/"))).when(k % 3 == 1, F.concat(F.lit("https://h"), (k % 5).cast("string")))
    return first, F.when(k % 2 == 0, "/x")


def q_sink_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings at calls, their line numbers as arguments, parts as expressions of up to two operands."""
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    target = F.when(F.col("o_orderpriority") < "2", "VALUE").when(F.col("o_orderpriority") < "4", "FIRST_ARGUMENT").otherwise("ARGUMENTS")
    sinks = orders.select(F.col("o_orderkey").alias("finding"), target.alias("target"), (F.col("o_custkey") % 2 == 0).alias("fixed_host"))
    single = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("node"))
    arguments = single.select(F.col("l_orderkey").alias("finding"), (F.col("l_linenumber") - 1).alias("pos"), "node")
    first, second = _address(F.col("k"))
    operands = part.select(F.col("k").alias("node"), F.lit(0).alias("pos"), first.alias("constant")).union(part.where("k % 7 <> 0").select("k", F.lit(1), second))
    verdict = F.when(F.col("k") % 4 == 0, "CLIENT").when(F.col("k") % 4 == 1, "SERVER_SET").when(F.col("k") % 4 == 2, "SESSION_OVERWRITE")
    values = part.select(F.col("k").alias("node"), verdict.alias("verdict"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("evidence")).where("verdict IS NOT NULL")
    return sink_verdicts(sinks, arguments, operands, values)


def q_guard_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as devices, their orders as methods that each call the next, order lines as code."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    hooks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.when(F.col("c_custkey") % 2 == 0, "INTERCEPTOR").otherwise("FILTER").alias("kind"))
    name = F.element_at(F.array(*map(F.lit, ("preHandle", "doFilter", "helper", "log"))), (k % 4 + 1).cast("int"))
    methods = orders.select(k.alias("method"), F.col("o_custkey").alias("owner"), name.alias("name"))
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    calls = orders.select(k.alias("caller"), after.alias("callee")).where("callee IS NOT NULL AND caller % 3 <> 0")
    code = F.element_at(F.array(*map(F.lit, ("u = getSession()", "return false;", "x = 1", "// getHeader(n)", "res.sendError(403)", "return;", "getCookies ()"))), (F.col("l_partkey") % 7 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("method"), F.col("l_linenumber").alias("pos"), code.alias("text"), "l_partkey").groupBy("method", "pos").agg(F.min_by("text", "l_partkey").alias("text"))
    return guard_candidates(hooks, methods, calls, lines, 2)


def q_byte_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in each document in bytes, and what character begins at a place in bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 900 + 1).cast("int").alias("c"))
    return docs.select("doc_id", byte_column(F.col("text"), F.col("c")).alias("byte_at"), char_column(F.col("text"), F.col("c")).alias("char_at"))


def q_ranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as libraries on their way from one version to another: guides that rules name, else releases of their repository, else none."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    numbers = lambda *n: F.array(*[x.cast("int") if isinstance(x, Column) else F.lit(x) for x in n])
    wanted = part.select(
        F.concat(F.col("p_brand"), F.lit(":"), k.cast("string")).alias("coordinate"), numbers(1, k % 4, 0).alias("start"), numbers(1 + k % 2, k % 6, 0).alias("end"),
        F.concat(F.when(k % 3 == 0, "https://github.com/").otherwise("git@gitlab.com:"), F.col("p_type"), F.lit("/r"), (k % 5).cast("string"), F.lit(".git")).alias("scm"),
    )
    rules = part.where("p_size % 10 = 1").select(F.concat(F.col("p_brand"), F.lit(":"), (k % 100).cast("string")).alias("prefix"), F.lit(1).alias("pos"), F.lit("GUIDE").alias("kind"), F.concat(F.lit("g/"), F.col("p_type"), F.lit("/{line}")).alias("url"), F.lit("{line}").alias("title"), F.lit(False).alias("by_section")).distinct()
    documents = part.select(F.concat(F.lit("g/"), F.col("p_type"), F.lit("/1."), (F.col("p_size") % 9).cast("string")).alias("url"), F.lit("guide").alias("text")).distinct()
    releases = part.select(F.when(k % 2 == 0, "GITHUB").otherwise("GITLAB").alias("host"), F.concat(F.col("p_type"), F.lit("/r"), (F.col("p_size") % 5).cast("string")).alias("path"), F.concat(F.lit("v1."), (k % 8).cast("string"), F.lit(".0")).alias("name"), F.lit("u").alias("url"), F.lit("notes").alias("text")).distinct()
    sources = [lambda w: rule_documents(w, rules, documents), lambda w: repository_releases(w, releases, "GITHUB"), lambda w: repository_releases(w, releases, "GITLAB")]
    return first_with_documents(wanted, sources).select("coordinate", "source", "title")


QUERIES = {f.__name__: f for f in (q_related_code, q_enclosing_statement, q_common_prefix, q_sink_verdicts, q_guard_candidates, q_byte_columns, q_ranked_sources)}

_QUOTE = "'"
_CODE, _CONFIG = (pattern.replace(_QUOTE, _QUOTE * 2) for pattern in (CODE_SECRET, CONFIG_SECRET))
_NAMES = "|".join(_TAGS)

ORACLES = {
    "q_related_code": rf"""
        WITH c AS (
            SELECT doc_id % 97 AS finding, doc_id AS pos, CASE WHEN doc_id % 13 = 0 THEN 'src/test/' ELSE 'src/' END || source AS path, CAST(doc_id % 7 AS INT) AS first, lang AS reason,
                string_split_regex(text, '\. |\n') AS lines FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0
        ), f AS (
            SELECT * FROM c WHERE len(list_filter(lines, lambda x: regexp_matches(x, '{_CODE}') OR regexp_matches(x, '{_CONFIG}'))) = 0
            QUALIFY row_number() OVER (PARTITION BY finding, path, first ORDER BY pos) = 1
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY finding ORDER BY pos) AS INT) AS rank, CASE WHEN len(lines) > 40 THEN 41 ELSE len(lines) END AS cost FROM f QUALIFY rank <= 8
        ), b AS (
            SELECT *, coalesce(sum(cost) OVER (PARTITION BY finding ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r
        ), t AS (
            SELECT *, CAST(least(len(lines), 40, 240 - before) AS INT) AS n FROM b WHERE before < 240
        )
        SELECT finding, rank, path, first, reason, sha256(array_to_string(lines[1:n], chr(10)) || CASE WHEN len(lines) > n THEN chr(10) || '    // … (이하 ' || (len(lines) - n) || '줄 생략)' ELSE '' END) AS code_sha256 FROM t
    """,
    "q_enclosing_statement": rf"""
        WITH s AS (SELECT page_id, string_split(replace(html, '>', '>' || chr(10)), chr(10)) AS l FROM pages),
        x AS (SELECT page_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line, unnest(l) AS text FROM s),
        m AS (SELECT page_id, line, nullif(lower(regexp_extract(text, '(?i)<({_NAMES})\b', 1)), '') AS tag, regexp_extract_all(lower(text), '</({_NAMES})\s*>', 1) AS closes FROM x),
        o AS (
            SELECT page_id, line, max(CASE WHEN tag IS NOT NULL THEN line END) OVER w AS o, max(CASE WHEN len(closes) > 0 THEN line END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c
            FROM m WINDOW w AS (PARTITION BY page_id ORDER BY line)
        ), e AS (
            SELECT page_id, line, unnest(closes) AS tag FROM m
        ), f AS (
            SELECT h.page_id, h.line, h.o, min(e.line) AS l FROM o h JOIN m ON m.page_id = h.page_id AND m.line = h.o JOIN e ON e.page_id = h.page_id AND e.tag = m.tag AND e.line >= h.o
            WHERE h.line % 5 = 0 AND (h.c IS NULL OR h.c <= h.o) GROUP BY h.page_id, h.line, h.o HAVING min(e.line) >= h.line + 1
        )
        SELECT h.page_id || ':' || h.line AS hit, f.o AS first, f.l AS last FROM o h LEFT JOIN f ON f.page_id = h.page_id AND f.line = h.line WHERE h.line % 5 = 0
    """,
    "q_common_prefix": r"""
        WITH w AS (SELECT *, string_split(p_name, ' ') AS s FROM part),
        v AS (SELECT *, upper(s[1][1]) || s[1][2:] AS a, upper(s[2][1]) || s[2][2:] AS b FROM w),
        n AS (SELECT a || ':' || p_size % 8 AS key, 'get' || a || CASE WHEN p_partkey % 4 = 0 THEN 'er' ELSE '' END || b || CASE WHEN p_size % 2 = 0 THEN a ELSE 'Id' END AS name FROM v),
        g AS (SELECT key, list(name) AS names, min(name) AS x, max(name) AS y FROM n GROUP BY key),
        l AS (SELECT key, names, x[1:list_max(list_filter(range(0, least(length(x), length(y)) + 1), lambda i: x[1:i] = y[1:i]))] AS p FROM g)
        SELECT key, nullif(CASE WHEN len(list_filter(names, lambda z: length(z) > length(p) AND NOT regexp_matches(z[length(p) + 1], '^[A-Z]$'))) > 0 THEN regexp_replace(p, '[A-Z]?[^A-Z]*$', '') ELSE p END, '') AS prefix FROM l
    """,
    "q_sink_verdicts": r"""
        WITH a AS (SELECT l_orderkey AS f, l_linenumber - 1 AS pos, min(l_partkey) AS k FROM lineitem GROUP BY ALL),
        p AS (
            SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS rank, CASE WHEN p_partkey % 4 < 3 THEN 'p' || p_partkey END AS why,
                CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 < 2 THEN 'https://h' || p_partkey % 5 || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '/x' ELSE '' END END AS prefix FROM part
        ), m AS (
            SELECT f, pos, o_custkey % 2 = 0 AND coalesce(regexp_full_match(prefix, 'https?://[^/\s]+/.*'), false) AS fixed, prefix, coalesce(rank, 3) AS rank, why FROM a JOIN orders ON o_orderkey = f LEFT JOIN p USING (k)
            WHERE CASE WHEN o_orderpriority < '2' THEN pos = 0 WHEN o_orderpriority < '4' THEN pos = 1 ELSE pos > 0 END
        ), t AS (
            SELECT f, pos, CASE WHEN fixed THEN 2 ELSE rank END AS rank, CASE WHEN fixed THEN 'fixed host: ' || prefix ELSE why END AS evidence FROM m
        )
        SELECT f AS finding, CASE rank WHEN 5 THEN 'CLIENT' WHEN 2 THEN 'SERVER_SET' WHEN 1 THEN 'SESSION_OVERWRITE' ELSE 'UNKNOWN' END AS verdict, evidence
        FROM t QUALIFY row_number() OVER (PARTITION BY f ORDER BY rank DESC, pos) = 1
    """,
    "q_guard_candidates": r"""
        WITH m AS (
            SELECT o_orderkey AS k, o_custkey AS owner, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders
        ), one AS (
            SELECT k AS start, k, owner, after, 0 AS depth FROM m WHERE k % 4 = CASE WHEN owner % 2 = 0 THEN 0 ELSE 1 END
        ), two AS (
            SELECT one.start, m.k, m.owner, m.after, 1 AS depth FROM one JOIN m ON m.k = one.after AND one.k % 3 <> 0
        ), three AS (
            SELECT two.start, m.k, m.owner, m.after, 2 AS depth FROM two JOIN m ON m.k = two.after AND two.k % 3 <> 0
        ), b AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
        l AS (
            SELECT l_orderkey AS k, l_linenumber AS pos, ['u = getSession()', 'return false;', 'x = 1', '// getHeader(n)', 'res.sendError(403)', 'return;', 'getCookies ()'][arg_min(l_partkey, l_partkey) % 7 + 1] AS text FROM lineitem GROUP BY ALL
        ), c AS (
            SELECT owner, depth, b.k, pos, text, text IN ('u = getSession()', 'getCookies ()') AS reads, text IN ('return false;', 'res.sendError(403)') AS stops, text = 'return;' AND owner % 2 = 1 AS ends FROM b JOIN l ON l.k = b.k
        ), r AS (
            SELECT owner, arg_min(text, (depth, k, pos)) FILTER (reads) AS reads, coalesce(arg_min(text, (depth, k, pos)) FILTER (stops), arg_min(text, (depth, k, pos)) FILTER (ends)) AS blocks FROM c GROUP BY owner
        )
        SELECT owner, CASE WHEN owner % 2 = 0 THEN 'INTERCEPTOR' ELSE 'FILTER' END AS kind, reads, blocks FROM r WHERE reads IS NOT NULL AND blocks IS NOT NULL AND owner IN (SELECT c_custkey FROM customer)
    """,
    "q_byte_columns": """
        WITH d AS (SELECT doc_id, text, CAST(doc_id % 900 + 1 AS INT) AS c FROM documents),
        p AS (SELECT doc_id, c, strlen(text[1:c - 1]) + 1 AS b, list_filter(range(1, least(c, length(text) + 1) + 1), lambda i: strlen(text[1:i - 1]) + 1 = c) AS found FROM d)
        SELECT doc_id, CAST(b AS INT) AS byte_at, CAST(found[1] AS INT) AS char_at FROM p
    """,
    "q_ranked_sources": r"""
        WITH w AS (
            SELECT p_brand || ':' || p_partkey AS coordinate, p_partkey % 4 AS sm, 1 + p_partkey % 2 AS major, p_partkey % 6 AS em, CASE WHEN p_partkey % 3 = 0 THEN 'GITHUB' ELSE 'GITLAB' END AS host, p_type || '/r' || p_partkey % 5 AS path FROM part
        ), l AS (
            SELECT coordinate, '1.' || unnest(range(sm + 1, em + 1)) AS line FROM w WHERE major = 1
            UNION ALL SELECT coordinate, '1.' || unnest(range(sm + 1, sm + 11)) FROM w WHERE major = 2 UNION ALL SELECT coordinate, '2.' || unnest(range(0, em + 1)) FROM w WHERE major = 2
        ), r AS (SELECT DISTINCT p_brand || ':' || p_partkey % 100 AS prefix, p_type FROM part WHERE p_size % 10 = 1),
        g AS (SELECT DISTINCT p_type, '1.' || p_size % 9 AS line FROM part),
        d AS (SELECT DISTINCT w.coordinate, l.line, r.p_type FROM w JOIN r ON starts_with(w.coordinate, r.prefix) JOIN l ON l.coordinate = w.coordinate JOIN g ON g.p_type = r.p_type AND g.line = l.line),
        v AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'GITHUB' ELSE 'GITLAB' END AS host, p_type || '/r' || p_size % 5 AS path, p_partkey % 8 AS n FROM part)
        SELECT coordinate, 'RULE' AS source, line AS title FROM d
        UNION ALL SELECT coordinate, v.host, 'v1.' || n || '.0' FROM w JOIN v ON v.host = w.host AND v.path = w.path
        WHERE coordinate NOT IN (SELECT coordinate FROM d) AND n > sm AND (major = 2 OR n <= em)
    """,
}
