"""Versions, ranges, fixes and the graph of fixes, over versions made from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.versions import jump_class, major, numeric_key, numeric_parts, version_key, with_version_keys
from siftline.operators.advisories import event_range_text, event_ranges, fix_chain, in_event_ranges, in_ranges, lowest_above
from siftline.sources.tables import table


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of three numbers, the second of up to four digits, some of them candidates or named final."""
    k = F.col("p_partkey")
    suffix = F.when(k % 11 == 0, "-RC1").when(k % 11 == 1, ".Final").otherwise("")
    version = F.concat(F.concat_ws(".", (F.col("p_size") % 9).cast("string"), (k % 10 * 137).cast("string"), (k % 7).cast("string")), suffix)
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("package"), version.alias("version"))


def _key(version: Column) -> Column:
    """The native order of versions of numbers alone."""
    return F.when(version.isNotNull(), numeric_key(numeric_parts(version)))


def q_version_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit("v"), F.col("version"), F.when(F.col("p_partkey") % 3 == 0, "-RC1").otherwise(".Final"))
    rows = _versions(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(v).alias("version"))
    return rows.select("p_partkey", "version", major(F.col("version")).alias("major"))


def q_jump_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _versions(spark, sf_dir)
    to = F.concat_ws(".", (F.col("p_partkey") % 4).cast("string"), (F.col("p_partkey") % 10 * 137).cast("string"), F.lit("3"))
    pairs = with_version_keys(rows.select("p_partkey", "version", to.alias("next")), version_key="version", next_key="next")
    parts = [numeric_parts(F.col(c)) for c in ("version", "next")]
    return pairs.select("p_partkey", jump_class(*parts, F.col("next_key") > F.col("version_key")).alias("jump"))


def q_lowest_same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the versions are fixes of the others; by their numbers alone."""
    rows = _versions(spark, sf_dir)
    installed = rows.where("p_partkey % 3 <> 1").select("p_partkey", "package", "version", major(F.col("version")).alias("major"), _key(F.col("version")).alias("version_key"))
    fixes = rows.where("p_partkey % 3 = 1").select("package", F.col("version").alias("candidate"), major(F.col("version")).alias("candidate_major"), _key(F.col("version")).alias("candidate_key"))
    return lowest_above(installed, fixes, ["package"]).select("p_partkey", "version", "fix")


def _ranges(spark: SparkSession) -> DataFrame:
    rows = [("Brand#11", 0, "1.2.0", None, None, "3.0.0"), ("Brand#11", 1, None, "5.0.0", "6.4.2", None), ("Brand#12", 0, None, None, "2.0.0", None), ("Brand#13", 0, "4.0.0", None, None, None), ("Brand#21", 0, None, None, None, None)]
    out = spark.createDataFrame(rows, "package string, pos int, start_incl string, start_excl string, end_incl string, end_excl string")
    return out.select("package", "pos", *[version_key(c).alias(c) for c in out.columns[2:]])


def q_version_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    installed = with_version_keys(_versions(spark, sf_dir), key="version")
    return in_ranges(installed, _ranges(spark), ["package"], "key").select("p_partkey", "vulnerable", "range_pos")


def q_event_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("Brand#11", [("0", None, None), (None, "2.1.0", None), ("3.0.0", None, None), (None, None, "4.4.4")]),
        ("Brand#12", [("1.0.0", None, None), ("2.0.0", None, None), (None, "5.0.0", None)]),
        ("Brand#13", [(None, "9.9.9", None), ("6.0.0", None, None)]),
    ]
    events = spark.createDataFrame(rows, "package string, events array<struct<introduced:string,fixed:string,last_affected:string>>")
    ranges = events.select("package", F.posexplode(event_ranges(F.col("events"))).alias("pos", "r")).select(
        "package", "pos", "r.start", *[version_key(F.col(f"r.{c}")).alias(f"{c}_key") for c in ("start", "fixed", "last")],
        event_range_text(F.col("r.start"), F.col("r.fixed"), F.col("r.last")).alias("range_text"),
    )
    installed = with_version_keys(_versions(spark, sf_dir), key="version")
    found = in_event_ranges(installed, ranges, ["package"], "key")
    texts = ranges.select("package", F.col("pos").alias("range_pos"), "range_text")
    return found.join(texts, ["package", "range_pos"], "left").select("p_partkey", "vulnerable", "range_text")


def q_fix_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each affected version of a brand to a clean one, by the next version of the line."""
    rows = with_version_keys(_versions(spark, sf_dir).select("package", "version").distinct(), key="version")
    affected = rows.where(F.aggregate(numeric_parts(F.col("version")), F.lit(0), lambda a, x: a + x) % 3 != 0)
    keyed = lambda df, *names: df.select("package", F.col("version").alias(names[0]), major(F.col("version")).alias(names[1]), F.col("key").alias(names[2]))
    steps = lowest_above(keyed(affected, "version", "major", "version_key"), keyed(rows, "candidate", "candidate_major", "candidate_key"), ["package"])
    found = fix_chain(rows, steps.select("package", "version", F.col("fix").alias("next")))
    return found.select("package", "version", F.array_join("chain", ">").alias("chain"), "status", "target")


QUERIES = {f.__name__: f for f in (q_version_major, q_jump_class, q_lowest_same_line, q_version_range, q_event_range, q_fix_closure)}

_V = """v AS (
    SELECT p_partkey, p_brand AS package, p_size % 9 AS a, p_partkey % 10 * 137 AS b, p_partkey % 7 AS c, p_partkey % 11 = 0 AS rc,
        a || '.' || b || '.' || c || CASE p_partkey % 11 WHEN 0 THEN '-RC1' WHEN 1 THEN '.Final' ELSE '' END AS version,
        CAST(a AS BIGINT) * 1000000000 + b * 100000 + c * 10 + CASE WHEN rc THEN 0 ELSE 1 END AS k FROM part
)"""

ORACLES = {
    "q_version_major": f"""
        WITH {_V}, w AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE 'v' || version || CASE WHEN p_partkey % 3 = 0 THEN '-RC1' ELSE '.Final' END END AS version FROM v)
        SELECT p_partkey, version, coalesce(TRY_CAST(regexp_replace(regexp_extract(version, '^[^.-]*'), '[^0-9]', '', 'g') AS INT), -1) AS major FROM w
    """,
    "q_jump_class": f"""
        WITH {_V} SELECT p_partkey, CASE WHEN (p_partkey % 4) * 1000000000 + (p_partkey % 10 * 137) * 100000 + 31 <= k THEN 'UNKNOWN'
            WHEN p_partkey % 4 <> a THEN 'MAJOR' WHEN p_partkey % 10 * 137 <> b THEN 'MINOR' ELSE 'PATCH' END AS jump FROM v
    """,
    "q_lowest_same_line": f"""
        WITH {_V}, f AS (SELECT DISTINCT package, a, k // 10 AS n, version FROM v WHERE p_partkey % 3 = 1)
        SELECT i.p_partkey, i.version, min({{'n': f.n, 'v': f.version}}).v AS fix FROM (SELECT * FROM v WHERE p_partkey % 3 <> 1) i
        LEFT JOIN f ON f.package = i.package AND f.a = i.a AND f.n > i.k // 10 GROUP BY i.p_partkey, i.version
    """,
    "q_version_range": f"""
        WITH {_V}, r(package, pos, si, se, ei, ee) AS (VALUES
            ('Brand#11', 0, 1000200001, NULL, NULL, 3000000001), ('Brand#11', 1, NULL, 5000000001, 6000400021, NULL), ('Brand#12', 0, NULL, NULL, 2000000001, NULL),
            ('Brand#13', 0, 4000000001, NULL, NULL, NULL), ('Brand#21', 0, NULL, NULL, NULL, NULL)
        ), j AS (
            SELECT p_partkey, pos, (si IS NULL OR NOT k < si) AND (se IS NULL OR NOT k <= se) AND (ei IS NULL OR NOT k > ei) AND (ee IS NULL OR NOT k >= ee) AS inside
            FROM v LEFT JOIN r USING (package)
        )
        SELECT p_partkey, bool_or(CASE WHEN pos IS NOT NULL THEN inside END) AS vulnerable, min(CASE WHEN inside THEN pos END) AS range_pos FROM j GROUP BY p_partkey
    """,
    "q_event_range": f"""
        WITH {_V}, r(package, pos, lo, hi, t) AS (VALUES
            ('Brand#11', 0, 0, 2000100001, '>= 0, < 2.1.0'), ('Brand#11', 1, 3000000001, 4000400042, '>= 3.0.0, <= 4.4.4'),
            ('Brand#12', 0, 2000000001, 5000000001, '>= 2.0.0, < 5.0.0'), ('Brand#13', 0, 6000000001, 999000000000, '>= 6.0.0 (수정 버전 미공개)')
        )
        SELECT p_partkey, bool_or(CASE WHEN pos IS NOT NULL THEN NOT k < lo AND NOT k >= hi END) AS vulnerable,
            arg_min(t, pos) FILTER (NOT k < lo AND NOT k >= hi) AS range_text FROM v LEFT JOIN r USING (package) GROUP BY p_partkey
    """,
    "q_fix_closure": f"""
        WITH RECURSIVE {_V}, d AS (SELECT DISTINCT package, a, b, c, k, version FROM v),
        n AS (SELECT x.package, x.version, min({{'k': y.k, 'v': y.version}}).v AS next FROM d x LEFT JOIN d y ON y.package = x.package AND y.a = x.a AND y.k > x.k WHERE (x.a + x.b + x.c) % 3 <> 0 GROUP BY x.package, x.version),
        w AS (
            SELECT package, version, version AS cur, version AS chain, 0 AS depth FROM d
            UNION ALL
            SELECT w.package, w.version, n.next, w.chain || '>' || n.next, depth + 1 FROM w JOIN n ON n.package = w.package AND n.version = w.cur WHERE n.next IS NOT NULL AND depth < 5
        ), l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY package, version ORDER BY depth DESC) = 1)
        SELECT l.package, l.version, chain, CASE WHEN n.version IS NULL THEN 'CLEAN' WHEN depth >= 5 THEN 'MAX_DEPTH_REACHED' ELSE 'NO_SAME_LINE_FIX' END AS status,
            CASE WHEN n.version IS NULL THEN cur END AS target FROM l LEFT JOIN n ON n.package = l.package AND n.version = l.cur
    """,
}
