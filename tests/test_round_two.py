"""Rows that repeat, lines that are counted, patterns of either kind, verdicts for want of an origin, places of hot keys."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import releases, text, versions
from siftline.operators import advisories as ad
from siftline.operators import findings, keyed, tracing
from siftline.sources import reports


def test_repeated_rows_stay(spark):
    installed = spark.createDataFrame([("g:a", "1"), ("g:a", "1"), ("g:a", "1"), ("g:b", None), (None, "1")], "package string, key string")
    ranges = spark.createDataFrame([("g:a", 0, None, None, None, "2"), ("g:a", 1, "0", None, None, None)], "package string, pos int, start_incl string, start_excl string, end_incl string, end_excl string")
    got = ad.in_ranges(installed, ranges, ["package"], "key").collect()
    assert len(got) == 5
    assert [r.vulnerable for r in got if r.package == "g:a"] == [True] * 3 and {r.vulnerable for r in got if r.package != "g:a"} == {None}
    rows = spark.createDataFrame([("p", 1, "05"), ("p", 1, "05"), ("p", 2, "05"), ("p", 1, "09")], "package string, major int, version_key string")
    fixes = spark.createDataFrame([("p", "v5", 1, "05"), ("p", "v7", 1, "07"), ("p", "v7b", 1, "07"), ("p", "v8", 1, "08"), ("q", "v6", 1, "06")], "package string, candidate string, candidate_major int, candidate_key string")
    assert sorted((r.major, r.version_key, r.fix or "") for r in ad.lowest_above(rows, fixes, ["package"]).collect()) == [(1, "05", "v7"), (1, "05", "v7"), (1, "09", ""), (2, "05", "")]
    points = spark.createDataFrame([("f", 700), ("f", 700), ("f", 5), ("g", 5)], "file string, line int")
    spans = spark.createDataFrame([("f", 1, 5000, 1), ("f", 500, 1300, 2), ("f", 690, 710, 3), ("g", 9, 8, 4)], "file string, first int, last int, range_id int")
    assert sorted((r.file, r.line, r.range_id or 0) for r in findings.smallest_enclosing(points, spans, "file", "line").collect()) == [("f", 5, 1), ("f", 700, 3), ("f", 700, 3), ("g", 5, 0)]


@pytest.mark.parametrize(("line", "want"), [("""don't log("isn't")""", """don'****'t")"""), ('a = "x" + \'y"z\'', "a = \"****\" + '****'"), (r'p = "a\"b"', 'p = "****"'), ("db.password: abc # x", "db.password: ****"), ("// 비밀번호: abc def", "// 비밀번호: **** def")])
def test_masking(spark, line, want):
    assert spark.createDataFrame([(line,)], "v string").select(text.masked(F.col("v")).alias("m")).head().m == want


def test_lines_of_statements(spark):
    xml = """<mapper>
<!-- two
lines <select id="no">x</select> -->
<select id="a">select 1</select> <!-- x -->
<select id="b">
 select ${col} <!-- one
 two --> </select>
<select id="c">select 1</select>
</mapper>"""
    got = {r.id: r.line for r in reports.mapper_statements(spark.createDataFrame([("m.xml", xml)], "path string, text string")).collect()}
    assert got == {"a": 4, "b": 5, "c": 8}


def test_patterns_and_guards(spark):
    paths = spark.createDataFrame([("/",), ("/a",), ("/a/b.do",), ("/ab",), ("/x.do",)], "path string")
    fits = lambda p: sorted(r.path for r in paths.where(F.col("path").rlike(text.servlet_regex(p))).collect())
    assert fits("/*") == fits("/") == ["/", "/a", "/a/b.do", "/ab", "/x.do"] and fits("/a/*") == ["/a", "/a/b.do"]
    assert fits("*.do") == ["/a/b.do", "/x.do"] and fits("/ab") == ["/ab"]
    hook = lambda **more: {"name": "Login", "kind": "FILTER", "include": ["/a/*"], "exclude": [], "known": True} | more
    open_, why = tracing.unprotected(paths, {"Login"}, [hook(), hook(kind="INTERCEPTOR", include=["/*"], exclude=["/x*"])])
    assert why is None and [r.path for r in open_.collect()] == ["/x.do"]
    assert tracing.unprotected(paths, set(), [hook()]) == (None, "NO_DEVICES") and tracing.unprotected(paths, {"Other"}, [hook()]) == (None, "NOT_REGISTERED")
    assert tracing.unprotected(paths, {"Login"}, [hook(), hook(known=False)]) == (None, "PATTERNS_UNKNOWN")
    joined = spark.createDataFrame([("/a/", "/b/"), ("", ""), (None, "x")], "a string, b string").select(text.joined_path(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in joined.collect()] == ["/a/b", "/", "/x"]


def test_values_without_an_origin_are_unknown_and_so_is_what_they_feed(spark):
    flows = spark.createDataFrame([("v", "safe"), ("v", "lost"), ("w", "v"), ("s", "safe"), ("l1", "l2"), ("l2", "l1"), ("x", "l1"), ("x", "client")], "dst string, src string")
    origins = spark.createDataFrame([("safe", "SERVER_SET", None), ("client", "CLIENT", None)], "node string, verdict string, evidence string")
    got = {r.node: r.verdict for r in tracing.value_origins(flows, origins).collect()}
    assert got == {"v": "UNKNOWN", "w": "UNKNOWN", "lost": "UNKNOWN", "safe": "SERVER_SET", "s": "SERVER_SET", "l1": "UNKNOWN", "l2": "UNKNOWN", "x": "CLIENT", "client": "CLIENT"}


def test_hierarchies_of_any_depth_and_callers(spark):
    extends = spark.createDataFrame([(f"T{i + 1}", f"T{i}") for i in range(25)] + [("T0", "T25")], "type string, parent string")
    found = tracing.inherited_methods(extends, spark.createDataFrame([("T0", "m")], "owner string, method string"))
    assert {r.type: r.depth for r in found.collect()} == {f"T{i}": i for i in range(26)}
    calls = spark.createDataFrame([("a", "T9", "m"), ("a", "T3", "m"), ("b", "T0", "m"), ("c", "T0", "n")], "caller string, type string, method string")
    assert sorted((r.owner, r.caller) for r in tracing.callers(calls, found).collect()) == [("T0", "a"), ("T0", "b")]


def test_places_where_one_key_has_all(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 != 0, F.col("id") * 7919 % 4001).alias("v"), "id")
    got = keyed.placed(rows.where("k = 0"), ["k"], [F.desc_nulls_last("v"), F.asc("id")], F.floor(F.col("v") / 100)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, len(got) + 1))
    assert [r.id for r in got] == [r.id for r in sorted(got, key=lambda r: (r.v is None, -(r.v or 0), r.id))]


def test_lines_and_numeric_keys(spark):
    one = lambda a, b: spark.range(1).select(releases.lines_between(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), 2).alias("x")).head().x
    assert one((2, 3), (2, 5)) == ["2.4", "2.5"] and one((2, 5), (2, 5)) == [] == one((3, 0), (2, 9))
    assert one((1, 3), (3, 1)) == ["1.4", "1.5", "2.0", "2.1", "3.0", "3.1"] and one((1, 3), (2, 0)) == ["1.4", "1.5", "2.0"]
    keys = spark.createDataFrame([(v,) for v in ("1.0", "1", "1.1000.0", "2.0.0", "1.2.0.5")], "v string").select("v", versions.numeric_key(versions.numeric_parts(F.col("v"))).alias("k"))
    k = {r.v: r.k for r in keys.collect()}
    assert k["1.0"] == k["1"] < k["1.2.0.5"] < k["1.1000.0"] < k["2.0.0"]


def test_smallest_enclosing_range_of_any_place_and_length(spark):
    """Every range against every line, and no more rows between them than blocks of both."""
    random = __import__("random").Random(7)
    spans = [("f", a := random.randint(-70, 70), a + random.choice([-1, 0, 1, 3, 7, 8, 31, 64, 127, 500]), i) for i in range(400)] + [("h", 8, 15, 1000), ("h", 0, 63, 1001)]
    lines = [("f", n) for n in range(-80, 600, 3)] + [("h", n) for n in (-1, 0, 7, 8, 15, 16, 63, 64)] + [("f", None), (None, 3), ("g", 3)]
    ranges = spark.createDataFrame(spans, "file string, first int, last int, range_id int")
    got = findings.smallest_enclosing(spark.createDataFrame(lines, "file string, line int"), ranges, "file", "line")
    best = lambda f, n: min(((b - a, a, i) for g, a, b, i in spans if n is not None and g == f and a <= n <= b), default=(0, 0, None))[2]
    assert sorted(map(str, ((r.file, r.line, r.range_id) for r in got.collect()))) == sorted(str((f, n, best(f, n))) for f, n in lines)
    many = spark.range(3000).select(F.lit("f").alias("file"), (F.col("id") % 7).cast("int").alias("first"), (F.col("id") % 7 + 300).cast("int").alias("last"), F.col("id").alias("range_id"))
    few = findings.smallest_enclosing(spark.range(300).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line")), many, "file", "line")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = few._jdf.queryExecution()
        assert execution.toRdd().count() == 300
        plan, rows = [execution.executedPlan()], []
        while plan:
            node = plan.pop()
            rows += [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
            plan += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < max(rows) < 20_000
