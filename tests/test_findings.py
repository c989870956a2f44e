from pyspark.sql import functions as F

from siftline.functions import severity as sv
from siftline.functions import text as tx
from siftline.operators import findings as fd
from siftline.operators import keyed, queues

FIELDS = "fingerprint string, rule_id string, cwe string, severity string, file_path string, start_line int, start_col int, end_line int, end_col int, message string, trace_safety string, pos int"


def rows(spark, *items):
    names = [c.split()[0] for c in FIELDS.split(", ")]
    base = dict(cwe=None, severity="LOW", file_path="A.java", start_line=1, start_col=1, end_line=1, end_col=9, message="m", trace_safety=None)
    return spark.createDataFrame([tuple({**base, "pos": i, "fingerprint": f"f{i}", **item}[n] for n in names) for i, item in enumerate(items)], FIELDS)


def test_ranks_and_levels(spark):
    df = spark.createDataFrame([("CRITICAL", 0), ("high", 1), ("Medium", 2), ("LOW", 3), (None, 4), ("odd", 4)], "s string, want int")
    assert all(r.want == r.got for r in df.select("want", sv.severity_rank(F.col("s")).alias("got")).collect())
    levels = spark.createDataFrame([("ERROR", "HIGH"), ("WARNING", "MEDIUM"), ("INFO", "LOW"), ("X", "X")], "s string, want string")
    assert all(r.want == r.got for r in levels.select("want", sv.severity_of_level(F.col("s")).alias("got")).collect())
    verdicts = [("XML_FIXED", 0, True, "LOW"), ("SERVER_SET", 2, True, "LOW"), ("UNKNOWN", 3, False, "MEDIUM"), ("BYPASSABLE", 4, False, "HIGH"), ("CLIENT", 5, False, "HIGH"), (None, None, None, None)]
    df = spark.createDataFrame(verdicts, "v string, rank int, safe boolean, severity string")
    got = df.select("rank", "safe", "severity", sv.verdict_rank(F.col("v")), sv.verdict_is_safe(F.col("v")), sv.verdict_severity(F.col("v")))
    assert all(r[:3] == r[3:] for r in got.collect())


def test_same_cwe_on_a_line_is_made_one(spark):
    df = rows(
        spark,
        dict(rule_id="taint", cwe="CWE-78", severity="HIGH", start_line=82), dict(rule_id="exec", cwe="CWE-78", severity="LOW", start_line=82, trace_safety="SERVER_SET"),
        dict(rule_id="rand", cwe="CWE-330", start_line=82), dict(rule_id="b", cwe="CWE-1", severity="HIGH", start_line=5), dict(rule_id="a", cwe=" CWE-1", severity="LOW", start_line=5),
        dict(rule_id="x", cwe=" ", start_line=5), dict(rule_id="a", cwe="CWE-1", start_line=6), dict(rule_id="a", cwe="CWE-1", start_line=6),
    )
    kept, away = fd.without_same_cwe(df, F.col("rule_id").isin("exec"))
    got = {r.fingerprint: r for r in kept.collect()}
    assert set(got) == {"f1", "f2", "f4", "f5", "f6", "f7"}
    assert got["f1"].severity == "LOW" and "taint" in got["f1"].message and got["f4"].severity == "HIGH" and got["f2"].message == "m"
    assert sorted(map(tuple, away.collect())) == [("f0", "exec"), ("f3", "a")]


def test_nested_matches_go(spark):
    place = lambda rule, a, ac, b, bc, **more: dict(rule_id=rule, start_line=a, start_col=ac, end_line=b, end_col=bc, **more)
    df = rows(
        spark, place("r", 72, 19, 72, 74), place("r", 72, 47, 72, 73), place("r", 72, 80, 72, 90), place("s", 72, 20, 72, 30), place("r", 72, 0, 72, 50),
        place("r", 72, 19, 72, 74), place("q", 10, 1, 900, 2), place("q", 700, 5, 701, 1), place("q", 700, 5, 701, 1, file_path="B.java"),
    )
    kept, away = fd.without_nested(df)
    assert {r.fingerprint for r in kept.collect()} == {"f0", "f2", "f3", "f4", "f6", "f8"}
    assert sorted(map(tuple, away.collect())) == [("f1", "r"), ("f5", "r"), ("f7", "q")]


def test_verdicts_by_place_in_the_line(spark):
    left = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("b", 2, 2), ("c", 3, 3), ("c", 3, 4)], "file string, line int, pos int")
    right = spark.createDataFrame([("a", 1, 0, "CLIENT"), ("b", 2, 0, "XML_FIXED"), ("b", 2, 1, "CLIENT"), ("c", 3, 0, "UNKNOWN")], "file string, line int, at int, verdict string")
    got = keyed.zipped(left, right, ["file", "line"], F.col("pos"), F.col("at"), ["verdict"])
    assert {r.pos: (r.verdict, r.matched) for r in got.collect()} == {0: ("CLIENT", True), 1: ("XML_FIXED", True), 2: ("CLIENT", True), 3: (None, False), 4: (None, False)}


def test_reconcile_decisions(spark):
    state = "fingerprint string, rule_id string, file_path string, severity string, status string, status_manual boolean, remark string, first_at int, last_at int, resolved_at int"
    known = lambda name, status, manual=False, rule="r", file="A": (name, rule, file, "LOW", status, manual, None, 1, 1, 1 if status == "RESOLVED" else None)
    existing = spark.createDataFrame(
        [known("open", "OPEN"), known("back", "RESOLVED"), known("pinned", "RESOLVED", True), known("false", "FALSE_POSITIVE"), known("gone", "OPEN"), known("kept", "OPEN", True),
         known("failed", "OPEN", file="F"), known("old", "OPEN", rule="x"), known("away", "OPEN"), known("away2", "ACCEPTED"), known("solved", "RESOLVED")], state,
    )
    detected = spark.createDataFrame([(n, "r", "A", "HIGH", i) for i, n in enumerate(["new", "open", "back", "pinned", "false", "new"])], "fingerprint string, rule_id string, file_path string, severity string, pos int")
    frame = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    away = spark.createDataFrame([("away", "k"), ("away2", "k")], "fingerprint string, kept_rule string")
    got = {r.fingerprint: r for r in fd.reconciled(existing, detected, frame("file_path", "F"), frame("rule_id", "r"), away, F.lit(9)).collect()}
    assert {n: (r.action, r.status) for n, r in got.items()} == {
        "new": ("INSERTED", "OPEN"), "open": ("REFRESHED", "OPEN"), "back": ("REOPENED", "OPEN"), "pinned": ("REFRESHED", "RESOLVED"), "false": ("REFRESHED", "FALSE_POSITIVE"),
        "gone": ("RESOLVED", "RESOLVED"), "kept": ("KEPT", "OPEN"), "failed": ("KEPT", "OPEN"), "old": ("KEPT", "OPEN"), "away": ("MERGED", "RESOLVED"), "away2": ("KEPT", "ACCEPTED"),
        "solved": ("KEPT", "RESOLVED"),
    }
    assert got["new"].first_at == 9 and got["open"].severity == "HIGH" and got["open"].last_at == 9 and got["back"].resolved_at is None and got["gone"].resolved_at == 9
    assert "k" in got["away"].remark


def test_retired_rules_solve_once(spark):
    df = spark.createDataFrame([("a", "x", "OPEN", False, None, None), ("b", "x", "OPEN", True, None, None), ("c", "y", "OPEN", False, "r", None)], "fingerprint string, rule_id string, status string, status_manual boolean, remark string, resolved_at int")
    rules = spark.createDataFrame([("x", "retired")], "rule_id string, reason string")
    once = fd.retired(df, rules, F.lit(5))
    assert {r.fingerprint: (r.status, r.remark) for r in once.collect()} == {"a": ("RESOLVED", "retired"), "b": ("OPEN", None), "c": ("OPEN", "r")}
    assert sorted(once.collect()) == sorted(fd.retired(once, rules, F.lit(6)).collect())


def test_masking_and_fingerprints(spark):
    lines = [('String p = "abc\\"d"; // x', 'String p = "****"; // x'), ("db.password=geheim", "db.password=****"), ("# token: 123 end", "# token: **** end"), ("int a = 1;", "int a = 1;"), ("c = 'x'", "c = '****'")]
    df = spark.createDataFrame(lines, "line string, want string")
    assert all(r.want == r.got for r in df.select("want", tx.masked(F.col("line")).alias("got")).collect())
    code = spark.createDataFrame([("A", "x  =\n 1", 1), ("A", "x = 1", 2), ("A", "x = 2", 3)], "file string, code string, pos int").withColumn("code", tx.normalized(F.col("code")))
    got = {r.pos: r.fingerprint for r in fd.fingerprinted(code, ["file", "code"], F.col("pos")).collect()}
    assert len(set(got.values())) == 3
    import hashlib

    assert got[2] == hashlib.sha256(b"A\nx = 1\n1").hexdigest()


def test_slices_ranges_and_locations(spark):
    one = spark.range(1)
    start, end = tx.capped_range(F.lit(1), F.lit(500), F.lit(490), F.lit(490), 80)
    assert one.select(start, end).head()[:] == (421, 500)
    assert one.select(tx.sliced(F.lit("a\nb\nc"), F.lit(2), F.lit(9))).head()[0] == "b\nc"
    assert one.select(*tx.step_location(F.lit("Foo.java:12 call"))).head()[:] == ("Foo.java", 12)
    assert one.select(*tx.step_location(F.lit("nothing"))).head()[:] == (None, None)
    assert one.select(tx.truncated(F.lit("x" * 20), 10, F.lit("END"))).head()[0] == "xxxxxxxEND"
    assert one.select(tx.clause_of(F.lit("select a from t /* where */ where b = "))).head()[0] == "WHERE"
    assert one.select(tx.assigns_secret(F.lit('API_KEY = "x"')), tx.assigns_secret(F.lit("a = 1"))).head()[:] == (True, False)
    import re

    fits = lambda p, s: bool(re.match(tx.ant_regex(p), s))
    assert fits("/a/**", "/a/b/c") and fits("/a/**", "/a") and fits("/**/x.js", "/x.js") and fits("/a/*.do", "/a/b.do") and not fits("/a/*", "/a/b/c") and fits("/a?", "/ab") and not fits("/a.b", "/axb")


def test_queues(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None), (5, None), (6, "z")], "pos int, g string")
    assert sorted(r.pos for r in queues.limited_groups(df, F.col("g"), F.col("pos"), 3, 200).collect()) == [1, 2, 3, 4]
    assert sorted(r.pos for r in queues.limited_groups(df, F.col("g"), F.col("pos"), 9, 1).collect()) == [1, 3]
    review = spark.createDataFrame(
        [(1, "c", "h", None, None, 0), (2, " ", "h", None, None, 0), (3, "c", "h", "h", None, 0), (4, "c", "h", None, "h", 3), (5, "c", "h2", "h", "h", 3)],
        "id int, code string, input_hash string, reviewed_hash string, failed_hash string, failures int",
    )
    assert sorted(r.id for r in queues.pending_reviews(review).collect()) == [1, 5]
    results = spark.createDataFrame([("w", i, i not in (2, 9)) for i in range(12)], "worker string, pos int, failed boolean")
    assert sorted(r.pos for r in queues.stopped_at(results, "worker", F.col("pos"), F.col("failed")).collect()) == list(range(8))
    kinds = spark.createDataFrame([(401, "", "FATAL"), (429, "", "TRANSIENT"), (503, "", "TRANSIENT"), (None, "Read timed out", "TRANSIENT"), (200, "bad json", "CONTENT")], "s int, e string, want string")
    assert all(r.want == r.got for r in kinds.select("want", queues.failure_kind(F.col("s"), F.col("e")).alias("got")).collect())
    screen = spark.createDataFrame([("LOW", 3.1, "a", "1"), ("HIGH", None, "a", "2"), ("CRITICAL", 9.8, "a", "3"), ("HIGH", 7.5, "b", "4"), ("HIGH", 8.8, None, "5"), ("MEDIUM", 5.0, "a", "6")], "severity string, cvss double, system string, cve string")
    assert [r.cve for r in queues.screen_order(screen).collect()] == ["3", "5", "4", "2", "6", "1"]


def test_impacts_are_made_sound(spark):
    schema = "id int, status string, jump string, risk string, sources array<struct<url:string>>, changes array<struct<text:string,source_url:string>>"
    df = spark.createDataFrame(
        [(1, "ANALYZED", "MAJOR", "LOW", [("https://a",), ("ftp://b",)], [("x", "https://a"), ("y", "https://c")]), (2, "ANALYZED", "MINOR", "LOW", [], [("x", "https://a")]), (3, "NO_DATA", "MINOR", "LOW", [("https://a",)], [])], schema,
    )
    got = {r.id: (r.risk, len(r.sources), len(r.changes), r.dropped) for r in queues.normalized_impact(df).collect()}
    assert got == {1: ("HIGH", 1, 1, 1), 2: (None, 0, 0, 1), 3: (None, 0, 0, 0)}


def test_upserts_write_changed_rows_only(spark):
    schema = "app int, cve string, v string"
    state = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (None, "c", "x")], schema)
    new = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (None, "c", "z"), (2, "d", "w")], schema)
    got = sorted((str(r.app), r.cve, r.v, r.changed) for r in keyed.upserted(state, new.where("cve <> 'a'"), ["app", "cve"]).collect())
    assert got == [("1", "a", "x", False), ("1", "b", "y", True), ("2", "d", "w", True), ("None", "c", "z", True)]
    assert keyed.upserted(state, new, ["app", "cve"]).where("changed").count() == 3
    assert sorted(map(tuple, keyed.replaced_children(state.where("app IS NOT NULL"), spark.createDataFrame([(1, "q", "n")], schema), ["app"]).collect())) == [(1, "q", "n")]
