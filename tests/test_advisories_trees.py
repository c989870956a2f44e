import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftline.functions.versions import with_version_keys
from siftline.operators import advisories as ad
from siftline.operators import tracing, trees
from siftline.sources import reports, state
from siftline.streaming import reconcile


def keyed_ranges(spark, ranges):
    df = spark.createDataFrame([("p", i, *r) for i, r in enumerate(ranges)], "package string, pos int, a string, b string, c string, d string")
    df = with_version_keys(df, start_incl="a", start_excl="b", end_incl="c", end_excl="d")
    return df.select("package", "pos", "start_incl", "start_excl", "end_incl", "end_excl")


@pytest.mark.parametrize(
    ("version", "ranges", "want"),
    [
        ("6.2.4", [("5.7.0", None, None, "5.7.25"), ("6.3.0", None, None, "6.3.18")], False),
        ("6.1.8", [("6.0.0", None, None, "6.0.3"), ("6.1.0", None, None, "6.1.28")], True),
        ("4.1.110.Final", [(None, None, None, "4.1.133.Final")], True),
        ("4.1.140.Final", [(None, None, None, "4.1.133.Final")], False),
        ("1.0", [], None),
        ("2.0", [(None, "2.0", None, None)], False),
        ("2.0", [(None, None, "2.0", None)], True),
    ],
)
def test_ranges(spark, version, ranges, want):
    installed = with_version_keys(spark.createDataFrame([("p", version)], "package string, version string"), key="version")
    assert ad.in_ranges(installed, keyed_ranges(spark, ranges), ["package"], "key").head().vulnerable is want


def test_event_lists(spark):
    cases = [
        ("a", [("1.10.0", None, None), (None, None, "1.13.15")], ["1.12.6", "1.9.17"], [True, False]),
        ("b", [("0", None, None), (None, "2.1.0", None)], ["2.1.0", "2.0.9"], [False, True]),
        ("c", [("1.0", None, None), (None, "1.1", None), ("3.0", None, None)], ["1.5", "9.0"], [False, True]),
        ("d", [(None, "9.0", None)], ["1.0"], [None]),
    ]
    events = spark.createDataFrame([(p, e) for p, e, _, _ in cases], "package string, events array<struct<introduced:string,fixed:string,last_affected:string>>")
    ranges = events.select("package", F.posexplode(ad.event_ranges(F.col("events"))).alias("pos", "r")).select("package", "pos", "r.start", "r.fixed", "r.last")
    ranges = with_version_keys(ranges, start_key="start", fixed_key="fixed", last_key="last")
    installed = with_version_keys(spark.createDataFrame([(p, v, w) for p, _, vs, ws in cases for v, w in zip(vs, ws, strict=True)], "package string, version string, want boolean"), key="version")
    assert all(r.vulnerable is r.want for r in ad.in_event_ranges(installed, ranges, ["package"], "key").collect())


def test_chains_of_fixes(spark):
    steps = [("42.7.11", "42.7.12"), ("2.5.0", None), *[(f"1.{i}", f"1.{i + 1}") for i in range(20)]]
    table = spark.createDataFrame([("p", *s) for s in steps], "package string, version string, next string")
    got = {r.version: r for r in ad.fix_chain(table.select("package", "version"), table).collect()}
    assert (got["42.7.11"].chain, got["42.7.11"].status, got["42.7.11"].target) == (["42.7.11", "42.7.12"], "CLEAN", "42.7.12")
    assert (got["2.5.0"].status, got["2.5.0"].target) == ("NO_SAME_LINE_FIX", None)
    assert got["1.3"].status == "MAX_DEPTH_REACHED" and len(got["1.3"].chain) == 6 and got["1.15"].status == "CLEAN"


def test_scan_and_scores(spark):
    deps = spark.createDataFrame([("g:a", "1")], "package string, version string")
    advisories = spark.createDataFrame([("g:a", "1", 0, "GHSA-1", ["CVE-1"]), ("g:a", "1", 1, "GHSA-2", ["x", "CVE-1"]), ("g:a", "1", 2, "CVE-2", None), ("g:a", "1", 3, "GHSA-3", [])], "package string, version string, pos int, advisory_id string, aliases array<string>")
    assert sorted((r.cve, r.advisory_id) for r in ad.scanned(deps, advisories).collect()) == [("CVE-1", "GHSA-1"), ("CVE-2", "CVE-2")]
    metrics = spark.createDataFrame([({"V31": [("Secondary", 5.0, "MEDIUM"), ("Primary", 9.8, "CRITICAL")], "V2": [("Primary", 4.0, "LOW")]},), ({},), ({"V40": [], "V30": [("Secondary", 7.0, "HIGH")]},)], "m map<string,array<struct<type:string,score:double,severity:string>>>")
    assert [r[:] for r in metrics.select(*ad.best_score(F.col("m"))).collect()] == [(9.8, "CRITICAL"), (0.0, None), (7.0, "HIGH")]


TREE = "g:root:jar:1\n+- g:a:jar:1:compile\n|  +- g:b:jar:1:compile\n|  |  \\- g:c:jar:1:runtime\n|  \\- g:d:jar:1\n\\- g:e:jar:2\n   \\- g:c:jar:1\nnoise"


def test_dependency_trees(spark):
    nodes = trees.tree_lines(spark.createDataFrame([("t", TREE)], "tree string, text string"), "tree", "text")
    assert {r.coordinate: r.cause for r in trees.causes(nodes).collect()} == {"g:a": "g:a", "g:b": "g:a", "g:d": "g:a", "g:e": "g:e", "g:c": "g:e"}
    assert {r.pos: r.path for r in trees.ancestors(nodes).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 4], 5: [5], 6: [5, 6]}
    target = lambda c: spark.createDataFrame([("t", c)], "tree string, coordinate string")
    assert sorted(r.pos for r in trees.pruned(nodes, target("g:d")).collect()) == [0, 1, 4]
    assert trees.pruned(nodes, target("g:none")).count() == 8
    lines = spark.createDataFrame([("   g:a:jar:1.0:compile -- module x",), ("g:b:jar:tests:2.0:test",), ("The following files:",), ("",)], "value string")
    assert sorted(map(tuple, trees.dependencies(lines, "value").collect())) == [("g", "a", "1.0"), ("g", "b", "2.0")]


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([*((i, i + 1) for i in range(53)), (53, 0), (9, 7)], "src int, dst int").coalesce(1)
    got = trees.closure(edges, spark.createDataFrame([(0,), (50,)], "start int").coalesce(1), cut=state.written)
    want = {(0, i): i for i in range(54)} | {(50, i): (i - 50) % 54 for i in range(54)}
    assert {(r.start, r.node): r.depth for r in got.collect()} == want


def test_origins_of_values(spark):
    flows = spark.createDataFrame([("x", "p"), ("x", "lit"), ("y", "x"), ("z", "lit"), ("u", "w"), ("w", "u"), ("v", "s")], "dst string, src string")
    origins = spark.createDataFrame([("p", "CLIENT", "parameter p"), ("lit", "SERVER_SET", None), ("s", "SESSION_OVERWRITE", "session")], "node string, verdict string, evidence string")
    got = {r.node: r for r in tracing.value_origins(flows, origins).collect()}
    assert {n: r.verdict for n, r in got.items()} == {"x": "CLIENT", "y": "CLIENT", "p": "CLIENT", "lit": "SERVER_SET", "z": "SERVER_SET", "u": "UNKNOWN", "w": "UNKNOWN", "v": "SESSION_OVERWRITE", "s": "SESSION_OVERWRITE"}
    assert got["y"].steps == ["y", "x", "parameter p"]
    cases = [("SERVER_SET", "CLIENT", False, "BYPASSABLE"), ("CLIENT", "CLIENT", False, "CLIENT"), (None, None, False, "UNKNOWN"), (None, "CLIENT", False, "CLIENT"), ("CLIENT", None, True, "XML_FIXED"), ("SERVER_SET", None, False, "SERVER_SET")]
    df = spark.createDataFrame(cases, "d string, g string, f boolean, want string")
    assert all(r.want == r.got for r in df.select("want", tracing.statement_verdict(F.col("d"), F.col("g"), F.col("f")).alias("got")).collect())


def test_origins_of_values_far_away(spark):
    flows = spark.createDataFrame([*((f"v{i + 1}", f"v{i}") for i in range(43)), ("v43", "lit")], "dst string, src string").coalesce(1)
    origins = spark.createDataFrame([("v0", "CLIENT", None), ("lit", "SERVER_SET", None)], "node string, verdict string, evidence string").coalesce(1)
    got = {r.node: r for r in tracing.value_origins(flows, origins).collect()}
    assert got["v43"].verdict == "CLIENT" and len(got["v43"].steps) == 44 and got["lit"].verdict == "SERVER_SET"


def test_ancestors_of_a_deep_tree(spark):
    nodes = spark.createDataFrame([("t", i, i, str(i)) for i in range(1, 41)], "tree string, pos int, depth int, coordinate string")
    assert {r.pos: r.path for r in trees.ancestors(nodes).collect()} == {i: list(range(1, i + 1)) for i in range(1, 41)}
    assert trees.ancestors(nodes.where("false")).count() == 0


def test_rule_changes_and_proposals(spark):
    rules = lambda *r: spark.createDataFrame(list(r), "kind string, name string, value string")
    none = spark.createDataFrame([], "change_key string")
    changes = tracing.rule_changes(rules(("k", "n", "1"), ("k", "n", "2")), rules(("k", "n", "2"), ("k", "n", "3")), none)
    assert sorted((r.change, r.value, r.automatic) for r in changes.collect()) == [("ADD", "1", True), ("REMOVE", "3", False)]
    assert tracing.rule_changes(rules(("k", "n", "1")), rules(), changes.select("change_key")).count() == 0
    latest = spark.createDataFrame([("a", "PENDING"), ("b", "DISMISSED"), ("c", "PENDING")], "change_key string, status string")
    new = spark.createDataFrame([("c", False), ("d", True), ("e", False), ("b", False)], "change_key string, automatic boolean")
    assert {r.change_key: r.status for r in tracing.proposals(latest, new).collect()} == {"a": "OBSOLETE", "b": "DISMISSED", "c": "PENDING", "d": "AUTO_APPLIED", "e": "PENDING"}


def test_inherited_methods(spark):
    extends = spark.createDataFrame([("C", "B"), ("B", "A")], "type string, parent string")
    methods = spark.createDataFrame([("A", "m"), ("B", "m"), ("A", "n")], "owner string, method string")
    got = {(r.type, r.method): r.owner for r in tracing.inherited_methods(extends, methods).collect()}
    assert got == {("A", "m"): "A", ("B", "m"): "B", ("A", "n"): "A", ("B", "n"): "A", ("C", "m"): "B", ("C", "n"): "A"}


def test_reports_rules_and_mappers(spark, tmp_path):
    report = {"version": "1.2", "results": [{"check_id": "a.b.rule-x", "path": ".\\src\\A.java", "start": {"line": 3, "col": 2}, "end": {"line": 3, "col": 9}, "extra": {"message": "m", "severity": "WARNING", "metadata": {"cwe": "CWE-1"}}}], "errors": [{"path": "src/B.java", "type": "t", "message": "m"}, {"type": "t", "message": "m"}], "paths": {"scanned": ["a", "b"]}}
    df = spark.createDataFrame([(json.dumps(report),), ("not json",)], "value string")
    assert [(r.rule_id, r.file_path, r.severity, r.start_col, r.cwe) for r in reports.report_matches(df).collect()] == [("rule-x", "src/A.java", "MEDIUM", 2, "CWE-1")]
    assert [r.file_path for r in reports.report_failures(df).collect()] == ["src/B.java"]
    yaml = "rules:\n- id: r1\n  severity: ERROR\n  metadata: {cwe: [CWE-9], trace: value}\n- id: r2\n  severity: INFO\n"
    assert sorted(tuple(map(str, r)) for r in reports.rule_files(spark.createDataFrame([("a.yml", yaml)], "path string, text string")).collect()) == [("r1", "HIGH", "CWE-9", "value"), ("r2", "LOW", "None", "None")]
    assert reports.rules_version([("a", "1"), ("b", "2")]) == reports.rules_version([("b", "2"), ("a", "1")]) != reports.rules_version([("a", "2")])
    xml = '<mapper>\n<!-- ${no} -->\n<select id="find">\n select * from t where a = #{a} order by ${col}\n <include refid="w"/></select>\n<sql id="w"> where x = $y$ </sql></mapper>'
    got = {r.id: r for r in reports.mapper_statements(spark.createDataFrame([("m.xml", xml)], "path string, text string")).collect()}
    assert (got["find"].uses, got["find"].includes, got["find"].line, got["w"].uses, got["w"].kind) == (["col"], ["w"], 3, ["y"], "sql")
    item = spark.createDataFrame([(json.dumps({"id": "CVE-1", "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": True, "versionEndExcluding": "2"}, {"vulnerable": False}]}]}, {}]}),)], "value string")
    ranges = reports.item_ranges(item.select(F.from_json("value", reports.ITEM).alias("i")).select("i.*"))
    assert [(r.pos, r.end_excl, r.start_incl) for r in ranges.collect()] == [(0, "2", None)]
    (tmp_path / "adv").mkdir()
    advisory = {"id": "G", "affected": [{"package": {"name": "g:a", "ecosystem": "Maven"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1"}]}, {"events": []}]}, {"package": {"name": "x", "ecosystem": "npm"}, "ranges": [{"events": [{"introduced": "0"}]}]}]}
    (tmp_path / "adv/a.json").write_text(json.dumps(advisory))
    assert [(r.package, len(r.events)) for r in reports.advisory_events(spark, str(tmp_path / "adv")).collect()] == [("g:a", 2)]


def zipped(files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return data.getvalue()


def test_archives(spark):
    archives = [("a", zipped({"p/src/A.java": "class A {}", "p/.git/x": "no", "p/K.java": "한글".encode("cp949")})), ("b", zipped({"../x": "no"})), ("c", b"not a zip")]
    got = reports.archive_files(spark.createDataFrame(archives, "path string, content binary")).collect()
    assert sorted((r.path, r.text) for r in got if not r.error) == [("K.java", "한글"), ("src/A.java", "class A {}")]
    assert {r.archive for r in got if r.error} == {"b", "c"}


def test_scans_reconciled_as_a_stream(spark, tmp_path):
    scan = "fingerprint string, rule_id string, file_path string, severity string, pos int, at timestamp_ntz"
    source, path = str(tmp_path / "scans"), str(tmp_path / "state")
    rules = spark.createDataFrame([("r",)], "rule_id string")
    for day, found in (("2024-01-01", "ab"), ("2024-01-02", "bc"), ("2024-01-03", "ac")):
        spark.createDataFrame([(f, "r", "A", "LOW", i) for i, f in enumerate(found)], "fingerprint string, rule_id string, file_path string, severity string, pos int").withColumn("at", F.lit(day).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(scan).parquet(source)
        query = reconcile.reconcile_stream(stream, path, str(tmp_path / "checkpoint"), rules)
        query.awaitTermination(120)
    last = {r.fingerprint: r.status for r in reconcile.latest_state(spark, path, 2).collect()}
    assert last == {"a": "OPEN", "b": "RESOLVED", "c": "OPEN"}


def test_windowed_counts(spark):
    d = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(d).withColumn("at", F.col("ts").cast("timestamp"))
    batch = reconcile.windowed_counts(events, "at", "10 minutes", "1 day", "event_type")
    assert batch.agg(F.sum("n")).head()[0] == 1000


def test_state_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "app int, v string")
    state.replace_partitions(rows((1, "a"), (1, "b"), (2, "c")), path, "app")
    state.replace_partitions(rows((1, "z")), path, "app")
    assert sorted((r.app, r.v) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]
    state.append_history(rows((1, "x")), str(tmp_path / "h"))
    state.append_history(rows((1, "y")), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    assert state.next_version(rows((1, "x")), str(tmp_path / "v"), 3).endswith("version=000003")
    state.export_tsv(rows((1, "a\tb\nc")), str(tmp_path / "o"))
    assert {tuple(r[0].split("\t")) for r in spark.read.text(str(tmp_path / "o")).collect()} == {("app", "v"), ("1", "a b c")}
