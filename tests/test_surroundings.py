"""Small cases of related code, statements, prefixes, sinks, guards, columns and ranked sources."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import columns, releases
from siftline.operators import context, findings, keyed, notes, sinks, trees


def pieces(spark, *rows):
    return spark.createDataFrame([(f, pos, path, first, lines, over, "r") for f, pos, path, first, lines, over in rows], "finding int, pos int, path string, first int, lines array<string>, overlaps boolean, reason string")


def test_related_code_within_its_budget(spark):
    long = [f"line {i}" for i in range(50)]
    rows = [(1, i, f"src/A{i}.java", 1, long, False) for i in range(7)]
    got = context.related_code(pieces(spark, *rows)).orderBy("rank").collect()
    # Each has 40 lines and a note of the 10 left out; the sixth is cut at 240, and the seventh has no room.
    sizes = [len(r.code.split("\n")) for r in got]
    assert sizes == [41, 41, 41, 41, 41, 36] and got[0].code.endswith("    // … (이하 10줄 생략)") and got[5].code.endswith("    // … (이하 15줄 생략)")
    small = [(2, i, f"src/B{i}.java", 1, ["x"], False) for i in range(12)]
    assert [r.path for r in context.related_code(pieces(spark, *small)).orderBy("rank").collect()] == [f"src/B{i}.java" for i in range(8)]
    odd = [(3, 0, "src/test/T.java", 1, ["x"], False), (3, 1, "a/src/test/T.java", 1, ["x"], False), (3, 2, "src/O.java", 1, ["x"], True), (3, 3, "src/E.java", 1, [], False), (3, 4, "src/S.java", 1, ["x", 'String password = "hunter2";'], False), (3, 5, "src/P.properties", 1, ["db.password=abc"], False)]
    odd += [(3, 6, "src/K.java", 4, ["first"], None), (3, 7, "src/K.java", 4, ["second"], False), (3, 8, "src/K.java", 5, ["third"], False)]
    assert [r.code for r in context.related_code(pieces(spark, *odd)).orderBy("rank").collect()] == ["first", "third"]
    assert context.related_code(pieces(spark).where("false")).count() == 0


@pytest.mark.parametrize(("start", "end", "want"), [(2, 2, (2, 2)), (3, 3, (3, 5)), (4, 4, (3, 5)), (5, 5, (3, 5)), (4, 6, None), (6, 6, None), (8, 9, None), (99, 99, None), (1, 1, None)])
def test_enclosing_statements(spark, start, end, want):
    text = ["<mapper>", "<select id='a'>x</select>", "<UPDATE id='b'>", " set ${x}", "</update>", " between", "<insert id='c'>", " never closed"]
    lines = spark.createDataFrame([("m", i, t) for i, t in enumerate(text, 1)], "file string, line int, text string")
    hits = spark.createDataFrame([("h", "m", start, end), ("gone", "other", 1, 1)], "hit string, file string, start int, end int")
    got = {r.hit: (r.first, r.last) for r in context.enclosing_statements(lines, hits).collect()}
    assert got == {"h": want or (None, None), "gone": (None, None)}


def test_common_prefixes_of_words(spark):
    cases = {"a": (["getLoginDeptId", "getLoginUserId"], "getLogin"), "b": (["getLogin", "getLogout"], "get"), "c": (["getOne"], "getOne"), "d": (["get", "get1", "getA"], None), "e": (["x", "y"], None), "f": (["getA", "getB", "get"], "get"), "g": (["getÀa", "getÉb"], "get"), "h": (["same", "same"], "same"), "i": ([None], None)}
    names = spark.createDataFrame([(k, n) for k, (some, _) in cases.items() for n in some], "key string, name string")
    assert {r.key: r.prefix for r in context.common_camel_prefix(names, "key", "name").collect()} == {k: want for k, (_, want) in cases.items() if k != "i"}


def test_sinks(spark):
    make = spark.createDataFrame
    found = make([(1, "FIRST_ARGUMENT", True), (2, "ARGUMENTS", False), (3, "VALUE", True), (4, "ARGUMENTS", True), (5, "FIRST_ARGUMENT", True), (6, None, None), (7, "FIRST_ARGUMENT", True)], "finding int, target string, fixed_host boolean")
    arguments = make([(1, 1, "url"), (1, 2, "bad"), (2, 1, "good"), (2, 2, "bad"), (2, 3, "bad2"), (3, 0, "open"), (4, 1, "url"), (4, 2, "good"), (5, 1, "var"), (7, 1, "one")], "finding int, pos int, node string")
    operands = make([("url", 0, "https://"), ("url", 1, "host/"), ("url", 2, None), ("url", 3, "x"), ("open", 0, "https://host"), ("open", 1, None), ("one", 0, "https://host/x")], "node string, pos int, constant string")
    values = make([("url", "CLIENT", "q"), ("bad", "CLIENT", "b"), ("bad2", "CLIENT", "b2"), ("good", "SESSION_OVERWRITE", "s"), ("open", "CLIENT", "q"), ("var", "CLIENT", "q")], "node string, verdict string, evidence string")
    same = make([("var", "mid"), ("mid", "url")], "dst string, src string")
    got = {r.finding: (r.verdict, r.evidence) for r in sinks.sink_verdicts(found, arguments, operands, values, same).collect()}
    fixed = ("SERVER_SET", "fixed host: https://host/")
    assert got == {1: fixed, 2: ("CLIENT", "b"), 3: ("CLIENT", "q"), 4: fixed, 5: fixed, 7: ("UNKNOWN", None)}


def test_guards(spark):
    make = spark.createDataFrame
    hooks = make([("Login", "INTERCEPTOR"), ("Log", "INTERCEPTOR"), ("Gate", "FILTER"), ("Deep", "FILTER")], "owner string, kind string")
    methods = make([("l1", "Login", "preHandle"), ("l2", "Login", "check"), ("o1", "Log", "preHandle"), ("g1", "Gate", "doFilter"), ("d1", "Deep", "doFilterInternal"), ("d2", "Deep", "a"), ("d3", "Deep", "b"), ("x", "Other", "check")], "method string, owner string, name string")
    calls = make([("l1", "l2"), ("l2", "l1"), ("o1", "x"), ("d1", "d2"), ("d2", "d3"), ("d3", "d1")], "caller string, callee string")
    code = {"l1": ["// getSession()", "  user = s.getAttribute(\"u\");", "return check(user);"], "l2": ["return false;"], "o1": ["h = getHeader(n);"], "x": ["throw new X();"], "g1": ["getCookies();", "if (c == null) return ;"], "d1": ["return;"], "d2": ["noop"], "d3": ["getSession ()", "r.sendError(401)"]}
    lines = make([(m, i, t) for m, some in code.items() for i, t in enumerate(some)], "method string, pos int, text string")
    told = lambda depth: {r.owner: (r.reads, r.blocks) for r in sinks.guard_candidates(hooks, methods, calls, lines, depth).collect()}
    near = {"Login": ('user = s.getAttribute("u");', "return false;"), "Gate": ("getCookies();", "if (c == null) return ;")}
    assert told(1) == near and told(None) == near | {"Deep": ("getSession ()", "r.sendError(401)")}


def test_columns_in_bytes_and_characters(spark):
    lines = ["plain text", "한글 값 = request", "a😀b한", "é", ""]
    rows = spark.createDataFrame([(t, c) for t in lines for c in range(1, 22)], "line string, c int")
    line, c = F.col("line"), F.col("c")
    got = rows.select("*", columns.byte_column(line, c).alias("b"), columns.char_column(line, c).alias("i"), columns.legacy_byte_column(line, c).alias("lb"), columns.legacy_char_column(line, c).alias("li")).collect()
    for r in got:
        units = [u for ch in r.line for u in ((ch, "") if ord(ch) > 0xFFFF else (ch,))]
        before = units[: r.c - 1]
        cut = bool(before) and ord(before[-1] or " ") > 0xFFFF
        assert r.b == 1 + len("".join(before).encode()) - (3 if cut else 0)
        assert r.lb == 1 + sum(len(u.encode("cp949", "replace")) for u in before)
        places, legacy = ({1 + sum(size(u) for u in units[:k]): k + 1 for k in range(len(units), -1, -1) if k == len(units) or units[k]} for size in (lambda u: len(u.encode()), lambda u: len(u.encode("cp949", "replace"))))
        assert r.i == places.get(r.c) and r.li == legacy.get(r.c)
    nulls = spark.createDataFrame([(None, 1), ("x", None)], "line string, c int").select(columns.byte_column(line, c), columns.char_column(line, c), columns.legacy_byte_column(line, c), columns.legacy_char_column(line, c))
    assert all(v is None for r in nulls.collect()[:1] for v in r)


def test_ranked_sources(spark):
    make = spark.createDataFrame
    wanted = make([("g:a", [1, 0, 0], [1, 2, 0], "https://github.com/o/r.git"), ("g:b", [1, 0, 0], [1, 2, 0], "scm:git:git@github.com:o/r2"), ("h:c", [1, 0, 0], [1, 2, 0], "https://gitlab.com/x/y/z.git"), ("h:d", [1, 0, 0], [1, 2, 0], "https://github.com/${o}/r"), ("h:e", [1, 0, 0], [1, 2, 0], None)], "coordinate string, start array<int>, end array<int>, scm string")
    rules = make([("g:", 1, "GUIDE", "doc/{line}", "Guide {line}", False), ("g:a", 2, "GUIDE", "all", "All", True), ("h:", 1, "GUIDE", "empty/{line}", "E", False)], "prefix string, pos int, kind string, url string, title string, by_section boolean")
    documents = make([("doc/1.1", "one"), ("empty/1.1", " ")], "url string, text string")
    sections = make([("all", 2, "Version 1.2.0", "b"), ("all", 1, "1.1.0", "a"), ("all", 3, "2.0.0", "no")], "url string, pos int, heading string, text string")
    releases_ = make([("GITHUB", "o/r", "v1.1.0", "u", "t"), ("GITHUB", "o/r2", "v1.1.0", "u", "t"), ("GITLAB", "x/y/z", "v1.2.0", "u", "t"), ("GITLAB", "x/y/z", "v1.9.0", "u", "t")], "host string, path string, name string, url string, text string")
    asked = []

    def seen(name, source):
        def run(w):
            asked.append((name, sorted(r.coordinate for r in w.collect())))
            return source(w)

        return run

    sources = [seen("rules", lambda w: notes.rule_documents(w, rules, documents, sections)), seen("github", lambda w: notes.repository_releases(w, releases_, "GITHUB")), seen("gitlab", lambda w: notes.repository_releases(w, releases_, "GITLAB"))]
    got = sorted((r.coordinate, r.source, r.title, r.text) for r in notes.first_with_documents(wanted, sources).collect())
    assert got == [("g:a", "RULE", "All", "a\n\nb"), ("g:a", "RULE", "Guide 1.1", "one"), ("g:b", "RULE", "Guide 1.1", "one"), ("h:c", "GITLAB", "v1.2.0", "t")]
    assert asked == [("rules", ["g:a", "g:b", "h:c", "h:d", "h:e"]), ("github", ["h:c", "h:d", "h:e"]), ("gitlab", ["h:c", "h:d", "h:e"])]
    host, path = notes.repository(F.col("scm"))
    assert [(r[0], r[1]) for r in wanted.orderBy("coordinate").select(host, path).collect()] == [("GITHUB", "o/r"), ("GITHUB", "o/r2"), ("GITLAB", "x/y/z"), (None, None), (None, None)]


def test_release_names_with_numbers_of_any_size(spark):
    names = spark.createDataFrame([("Release 2.0.20240315120000",), ("v2.0.99999999999999999999999",), ("2.1.0",)], "t string")
    start, end = (F.array(*map(F.lit, v)) for v in ((1, 9, 0), (2, 1, 0)))
    assert [r[0] for r in names.select(releases.relevant(F.col("t"), start, end)).collect()] == [True, False, True]
    one = lambda a, b: spark.range(1).select(releases.lines_between(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), 3).alias("x")).head().x
    assert one((1, 2), (3, 1)) == ["1.3", "1.4", "1.5", "2.0", "2.1", "2.2", "3.0", "3.1"] and one((1, 5), (1, 5)) == one((2, 0), (1, 9)) == []


@pytest.mark.parametrize("blocks", [False, True])
def test_budgets_are_greedy_and_not_prefixes(spark, blocks):
    sizes = {"a": [5, 9, 4, 6, 1, 0, 11, 1], None: [3, 3, 20, 3, 3], "c": [None, 10, 1, 0], "d": []}
    rows = [(g, i, n) for g, some in sizes.items() for i, n in enumerate(some)] + [("e", 0, 6), ("e", 0, 6), ("e", 1, 4)]
    got = trees.within_budget(spark.createDataFrame(rows, "g string, i int, n int"), "g", ["i"], "n", 10, F.floor(F.col("i") / 2) if blocks else None)
    want = []
    for g, some in sizes.items():
        total = 0
        for i, n in enumerate(some):
            if total + (n or 0) <= 10:
                total += n or 0
                want.append((g, i))
    # Rows of one place are one item, of twelve here, which does not fit.
    assert sorted(((r.g, r.i) for r in got.collect()), key=str) == sorted([*want, ("e", 1)], key=str)


def test_deep_trees_and_common_lines(spark):
    nodes = spark.createDataFrame([("t", i, i, str(i)) for i in range(1, 1501)], "tree string, pos int, depth int, coordinate string")
    deepest = trees.ancestors(nodes).where("pos = 1500").head().path
    assert deepest == list(range(1, 1501))
    rows = spark.range(900).select((F.col("id") % 2).alias("k"), F.col("id").alias("pos"))
    plain, by_block = (findings.fingerprinted(rows, ["k"], F.col("pos"), block) for block in (None, F.floor(F.col("pos") / 50)))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, by_block.collect()))
    sums = keyed.summed_before(rows, ["k"], ["pos"], F.floor(F.col("pos") / 50), F.col("pos"), "s").where("pos = 899").head().s
    assert sums == sum(range(1, 899, 2))


def test_coordinates_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Estimates count neither the beginnings of a coordinate nor how well coordinates compress, so a small file may be too large for the driver."""
    plans, keep = [], notes.Rounds.keep if hasattr(notes, "Rounds") else None
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    if keep:
        monkeypatch.setattr(notes.Rounds, "keep", lambda self, df: seen(df) or keep(self, df))
    rows = [(f"g:{i}", [1, i % 3, 0], [1, 5, 0], f"https://github.com/o/r{i % 2}") for i in range(300)]
    spark.createDataFrame(rows, "coordinate string, start array<int>, end array<int>, scm string").write.parquet(f"{tmp_path}/wanted")
    wanted = spark.read.parquet(f"{tmp_path}/wanted")
    rules = spark.createDataFrame([("g:1", 1, "GUIDE", "d/{line}", "{line}", False), ("g:12", 2, "GUIDE", "d/{line}", "{line}", False), ("g:12", 2, "GUIDE", "e", "e", None)], "prefix string, pos int, kind string, url string, title string, by_section boolean")
    documents = spark.createDataFrame([("d/1.3", "three"), ("d/1.4", "four"), ("d/1.9", "no"), ("e", "e")], "url string, text string")
    releases_ = spark.createDataFrame([("GITHUB", "o/r0", "v1.2.0", "u", "t"), ("GITHUB", "o/r0", "v1.3.0", "u", "t"), ("GITHUB", "o/r1", "v1.6.0", "u", "t")], "host string, path string, name string, url string, text string")
    result = notes.first_with_documents(wanted, [lambda w: notes.rule_documents(w, rules, documents), lambda w: notes.repository_releases(w, releases_, "GITHUB")])
    seen(result)
    want = []
    for c, start, _, scm in rows:
        titles = [t for t in ("1.3", "1.4") if c.startswith("g:1")] + ["e"] * c.startswith("g:12")
        want += [(c, "RULE", t) for t in titles] or [(c, "GITHUB", v) for v, minor in (("v1.2.0", 2), ("v1.3.0", 3)) if scm.endswith("r0") and minor > start[1]]
    assert sorted((r.coordinate, r.source, r.title) for r in result.collect()) == sorted(want)
    assert not [line for p in plans for line in p.splitlines() if "BroadcastHashJoin [prefix" in line or "BroadcastHashJoin [path" in line]
