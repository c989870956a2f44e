"""Origins by frames of calls, against a plain recursion over stacks of calls; must-execute puts against a plain tree walk."""

import random

import pytest

from siftline.functions.severity import VERDICTS
from siftline.operators import frames, statements


def frame(spark, flows, returns, arguments, origins):
    make = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    return frames.framed_origins(
        make(flows, "dst string, src string"), make(returns, "dst string, src string, site string"), make(arguments, "param string, src string, site string"), make(origins, "node string, verdict string, evidence string")
    )


def slow(flows, returns, arguments, origins):
    params, own = {p for p, _, _ in arguments}, {n: VERDICTS.index(v) for n, v, _ in origins}
    nodes = {x for f in flows for x in f} | {x for d, s, _ in returns for x in (d, s)} | {x for p, s, _ in arguments for x in (p, s)} | set(own)

    def verdict(n, stack=()):
        if n in params:
            if stack:
                return max((verdict(s, stack[1:]) for p, s, site in arguments if p == n and site == stack[0]), default=3)
            if n in own:
                return own[n]
            return max(verdict(s) for p, s, _ in arguments if p == n)
        ways = [verdict(s, stack) for d, s in flows if d == n] + [verdict(s, (site, *stack)) for d, s, site in returns if d == n]
        return max(ways + [own[n]] if n in own else ways, default=3)

    return {n: VERDICTS[verdict(n)] for n in nodes}


def test_two_callers_of_one_helper(spark):
    flows = [("h.r", "h.p"), ("a", "x1"), ("b", "x2"), ("b2", "b"), ("b3", "b2")]
    returns, arguments = [("x1", "h.r", "s1"), ("x2", "h.r", "s2")], [("h.p", "request", "s1"), ("h.p", "literal", "s2")]
    origins = [("request", "CLIENT", "parameter q"), ("literal", "SERVER_SET", None)]
    got = {r.node: r for r in frame(spark, flows, returns, arguments, origins).collect()}
    assert {n: r.verdict for n, r in got.items()} == slow(flows, returns, arguments, origins)
    assert (got["a"].verdict, got["b3"].verdict, got["h.p"].verdict) == ("CLIENT", "SERVER_SET", "CLIENT")
    assert got["a"].steps == ["a", "x1", "parameter q"] and got["b3"].steps == ["b3", "x2", "literal"]


def test_handlers_recursion_and_missing_callers(spark):
    # f returns its parameter or, by a call of itself with it, what that returns; a handler's parameter is the client's, but not within a call.
    flows, returns = [("f.r", "f.p"), ("f.r", "f.x"), ("v", "y"), ("u", "z"), ("q", "lost")], [("f.x", "f.r", "s0"), ("y", "f.r", "s1"), ("z", "h.r", "s2")]
    arguments = [("f.p", "f.p", "s0"), ("f.p", "safe", "s1"), ("h.p", "safe", "s2"), ("g.p", "g.p", "s3")]
    origins = [("safe", "SESSION_OVERWRITE", "session"), ("h.p", "CLIENT", "handler")]
    got = {r.node: r.verdict for r in frame(spark, [*flows, ("h.r", "h.p"), (None, "safe")], returns, arguments, origins).collect() if r.node}
    assert got["v"] == got["u"] == got["f.p"] == got["f.r"] == "SESSION_OVERWRITE" and got["h.p"] == got["h.r"] == "CLIENT"
    assert got["q"] == got["lost"] == got["g.p"] == "UNKNOWN"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_programs(spark, seed):
    rng = random.Random(seed)
    flows, returns, arguments, origins = [], [], [], []
    for m in range(14):
        params, names = [f"m{m}.p{i}" for i in range(rng.randrange(3))], [f"m{m}.v{i}" for i in range(6)]
        for i, v in enumerate(names):
            kind = rng.randrange(5)
            if kind == 0 or i == 0 and not params:
                origins.append((v, rng.choice(["SERVER_SET", "SESSION_OVERWRITE", "CLIENT", "UNKNOWN"]), None))
            elif kind == 1 and m:
                callee, site = rng.randrange(m), f"c{m}.{i}"
                returns.append((v, f"m{callee}.v5", site))
                have = params + names[:i]
                arguments += [(f"m{callee}.p{k}", rng.choice(have), site) for k in range(2)] if have else []
            elif kind == 2 and i > 1:
                flows += [(v, rng.choice(params + names[:i])), (v, names[i - 1])]
            elif params + names[:i]:
                flows.append((v, rng.choice(params + names[:i])))
        if params and rng.random() < 0.3:
            origins.append((params[0], "CLIENT", "handler"))
    # Every parameter has an argument at each site of its method, as it must.
    got = {r.node: r.verdict for r in frame(spark, flows, returns, arguments, origins).collect()}
    assert got == slow(flows, returns, arguments, origins)


def verdicts(spark, flows, returns, arguments, origins):
    make = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    tables = make(flows, "dst string, src string"), make(returns, "dst string, src string, site string"), make(arguments, "param string, src string, site string"), make(origins, "node string, verdict string, evidence string")
    rows = frames.framed_origins(*tables, steps=False).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.verdict for r in rows}


@pytest.mark.parametrize("seed", [3, 4])
def test_verdicts_without_steps(spark, seed):
    # Methods call those before them by a variable, which some return, give on or leave; values that nothing takes, at sites with two returns; parameters that nobody gives.
    rng = random.Random(seed)
    flows, returns, arguments, origins = [], [], [], [("b0", "CLIENT", None), ("b1", "SERVER_SET", None), ("unused", "SESSION_OVERWRITE", None)]
    for m in range(12):
        params = [f"m{m}.p{i}" for i in range(m % 3)]
        names = [f"m{m}.v{i}" for i in range(8)]
        for i, v in enumerate(names):
            have, kind = params + names[:i] + ["b0", "b1", "b2"], rng.randrange(6)
            if kind < 3 and m:
                callee, site = rng.randrange(m), f"c{m}.{i}"
                returns += [(v, f"m{callee}.r", site)] + [(v, f"m{callee}.v1", site)] * (kind == 1)
                arguments += [(f"m{callee}.p{k}", rng.choice(have), site) for k in range(callee % 3)]
            elif kind == 3:
                flows += [(v, rng.choice(have)), (v, rng.choice(have))]
            elif kind == 4:
                flows.append((v, rng.choice(have)))
            elif rng.random() < 0.5:
                origins.append((v, rng.choice(["SERVER_SET", "SESSION_OVERWRITE", "CLIENT", "UNKNOWN"]), None))
        flows += [(f"m{m}.r", v) for v in rng.sample(params + names, 2)]
        if params and rng.random() < 0.3:
            origins.append((params[0], "CLIENT", "handler"))
    called = {p for p, _, _ in arguments}
    flows = [(d, s) for d, s in flows if ".p" not in s or s in called]
    want = slow(flows, returns, arguments, origins)
    got = verdicts(spark, flows, returns, arguments, origins)
    assert got == want and len(set(got.values())) > 2


def test_verdicts_by_recursion_nulls_and_repeats(spark):
    flows, returns = [("f.r", "f.p"), ("f.r", "f.x"), ("h.r", "h.p"), ("q", "lost"), (None, "safe"), ("w", None)], [("f.x", "f.r", "s0"), ("y", "f.r", "s1"), ("z", "h.r", "s2"), ("o", None, "s4"), (None, "f.r", "s5"), ("e", "f.r", "s6")] * 2
    arguments = [("f.p", "f.p", "s0"), ("f.p", "safe", "s1"), ("h.p", "safe", "s2"), ("g.p", "g.p", "s3"), ("f.p", None, "s7"), (None, "n", "s8")] * 2
    origins = [("safe", "SESSION_OVERWRITE", "session"), ("h.p", "CLIENT", "handler"), ("odd", None, None)]
    got = verdicts(spark, flows, returns, arguments, origins)
    assert got == {"f.r": "SESSION_OVERWRITE", "f.p": "SESSION_OVERWRITE", "f.x": "SESSION_OVERWRITE", "y": "SESSION_OVERWRITE", "z": "SESSION_OVERWRITE", "safe": "SESSION_OVERWRITE", "h.p": "CLIENT", "h.r": "CLIENT"} | dict.fromkeys(["q", "lost", "g.p", "o", "e", "n", "odd"], "UNKNOWN")


def test_rounds_have_no_values_that_nothing_takes(spark, monkeypatch):
    # Each call more is written once, as its argument's origin; it was written over 10 times.
    keep, wrote = frames.Rounds.keep, []

    def counted(self, df):
        kept = keep(self, df)
        wrote.append(kept.count())
        return kept

    monkeypatch.setattr(frames.Rounds, "keep", counted)

    def rows(n):
        wrote.clear()
        got = verdicts(spark, [("h.r", "h.p")], [(f"x{i}", "h.r", f"s{i}") for i in range(n)], [("h.p", f"a{i}", f"s{i}") for i in range(n)], [(f"a{i}", ["CLIENT", "SERVER_SET"][i % 2], None) for i in range(n)])
        assert got == {f"{k}{i}": ["CLIENT", "SERVER_SET"][i % 2] for i in range(n) for k in "ax"} | {"h.p": "CLIENT", "h.r": "CLIENT"}
        return sum(wrote)

    assert rows(120) - rows(20) == 100


KINDS = ["BLOCK", "IF", "TRY", "DO", "LABELED", "SYNCHRONIZED", "FOR", "WHILE", "SWITCH", "LAMBDA", "AND", "OTHER", "RETURN", "THROW", "EXPRESSION", "EXPRESSION", "EXPRESSION"]


def program(rng, method, numbers):
    """Statements of one method, parents before children, numbered in order of the text."""
    rows = []

    def grow(parent, role, kind, deep):
        me = next(numbers)
        rows.append([method, me, parent, me, kind, role, [f"k{rng.randrange(3)}"] if kind == "EXPRESSION" and rng.random() < 0.8 else []])
        roles = {"IF": ["CONDITION", "THEN", "ELSE"][: rng.choice([2, 3, 3])], "TRY": ["TRY", "CATCH"], "AND": ["LEFT", "RIGHT"], "BLOCK": [None] * rng.randrange(5)}.get(kind, [None])
        if kind in ("RETURN", "THROW", "EXPRESSION") or deep == 0:
            return
        for r in roles:
            grow(me, r, "CATCH" if r == "CATCH" else "BLOCK" if deep == 1 else rng.choice(KINDS), deep - 1)

    grow(None, None, "BLOCK", 5)
    return rows


def slow_puts(rows, uses):
    at, below = {r[1]: r for r in rows}, {}
    for r in rows:
        below.setdefault(r[2], []).append(r)

    def returns(r):
        return r[4] == "RETURN" or r[4] != "LAMBDA" and any(map(returns, below.get(r[1], [])))

    def always(r, key, leaves):
        inner, kind = below.get(r[1], []), r[4]
        if kind == "BLOCK":
            for c in inner:
                if always(c, key, leaves):
                    return True
                if not leaves and returns(c):
                    return False
            return False
        if kind == "EXPRESSION":
            return key in r[6]
        if kind in ("RETURN", "THROW"):
            return leaves
        if kind == "IF":
            both = [c for c in inner if c[5] in ("THEN", "ELSE")]
            return len(both) == 2 and all(always(c, key, leaves) for c in both)
        if kind in ("TRY", *statements.PASSING):
            return any(always(c, key, leaves) for c in inner if kind != "TRY" or c[5] == "TRY")
        return False

    def must(put, key, use):
        shared, n = set(), use
        while n is not None:
            shared.add(n)
            n = at[n][2]
        r = at[put]
        while r[2] is not None:
            p = at[r[2]]
            if p[1] in shared:
                return True
            if p[4] == "IF" and r[5] in ("THEN", "ELSE"):
                other = [c for c in below[p[1]] if c[5] in ("THEN", "ELSE") and c is not r]
                if not other or not always(other[0], key, True):
                    return False
            if p[4] in statements.MAYBE or p[4] in ("AND", "OR") and r[5] == "RIGHT":
                return False
            r = p
        return False

    body = {r[1]: {k for k in ("k0", "k1", "k2") if always(r, k, False)} for r in rows if r[2] is None}
    return {(u, key, r[1], must(r[1], key, stmt)) for u, stmt, key in uses for r in rows if r[0] == at[stmt][0] and r[4] == "EXPRESSION" and key in r[6] and r[3] < at[stmt][3]}, body


def test_puts_that_must_run(spark):
    rng, numbers = random.Random(3), iter(range(10**6))
    rows = [r for m in range(60) for r in program(rng, m, numbers)]
    uses = [(i, r[1], f"k{rng.randrange(3)}") for i, r in enumerate(rng.sample(rows, min(len(rows), 250)))]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(2)
    table = make(rows, "method int, stmt int, parent int, pos int, kind string, role string, puts array<string>")
    want, body = slow_puts(rows, uses)
    got = {(r.use, r.key, r.put, r.must) for r in statements.puts_before(table, make(uses, "use int, stmt int, key string")).collect()}
    assert got == want and len({x[3] for x in want}) == 2
    roots = {r.stmt: set(r["keys"]) for r in statements.always_puts(table, False).where("stmt IN (%s)" % ", ".join(map(str, body))).collect()}
    assert roots == body and any(body.values())


def test_methods_that_fill_a_map(spark):
    # f always puts a; g puts a unless it returns first; both put, in some way, what their callers read.
    rows = [
        ("f", 1, None, 1, "BLOCK", None, []), ("f", 2, 1, 2, "EXPRESSION", None, ["a"]), ("g", 10, None, 1, "BLOCK", None, []), ("g", 11, 10, 2, "IF", None, []), ("g", 12, 11, 3, "RETURN", "THEN", []), ("g", 13, 10, 4, "EXPRESSION", None, ["a"]),
        ("m", 20, None, 1, "BLOCK", None, []), ("m", 21, 20, 2, "EXPRESSION", None, []), ("m", 22, 20, 3, "OTHER", None, []), ("n", 30, None, 1, "BLOCK", None, []), ("n", 31, 30, 2, "EXPRESSION", None, []), ("n", 32, 30, 3, "OTHER", None, []),
    ]
    table = spark.createDataFrame(rows, "method string, stmt int, parent int, pos int, kind string, role string, puts array<string>").coalesce(1)
    uses = spark.createDataFrame([(1, 22, "a"), (2, 32, "a"), (3, 32, "b")], "use int, stmt int, key string")
    before = statements.puts_before(table, uses, spark.createDataFrame([(21, "f"), (31, "g")], "stmt int, callee string"))
    assert {(r.use, r.put, r.must) for r in before.collect()} == {(1, 21, True), (2, 31, False)}
    values = spark.createDataFrame([(21, "a", "SERVER_SET"), (31, "a", "SERVER_SET")], "put int, key string, verdict string")
    carried = spark.createDataFrame([(1, "a", "CLIENT"), (2, "a", "CLIENT"), (3, "b", None)], "use int, key string, verdict string")
    assert {r.use: (r.verdict, r.covered) for r in statements.key_verdicts(before, values, carried).collect()} == {1: ("SERVER_SET", True), 2: ("CLIENT", False), 3: ("UNKNOWN", False)}
    assert statements.always_puts(table.where("false"), True).count() == 0


def test_depths_join_no_ended_ways(spark, monkeypatch):
    # A chain of 10, 50 bodies with a statement each, one that stands in no statement, one that stands in itself with one within it.
    rows = [(i, i - 1 if i else None) for i in range(10)] + [(100 + i, None) for i in range(50)] + [(200 + i, 100 + i) for i in range(50)] + [(300, 999), (301, 300), (400, 400), (401, 400)]
    table = spark.createDataFrame(rows, "stmt int, parent int").coalesce(2)
    join, ended = type(table).join, []

    def spied(self, other, on=None, how=None):
        ended.append(self.where(f"{on} IS NULL").count())
        return join(self, other, on, how)

    monkeypatch.setattr(type(table), "join", spied)
    got = {r.stmt: r.depth for r in statements.depths(table, statements.Rounds(spark, "depths")).collect()}
    assert got == {i: i for i in range(10)} | {100 + i: 0 for i in range(50)} | {200 + i: 1 for i in range(50)} | {300: 0, 301: 1}
    assert ended and not any(ended)
