import re
from itertools import permutations

import duckdb

from siftline.llm import audit


def slow(docs, labels):
    """The rules, order by order and document by document."""
    good, toxic = ({i for i, *marks in labels if i is not None and marks[at] == 1} for at in (0, 1))
    fails = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        fails.append((i, part or "", {f for f, x in failed.items() if x}))
    out = []
    for part in {p for _, p, _ in fails}:
        own, rows, shapley = [(i, f) for i, p, f in fails if p == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def got(rows):
    return sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows)


def test_changes_visit_every_order_once():
    for n in range(6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in audit.plain_changes(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_audit_equals_brute_force(spark):
    plain, many = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(200))
    docs = [(1, plain, "a"), (2, plain, "a"), (3, plain, "b"), (3, plain, "b"), (0, "short # text", None), (4, "", ""), (5, None, "a"), (None, plain, "a"), (None, None, None), (None, plain, "a")]
    docs += [(6, f"{plain} {plain}", "a"), (7, f"{plain} | {plain.upper()}", "c"), (8, "X" * 100_000 + "\x1c" + plain, "c"), (9, many.replace(" ", "\t\r\n"), "c"), (9, many.replace(" ", "\t\r\n"), "b"), (10, "\x85Grüße 日本 " + many, "a"), (11, "word " * 30_000, "c")]
    docs += [(12, "ABC " * 5 + "é" * 1000, "a"), (1, "short # text", "a"), (2, plain, "z")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (None, 1, 1), (7, 1, None), (9, 1, 0), (99, 1, 1), (0, 0, 1)]
    table = spark.createDataFrame([(i, t, s, 7, "x") for i, t, s in docs], "doc_id bigint, text string, source string, words int, key string")
    marks = spark.createDataFrame([(*x, 1) for x in labels], "doc_id bigint, quality int, toxic int, n int")
    found = audit.audit(audit.cells(table, marks), "ABCDE")
    assert got(found.collect()) == slow(docs, labels)
    assert audit.audit(audit.cells(table.where("false"), marks), "ABCDE").count() == 0
    assert got(audit.audit(audit.cells(table, marks.where("false")), "ABCDE").collect()) == slow(docs, [])


def test_query_equals_brute_force_and_sql(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    found = got(audit.op13_filter_audit(spark, d).collect())
    assert found == slow(docs, labels) and len(found) == 600 * len({s for _, _, s in docs})
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet')")
    rows = db.execute(f"SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM ({audit.ORACLES['op13_filter_audit']})").fetchall()
    assert sorted(tuple(v if isinstance(v, str) else int(v) for v in r) for r in rows) == found
