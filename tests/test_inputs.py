"""Inputs of reviews and checks of what comes back, on literal rows."""

import hashlib

from pyspark.sql import functions as F

from siftline.operators import inputs


def test_input_hash(spark):
    rows = [("r", "p", "c", "l", "e", None), ("r", "p", None, None, None, ""), ("r", "p", "c", "l", "e", "x")]
    df = spark.createDataFrame(rows, "rule string, path string, code string, label string, evidence string, related string")
    got = [r[0] for r in df.select(inputs.input_hash(*[F.col(c) for c in df.columns])).collect()]
    want = ["r\0p\0c\0l\0e", "r\0p\0\0\0", "r\0p\0c\0l\0e\0x"]
    assert got == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_slices_of_one_origin(spark):
    code = "\n".join(f"l{i}" for i in range(1, 41))
    rows = [("a", i, code, 1, i) for i in (1, 20, 40, 41, 60, 70)] + [("b", 1, None, 1, 5), (None, 1, code, 1, 5), ("c", 1, code, 5, 2), ("d", 1, "x", 1, 1), ("d", 1, "x", 1, 1)]
    df = spark.createDataFrame(rows, "g string, id int, code string, code_start int, start_line int")
    found = inputs.origin_members(df, "g", "id").collect()
    assert len(found) == len(rows)
    got = {(r.g, r.id): (r.slice_start, r.slice and (r.slice.split("\n")[0], r.slice.split("\n")[-1])) for r in found}
    assert got[("a", 1)] == (1, ("l1", "l9")) and got[("a", 20)] == (12, ("l12", "l28")) and got[("a", 40)] == (32, ("l32", "l40"))
    assert got[("a", 41)] == (33, ("l33", "l40")) and got[("a", 60)] == (60, None) and got[("a", 70)] == (70, None)
    assert got[("b", 1)] == (5, None) and got[(None, 1)] == (5, None) and got[("c", 1)] == (5, ("l1", "l6")) and got[("d", 1)] == (1, ("x", "x"))


def test_changes(spark):
    good, versions = [("g:a", "1", "2", "BOM"), (" g:a ", "1", "2", "DIRECT")], "coordinate string, before string, after string, via string"
    bad = [("g", "1", "2", "BOM"), ("g:a:b", "1", "2", "BOM"), ("g:a", None, "2", "BOM"), ("g:a", "1", " ", "BOM"), ("g:a", "1", "2", "bom"), ("g:a", "1", "2", None), (None, None, None, None)]
    df = spark.createDataFrame([(1, *c) for c in good + bad], f"plan int, {versions}")
    assert [tuple(r) for r in inputs.change_counts(df, "plan").collect()] == [(1, 2, 7)]
    assert inputs.change_counts(df.where("plan > 1"), "plan").count() == 0


def test_summaries_and_targets(spark):
    rows = [(True, "x", "h"), (None, "x", "h"), (True, " ", None), (True, None, "h"), (True, "x" * 1001, None), (True, "x" * 1000 + "  ", "h"), (True, "x", " ")]
    df = spark.createDataFrame(rows, "known boolean, text string, digest string")
    assert [r[0] for r in df.select(inputs.refusal(F.col("known"), F.col("text"), F.col("digest"))).collect()] == [None, "UNKNOWN", "EMPTY", "EMPTY", "TOO_LONG", None, "NO_HASH"]
    lines = ["m.xml:2 ${a.b} (WHERE)", "${first}\nm.xml:2 #id:VARCHAR#", "x $name$ y", "${first}\nnone", "", None]
    df = spark.createDataFrame([(v,) for v in lines], "v string")
    assert [r[0] for r in df.select(inputs.trace_target(F.col("v"))).collect()] == ["${a.b}", "#id:VARCHAR#", "$name$", None, None, None]


def test_sections_and_rules(spark):
    df = spark.createDataFrame([("d", 1, False), ("d", 2, True), ("d", 3, None), ("d", 4, True)], "doc string, pos int, starts boolean")
    placed = inputs.line_starts_first(df, "doc", "pos", F.col("starts"))
    assert [r.pos for r in placed.orderBy("place").collect()] == [2, 4, 1, 3]
    common = spark.createDataFrame([("sink", ["b"]), ("login", ["l"])], "kind string, vals array<string>")
    own = spark.createDataFrame([("s", "sink", ["a", "b"]), ("t", "extra", None)], "system string, kind string, vals array<string>")
    got = {(r.system, r.kind): r.vals for r in inputs.overlaid(common, own, "system", "kind", "vals").collect()}
    assert got == {("s", "sink"): ["a", "b"], ("s", "login"): ["l"], ("t", "extra"): [], ("t", "sink"): ["b"], ("t", "login"): ["l"]}
    assert inputs.overlaid(common.limit(0), own, "system", "kind", "vals").count() == 2
    edited = own.select(inputs.changed_values(F.col("vals"), F.array(F.lit("c"), F.lit("b")), F.array(F.lit("b"))).alias("v"))
    assert edited.head().v == ["a", "c"]
