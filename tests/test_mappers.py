"""Uses of values in mapper files, rule sets, rule changes, grants."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import tracing, views
from siftline.sources import reports

MAPPER = """<mapper>
<select id="a">select ${col} from t <where> x = #{ key , jdbcType=VARCHAR} <if test="b != null">and y = ${b.c}</if></where> order by ${order}</select>
<update id="u">update t <set> n = #{n}, </set> where id = #{id} -- set
 and z = ${z}</update>
<update id="v">update t set a = #{a} /* where */, b = #{b} <trim prefix="where" prefixOverrides="and">c = ${c}</trim></update>
<insert id="i">insert into t values (#{v}) </insert>
<insert id="k">insert into ${name} select 1</insert>
<delete id="d">delete ${from} <!-- ${no} --></delete>
<select id="n">select 1 from x $not$ #neither#</select>
</mapper>"""
OLD = """<sqlMap namespace="s"><select id="o">select * from t <dynamic prepend="WHERE"><isNotEmpty prepend="AND" property="q">a = #q:VARCHAR# or b = $list[]$</isNotEmpty></dynamic></select>
<update id="p">update t <dynamic prepend="set"> x = #a.b# </dynamic></update></sqlMap>"""


def test_uses_of_values(spark):
    files = spark.createDataFrame([("m.xml", MAPPER), ("o.xml", OLD), ("e.xml", "")], "path string, text string")
    got = {}
    for r in reports.mapper_uses(files).orderBy("path", "id", "pos").collect():
        got.setdefault(r.id, []).append((r.name, r.how, r.condition))
    assert got == {
        "a": [("col", "TEXT", True), ("key", "BOUND", True), ("b", "TEXT", True), ("order", "TEXT", True)],
        "u": [("n", "BOUND", False), ("id", "BOUND", True), ("z", "TEXT", True)],
        "v": [("a", "BOUND", False), ("b", "BOUND", False), ("c", "TEXT", True)],
        "i": [("v", "BOUND", False)], "k": [("name", "TEXT", False)], "d": [("from", "TEXT", True)],
        "o": [("q", "BOUND", True), ("list", "TEXT", True)], "p": [("a", "BOUND", False)],
    }


def test_names_in_conditions(spark):
    cases = {"a != null and b.size > 0": ["a", "b"], "name == 'x y' or fn(z) and @T@m(q)": ["name", "z", "q"], "a eq a": ["a"], "list.isEmpty() and not done": ["list", "done"], "": []}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", reports.ognl_names(F.col("t")).alias("n"), reports.unescaped(F.lit("&lt;a&gt; &amp;amp; &quot;&apos;")).alias("u")).collect()
    assert {r.t: r.n for r in rows} == cases and rows[0].u == "<a> &amp; \"'"


def test_rule_sets(spark):
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    one = ("a.yml", "rules:\n - id: r1\n   severity: ERROR\n - severity: INFO\n - text\n")
    empty = [("b.yml", "rules:\n"), ("c.yml", ""), ("d.yml", "- a\n- b\n"), ("e.yml", "rules: {a: 1}\n")]
    found = reports.rule_set(files(one, *empty)).collect()
    assert [(r.rule_id, r.severity) for r in found] == [("r1", "HIGH")] and len(found[0].version) == 12
    assert reports.rule_set(files(*empty[::-1], one)).head().version == found[0].version != reports.rule_set(files(one)).head().version
    for none in (empty, []):
        with pytest.raises(ValueError):
            reports.rule_set(files(*none))


def test_rules_that_change_and_count(spark):
    drafted = spark.createDataFrame([("a", "k1", True), ("a", "k1", False), ("a", "k2", False), ("a", "k3", None), ("b", "k1", True), ("b", "k9", False)], "target string, key string, session boolean")
    existing = spark.createDataFrame([("a", "k2"), ("a", "k2"), ("a", "unseen"), ("c", "k1")], "target string, key string")
    got = sorted(tuple(r) for r in tracing.overwrite_changes(drafted, existing).collect())
    assert got == [("ADD_KEYS", "a", "k1", True), ("ADD_OVERWRITE", "b", "k1", True), ("REMOVE_KEYS", "a", "k2", False)]
    rules = spark.createDataFrame([("r1",), ("r1",)], "rule_id string")
    assert sorted(r.rule_id for r in tracing.active_rules(rules, {"scope": True, "auth": False}).collect()) == ["r1", "scope"]


def test_grants(spark):
    grants = spark.createDataFrame([(1, 1, ["B", "A", "C"], True), (2, 1, ["A"], False), (3, 2, ["A"], True), (4, 3, ["A"], True)], "user_id int, program_id int, buttons array<string>, active boolean")
    programs = spark.createDataFrame([(1, ["A", "B"], True), (2, [], True), (3, ["A"], False)], "program_id int, buttons array<string>, active boolean")
    assert {(r.user_id, tuple(r.buttons)) for r in views.granted(grants, programs).collect()} == {(1, ("B", "A")), (3, ())}
