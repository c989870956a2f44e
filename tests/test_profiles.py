"""Small cases of facts of configuration files, of advice set in XML, and of the files that are read."""

import __spark_entry__ as entry
import duckdb
import pytest

from siftline.operators import profiles
from siftline.sources.files import source_files

DATA = "/root/testdata/sf0.001"
FILES = "system string, path string, content string, kind int"


def facts(spark, *files, types=None):
    df = spark.createDataFrame([("s", p, c, 0) for p, c in files], FILES)
    return {(r.kind, r.value): r.evidence for r in profiles.framework_facts(df, types).collect()}


def test_build_files(spark):
    pom = "<parent>\n<artifactId> spring-boot-starter-parent </artifactId> <version> 3.2.1 </version></parent><artifactId>mybatis-spring-boot-starter</artifactId>"
    gradle = "id 'org.springframework.boot' version '2.7.0'\nimplementation 'org.mybatis:mybatis-spring:2.0'\nx 'not-struts-core'"
    assert facts(spark, ("b/pom.xml", pom), ("a/build.gradle", gradle), ("a/other.gradle", gradle)) == {
        ("웹", "Spring Boot 3.2.1"): "pom.xml spring-boot 3.2.1",
        ("웹", "Spring Boot 2.7.0"): "build.gradle spring-boot 2.7.0",
        ("영속성", "MyBatis(Spring Boot)"): "pom.xml mybatis-spring-boot-starter",
        ("영속성", "MyBatis(Spring)"): "build.gradle mybatis-spring",
    }


def test_descriptors_and_beans(spark):
    web = "<servlet-class>x.DispatcherServlet</servlet-class><listener-class>org.apache.struts2.Up</listener-class><filter-class>\n a.Gate </filter-class><filter-class/><!--<filter-class>a.Off</filter-class>--><session-config>"
    beans = '<beans><!-- <mvc:interceptors> --><bean class="a.Plain"/><bean id=\'f\' class="o.SqlSessionFactoryBean"></bean><mvc:interceptors><bean class="a.One"/><bean class="b.One"/></mvc:interceptors><bean class="a.After"/><mvc:annotation-driven /><aop:aspectj-autoproxy/><aop:aspect><bean class=unquoted>'
    assert facts(spark, ("web.xml", web), ("x/c.xml", beans), ("x/d.xml", "<sqlMapConfig>"), ("e.xml", "<configuration mybatis>"), ("struts.xml", None), ("f.xml", None)) == {
        ("웹", "Spring MVC(web.xml DispatcherServlet)"): "web.xml <servlet-class>x.DispatcherServlet",
        ("웹", "Struts 2"): "struts.xml",
        ("필터", "Gate"): "web.xml <filter-class>a.Gate",
        ("세션", "web.xml session-config"): "web.xml <session-config>",
        ("영속성", "MyBatis(Spring)"): "c.xml SqlSessionFactoryBean",
        ("영속성", "iBatis 2"): "x/d.xml <sqlMapConfig>",
        ("영속성", "MyBatis"): "e.xml <configuration>",
        ("인터셉터", "One"): "c.xml <mvc:interceptors> a.One",
        ("웹", "Spring MVC(XML 설정)"): "c.xml <mvc:annotation-driven>",
        ("AOP", "어노테이션 AOP(<aop:aspectj-autoproxy>)"): "c.xml <aop:aspectj-autoproxy>",
    }


@pytest.mark.parametrize(
    ("name", "content", "want"),
    [
        ("application.properties", "server.servlet.session.timeout='30m'  # half an hour", {"세션 만료 30m"}),
        ("application-x.properties", "server.servlet.session.timeout:5\n timeout: 6\nspring.session.store-type=${X}\nspring.aop.proxy-target-class=", {"세션 만료 5"}),
        ("bootstrap.yml", "a:\r\n  timeout: 7\r\n  # store-type: off\r\n  store-type: redis\r\n  timeout: 8", {"세션 만료 7", "세션 만료 8", "세션 저장소 redis"}),
        ("application.txt", "timeout: 1", None),
    ],
)
def test_settings(spark, name, content, want):
    got = facts(spark, (f"src/{name}", content))
    assert {v for k, v in got if k == "세션"} == (want or set())
    assert got.get(("설정 파일", name)) == (None if want is None else f"src/{name}")


def test_types_and_order(spark):
    schema = "system string, path string, name string, full_name string, annotations array<string>, supers array<string>, registered array<string>"
    types = spark.createDataFrame(
        [("s", "z/B.java", "B", "z.B", ["Aspect"], ["Filter"], ["Check"]), ("s", "y/B.java", "B", "a.B", None, ["OncePerRequestFilter"], None), ("s", "W.java", "W", None, [], ["HttpServletRequestWrapper"], [])], schema
    )
    long = "a." + "L" * 300
    got = facts(spark, ("web.xml", f"<filter-class>{long}</filter-class>"), types=types)
    assert got == {
        ("필터", "L" * 197 + "..."): ("web.xml <filter-class>" + long)[:197] + "...",
        ("AOP", "@Aspect B"): "B.java B", ("필터", "B"): "B.java B", ("인터셉터", "Check"): "B.java addInterceptor(Check)", ("필터", "요청 래퍼 W"): "W.java W — 요청 파라미터를 바꿀 수 있다",
    }
    twice = spark.createDataFrame([(None, "b/application.yml", "", 0), (None, "b/application.yml", "", 1), (None, "a/application.yml", "", 0), ("t", "c/application.yml", "", 0)], FILES)
    assert sorted((r.system or "", r.evidence) for r in profiles.framework_facts(twice).collect()) == [("", "a/application.yml"), ("t", "c/application.yml")]
    assert profiles.framework_facts(twice.where("false")).count() == 0


def test_advices(spark):
    config = '<beans>\n<aop:config>\n<aop:before method="none" pointcut="x"/><aop:pointcut id="p" expression="old"/><aop:pointcut id="p" expression="new"/>\n<aop:aspect ref="guard">\n<!-- two\nlines --><aop:before method="m" pointcut-ref="p"/><aop:around method="n" pointcut="own" pointcut-ref="p"/><aop:before method="o" pointcut-ref="q"/><aop:after method="p" pointcut="x"/><aop:before pointcut="x"/></aop:aspect><aop:aspect ref="logger"><aop:around method="l" pointcut="x"/></aop:aspect>'
    rows = [("s", "d/c.xml", config, 0), ("s", "d/c.xml", config, 1), ("s", "b.xml", '<bean id="guard" class="a.Second"/>', 0), ("s", "a.xml", '<bean class="a.First" id="guard"/><bean id="guard" class="a.Third"/>', 0), ("t", "a.xml", '<bean class="a.Logger2" id="logger"/>', 0), ("s", "e.xml", '<beans><aop:pointcut id="q" expression="elsewhere"/>', 0)]
    df = spark.createDataFrame(rows, FILES)
    got = sorted((r.line, r.owner, r.method, r.pointcut, r.evidence) for r in profiles.xml_advices(df).collect())
    assert got == [
        (6, "First", "m", "new", 'c.xml:6 <aop:before method="m" pointcut="new">'), (6, "First", "n", "own", 'c.xml:6 <aop:around method="n" pointcut="own">'),
        (6, "Logger", "l", "x", 'c.xml:6 <aop:around method="l" pointcut="x">'),
    ]
    assert profiles.xml_advices(df.where("false")).count() == 0


def test_files_of_a_folder(spark, tmp_path):
    held = {"one/pom.xml": "가", "one/src/A.java": "class A", "one/src/test/T.java": "", "one/target/x.xml": "", "one/a/.git/y.xml": "", "one/outer/z.xml": "z", "two/application.yml": "a: b", "two/bootstrap.yml": "", "two/application.json": "", "two/messages.properties": ""}
    for path, text in held.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text.encode("cp949"))
    got = {(r.system, r.path): r.content for r in source_files(spark, str(tmp_path)).collect()}
    assert got == {("one", "pom.xml"): "가", ("one", "src/A.java"): "class A", ("one", "outer/z.xml"): "z", ("two", "application.yml"): "a: b"}
    assert {(r.system, r.path) for r in source_files(spark, str(tmp_path / "one"), "first").collect()} == {("first", "pom.xml"), ("first", "src/A.java"), ("first", "outer/z.xml")}


@pytest.mark.parametrize("name", ["q_framework_facts", "q_xml_advices"])
def test_queries_equal_their_sql(spark, name):
    df = entry.queries()[name](spark, DATA)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{DATA}/part.parquet'")
    columns = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(db.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall(), key=str)
