"""How systems are built: facts of configuration files with their first evidence, and advice set in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.profiles import ARTIFACTS, framework_facts, xml_advices
from siftline.sources.tables import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a file of its brand's system, of one of five kinds."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    word = F.regexp_replace("p_type", " ", "")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    artifact = F.element_at(F.array(*[F.lit(token) for token, _, _ in ARTIFACTS]), (k % len(ARTIFACTS) + 1).cast("int"))
    kinds = [
        ("pom.xml", cat("<project><parent><artifactId>spring-boot-starter-parent</artifactId>\n<version>", size, ".0</version></parent><artifactId>", artifact, "</artifactId></project>")),
        ("web.xml", cat("<web-app><!-- <filter-class>a.Off</filter-class> -->\n<filter-class> com.x.", word, "\n</filter-class></web-app>")),
        ("beans.xml", cat(
            '<beans><bean id="b', size, '" class="com.y.', word, '"/>\n<mvc:interceptors><bean class="com.z.Check', size, '"/></mvc:interceptors>\n',
            '<aop:config><aop:pointcut id="p" expression="execution(* ', word, '.*(..))"/>\n<aop:aspect ref="b', (F.col("p_size") + 1).cast("string"),
            '">\n<!-- <aop:before method="off" pointcut="off"/>\n--><aop:before method="m', size, '" pointcut-ref="p"/></aop:aspect></aop:config></beans>',
        )),
        ("application.properties", cat("#server.servlet.session.timeout=1\nserver.servlet.session.timeout=", size, "m # note\nspring.session.store-type=${STORE}")),
        ("application.yml", cat("spring:\n  session:\n    store-type: '", word, "'\nmybatis:\n  x: y")),
    ]
    at = (k % 5 + 1).cast("int")
    file = F.element_at(F.array(*[F.struct(F.lit(n).alias("n"), c.alias("c")) for n, c in kinds]), at)
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("system"), F.concat(F.lit("m"), k.cast("string"), F.lit("/"), file["n"]).alias("path"), file["c"].alias("content"))


def q_framework_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files; what they tell of their brand's system, each fact once with the first file that tells it."""
    return framework_facts(_files(spark, sf_dir))


def q_xml_advices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice set in the parts' files of beans, with the class of its aspect's bean from whichever file of the brand defines it first."""
    return xml_advices(_files(spark, sf_dir))


QUERIES = {"q_framework_facts": q_framework_facts, "q_xml_advices": q_xml_advices}

_ARTIFACT = ", ".join(f"({i}, '{token}', '{kind}', '{value}')" for i, (token, kind, value) in enumerate(ARTIFACTS))
_PARTS = "parts AS (SELECT p_brand AS system, p_partkey AS k, p_size AS size, replace(p_type, ' ', '') AS word, 'm' || p_partkey || '/' AS dir FROM part)"

ORACLES = {
    "q_framework_facts": f"""
        WITH {_PARTS}, artifacts(i, token, kind, value) AS (VALUES {_ARTIFACT}), facts AS (
            SELECT system, dir, '웹' AS kind, 'Spring Boot ' || size || '.0' AS value, 'pom.xml spring-boot ' || size || '.0' AS evidence FROM parts WHERE k % 5 = 0
            UNION ALL SELECT system, dir, kind, value, 'pom.xml ' || token FROM parts JOIN artifacts ON i = k % {len(ARTIFACTS)} WHERE k % 5 = 0
            UNION ALL SELECT system, dir, '필터', word, 'web.xml <filter-class>com.x.' || word FROM parts WHERE k % 5 = 1
            UNION ALL SELECT system, dir, '인터셉터', 'Check' || size, 'beans.xml <mvc:interceptors> com.z.Check' || size FROM parts WHERE k % 5 = 2
            UNION ALL SELECT system, dir, 'AOP', 'XML AOP(<aop:config>)', 'beans.xml <aop:config>' FROM parts WHERE k % 5 = 2
            UNION ALL SELECT system, dir, 'AOP', 'XML 애스펙트 b' || (size + 1), 'beans.xml <aop:aspect ref="b' || (size + 1) || '">' FROM parts WHERE k % 5 = 2
            UNION ALL SELECT system, dir, '설정 파일', 'application.properties', dir || 'application.properties' FROM parts WHERE k % 5 = 3
            UNION ALL SELECT system, dir, '세션', '세션 만료 ' || size || 'm', 'application.properties server.servlet.session.timeout' FROM parts WHERE k % 5 = 3
            UNION ALL SELECT system, dir, '설정 파일', 'application.yml', dir || 'application.yml' FROM parts WHERE k % 5 = 4
            UNION ALL SELECT system, dir, '세션', '세션 저장소 ' || word, 'application.yml spring.session.store-type' FROM parts WHERE k % 5 = 4
            UNION ALL SELECT system, dir, '영속성', 'MyBatis(Spring Boot)', 'application.yml mybatis 설정' FROM parts WHERE k % 5 = 4)
        SELECT system, kind, value, arg_min(evidence, dir) AS evidence FROM facts GROUP BY system, kind, value""",
    "q_xml_advices": f"""
        WITH {_PARTS}, beans AS (SELECT * FROM parts WHERE k % 5 = 2), owners AS (SELECT system, size, arg_min(word, dir) AS owner FROM beans GROUP BY system, size)
        SELECT b.system, b.dir || 'beans.xml' AS path, 6 AS line, coalesce(o.owner, 'B' || (b.size + 1)) AS owner, 'm' || b.size AS method, 'execution(* ' || b.word || '.*(..))' AS pointcut,
               'beans.xml:6 <aop:before method="m' || b.size || '" pointcut="execution(* ' || b.word || '.*(..))">' AS evidence
        FROM beans b LEFT JOIN owners o ON o.system = b.system AND o.size = b.size + 1""",
}
