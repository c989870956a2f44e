"""What a system is built with: facts of its build and configuration files and types, advice set in XML, each with its first evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import last_segment

# The kinds of facts, artifacts that tell of a framework, settings whose values may be read, base types.
WEB, PERSISTENCE, AOP, INTERCEPTOR, FILTER, SESSION, CONFIG = "웹", "영속성", "AOP", "인터셉터", "필터", "세션", "설정 파일"
ARTIFACTS = [
    ("spring-boot-starter-web", WEB, "Spring Boot MVC"),
    ("spring-boot-starter-webflux", WEB, "Spring WebFlux"),
    ("spring-webmvc", WEB, "Spring MVC"),
    ("struts2-core", WEB, "Struts 2"),
    ("struts-core", WEB, "Struts 1"),
    ("egovframework.rte", WEB, "전자정부 표준프레임워크"),
    ("mybatis-spring-boot-starter", PERSISTENCE, "MyBatis(Spring Boot)"),
    ("mybatis-spring", PERSISTENCE, "MyBatis(Spring)"),
    ("ibatis-sqlmap", PERSISTENCE, "iBatis 2"),
    ("spring-boot-starter-data-jpa", PERSISTENCE, "JPA(Spring Data)"),
    ("hibernate-core", PERSISTENCE, "Hibernate"),
    ("spring-boot-starter-aop", AOP, "Spring AOP(Spring Boot)"),
    ("aspectjweaver", AOP, "AspectJ"),
    ("spring-session-data-redis", SESSION, "Spring Session(Redis)"),
    ("spring-session-jdbc", SESSION, "Spring Session(JDBC)"),
    ("spring-boot-starter-security", FILTER, "Spring Security"),
    ("spring-security-web", FILTER, "Spring Security"),
]
SETTINGS = {"spring.session.store-type": "세션 저장소", "server.servlet.session.timeout": "세션 만료", "spring.aop.proxy-target-class": "AOP 프록시 방식"}
INTERCEPTORS = ["HandlerInterceptor", "HandlerInterceptorAdapter", "AsyncHandlerInterceptor"]
FILTERS = ["Filter", "OncePerRequestFilter", "GenericFilterBean"]

FACT = "struct<kind: string, value: string, evidence: string>"
LONGEST = 200


def _fact(kind: str, value: Column | str, evidence: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(value) if isinstance(value, str) else value).alias("value"), evidence.alias("evidence")).cast(FACT)


def _facts(*cases: tuple[Column, Column]) -> Column:
    """Those facts whose condition holds."""
    return F.array_compact(F.array(*[F.when(when, fact) for when, fact in cases]))


def one_line(text: Column) -> Column:
    """White space collapsed; beyond 200 characters cut, with an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > LONGEST, F.concat(F.left(line, F.lit(LONGEST - 3)), F.lit("..."))).otherwise(line)


def first_evidence(facts: DataFrame, order: list[str]) -> DataFrame:
    """``system, kind, value, evidence``: each fact once, with the evidence that comes first by ``order``, ties by the evidence itself.

    One aggregation that combines before the shuffle, so a system with a third of all rows sends each fact once a task.
    """
    flat = facts.select("system", "kind", one_line(F.col("value")).alias("value"), F.struct(*order, one_line(F.col("evidence")).alias("evidence")).alias("at"))
    return flat.groupBy("system", "kind", "value").agg(F.min("at")["evidence"].alias("evidence"))


def start_tags(files: DataFrame) -> DataFrame:
    """The well-formed start tags of each file outside comments: ``system, path, pos, line, tag, names, values, text, intercepts, aspect``.

    ``line`` counts from 1; ``names`` and ``values`` are those of the attributes in order; ``text`` is what follows up to the next tag or comment;
    ``intercepts`` says whether the tag stands in the interceptors' part, ``aspect`` is the struct of the ``ref`` of the last aspect so far, itself included.
    A comment that is never closed reaches to the end. Windows hold one file, which was one row.
    """
    spans = F.split(F.coalesce("content", F.lit("")), r"(?=<[\w/!:.-])|(?<!<!)(?=-->)", -1)
    pieces = files.select("system", "path", F.posexplode(spans).alias("pos", "piece"))
    file = Window.partitionBy("system", "path").orderBy("pos")
    piece = F.col("piece")
    so_far = lambda case: F.last(case, ignorenulls=True).over(file)
    told = pieces.select(
        "*",
        (F.lit(1) + F.coalesce(F.sum(F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int").alias("line"),
        F.coalesce(so_far(F.when(piece.startswith("<!--"), True).when(piece.startswith("-->"), False)), F.lit(False)).alias("comment"),
    ).where("NOT comment")
    whole = F.regexp_extract("piece", r"""^<[\w:.-]+(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*/?>""", 0)
    attribute = r"""([\w:.-]+)\s*=\s*("[^"]*"|'[^']*')"""
    tags = told.withColumn("whole", whole).select(
        "system", "path", "pos", "line", "piece",
        F.when(F.col("whole") != "", F.regexp_extract("whole", r"^<([\w:.-]+)", 1)).alias("tag"),
        F.regexp_extract_all("whole", F.lit(attribute), F.lit(1)).alias("names"),
        F.transform(F.regexp_extract_all("whole", F.lit(attribute), F.lit(2)), lambda v: F.substring(v, F.lit(2), F.length(v) - 2)).alias("values"),
        F.trim(F.regexp_replace(F.substring("piece", F.length("whole") + 1, F.length("piece")), r"^\s+|\s+$", "")).alias("text"),
    )
    opens, closes = piece.startswith("<mvc:interceptors"), piece.startswith("</mvc:interceptors")
    return tags.select(
        "*",
        F.coalesce(so_far(F.when(opens, True).when(closes, False)), F.lit(False)).alias("intercepts"),
        so_far(F.when(F.col("tag") == "aop:aspect", F.struct(attribute_of("ref").alias("ref")))).alias("aspect"),
    ).where("tag IS NOT NULL").drop("piece")


def attribute_of(name: str) -> Column:
    """The value of an attribute of a start tag; null if it has none."""
    return F.get(F.col("values"), F.array_position("names", F.lit(name)).cast("int") - 1)


def _setting_values(name: Column, lines: Column, key: str) -> Column:
    """The values of a setting: by its whole key in properties, by the last part of its key elsewhere; none that are empty or refer to others."""
    properties = name.endswith(".properties")
    sought = F.when(properties, F.lit(key)).otherwise(F.lit(key.rsplit(".", 1)[-1]))
    found = F.filter(lines, lambda x: x.startswith(F.concat(sought, F.lit(":"))) | (properties & x.startswith(F.concat(sought, F.lit("=")))))
    bare = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.substring(x, F.length(sought) + 2, F.length(x)), r"\s+#.*$", "")), r"^[\"']|[\"']$", "")
    return F.filter(F.transform(found, bare), lambda v: (v != "") & ~v.contains("${"))


def _told_by_files(files: DataFrame) -> DataFrame:
    """Facts that a file tells as a whole, by its name: build files, settings, roots of XML."""
    content, name = F.col("content"), F.col("name")
    named = lambda *parts: F.concat_ws(" ", name, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    parent = F.regexp_extract("content", r"(?s)<parent>.*?<artifactId>\s*spring-boot-starter-parent\s*</artifactId>\s*<version>\s*([^<\s]+)\s*</version>", 1)
    plugin = F.regexp_extract("content", r"""org\.springframework\.boot['"]?\)?\s*version\s*['"]([^'"]+)['"]""", 1)
    version = F.when(name == "pom.xml", parent).otherwise(plugin)
    build = _facts(
        (version != "", _fact(WEB, F.concat(F.lit("Spring Boot "), version), named(F.concat(F.lit("spring-boot "), version)))),
        *[(content.rlike(rf"(?<=[>:'\"])\Q{token}\E(?=[<:'\".])"), _fact(kind, value, named(token))) for token, kind, value in ARTIFACTS],
    )
    lines = F.filter(F.transform(F.split(content, r"\R", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: ~x.startswith("#"))
    uses_mapper = F.exists(lines, lambda x: x.startswith("mybatis.") | x.startswith("mybatis:"))
    told = lambda key, label: lambda v: _fact(SESSION, F.concat(F.lit(f"{label} "), v), named(key))
    settings = [F.transform(_setting_values(name, lines, key), told(key, label)) for key, label in SETTINGS.items()]
    config = F.concat(F.array(_fact(CONFIG, name, F.col("path"))), _facts((uses_mapper, _fact(PERSISTENCE, "MyBatis(Spring Boot)", named("mybatis 설정")))), *settings)
    root = lambda tag: content.contains(f"<{tag}")
    facts = (
        F.when(name.isin("pom.xml", "build.gradle", "build.gradle.kts"), build)
        .when(name == "web.xml", _facts((root("session-config"), _fact(SESSION, "web.xml session-config", named("<session-config>")))))
        .when(name == "struts-config.xml", F.array(_fact(WEB, "Struts 1", F.col("path"))))
        .when(name == "struts.xml", F.array(_fact(WEB, "Struts 2", F.col("path"))))
        .when(name.endswith(".xml") & ~root("beans") & root("sqlMapConfig"), F.array(_fact(PERSISTENCE, "iBatis 2", F.concat("path", F.lit(" <sqlMapConfig>")))))
        .when(name.endswith(".xml") & ~root("beans") & root("configuration") & content.contains("mybatis"), F.array(_fact(PERSISTENCE, "MyBatis", F.concat("path", F.lit(" <configuration>")))))
        .when(name.rlike(r"^(?:application|bootstrap).*\.(?:yml|yaml|properties)$"), config)
    )
    return files.select("system", "path", F.lit(-1).alias("pos"), F.inline(facts))


def _told_by_tags(files: DataFrame) -> DataFrame:
    """Facts that single tags tell, in descriptors of web applications and in files of beans."""
    name, tag, text = F.col("name"), F.col("tag"), F.col("text")
    beans = name.endswith(".xml") & F.col("content").contains("<beans") & ~name.isin("pom.xml", "web.xml", "struts.xml", "struts-config.xml")
    tags = start_tags(files.where((name == "web.xml") | beans)).withColumn("name", last_segment(F.col("path"), "/"))
    shown = F.concat(name, F.lit(" <"), tag, F.lit(">"))
    with_text = F.concat(shown, text)
    dispatches, struts = text.endswith("DispatcherServlet"), text.contains("struts")
    web = F.when(tag.isin("servlet-class", "filter-class", "listener-class") & (text != ""), _facts(
        (tag == "filter-class", _fact(FILTER, last_segment(text), with_text)),
        ((tag != "filter-class") & dispatches, _fact(WEB, "Spring MVC(web.xml DispatcherServlet)", with_text)),
        ((tag != "filter-class") & ~dispatches & struts, _fact(WEB, F.when(text.contains("struts2"), "Struts 2").otherwise("Struts 1"), with_text)),
    ))
    ref, owner = attribute_of("ref"), attribute_of("class")
    maps, ibatis, bean = owner.contains("SqlSessionFactoryBean"), owner.contains("SqlMapClientFactoryBean"), tag == "bean"
    made = F.concat_ws(" ", name, last_segment(owner))
    spring = _facts(
        (tag == "aop:config", _fact(AOP, "XML AOP(<aop:config>)", shown)),
        (tag == "aop:aspectj-autoproxy", _fact(AOP, "어노테이션 AOP(<aop:aspectj-autoproxy>)", shown)),
        (tag == "mvc:annotation-driven", _fact(WEB, "Spring MVC(XML 설정)", shown)),
        ((tag == "aop:aspect") & ref.isNotNull(), _fact(AOP, F.concat(F.lit("XML 애스펙트 "), ref), F.concat(name, F.lit(' <aop:aspect ref="'), ref, F.lit('">')))),
        (bean & maps, _fact(PERSISTENCE, "MyBatis(Spring)", made)),
        (bean & ~maps & ibatis, _fact(PERSISTENCE, "iBatis 2", made)),
        (bean & ~maps & ~ibatis & F.col("intercepts"), _fact(INTERCEPTOR, last_segment(owner), F.concat(name, F.lit(" <mvc:interceptors> "), owner))),
    )
    return tags.select("system", "path", "pos", F.inline(F.when(name == "web.xml", web).otherwise(spring)))


def _told_by_types(types: DataFrame) -> DataFrame:
    """Facts of types: ``system, path, name, full_name, annotations, supers, registered`` (the last three arrays of names, null for none)."""
    name = F.col("name")
    at = F.concat_ws(" ", last_segment(F.col("path"), "/"), name)
    none = F.array().cast("array<string>")
    has = lambda c: F.array_contains(F.coalesce("annotations", none), c)
    extends = lambda bases: F.arrays_overlap(F.coalesce("supers", none), F.array(*[F.lit(b) for b in bases]))
    facts = _facts(
        (has("SpringBootApplication"), _fact(WEB, "Spring Boot", F.concat(at, F.lit(" @SpringBootApplication")))),
        (has("Aspect"), _fact(AOP, F.concat(F.lit("@Aspect "), name), at)),
        (has("EnableAspectJAutoProxy"), _fact(AOP, "어노테이션 AOP(@EnableAspectJAutoProxy)", at)),
        (extends(INTERCEPTORS), _fact(INTERCEPTOR, name, at)),
        (extends(FILTERS), _fact(FILTER, name, at)),
        (extends(["HttpServletRequestWrapper"]), _fact(FILTER, F.concat(F.lit("요청 래퍼 "), name), F.concat(at, F.lit(" — 요청 파라미터를 바꿀 수 있다")))),
    )
    file = last_segment(F.col("path"), "/")
    registered = F.transform(F.coalesce("registered", none), lambda t: _fact(INTERCEPTOR, t, F.concat(file, F.lit(" addInterceptor("), t, F.lit(")"))))
    return types.select("system", "full_name", F.posexplode(F.concat(facts, registered)).alias("pos", "f")).select("system", F.coalesce("full_name", F.lit("")).alias("path"), "pos", "f.*")


def framework_facts(files: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """``system, kind, value, evidence``: what build files, settings, XML and types (see ``_told_by_types``) tell, each fact once for a system.

    ``files`` has ``system, path, content``; the evidence is the first by path and place, types after files, by full name. Values of settings are read for
    three that are no secrets, of the others the names alone. A null system is one of its own; null contents tell no more than their names do; files that
    stand twice tell what they tell once; an empty table tells nothing; other columns are not read.
    """
    named = files.select("system", "path", F.coalesce("content", F.lit("")).alias("content"), last_segment(F.col("path"), "/").alias("name"))
    found = [_told_by_files(named).withColumn("stage", F.lit(0)), _told_by_tags(named.dropDuplicates(["system", "path"])).withColumn("stage", F.lit(0))]
    if types is not None:
        found.append(_told_by_types(types).withColumn("stage", F.lit(1)))
    return first_evidence(reduce(DataFrame.unionByName, found), ["stage", "path", "pos"])


def xml_advices(files: DataFrame) -> DataFrame:
    """``system, path, line, owner, method, pointcut, evidence``: advice that files of XML put before or around calls.

    ``owner`` is the simple name of the class of the aspect's bean, the first by path and place of the beans with its id in the system, or, where there is none, the
    id with a capital first. A pointcut by reference is the last of its id in the same file; advice without method, aspect or pointcut is left out.
    An aspect or pointcut without a name joins nothing.
    """
    once = files.where(F.col("path").endswith(".xml")).select("system", "path", "content").dropDuplicates(["system", "path"])
    same = lambda a, b, *keys: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    at_id = attribute_of("id")
    beans = (
        start_tags(once.where(F.col("content").contains("<bean")))
        .where((F.col("tag") == "bean") & at_id.isNotNull() & attribute_of("class").isNotNull())
        .groupBy("system", at_id.alias("ref")).agg(F.min(F.struct("path", "pos", last_segment(F.trim(attribute_of("class"))).alias("owner")))["owner"].alias("owner"))
    )
    tags = start_tags(once.where(F.col("content").contains("<aop:config")))
    expression = attribute_of("expression")
    pointcuts = (
        tags.where((F.col("tag") == "aop:pointcut") & at_id.isNotNull() & expression.isNotNull())
        .groupBy("system", "path", at_id.alias("pointcut_ref")).agg(F.max(F.struct("pos", expression.alias("e")))["e"].alias("expression"))
    )
    advice = tags.where(F.col("tag").isin("aop:before", "aop:around")).select(
        "system", "path", "line", "tag", F.col("aspect.ref").alias("ref"), attribute_of("method").alias("method"), attribute_of("pointcut").alias("own"), attribute_of("pointcut-ref").alias("pointcut_ref")
    ).where("ref IS NOT NULL AND method IS NOT NULL")
    met = (
        advice.alias("a")
        .join(pointcuts.alias("p"), same("a", "p", "system", "path") & (F.col("a.pointcut_ref") == F.col("p.pointcut_ref")), "left")
        .join(beans.alias("b"), same("a", "b", "system") & (F.col("a.ref") == F.col("b.ref")), "left")
    )
    pointcut = F.coalesce("own", "expression")
    capital = F.concat(F.upper(F.left("a.ref", F.lit(1))), F.substring("a.ref", 2, 1 << 30))
    evidence = F.concat(last_segment(F.col("a.path"), "/"), F.lit(":"), F.col("line").cast("string"), F.lit(" <"), F.col("tag"), F.lit(' method="'), F.col("method"), F.lit('" pointcut="'), pointcut, F.lit('">'))
    return met.where(pointcut.isNotNull()).select("a.system", "a.path", "line", F.coalesce("owner", capital).alias("owner"), "method", pointcut.alias("pointcut"), evidence.alias("evidence"))
