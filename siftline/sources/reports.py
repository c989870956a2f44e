"""Reports, advisories and sources as tables: JSON, archives, folders, rule files."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.severity import severity_of_level
from siftline.functions.text import clean_path, last_segment

POINT = "struct<line:int,col:int>"
REPORT = (
    "version string, results array<struct<check_id:string,path:string,start:" + POINT + ",end:" + POINT + ","
    "extra:struct<message:string,severity:string,metadata:map<string,string>>>>,"
    "errors array<struct<path:string,type:string,message:string>>, paths struct<scanned:array<string>>"
)
ADVISORY = (
    "id string, aliases array<string>, affected array<struct<package:struct<name:string,ecosystem:string>,"
    "ranges:array<struct<events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
)
ITEM = (
    "id string, lastModified string, descriptions array<struct<lang:string,value:string>>, configurations array<struct<nodes:array<struct<cpeMatch:array<struct<"
    "vulnerable:boolean,criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>>>>>"
)


def report_matches(reports: DataFrame, column: str = "value") -> DataFrame:
    """A row for each match of analyzers' JSON reports, in the report's order (``pos``)."""
    parsed = reports.select(F.from_json(column, REPORT).alias("r"))
    return parsed.select(F.posexplode("r.results").alias("pos", "m")).select(
        "pos",
        last_segment(F.col("m.check_id")).alias("rule_id"),
        clean_path(F.col("m.path")).alias("file_path"),
        F.col("m.start.line").alias("start_line"), F.col("m.end.line").alias("end_line"),
        F.coalesce("m.start.col", F.lit(0)).alias("start_col"), F.coalesce("m.end.col", F.lit(0)).alias("end_col"),
        F.col("m.extra.message").alias("message"),
        severity_of_level(F.col("m.extra.severity")).alias("severity"),
        F.try_element_at("m.extra.metadata", F.lit("cwe")).alias("cwe"),
    )


def report_failures(reports: DataFrame, column: str = "value") -> DataFrame:
    """The different files in which the analyzer failed; errors without a file say nothing about one."""
    errors = reports.select(F.explode(F.from_json(column, REPORT)["errors"]).alias("e")).where("e.path IS NOT NULL AND e.path <> ''")
    return errors.select(clean_path(F.col("e.path")).alias("file_path")).distinct()


def report_scanned(reports: DataFrame, column: str = "value") -> DataFrame:
    parsed = reports.select(F.from_json(column, REPORT).alias("r"))
    return parsed.select("r.version", F.coalesce(F.size("r.paths.scanned"), F.lit(0)).alias("n_scanned"))


def advisory_events(spark: SparkSession, path: str, ecosystem: str = "Maven") -> DataFrame:
    """``advisory_id, package, events`` of advisory files, a row for each range of the ecosystem that has events."""
    files = spark.read.schema(ADVISORY).json(path)
    ranges = files.select(F.col("id").alias("advisory_id"), F.explode("affected").alias("a")).where(F.col("a.package.ecosystem") == ecosystem)
    return ranges.select("advisory_id", F.col("a.package.name").alias("package"), F.explode("a.ranges.events").alias("events")).where(F.size("events") > 0)


def item_ranges(items: DataFrame) -> DataFrame:
    """``id, pos`` and the four bounds of each vulnerable match of CVE items, in order; blank bounds are none."""
    nodes = F.flatten(F.transform("configurations", lambda c: F.coalesce(c["nodes"], F.array().cast("array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>>>"))))
    matches = F.filter(F.flatten(F.filter(F.transform(nodes, lambda n: n["cpeMatch"]), lambda m: m.isNotNull())), lambda m: m["vulnerable"])
    each = items.select("id", F.posexplode(matches).alias("pos", "m"))
    bound = lambda name: F.nullif(F.trim(F.col(f"m.{name}")), F.lit(""))
    return each.select(
        "id", "pos", bound("versionStartIncluding").alias("start_incl"), bound("versionStartExcluding").alias("start_excl"),
        bound("versionEndIncluding").alias("end_incl"), bound("versionEndExcluding").alias("end_excl"),
    )


def decoded(data: bytes) -> str:
    """UTF-8, or the legacy Korean code page where that fails."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp949", errors="replace")


# Folders and files that are no source.
IGNORED = (".git", "node_modules", "target", "build", ".idea", "__MACOSX", ".DS_Store")


def archive_files(archives: DataFrame, most_files: int = 20_000, most_bytes: int = 300_000_000) -> DataFrame:
    """``archive, path, text`` of the files in zip archives (``path, content`` as from ``binaryFile``).

    A folder that holds everything is left out of paths. Paths that lead out of the archive, and archives
    with more files or bytes than allowed, give one row with ``error`` in place of files.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows: list[tuple[Any, ...]] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = [i for i in z.infolist() if not i.is_dir()]
                        names = {i: i.filename.replace("\\", "/") for i in infos}
                        if any(n.startswith("/") or ".." in n.split("/") for n in names.values()):
                            raise ValueError("a path leads out of the archive")
                        if len(infos) > most_files or sum(i.file_size for i in infos) > most_bytes:
                            raise ValueError("the archive is too large")
                        kept = [i for i in infos if not set(names[i].split("/")) & set(IGNORED)]
                        roots = {names[i].split("/", 1)[0] if "/" in names[i] else "" for i in kept}
                        strip = f"{next(iter(roots))}/" if len(roots) == 1 and roots != {""} else ""
                        rows = [(name, names[i].removeprefix(strip), decoded(z.read(i)), None) for i in kept]
                except (ValueError, zipfile.BadZipFile) as e:
                    rows = [(name, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "path", "text", "error"])

    return archives.select("path", "content").mapInPandas(unpack, "archive string, path string, text string, error string")


def rule_files(files: DataFrame) -> DataFrame:
    """``rule_id, severity, cwe, trace`` of analyzer rules in YAML (``path, text``); a file without rules gives none, nor does a rule without an id.

    Rule files are configuration: a few hundred lines, parsed where they are read.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                document = yaml.safe_load(text)
                for rule in (document.get("rules") if isinstance(document, dict) else None) or []:
                    if not isinstance(rule, dict) or rule.get("id") is None:
                        continue
                    meta = rule.get("metadata") if isinstance(rule.get("metadata"), dict) else {}
                    cwe = meta.get("cwe")
                    rows.append((str(rule["id"]), rule.get("severity"), cwe[0] if isinstance(cwe, list) and cwe else cwe, meta.get("trace")))
            yield pd.DataFrame(rows, columns=["rule_id", "level", "cwe", "trace"])

    rules = files.select("text").mapInPandas(parse, "rule_id string, level string, cwe string, trace string")
    return rules.select("rule_id", severity_of_level(F.col("level")).alias("severity"), "cwe", "trace")


def rule_set(files: DataFrame) -> DataFrame:
    """The rules of ``rule_files`` with ``version``, 12 hex digits that change with any text (``path, text``, in order of paths).

    No rules at all are an error: a scan without rules would find nothing, and solve all that is known.
    """
    rules = rule_files(files).dropDuplicates(["rule_id"])
    if rules.isEmpty():
        raise ValueError("there are no rules in these files")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))), lambda f: f["text"])
    version = files.agg(F.substring(F.sha2(F.array_join(texts, ""), 256), 1, 12)).head()[0]
    return rules.withColumn("version", F.lit(version))


def rules_version(texts: list[tuple[str, str]]) -> str:
    """Twelve hex digits that change with any rule file (name, text)."""
    whole = hashlib.sha256()
    for name, text in sorted(texts):
        whole.update(f"{name}\0{text}\0".encode())
    return whole.hexdigest()[:12]


# What a mapper statement is, and how it uses values.
STATEMENT = r"(?is)<(select|insert|update|delete|sql|statement|procedure)\b[^>]*?\bid\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</\1\s*>"
USE = r"\$\{\s*([\w.]+)|\$([A-Za-z_][\w.]*)\$"
INCLUDE = r"<include\b[^>]*\brefid\s*=\s*[\"']([^\"']+)[\"']"


def mapper_statements(files: DataFrame) -> DataFrame:
    """``path, id, kind, line, body, uses, includes`` of the statements in SQL mapper files (``path, text``).

    ``uses`` are the names put into the text as they are, ``includes`` the fragments taken in. Comments count as
    nothing, but for their lines.
    """
    n_lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    comments = F.regexp_extract_all("text", F.lit(r"(?s)<!--.*?-->"), F.lit(0))
    between = F.split("text", r"(?s)<!--.*?-->", -1)
    blank = F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.repeat(F.lit("\n"), n_lines(F.get(comments, i))), F.lit(""))))
    bare = files.select("path", F.array_join(blank, "").alias("text"))
    found = bare.select("path", F.regexp_extract_all("text", F.lit(STATEMENT), F.lit(0)).alias("all"), F.split("text", STATEMENT, -1).alias("rest"))
    # What stands before a statement: all statements before it, and what is between these.
    before = lambda column, n: F.aggregate(F.slice(column, F.lit(1), n), F.lit(0), lambda a, x: a + n_lines(x))
    each = found.select("path", "all", "rest", F.posexplode("all").alias("at", "s"))
    names = lambda group: F.filter(F.regexp_extract_all("s", F.lit(USE), F.lit(group)), lambda x: x != "")
    return each.select(
        "path",
        F.regexp_extract("s", STATEMENT, 2).alias("id"),
        F.lower(F.regexp_extract("s", STATEMENT, 1)).alias("kind"),
        (before("all", F.col("at")) + before("rest", F.col("at") + 1) + 1).alias("line"),
        F.regexp_extract("s", STATEMENT, 3).alias("body"),
        F.array_distinct(F.concat(names(1), names(2))).alias("uses"),
        F.regexp_extract_all("s", F.lit(INCLUDE), F.lit(1)).alias("includes"),
    )


# How mapper files name values (put in as text or bound, in either notation), the keywords and tags that tell a condition from a value, and words of OGNL.
USES = r"\$\{[^}]+\}|#\{[^}]+\}"
OLD_USES = r"\$[A-Za-z_][\w.\[\]]*\$|#[A-Za-z_][\w.\[\]]*(?:[:,][^#\n]*)?#"
FIRST_NAME = r"^[$#]\{?\s*([A-Za-z_$][\w$]*)"
CLAUSES, VALUE_CLAUSES = r"\b(WHERE|ON|HAVING|SET|VALUES|UPDATE)\b", ["SET", "VALUES", "UPDATE"]
CONDITION_WORDS = ["WHERE", "AND", "OR"]
OGNL_WORDS = ["and", "or", "not", "null", "true", "false", "eq", "neq", "lt", "gt", "lte", "gte", "in", "instanceof", "new", "_databaseId"]


def _means_condition(tag: Column) -> Column:
    """Whether an open dynamic tag says that what stands in it is part of a condition (true) or a value (false); null if it says nothing."""
    name = F.lower(F.regexp_extract(tag, r"^<\s*([\w.:-]+)", 1))
    attribute = lambda key: F.upper(F.trim(F.regexp_extract(tag, rf"(?s)\b{key}\s*=\s*[\"']([^\"']*)[\"']", 1)))
    prefix = F.when(name == "trim", attribute("prefix")).otherwise("")
    return F.when((name == "where") | (prefix == "WHERE"), True).when((name == "set") | (prefix == "SET"), False).when(attribute("prepend").isin(CONDITION_WORDS), True).when(attribute("prepend") == "SET", False)


def mapper_uses(files: DataFrame) -> DataFrame:
    """``path, id, kind, pos, name, how, condition``: each value that a statement of a mapper file (``path, text``) uses, by its first name.

    ``how`` is TEXT if it is put in as it is (``${}``, in the old notation ``$x$``) or BOUND (``#{}``, ``#x#``); the old notation counts in files with a ``sqlMap`` alone. ``condition`` tells whether it
    stands in a condition: by the innermost open tag that says so, else by the last keyword of the SQL before it, comments left out; without either only an insert's is a value.
    """
    old = files.select("path", F.when(F.col("text").contains("<sqlMap"), F.lit(OLD_USES)).otherwise(F.lit(USES)).alias("notation"))
    each = mapper_statements(files).select("path", "id", "kind", "body").join(old, "path")
    taken = each.select("path", "id", "kind", F.regexp_extract_all("body", F.col("notation"), F.lit(0)).alias("all"), F.split("body", F.col("notation"), -1).alias("rest"))
    placed = taken.select("path", "id", "kind", "rest", F.posexplode("all").alias("pos", "token")).withColumn("before", F.array_join(F.slice("rest", F.lit(1), F.col("pos") + 1), " "))
    tags = F.regexp_extract_all("before", F.lit(r"<[^>]*>"), F.lit(0))
    open_tags = F.aggregate(
        tags, F.array().cast("array<string>"),
        lambda held, tag: F.when(tag.startswith("</"), F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(tag.endswith("/>"), held).otherwise(F.array_append(held, tag)),
    )
    by_tag = F.get(F.filter(F.transform(F.reverse(open_tags), _means_condition), lambda m: m.isNotNull()), 0)
    sql = F.regexp_replace(F.regexp_replace("before", r"<[^>]*>", " "), r"(?s)--[^\n]*|/\*.*?\*/", " ")
    last = F.try_element_at(F.regexp_extract_all(F.upper(sql), F.lit(CLAUSES), F.lit(1)), F.lit(-1))
    by_keyword = F.when(last.isNotNull(), ~last.isin(VALUE_CLAUSES))
    return placed.select(
        "path", "id", "kind", "pos", F.regexp_extract("token", FIRST_NAME, 1).alias("name"), F.when(F.col("token").startswith("$"), "TEXT").otherwise("BOUND").alias("how"),
        F.coalesce(by_tag, by_keyword, F.col("kind") != "insert").alias("condition"),
    )


def ognl_names(expression: Column) -> Column:
    """The names in a condition of a dynamic tag, in order, each once: no strings, words of the language, members after a dot, or calls."""
    bare = F.regexp_replace(expression, r"'[^']*'|\"[^\"]*\"", " ")
    names = F.regexp_extract_all(bare, F.lit(r"(?<![\w.$@])([A-Za-z_$][\w$]*+)(?!\s*\()"), F.lit(1))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin(OGNL_WORDS)))


def unescaped(value: Column) -> Column:
    """The five entities of XML resolved, the ampersand last."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(sign))
    return value
