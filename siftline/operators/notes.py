"""Release notes from ranked sources: a source is asked only for what no better one has a document for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.releases import lines_between, relevant
from siftline.sources.state import Rounds, dealt

# How repositories are named in addresses.
GITHUB = r"github\.com[:/]+([\w.-]+)/([\w.-]+?)(?:\.git)?(?:[/#?]|$)"
GITLAB = r"gitlab\.com[:/]+([\w./-]+?)(?:\.git)?(?:[#?]|$)"
COLUMNS = ["coordinate", "source", "kind", "url", "title", "text"]


def repository(address: Column) -> tuple[Column, Column]:
    """The host (GITHUB or GITLAB) and the path of the repository that an address names; null for others, and for an address with an open placeholder."""
    plain = F.when(~address.contains("${"), address)
    owner, name, path = F.regexp_extract(plain, GITHUB, 1), F.regexp_extract(plain, GITHUB, 2), F.regexp_extract(plain, GITLAB, 1)
    host = F.when(owner != "", "GITHUB").when(path != "", "GITLAB")
    return host, F.when(owner != "", F.concat(owner, F.lit("/"), name)).when(path != "", path)


def rule_documents(wanted: DataFrame, rules: DataFrame, documents: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """The documents that rules name for the version lines on the way.

    ``wanted``: ``coordinate, start, end`` (arrays of numbers); ``rules``: ``prefix, pos, kind, url, title, by_section``, the last three with ``{line}`` for a version line; ``documents``: ``url, text``. A rule
    ``by_section`` takes of its document only the ``sections`` (``url, pos, heading, text``) whose heading names a version on the way, and nothing if there is none. Rules are joined by each beginning of the coordinate that is as long as some
    rule's, a rule and a coordinate once, whatever the number of either. What is wanted by the same rules on the same way is looked up once; neither the beginnings nor the coordinates, which no estimate counts, are ever broadcast.
    """
    rounds = Rounds(wanted.sparkSession, "rule_documents")
    lengths = rules.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    begins = F.transform(F.filter(F.sequence(F.lit(1), F.length("coordinate")), lambda i: F.array_contains("lengths", i)), lambda i: F.substring("coordinate", F.lit(1), i))
    begun = wanted.select("coordinate", "start", "end").crossJoin(F.broadcast(lengths)).select("coordinate", "start", "end", F.explode(begins).alias("prefix"))
    met = begun.join(rules.select("prefix").distinct().hint("shuffle_hash"), "prefix")
    ruled = rounds.keep(dealt(met, "coordinate").groupBy("coordinate", "start", "end").agg(F.sort_array(F.collect_set("prefix")).alias("prefixes")))
    way = ["prefixes", "start", "end"]
    line = ruled.select(*way).distinct().withColumn("prefix", F.explode("prefixes")).hint("merge").join(rules, "prefix").withColumn("line", F.explode(lines_between(F.col("start"), F.col("end"))))
    filled = lambda c: F.replace(F.col(c), F.lit("{line}"), F.col("line")).alias(c)
    asked = line.select(*way, "kind", filled("url"), filled("title"), F.coalesce("by_section", F.lit(False)).alias("by_section")).distinct()
    whole = asked.where("NOT by_section").hint("merge").join(documents.where("trim(text) <> ''"), "url")
    found = whole.select(*way, "kind", "url", "title", "text")
    if sections is not None:
        cut = asked.where("by_section").hint("merge").join(sections, "url").where(relevant(F.col("heading"), F.col("start"), F.col("end")))
        parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
        joined = cut.groupBy(*way, "kind", "url", "title").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
        found = found.unionByName(joined)
    return ruled.join(found.hint("shuffle_hash"), way).select("coordinate", F.lit("RULE").alias("source"), "kind", "url", "title", "text")


def repository_releases(wanted: DataFrame, releases: DataFrame, host: str) -> DataFrame:
    """The releases on the way of the repositories that ``wanted`` (with ``scm``) are in; ``releases``: ``host, path, name, url, text``. Each way of a repository is looked up once."""
    at, path = repository(F.col("scm"))
    placed = wanted.select("coordinate", "start", "end", path.alias("path"), at.alias("host")).where(F.col("host") == host).drop("host")
    way = ["path", "start", "end"]
    met = placed.select(*way).distinct().hint("merge").join(releases.where(F.col("host") == host).drop("host"), "path").where(relevant(F.col("name"), F.col("start"), F.col("end")))
    return placed.join(met.hint("shuffle_hash"), way).select("coordinate", F.lit(host).alias("source"), F.lit("RELEASE_NOTES").alias("kind"), "url", F.col("name").alias("title"), "text")


def first_with_documents(wanted: DataFrame, sources: list[Callable[[DataFrame], DataFrame]], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All documents of the first source that has any for each of ``wanted`` (by ``coordinate``); a further source sees only what is still without, which is
    written. ``keep`` may write what a source has found; else it is found twice, for what it has and for what is left."""
    rounds, found = Rounds(wanted.sparkSession, "first_with_documents"), []
    for source in sources:
        if found:
            wanted = rounds.keep(wanted.join(found[-1].select("coordinate").distinct(), "coordinate", "left_anti"))
        found.append(keep(source(wanted).select(*COLUMNS)))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole
