"""What reviewers and summaries are given, and what is taken from them: input hashes, slices, checks, rule overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shape of a coordinate, ways of a change, and how a mapper puts a value into SQL.
COORDINATE = r"^[^:\s]+:[^:\s]+$"
CHANGE_VIA = ("PARENT", "BOM", "PROPERTY", "DIRECT")
MAPPER_EXPRESSION = r"[$#]\{[^}]*}|\$[A-Za-z_][\w.\[\]]*\$|#[A-Za-z_][\w.\[\]]*(?:[:,][^#\s]*)?#"


def input_hash(rule: Column, path: Column, masked_code: Column, label: Column, evidence: Column, related: Column) -> Column:
    """SHA-256, in hex, of what a review is of, parts separated by a zero; line numbers are no part, related code only where there is any.

    Nulls count as empty, so that a finding without code or evidence has a hash too.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    more = F.when(text(related) != "", F.concat(F.lit("\0"), related)).otherwise(F.lit(""))
    return F.sha2(F.concat(F.concat_ws("\0", text(rule), text(path), text(masked_code), text(label), text(evidence)), more), 256)


def origin_members(findings: DataFrame, group: str, order: str, around: int = 8, with_code: int = 5) -> DataFrame:
    """``findings`` (``code, code_start, start_line``) with ``slice``, the lines about the hit, and ``slice_start``, its first line.

    Only the first ``with_code`` of a group have a slice; the others, and those whose hit lies outside of their code, have null
    and the line of the hit, as have rows without a group. The first of each group are found by a rank limit, which drops rows
    before the shuffle; rows that share ``order`` in a group stay as they are, each with its slice if one of them is among the first.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    first = findings.select(group, order).withColumn("place", place).where(F.col("place") <= with_code).drop("place").distinct().withColumn("__slice", F.lit(True))
    lines = F.split("code", "\n", -1)
    hit = F.col("start_line") - F.col("code_start")
    begin = F.greatest(F.lit(0), hit - around)
    end = F.least(F.size(lines), hit + around + 1)
    told = F.coalesce(F.col("__slice") & F.col("code").isNotNull() & (begin < end), F.lit(False))
    return findings.join(first, [group, order], "left").select(
        *findings.columns,
        F.when(told, F.array_join(F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0))), "\n")).alias("slice"),
        F.when(told, F.col("code_start") + begin).otherwise(F.col("start_line")).cast("int").alias("slice_start"),
    )


def valid_change(coordinate: Column, before: Column, after: Column, via: Column) -> Column:
    """Whether a proposed change names group and artifact, both versions, and one of the known ways; never null."""
    named = F.trim(coordinate).rlike(COORDINATE) & (F.trim(before) != "") & (F.trim(after) != "")
    return F.coalesce(named & via.isin(*CHANGE_VIA), F.lit(False))


def change_counts(changes: DataFrame, plan: str) -> DataFrame:
    """``kept`` and ``dropped`` changes (``coordinate, before, after, via``) of each plan."""
    good = valid_change(F.col("coordinate"), F.col("before"), F.col("after"), F.col("via"))
    return changes.groupBy(plan).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


def refusal(known: Column, text: Column, digest: Column, most: int = 1000) -> Column:
    """Why a summary is refused: UNKNOWN, EMPTY, TOO_LONG or NO_HASH, the first that holds; null if it is taken."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return (
        F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN")
        .when(bare == "", "EMPTY")
        .when(F.length(bare) > most, "TOO_LONG")
        .when(F.trim(F.coalesce(digest, F.lit(""))) == "", "NO_HASH")
    )


def trace_target(evidence: Column) -> Column:
    """The value that a mapper puts into SQL, from the last line of evidence; null without one."""
    last = F.element_at(F.split(evidence, "\n", -1), -1)
    return F.nullif(F.regexp_extract(last, MAPPER_EXPRESSION, 0), F.lit(""))


def line_starts_first(sections: DataFrame, doc: str, pos: str, starts: Column) -> DataFrame:
    """``place`` of each section from 1: those that begin a release line first, else in the order of the document."""
    by_doc = Window.partitionBy(doc).orderBy(F.coalesce(starts, F.lit(False)).desc(), pos)
    return sections.withColumn("place", F.row_number().over(by_doc))


def overlaid(common: DataFrame, own: DataFrame, system: str, kind: str, values: str) -> DataFrame:
    """Each system's rule values of a kind, the common ones and its own, sorted, for the systems that have any of their own.

    ``common``: ``kind, values``; ``own``: ``system, kind, values``, with one row of a kind at most for a system. Kinds are rule
    files' keys, a few names, so that those of ``common`` are put into the plan.
    """
    kinds = sorted(r[0] for r in common.select(kind).distinct().collect())
    given = own.select(system).distinct().withColumn(kind, F.explode(F.array(*[F.lit(k) for k in kinds]).cast("array<string>")))
    both = given.unionByName(own.select(system, kind)).distinct()
    shared = common.select(kind, F.col(values).alias("__common"))
    joined = both.join(own, [system, kind], "left").join(shared, kind, "left")
    empty = F.array().cast("array<string>")
    whole = F.array_union(F.coalesce("__common", empty), F.coalesce(values, empty))
    return joined.select(system, kind, F.array_sort(whole).alias(values))


def changed_values(values: Column, added: Column, removed: Column) -> Column:
    """A rule's values after an edit: what is removed goes even if it is added too."""
    return F.array_sort(F.array_except(F.array_union(values, added), removed))
