"""Operators over static-analysis findings: fingerprints, merges, verdicts, reconciliation.

Columns, where not given otherwise: ``fingerprint, rule_id, cwe, severity, file_path, start_line, end_line,
start_col, end_col, message, trace_safety``, and ``pos`` for the order of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.severity import SEVERITIES, severity_rank, verdict_name, verdict_rank
from siftline.functions.text import digest, joined_remark, truncated
from siftline.operators.advisories import joined_back
from siftline.operators.keyed import first_by_key, numbered, placed

OPEN, RESOLVED = "OPEN", "RESOLVED"


def fingerprinted(matches: DataFrame, keys: list[str], order: Column, block: Column | None = None) -> DataFrame:
    """Adds ``occurrence``, which of its equals a row is from 0, and ``fingerprint`` of keys and occurrence.

    With a ``block`` that does not fall along the order, equals may be any share of the rows: see ``keyed.placed``, whose blocks come from the highest down.
    """
    if block is None:
        counted = numbered(matches, keys, order, name="occurrence")
    else:
        # Rows are dealt by a digest of their keys, which may be long.
        told = matches.withColumn("__same", equal_key(*keys))
        counted = placed(told, ["__same"], [order], -block, name="occurrence").withColumn("occurrence", (F.col("occurrence") - 1).cast("int")).drop("__same")
    return counted.withColumn("fingerprint", digest(*[F.col(k) for k in keys], F.col("occurrence")))


def equal_key(*keys: str) -> Column:
    """128 bits that rows with equal keys share; null is a value of its own."""
    told = [F.when(F.col(k).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string"))) for k in keys]
    return F.unhex(F.md5(F.concat(*told).cast("binary")))


def without_nested(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that lie in no other of the same rule and file, and for the others which rule covers them.

    Of equal ranges the first by ``pos`` stays; findings without a column neither cover nor lie. The
    join is by rule and file, and by blocks of ``BLOCK`` lines that a range spans, so that a file
    with many findings is not compared with itself as a whole.
    """
    placed = findings.where("start_col > 0")
    begin, end = F.struct("start_line", "start_col"), F.struct("end_line", "end_col")
    block = lambda c: F.floor(F.col(c) / BLOCK)
    outer = placed.select(
        F.col("rule_id").alias("o_rule"), F.col("file_path").alias("o_file"), begin.alias("o_begin"), end.alias("o_end"), F.col("pos").alias("o_pos"),
        F.explode(F.sequence(block("start_line"), F.greatest(block("start_line"), block("end_line")))).alias("o_block"),
    )
    inner = placed.select("fingerprint", "pos", "rule_id", "file_path", begin.alias("begin"), end.alias("end"), block("start_line").alias("block"))
    same = (F.col("o_begin") == F.col("begin")) & (F.col("o_end") == F.col("end"))
    inside = (F.col("o_begin") <= F.col("begin")) & (F.col("end") <= F.col("o_end"))
    covered = inner.join(
        outer,
        (F.col("o_rule") == F.col("rule_id")) & (F.col("o_file") == F.col("file_path")) & (F.col("o_block") == F.col("block"))
        & (F.col("o_pos") != F.col("pos")) & inside & (~same | (F.col("o_pos") < F.col("pos"))),
        "left_semi",
    )
    away = covered.select("pos", "fingerprint", F.col("rule_id").alias("kept_rule"))
    return findings.join(away.select("pos"), "pos", "left_anti"), away.select("fingerprint", "kept_rule")


BLOCK = 256


def without_same_cwe(findings: DataFrame, traceable: Column) -> tuple[DataFrame, DataFrame]:
    """Findings of different rules on a line with the same CWE made one, and which rule took the others.

    The rule that stays is a traceable one if there is any, then the least id. It gets the highest severity of
    the line, unless it has a verdict of its own, and a note of the others.
    """
    # The note's words.
    note, note_end = " (같은 줄·같은 CWE로 함께 탐지된 규칙 ", "을 한 건으로 합침)"
    cwe = F.nullif(F.trim("cwe"), F.lit(""))
    # A line's findings come together once, and all that is asked of them is asked there.
    line = Window.partitionBy("file_path", "start_line", "__cwe")
    marked = findings.withColumn("__cwe", cwe).withColumn("__order", F.struct((~traceable).alias("late"), F.col("rule_id").alias("rule")))
    asked = {"__orders": F.collect_set("__order").over(line), "__first": F.min("__order").over(line), "__rank": F.min(severity_rank(F.col("severity"))).over(line)}
    joined = marked.withColumns(asked).withColumn("__kept", F.when(F.col("__cwe").isNotNull() & (F.size("__orders") > 1), F.col("__first.rule")))
    others = F.array_join(F.transform(F.filter(F.array_sort("__orders"), lambda o: o["rule"] != F.col("__kept")), lambda o: o["rule"]), ", ")
    merged = F.col("__kept").isNotNull()
    highest = F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("__rank"))
    stays = joined.where(~merged | (F.col("rule_id") == F.col("__kept")))
    kept = stays.withColumns(
        {
            "severity": F.when(merged & F.col("trace_safety").isNull(), F.coalesce(highest, F.col("severity"))).otherwise(F.col("severity")),
            "message": F.when(merged, truncated(F.col("message"), 1000, F.concat(F.lit(note), others, F.lit(note_end)))).otherwise(F.col("message")),
        }
    )
    away = joined.where(merged & (F.col("rule_id") != F.col("__kept"))).select("fingerprint", F.col("__kept").alias("kept_rule"))
    return kept.select(*findings.columns), away


def worst_of(df: DataFrame, keys: list[str], verdict: str, order: str, evidence: str) -> DataFrame:
    """The worst verdict of each key, with the evidence of the first row that has it."""
    rank = verdict_rank(F.col(verdict))
    best = F.max(F.struct(rank.alias("rank"), (-F.col(order)).alias("first"), F.col(evidence).alias("evidence")))
    return df.groupBy(*keys).agg(best.alias("w")).select(*keys, verdict_name(F.col("w.rank")).alias(verdict), F.col("w.evidence").alias(evidence))


def confusion(predicted: DataFrame, truth: DataFrame, key: str, flagged: Column, real: Column) -> DataFrame:
    """One row: true and false positives and negatives, and how many of the answer key have no verdict."""
    joined = truth.join(predicted, key, "left")
    count = lambda c: F.count_if(c)
    return joined.agg(
        count(flagged & real).alias("tp"), count(flagged & ~real).alias("fp"), count(~flagged & real).alias("fn"),
        count(~flagged & ~real).alias("tn"), count(flagged.isNull()).alias("unknown"),
    )


def same_origin_key(app: Column, cwe: Column, evidence: Column) -> Column:
    """Findings with the same key come from the same place; null, so alone, without evidence."""
    first = F.nullif(F.trim(F.split(evidence, "\n")[0]), F.lit(""))
    return F.concat(app.cast("string"), F.lit("|"), F.coalesce(cwe, F.lit("")), F.lit("|"), first)


def reconciled(existing: DataFrame, detected: DataFrame, failed_files: DataFrame, active_rules: DataFrame, merged_away: DataFrame, now: Column) -> DataFrame:
    """The state after a scan, a row for each fingerprint of either side.

    ``existing``: ``fingerprint, rule_id, file_path, severity, status, status_manual, remark, first_at, last_at,
    resolved_at``; ``detected``: ``fingerprint, rule_id, file_path, severity, pos``; ``failed_files``:
    ``file_path``; ``active_rules``: ``rule_id``; ``merged_away``: ``fingerprint, kept_rule``. Adds ``action``:
    INSERTED, REFRESHED, REOPENED, RESOLVED, MERGED or KEPT; all but KEPT are to be written. INSERTED and
    REOPENED are new to the open ones, RESOLVED and no MERGED count as solved.
    """
    # The remark on a finding that another took, around the other's rule.
    remark, remark_end = "같은 위치의 ", " 탐지와 한 건으로 합침"
    first = first_by_key(detected, ["fingerprint"], F.col("pos"))
    d = first.select("fingerprint", *[F.col(c).alias(f"d_{c}") for c in ("rule_id", "file_path", "severity")], F.lit(True).alias("found"))
    away = first_by_key(merged_away, ["fingerprint"], F.col("kept_rule"))
    joined = (
        existing.withColumn("known", F.lit(True))
        .join(d, "fingerprint", "full")
        .join(away, "fingerprint", "left")
        .join(failed_files.select("file_path").distinct().withColumn("failed", F.lit(True)), "file_path", "left")
        .join(active_rules.select("rule_id").distinct().withColumn("active", F.lit(True)), "rule_id", "left")
    )
    manual = F.coalesce("status_manual", F.lit(False))
    solvable = (F.col("status") == OPEN) & ~manual
    found, known = F.col("found").isNotNull(), F.col("known").isNotNull()
    action = (
        F.when(found & ~known, "INSERTED")
        .when(found & (F.col("status") == RESOLVED) & ~manual, "REOPENED")
        .when(found, "REFRESHED")
        .when(F.col("kept_rule").isNotNull(), F.when(solvable, "MERGED").otherwise("KEPT"))
        .when(F.col("failed").isNotNull() | F.col("active").isNull(), "KEPT")
        .when(solvable, "RESOLVED")
        .otherwise("KEPT")
    )
    done = joined.withColumn("action", action)
    opened, closed = F.col("action").isin("INSERTED", "REOPENED"), F.col("action").isin("RESOLVED", "MERGED")
    seen = F.col("found").isNotNull()
    taken = F.concat(F.lit(remark), F.col("kept_rule"), F.lit(remark_end))
    return done.select(
        "fingerprint",
        *[F.when(seen, F.col(f"d_{c}")).otherwise(F.col(c)).alias(c) for c in ("rule_id", "file_path", "severity")],
        F.when(opened, OPEN).when(closed, RESOLVED).otherwise(F.col("status")).alias("status"),
        manual.alias("status_manual"),
        F.when(F.col("action") == "MERGED", joined_remark(F.col("remark"), taken)).otherwise(F.col("remark")).alias("remark"),
        F.when(F.col("action") == "INSERTED", now).otherwise(F.col("first_at")).alias("first_at"),
        F.when(seen, now).otherwise(F.col("last_at")).alias("last_at"),
        F.when(closed, now).when(opened, None).otherwise(F.col("resolved_at")).alias("resolved_at"),
        "action",
    )


def retired(findings: DataFrame, retired_rules: DataFrame, now: Column) -> DataFrame:
    """Open findings of retired rules (``rule_id``, ``reason``) solved with the reason; doing it again changes nothing."""
    joined = findings.join(retired_rules.select("rule_id", "reason"), "rule_id", "left")
    hit = F.col("reason").isNotNull() & (F.col("status") == OPEN) & ~F.coalesce("status_manual", F.lit(False))
    changed = {
        "status": F.when(hit, RESOLVED).otherwise(F.col("status")),
        "remark": F.when(hit, joined_remark(F.col("remark"), F.col("reason"))).otherwise(F.col("remark")),
        "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in findings.columns])


#: The blocks of 2, 4, 8 ... lines that tile a range, by the power and the number of the block: two of a power at most.
TILES = """
    flatten(transform(sequence(0, cast(log2(last - first + 1) AS int) + 1), p -> transform(
        array(struct(p AS power, -shiftright(-first, p) AS lo, shiftright(last + 1, p) - 1 AS hi)),
        t -> array(if(t.lo <= t.hi AND t.lo & 1 = 1, struct(t.power AS power, t.lo AS block), null), if(t.lo <= t.hi AND t.hi & 1 = 0, struct(t.power AS power, t.hi AS block), null))
    )))
"""


def smallest_enclosing(points: DataFrame, ranges: DataFrame, file: str, line: str) -> DataFrame:
    """``points`` with ``range_id`` of the shortest range of the file that holds the line; null without one.

    ``ranges``: ``file, first, last, range_id``. A range goes to the blocks of 1, 2, 4 ... lines that tile it, at most two of each size, and of a block's ranges only the shortest
    stays. A line is in one block of each size, so that points and ranges never meet one by one. Each different point is looked up once; repeated rows stay repeated.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    # Of equal ranges one stays, so that size and beginning name a range; as one number they are compared without sorting rows.
    spans = ranges.where("first <= last").groupBy(F.col("file").alias("r_file"), long("first"), long("last")).agg(F.min("range_id").alias("range_id"))
    order = (F.shiftleft(F.col("last") - F.col("first"), 32) + F.col("first")).alias("order")
    tiles = spans.select("r_file", "range_id", order, F.explode(F.flatten(F.expr(TILES))).alias("t")).where("t IS NOT NULL").select("r_file", "range_id", "order", "t.power", F.col("t.block").alias("r_block"))
    shortest = tiles.groupBy("r_file", "power", "r_block").agg(F.min_by("range_id", "order").alias("range_id"), F.min("order").alias("order"))
    powers = ranges.where("first <= last").agg(F.max(F.col("last").cast("long") - F.col("first").cast("long") + 1).alias("longest"))
    known = points.select(F.col(file).alias("p_file"), F.col(line).alias("p_line")).distinct().crossJoin(F.broadcast(powers)).where("longest IS NOT NULL")
    asked = known.select("p_file", "p_line", F.explode(F.expr("sequence(0, cast(log2(longest) AS int) + 1)")).alias("p_power"))
    within = asked.select("p_file", "p_line", "p_power", F.expr("shiftright(cast(p_line AS bigint), p_power)").alias("p_block"))
    holds = (F.col("r_file") == F.col("p_file")) & (F.col("power") == F.col("p_power")) & (F.col("r_block") == F.col("p_block"))
    best = within.join(shortest, holds).groupBy("p_file", "p_line").agg(F.min_by("range_id", "order").alias("range_id"))
    return joined_back(points, best.withColumnsRenamed({"p_file": file, "p_line": line}), [file, line])


def resolved_names(uses: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """A short name's full one, where exactly one definition ends with it after a dot or is it; else null."""
    parts = F.split("full", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    by_end = definitions.select("full", F.explode(ends).alias(name)).groupBy(name).agg(F.count_distinct("full").alias("n"), F.min("full").alias("full"))
    return uses.join(by_end.where("n = 1").drop("n"), name, "left")


def best_ranked(candidates: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """Of each key all candidates of the best (least) priority."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(priority))
    return candidates.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
