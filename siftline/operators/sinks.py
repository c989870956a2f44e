"""Sinks and guards: the verdict on what reaches a call, and devices that read a credential and block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.severity import verdict_rank
from siftline.operators.findings import worst_of
from siftline.operators.tracing import jumps
from siftline.operators.trees import closure
from siftline.sources.state import Rounds

# An address whose host is fixed; calls that read a credential; what blocks; what ends a filter; where guards are entered.
FIXED_HOST = r"^https?://[^/\s]+/.*$"
READS = r"\b(getSession|getAttribute|getHeader|getCookies|getUserPrincipal|getRemoteUser|getAuthType)\s*\("
BLOCKS = r"\breturn\s+false\b|\bsendRedirect\s*\(|\bsendError\s*\(|\bsetStatus\s*\(|\bthrow\s+new\b|\.forward\s*\("
FILTER_RETURN = r"\breturn\s*;"
ENTRIES = {"INTERCEPTOR": ["preHandle"], "FILTER": ["doFilter", "doFilterInternal"]}
COMMENT = r"^\s*(//|\*|/\*)"


def constant_prefixes(operands: DataFrame) -> DataFrame:
    """``node, prefix``: what a concatenation of two operands or more begins with for certain: its ``constant`` operands (``node, pos, constant``) up to the first that is none."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "constant")))
    gathered = operands.groupBy("node").agg(parts.alias("parts")).where(F.size("parts") > 1)
    begun = F.struct(F.lit("").alias("text"), F.lit(True).alias("on"))
    step = lambda acc, p: F.struct(F.when(acc["on"] & p["constant"].isNotNull(), F.concat(acc["text"], p["constant"])).otherwise(acc["text"]).alias("text"), (acc["on"] & p["constant"].isNotNull()).alias("on"))
    return gathered.select("node", F.aggregate("parts", begun, step, lambda acc: acc["text"]).alias("prefix"))


def sink_verdicts(sinks: DataFrame, arguments: DataFrame, operands: DataFrame, values: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """``finding, verdict, evidence``: the worst of the values that a finding's sink looks at, the first of equally bad ones; findings without such a value are not there.

    ``sinks``: ``finding, target`` (VALUE: the expression, FIRST_ARGUMENT, ARGUMENTS) and ``fixed_host``; ``arguments``: ``finding, pos, node``, the expression at 0 and its arguments from 1;
    ``values``: ``node, verdict, evidence``, UNKNOWN if there is none. Where a sink minds fixed hosts, an address that begins with a constant one is SERVER_SET, whatever comes after it. ``same``
    (``dst, src``) has variables that are set once, which are followed to what they are set to.
    """
    looked_at = F.col("target").eqNullSafe("VALUE") & (F.col("pos") == 0) | F.col("target").eqNullSafe("FIRST_ARGUMENT") & (F.col("pos") == 1) | F.col("target").eqNullSafe("ARGUMENTS") & (F.col("pos") > 0)
    chosen = sinks.join(arguments, "finding").where(looked_at)
    hosts = constant_prefixes(operands).where(F.col("prefix").rlike(FIXED_HOST))
    if same is not None:
        chains = jumps(same.distinct(), operands.select("node").distinct(), Rounds(sinks.sparkSession, "sinks"))
        hosts = hosts.union(chains.select("node", F.col("to").alias("of")).join(hosts.withColumnRenamed("node", "of"), "of").select("node", "prefix"))
    met = chosen.join(hosts, "node", "left").join(values.withColumnsRenamed({"verdict": "known", "evidence": "why"}), "node", "left")
    fixed = F.coalesce("fixed_host", F.lit(False)) & F.col("prefix").isNotNull()
    told = met.select(
        "finding", "pos", F.when(fixed, "SERVER_SET").when(verdict_rank(F.col("known")).isNull(), "UNKNOWN").otherwise(F.col("known")).alias("verdict"),
        F.when(fixed, F.concat(F.lit("fixed host: "), F.col("prefix"))).otherwise(F.col("why")).alias("evidence"),
    )
    return worst_of(told, ["finding"], "verdict", "pos", "evidence")


def guard_candidates(hooks: DataFrame, methods: DataFrame, calls: DataFrame, lines: DataFrame, depth: int | None = 1) -> DataFrame:
    """``owner, kind, reads, blocks``: registered devices whose entry, or what that calls in its own class, both reads a credential and blocks, with the line for each.

    ``hooks``: ``owner, kind`` (INTERCEPTOR or FILTER); ``methods``: ``method, owner, name``; ``calls``: ``caller, callee``; ``lines``: ``method, pos, text``. Calls are followed ``depth`` deep, or with None as far as they go;
    circles end. The line is the first in the nearest method; comments do not count. A filter that has nothing else that blocks may return.
    """
    entry = F.when(F.col("kind") == "INTERCEPTOR", F.col("name").isin(ENTRIES["INTERCEPTOR"])).otherwise(F.col("name").isin(ENTRIES["FILTER"]))
    entries = hooks.distinct().join(methods, "owner").where(entry).select("owner", "kind", "method")
    inside = methods.select(F.col("method").alias("caller"), "owner").join(calls, "caller").join(methods.select(F.col("method").alias("callee"), "owner"), ["callee", "owner"])
    reached = closure(inside.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct(), entries.select(F.col("method").alias("start")).distinct(), most=depth)
    bodies = entries.withColumnRenamed("method", "start").join(reached, "start").select("owner", "kind", F.col("node").alias("method"), "depth")
    code = bodies.join(lines.where(~F.col("text").rlike(COMMENT)), "method")
    at = F.struct("depth", "method", "pos")
    text = F.col("text")
    first = lambda hit: F.min_by(F.when(hit, F.trim(text)), F.when(hit, at))
    found = code.groupBy("owner", "kind").agg(first(text.rlike(READS)).alias("reads"), first(text.rlike(BLOCKS)).alias("stops"), first(text.rlike(FILTER_RETURN) & (F.col("kind") == "FILTER")).alias("returns"))
    return found.select("owner", "kind", "reads", F.coalesce("stops", "returns").alias("blocks")).where("reads IS NOT NULL AND blocks IS NOT NULL")
