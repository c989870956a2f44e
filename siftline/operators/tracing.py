"""Value origins from facts: where a value comes from, and how bad that is, as a fixpoint over edges.

The facts are tables that an extractor makes from code: ``flows`` (``dst, src``: a value that another may
take, through assignments, arguments, returns and operators) and ``origins`` (``node, verdict, evidence``:
what literals, sessions, parameters of handlers and the like are by themselves). A value is as bad as the worst that
flows into it; ranks only grow, so rounds end when no rank does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.severity import VERDICTS, verdict_name, verdict_rank
from siftline.functions.text import ant_regex, servlet_regex
from siftline.sources.state import Rounds, written


#: Tables of rounds that are read together before they become one.
PARTS = 8


def jumps(flows: DataFrame, origins: DataFrame, rounds: Rounds) -> DataFrame:
    """``node, src, to, far``: for values with one source alone and no origin, where the chain of such values begins, and how far that is.

    Chains are followed by doubling, so there are as many rounds as the longest has binary digits. What runs in a circle is left out: when a round ends no chain,
    none is left that ends.
    """
    one = flows.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n = 1")
    every = [rounds.keep(one.join(origins.select("node"), "node", "left_anti").select("node", "src", F.col("src").alias("to"), F.lit(1).alias("far"), F.lit(True).alias("open")))]
    kept, before = [*every], -1
    while True:
        known = reduce(DataFrame.unionByName, every)
        on = known.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("open").alias("still"))
        step = every[-1].where("open").join(on, "to", "left")
        last = rounds.keep(step.select("node", "src", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.coalesce("still", F.lit(False)).alias("open")))
        left = last.where("open").count()
        every[-1] = every[-1].where("NOT open")
        every.append(last)
        kept.append(last)
        if left in (0, before):
            whole = rounds.keep(reduce(DataFrame.unionByName, [p.where("NOT open") for p in every]).drop("open"))
            rounds.drop(*kept)
            return whole
        before = left


def better(df: DataFrame) -> DataFrame:
    """The row of each node with the worst verdict, then the least distance, then the least source."""
    return df.groupBy("node").agg(F.min(F.struct((-F.col("rank")).alias("over"), "dist", "via", "evidence")).alias("it")).select(
        "node", (-F.col("it.over")).alias("rank"), "it.dist", "it.via", "it.evidence"
    )


def best(df: DataFrame, asked: bool = False) -> DataFrame:
    """``better`` with whether anything ``reached`` the node; if ``asked``, rows without a rank ask for it, and what is asked for and not reached is UNKNOWN."""
    row = F.when(F.col("rank").isNotNull(), F.struct((-F.col("rank")).alias("over"), "dist", "via", "evidence"))
    known = df.groupBy("node").agg(F.min(row).alias("it"), F.max("reached").alias("reached"), F.max(F.col("rank").isNull()).alias("asked"))
    if asked:
        alone = F.col("asked") & ~F.coalesce("reached", F.lit(False))
        known = known.withColumn("it", F.when(~alone, F.col("it"))).where("it IS NOT NULL OR asked")
    rank = -F.col("it.over")
    return known.select("node", F.coalesce(rank, F.lit(VERDICTS.index("UNKNOWN"))).alias("rank"), F.coalesce("it.dist", F.lit(0)).alias("dist"), "it.via", "it.evidence", "reached")


def spread(flows: DataFrame, origins: DataFrame, rounds: Rounds, wanting: DataFrame | None = None) -> DataFrame:
    """``node, rank, dist, via, evidence``: the worst rank of ``origins`` (``node, rank, evidence``) that reaches each node over ``flows``
    (``dst, src``), how far it is and from which source; nodes that nothing reaches are not there, but those of ``wanting`` (``node``) are then UNKNOWN origins themselves.

    Only flows between values that both take and give go on in rounds: what takes from nothing gives once, before, and what gives nothing takes once, after.
    Chains of values with one source are jumped over. A round joins the flows with what the round before made worse, or nearer, and writes what
    that makes worse again, and nothing else; what is known is the union of what rounds have written, put together every ``PARTS`` rounds.
    """
    nothing = F.lit(None).cast("string")
    start = origins.select("node", "rank", F.lit(0).alias("dist"), nothing.alias("via"), F.coalesce("evidence", "node").alias("evidence"))
    real = rounds.keep(flows.select("dst", "src").where("dst <> src"))
    middle = rounds.keep(real.select(F.col("dst").alias("node")).distinct().join(real.select(F.col("src").alias("node")).distinct(), "node", "left_semi"))
    takes = real.join(middle.select(F.col("node").alias("dst")), "dst", "left_semi")
    ends = real.join(middle.select(F.col("node").alias("dst")), "dst", "left_anti")
    first = rounds.keep(takes.join(middle.select(F.col("node").alias("src")), "src", "left_anti"))
    core = rounds.keep(takes.join(middle.select(F.col("node").alias("src")), "src", "left_semi").distinct())
    chains = jumps(core, origins.select("node").union(first.select("dst")), rounds)
    inner = core.join(chains.select(F.col("node").alias("dst")), "dst", "left_anti")
    edges = rounds.keep(
        inner.join(chains.select(F.col("node").alias("src"), "to", "far"), "src", "left").select("dst", F.col("src").alias("by"), F.coalesce("to", "src").alias("src"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))
    )
    once = lambda some: some.select("dst", F.col("src").alias("by"), "src", F.lit(1).alias("far"))

    def passed_on(some: DataFrame, over: DataFrame, *more: str) -> DataFrame:
        """What some nodes pass to those that take their values."""
        met = over.join(some.select(F.col("node").alias("src"), "rank", "dist", *more), "src")
        return met.select(F.col("dst").alias("node"), "rank", (F.col("dist") + F.col("far")).alias("dist"), F.col("by").alias("via"), nothing.alias("evidence"), *more)

    def followed(fresh: DataFrame, parts: list[DataFrame]) -> list[DataFrame]:
        """``parts``, what is known of the values between, with what comes of fresh rows. The parts given stay, as others read them."""
        over, given = edges.unionByName(once(first)), parts
        while True:
            was = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.min(order).alias("was"))
            fresh = rounds.keep(better(passed_on(fresh, over)).join(was, "node", "left").where(F.col("was").isNull() | (order < F.col("was"))).drop("was"))
            if fresh.isEmpty():
                return parts
            over, parts = edges, [*parts, fresh]
            if len(parts) > PARTS:
                whole = rounds.keep(better(reduce(DataFrame.unionByName, parts[:-1])))
                rounds.drop(*[p for p in parts[:-1] if not any(p is g for g in given)])
                parts = [whole, fresh]

    def along(known: DataFrame, *more: str) -> DataFrame:
        """What is known of chains' values by that of their beginnings."""
        met = chains.join(known.select(F.col("node").alias("to"), "rank", "dist", *more), "to")
        return met.select("node", "rank", (F.col("dist") + F.col("far")).alias("dist"), F.col("src").alias("via"), nothing.alias("evidence"), *more)

    order = F.struct((-F.col("rank")).alias("over"), "dist", "via")
    own = rounds.keep(better(start))
    parts = followed(own, [rounds.keep(own.join(middle, "node", "left_semi"))])
    reached = reduce(DataFrame.unionByName, [own.join(middle, "node", "left_anti"), *parts]).withColumn("reached", F.lit(True))
    found = [reached]
    if wanting is not None:
        known = reached.select("node").union(chains.join(reached.select(F.col("node").alias("to")).distinct(), "to", "left_semi").select("node"))
        giving = middle.union(real.select("src")).distinct()
        alone = rounds.keep(unknown(wanting.join(giving, "node", "left_semi").join(known.distinct(), "node", "left_anti").distinct()))
        later = [] if alone.isEmpty() else followed(alone, [*parts, rounds.keep(alone.join(middle, "node", "left_semi"))])
        found += [df.withColumn("reached", F.lit(False)) for df in (alone, *later)]
    # A value on a chain may itself have been given an origin for want of one; its chain's beginning then has none worse.
    found = reduce(DataFrame.unionByName, found)
    given = found.unionByName(along(found, "reached"))
    rows = given.unionByName(passed_on(best(given), once(ends), "reached"))
    if wanting is not None:
        # What gives nothing and is not reached is known by now alone.
        rows = rows.unionByName(wanting.select("node", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("int").alias("dist"), nothing.alias("via"), nothing.alias("evidence"), F.lit(None).cast("boolean").alias("reached")))
    return rounds.keep(best(rows, wanting is not None).drop("reached"))


def unknown(nodes: DataFrame) -> DataFrame:
    """Nodes as UNKNOWN origins without evidence."""
    nothing = F.lit(None).cast("string")
    return nodes.select("node", F.lit(VERDICTS.index("UNKNOWN")).alias("rank"), F.lit(0).alias("dist"), nothing.alias("via"), nothing.alias("evidence"))


def with_steps(found: DataFrame, rounds: Rounds) -> DataFrame:
    """``node, steps``: the way from each node of ``spread`` back to its origin's evidence. Ways double in each round, so there are few; what no way leads through joins them once, after."""
    through = rounds.keep(found.where("via IS NOT NULL").select(F.col("via").alias("node")).distinct())
    inner = rounds.keep(found.join(through, "node", "left_semi"))
    ways = inner.select("node", F.when(F.col("via").isNull(), F.array("evidence")).otherwise(F.array("node")).alias("steps"), "via")
    most = inner.agg(F.max("dist")).head()[0] or 0
    for _ in range(most.bit_length()):
        before = ways = rounds.keep(ways)
        on = before.where("via IS NOT NULL").join(before.select(F.col("node").alias("via"), F.col("steps").alias("more"), F.col("via").alias("next")), "via")
        ways = before.where("via IS NULL").unionByName(on.select("node", F.concat("steps", "more").alias("steps"), F.col("next").alias("via")))
    ways = rounds.keep(ways.select("node", "steps"))
    rest = found.join(through, "node", "left_anti")
    led = rest.join(ways.withColumnRenamed("node", "via"), "via").select("node", F.concat(F.array("node"), "steps").alias("steps"))
    return ways.unionByName(rest.where("via IS NULL").select("node", F.array("evidence").alias("steps"))).unionByName(led)


def value_origins(flows: DataFrame, origins: DataFrame, steps: bool = True) -> DataFrame:
    """``node, verdict, steps`` (the steps from the value back to where its verdict comes from; none are followed without ``steps``).

    A value that no origin reaches is UNKNOWN, and so is, at best, what it flows into. Of equally bad ways the shortest is the evidence,
    then that of the least source. There are as many rounds as the longest way on which a verdict gets worse, less the chains on it. What has its verdict
    for want of an origin has no steps.
    """
    rounds = Rounds(flows.sparkSession, "value_origins")
    nodes = flows.select(F.col("dst").alias("node")).union(flows.select("src")).union(origins.select("node"))
    own = origins.select("node", verdict_rank(F.col("verdict")).alias("rank"), "evidence")
    found = spread(flows, own, rounds, nodes)
    verdict = verdict_name(F.col("rank")).alias("verdict")
    if not steps:
        return found.select("node", verdict)
    known = F.when(~F.exists("steps", lambda s: s.isNull()), F.col("steps")).alias("steps")
    return with_steps(found, rounds).join(found.select("node", "rank"), "node").select("node", verdict, known)


def statement_verdict(direct: Column, generic: Column, fixed: Column) -> Column:
    """A statement's verdict from the worst of its direct and of its generic routes; text fixed in the file is safe.

    Safe by direct routes but open to the client by generic ones is BYPASSABLE; without any route UNKNOWN.
    """
    d, g = verdict_rank(direct), verdict_rank(generic)
    client = VERDICTS.index("CLIENT")
    return (
        F.when(fixed, "XML_FIXED")
        .when(direct.isNull() & generic.isNull(), "UNKNOWN")
        .when((g == client) & direct.isNotNull() & (d < client), "BYPASSABLE")
        .otherwise(verdict_name(F.greatest(F.coalesce(d, F.lit(-1)), F.coalesce(g, F.lit(-1)))))
    )


def key_origins(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdicts of keys read from a request map: SESSION_OVERWRITE where a rule with the same annotation, first parameter,
    container and key says that the session sets it, else CLIENT."""
    keys = ["annotation", "first_param", "container", "map_key"]
    return sites.join(rules.select(*keys).distinct().withColumn("set", F.lit(True)), keys, "left").select(
        *sites.columns, F.when(F.col("set"), "SESSION_OVERWRITE").otherwise("CLIENT").alias("verdict")
    )


def inherited_methods(extends: DataFrame, methods: DataFrame, cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``type, method, owner, depth``: the nearest type up the hierarchy that has the method; extends: ``type, parent``.

    Rounds go a level down each and end when no type has anything new, so loops end, too.
    """
    found = newest = methods.select(F.col("owner").alias("type"), "method", "owner", F.lit(0).alias("depth"))
    for depth in count(1):
        step = newest.join(extends.withColumnRenamed("type", "child"), newest.type == F.col("parent")).select(F.col("child").alias("type"), "method", "owner")
        newest = cut(step.join(found, ["type", "method"], "left_anti").groupBy("type", "method").agg(F.min("owner").alias("owner")).withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            return found
        found = cut(found.unionByName(newest.select(*found.columns)))


def callers(calls: DataFrame, inherited: DataFrame) -> DataFrame:
    """``owner, method, caller``: who calls each method; calls (``caller, type, method``) go to the nearest type that has it."""
    return calls.join(inherited, ["type", "method"]).select("owner", "method", "caller").distinct()


def covered(path: Column, devices: list[tuple[str, list[str], list[str]]], regex: Callable[[str], str] = ant_regex) -> Column:
    """Whether a guard covers a path: one of its patterns fits and none of its exceptions; null without any guard.

    ``devices``: name, patterns and exceptions, which come from configuration and go into the expression; ``regex`` is ``ant_regex`` for
    interceptors, ``servlet_regex`` for filters.
    """
    hit = lambda patterns: reduce(or_, [path.rlike(regex(p)) for p in patterns], F.lit(False))
    if not devices:
        return F.lit(None).cast("boolean")
    return reduce(or_, [hit(includes) & ~hit(excludes) for _, includes, excludes in devices])


def unprotected(endpoints: DataFrame, devices: set[str], hooks: list[dict]) -> tuple[DataFrame | None, str | None]:
    """The paths of endpoints (``endpoint, path``) that no registered guard covers; or None and why it cannot be told.

    ``hooks``: registrations from configuration with ``name, kind`` (INTERCEPTOR or FILTER), ``include, exclude, known`` (whether its
    patterns could be read). Without a device, without a registration of one, or with patterns that could not be read, nothing is judged.
    """
    if not devices:
        return None, "NO_DEVICES"
    applied = [h for h in hooks if h["name"] in devices]
    if not applied:
        return None, "NOT_REGISTERED"
    if not all(h["known"] for h in applied):
        return None, "PATTERNS_UNKNOWN"
    kinds = {"INTERCEPTOR": ant_regex, "FILTER": servlet_regex}
    hit = reduce(or_, [covered(F.col("path"), [(h["name"], h["include"], h["exclude"])], kinds[h["kind"]]) for h in applied])
    return endpoints.where(~F.coalesce(hit, F.lit(False))), None


def rule_changes(drafted: DataFrame, current: DataFrame, dismissed: DataFrame) -> DataFrame:
    """What a drafted set of rules (``kind, name, value``) changes: ADD and REMOVE rows with a key; dismissed keys
    (``change_key``) are left out. Additions are automatic, removals need a person."""
    keys = ["kind", "name", "value"]
    add = drafted.select(*keys).distinct().join(current, keys, "left_anti").withColumn("change", F.lit("ADD"))
    remove = current.select(*keys).distinct().join(drafted, keys, "left_anti").withColumn("change", F.lit("REMOVE"))
    keyed = add.unionByName(remove).withColumn("change_key", F.sha2(F.concat_ws("\n", "change", *keys), 256))
    return keyed.join(dismissed.select("change_key"), "change_key", "left_anti").withColumn("automatic", F.col("change") == "ADD")


def overwrite_changes(drafted: DataFrame, existing: DataFrame) -> DataFrame:
    """``change, target, key, automatic``: how rules on what a session overwrites are to change by a new draft.

    ``drafted``: ``target, key, session`` (whether the code puts the session's value there; of several rows of a key one that does is enough); ``existing``: ``target, key``. Session keys
    of a target without a rule are ADD_OVERWRITE, others that are not there yet ADD_KEYS; a key that is there is REMOVE_KEYS only if the draft has it as none of the session's, so
    what a draft does not see stays. Removals need a person.
    """
    keyed = drafted.groupBy("target", "key").agg(F.bool_or(F.coalesce("session", F.lit(False))).alias("session"))
    there = existing.select("target", "key").distinct().withColumn("there", F.lit(True))
    known = existing.select("target").distinct().withColumn("known", F.lit(True))
    met = keyed.join(there, ["target", "key"], "left").join(known, "target", "left").where(F.col("session") == F.col("there").isNull())
    change = F.when(F.col("session") & F.col("known").isNull(), "ADD_OVERWRITE").when(F.col("session"), "ADD_KEYS").otherwise("REMOVE_KEYS")
    return met.select(change.alias("change"), "target", "key", F.col("session").alias("automatic"))


def active_rules(files: DataFrame, judged: dict[str, bool]) -> DataFrame:
    """``rule_id`` of all rules whose absence in a scan means something: those of the files, and those of further judges that came to a judgement."""
    more = files.sparkSession.createDataFrame([(r,) for r, done in judged.items() if done], "rule_id string")
    return files.select("rule_id").union(more).distinct()


def proposals(latest: DataFrame, changes: DataFrame) -> DataFrame:
    """Proposals after a new draft: ``latest`` has ``change_key, status``; dismissed ones stay dismissed, pending ones whose change
    is gone are OBSOLETE, new changes are PENDING or AUTO_APPLIED."""
    joined = latest.join(changes.select("change_key", "automatic"), "change_key", "full")
    new = F.when(F.col("automatic"), "AUTO_APPLIED").otherwise("PENDING")
    return joined.select(
        "change_key",
        F.when(F.col("status").isNull(), new)
        .when((F.col("status") == "PENDING") & F.col("automatic").isNull(), "OBSOLETE")
        .when((F.col("status") == "OBSOLETE") & F.col("automatic").isNotNull(), new)
        .otherwise(F.col("status"))
        .alias("status"),
    )
