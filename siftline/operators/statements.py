"""Which puts of a map's key must have run before a use of it: an and/or fold over statement trees, level by level.

``statements``: ``method, stmt, parent, pos, kind, role, puts``. ``stmt`` is a statement's key over all methods, ``parent`` the one it stands in (null for a method's body), ``pos`` its
place in the method's text, ``puts`` the map keys that it puts itself. Kinds that count are BLOCK, EXPRESSION, RETURN, THROW, IF (children with role THEN, ELSE or CONDITION),
TRY (the block has role TRY; CATCH is a kind), DO, LABELED, SYNCHRONIZED, FOR, FOR_EACH, WHILE, SWITCH, LAMBDA, CONDITIONAL, and AND or OR (role RIGHT); any other kind
neither puts nor stands in the way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.severity import verdict_name, verdict_rank
from siftline.sources.state import Rounds

#: Within these a statement may run or not.
MAYBE = ["FOR", "FOR_EACH", "WHILE", "SWITCH", "CATCH", "LAMBDA", "CONDITIONAL"]
#: These always run what stands in them.
PASSING = ["DO", "LABELED", "SYNCHRONIZED"]


def depths(statements: DataFrame, rounds: Rounds) -> DataFrame:
    """``stmt, depth``: how many statements each stands in. Ways up double each round; what stands in itself has no depth.

    Only ways that go on are looked up: those that have ended all have one key, null, and would meet in one task.
    """
    ways = rounds.keep(statements.select("stmt", F.col("parent").alias("up"), F.lit(0).alias("depth")))
    ended, before = [ways.where("up IS NULL")], -1
    while True:
        going = ways.where("up IS NOT NULL")
        left = going.count()
        if left in (0, before):
            return reduce(DataFrame.unionByName, ended).select("stmt", "depth")
        before = left
        above = reduce(DataFrame.unionByName, [going, *ended]).select(F.col("stmt").alias("up"), F.col("up").alias("next"), (F.col("depth") + 1).alias("more"))
        # A parent that is no statement ends the way.
        ways = rounds.keep(going.join(above, "up", "left").select("stmt", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        ended.append(ways.where("up IS NULL"))


def folded(kind: Column, own: Column, children: Column, leaves: bool) -> tuple[Column, Column]:
    """The keys that a statement always puts, and whether it never ends normally, from its children's in their order.

    With ``leaves`` a statement that returns or throws covers every key, as nothing comes after it. Without, a block counts up to its first child with a return in it.
    """
    empty = F.array().cast("array<string>")
    of_role = lambda role: F.filter(children, lambda c: c["role"] == role)
    all_keys = lambda some: F.array_distinct(F.flatten(F.transform(some, lambda c: c["keys"])))
    returning = F.array_position(F.transform(children, lambda c: c["returns"]), True).cast("int")
    counted = children if leaves else F.when(returning > 0, F.slice(children, F.lit(1), returning)).otherwise(children)
    then, other = F.get(of_role("THEN"), 0), F.get(of_role("ELSE"), 0)
    both = then.isNotNull() & other.isNotNull()
    either = F.when(then["ends"], other["keys"]).when(other["ends"], then["keys"]).otherwise(F.array_intersect(then["keys"], other["keys"]))
    keys = (
        F.when(kind == "EXPRESSION", own)
        .when(kind == "BLOCK", all_keys(counted))
        .when((kind == "IF") & both, either)
        .when(kind == "TRY", all_keys(of_role("TRY")))
        .when(kind.isin(PASSING), all_keys(children))
        .otherwise(empty)
    )
    any_ends = lambda some: F.exists(some, lambda c: c["ends"])
    ends = (
        F.when(kind.isin("RETURN", "THROW"), F.lit(leaves))
        .when(kind == "BLOCK", any_ends(counted))
        .when((kind == "IF") & both, then["ends"] & other["ends"])
        .when(kind == "TRY", any_ends(of_role("TRY")))
        .when(kind.isin(PASSING), any_ends(children))
        .otherwise(F.lit(False))
    )
    return F.coalesce(keys, empty), F.coalesce(ends, F.lit(False))


def always_puts(statements: DataFrame, leaves: bool, rounds: Rounds | None = None) -> DataFrame:
    """``stmt, keys, ends``: the map keys that each statement puts whenever it runs, and whether it never ends normally; see ``folded`` for ``leaves``.

    One round a level, from the deepest up: a level reads its own statements and what the level below has written. A statement's children are gathered, so none may have
    more than fit in memory.
    """
    rounds = rounds or Rounds(statements.sparkSession, "always_puts")
    placed = rounds.keep(statements.select("stmt", "parent", "pos", "kind", "role", "puts").join(depths(statements, rounds), "stmt"))
    deepest = placed.agg(F.max("depth")).head()[0]
    below, done = None, []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = placed.where(F.col("depth") == depth)
        if below is None:
            known = level.withColumn("children", F.lit(None))
            children = F.array().cast("array<struct<pos:long,role:string,keys:array<string>,ends:boolean,returns:boolean>>")
        else:
            told = F.struct(F.col("pos").cast("long").alias("pos"), "role", "keys", "ends", "returns")
            known = level.join(below.groupBy(F.col("parent").alias("stmt")).agg(F.sort_array(F.collect_list(told)).alias("children")), "stmt", "left")
            children = F.coalesce("children", F.array().cast("array<struct<pos:long,role:string,keys:array<string>,ends:boolean,returns:boolean>>"))
        keys, ends = folded(F.col("kind"), F.coalesce("puts", F.array().cast("array<string>")), children, leaves)
        returns = (F.col("kind") == "RETURN") | (F.col("kind") != "LAMBDA") & F.exists(children, lambda c: c["returns"])
        below = rounds.keep(known.select("stmt", "parent", "pos", "role", keys.alias("keys"), ends.alias("ends"), returns.alias("returns")))
        done.append(below.select("stmt", "keys", "ends"))
    return reduce(DataFrame.union, done) if done else statements.select("stmt", F.array().cast("array<string>").alias("keys"), F.lit(False).alias("ends"))


def climbed(starts: DataFrame, edges: DataFrame, rounds: Rounds) -> DataFrame:
    """``starts`` (``start, key, node``) with all nodes above that ``edges`` (``node, up, only``) lead to; an edge with ``only`` is open to that key alone."""
    every = [rounds.keep(starts)]
    while not every[-1].isEmpty():
        open_ = every[-1].join(edges, "node").where("only IS NULL OR only = key")
        every.append(rounds.keep(open_.select("start", "key", F.col("up").alias("node"))))
    return reduce(DataFrame.unionByName, every)


def puts_before(statements: DataFrame, uses: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """``use, key, put, must``: the puts of each used key that stand before a use in its method, and whether each runs on every way to it.

    ``uses``: ``use, stmt, key``, the statement in which a key is read. ``calls``: ``stmt, callee``, statements that hand the map to a method: each key that the method puts
    anywhere counts as put there, and must run if the method puts it on each of its ways.

    A put must run unless something between it and what it shares with the use stands in the way: a loop, a case, a catch, a lambda, a right operand, or
    one branch of a condition whose other branch neither puts the key nor leaves the method.
    """
    rounds = Rounds(statements.sparkSession, "puts_before")
    base = rounds.keep(statements)
    own = base.where("kind = 'EXPRESSION'").select("method", F.col("stmt").alias("put"), "pos", F.explode("puts").alias("key"), F.lit(True).alias("always"))
    if calls is not None:
        full = always_puts(base, False, rounds).join(base.where("parent IS NULL").select("stmt", "method"), "stmt").select(F.col("method").alias("callee"), F.explode("keys").alias("key"), F.lit(True).alias("always"))
        some = own.select(F.col("method").alias("callee"), "key").distinct()
        of_callee = some.join(full.distinct(), ["callee", "key"], "left")
        there = base.select("method", "stmt", "pos").join(calls.distinct(), "stmt").join(of_callee, "callee")
        own = own.unionByName(there.groupBy("method", F.col("stmt").alias("put"), "pos", "key").agg(F.max(F.coalesce("always", F.lit(False))).alias("always")))
    puts = rounds.keep(own.distinct())
    other = base.where("role IN ('THEN', 'ELSE')").join(always_puts(base, True, rounds), "stmt").select("parent", F.when(F.col("role") == "THEN", "ELSE").otherwise("THEN").alias("role"), F.col("keys").alias("other_keys"), F.col("ends").alias("other_ends"))
    above = base.select(F.col("stmt").alias("parent"), F.col("kind").alias("parent_kind"))
    step = base.select(F.col("stmt").alias("node"), F.col("parent"), "role").join(above, "parent")
    branch = (F.col("parent_kind") == "IF") & F.col("role").isin("THEN", "ELSE")
    barred = F.col("parent_kind").isin(MAYBE) | F.col("parent_kind").isin("AND", "OR") & F.coalesce(F.col("role") == "RIGHT", F.lit(False))
    free = step.where(~barred & ~F.coalesce(branch, F.lit(False))).select("node", F.col("parent").alias("up"), F.lit(None).cast("string").alias("only"))
    by_branch = step.where(branch).join(other, ["parent", "role"])
    ended = by_branch.where("other_ends").select("node", F.col("parent").alias("up"), F.lit(None).cast("string").alias("only"))
    filled = by_branch.where("NOT other_ends").select("node", F.col("parent").alias("up"), F.explode("other_keys").alias("only"))
    edges = rounds.keep(free.unionByName(ended).unionByName(filled))
    starts = puts.where("always").select(F.col("put").alias("start"), "key", F.col("put").alias("node")).distinct()
    shared = base.select(F.col("stmt").alias("node"), F.col("parent").alias("shared")).where("shared IS NOT NULL")
    reach = climbed(starts, edges, rounds).join(shared, "node").select(F.col("start").alias("put"), "key", "shared").distinct()
    up = base.where("parent IS NOT NULL").select(F.col("stmt").alias("node"), F.col("parent").alias("up"), F.lit(None).cast("string").alias("only"))
    inside = climbed(uses.select(F.col("use").alias("start"), "key", F.col("stmt").alias("node")).distinct(), up, rounds)
    placed = uses.distinct().join(base.select("stmt", "method", F.col("pos").alias("use_pos")), "stmt")
    pairs = placed.join(puts, ["method", "key"]).where("pos < use_pos").select("use", "key", "put").distinct()
    met = inside.select(F.col("start").alias("use"), "key", F.col("node").alias("shared")).join(reach, ["key", "shared"]).select("use", "key", "put").distinct().withColumn("must", F.lit(True))
    return pairs.join(met, ["use", "key", "put"], "left").select("use", "key", "put", F.coalesce("must", F.lit(False)).alias("must"))


def key_verdicts(before: DataFrame, values: DataFrame, carried: DataFrame) -> DataFrame:
    """``use, key, verdict, covered``: the worst of what the puts before a use put, and, unless one of them must have run, of what the map brought.

    ``values``: ``put, key, verdict``; ``carried``: ``use, key, verdict`` of the map before any put, for every use. A verdict that is not known is UNKNOWN.
    """
    rank = lambda df: F.coalesce(verdict_rank(df["verdict"]), verdict_rank(F.lit("UNKNOWN")))
    put = before.join(values, ["put", "key"], "left").select("use", "key", "must", F.coalesce(verdict_rank(F.col("verdict")), verdict_rank(F.lit("UNKNOWN"))).alias("rank"))
    worst = put.groupBy("use", "key").agg(F.max("rank").alias("put_rank"), F.max("must").alias("covered"))
    met = carried.select("use", "key", rank(carried).alias("rank")).join(worst, ["use", "key"], "left")
    covered = F.coalesce("covered", F.lit(False))
    return met.select("use", "key", verdict_name(F.when(covered, F.col("put_rank")).otherwise(F.greatest("rank", F.coalesce("put_rank", "rank")))).alias("verdict"), covered.alias("covered"))
