"""Value origins by frames of calls: a parameter takes its argument's origin in the frame of the call that is followed, not all callers'.

The facts: ``flows`` (``dst, src``) within a method; ``returns`` (``dst, src, site``): the value of a call takes what a callee returns; and
``arguments`` (``param, src, site``): a callee's parameter takes an argument at a call. A way from a value goes into a callee by a return and out of it
by a parameter, and only at the same site; where it has gone out of all it went into, it goes on to every caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.severity import VERDICTS, verdict_name, verdict_rank
from siftline.operators.tracing import jumps, spread, with_steps
from siftline.sources.state import Rounds

#: Stands between the steps of an origin that is found within calls.
BETWEEN = "\x1f"


def shortcuts(flows: DataFrame, returns: DataFrame, arguments: DataFrame, rounds: Rounds, params: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``flows`` with a flow from an argument to the value of its call wherever the callee returns what the parameter brings; and ``node, param``: which
    parameters of its own method each value takes from.

    Rounds join what the round before has found alone: a value that takes from a parameter passes that on over the flows, and where it is returned it makes
    new flows in its callers, which pass on what is known. Both tables only grow, so rounds end when neither does, with recursion too.
    Arguments that take from nothing within their method bring no parameter, so rounds do without them; their flows are made once, at the end, and may repeat.
    ``params`` (``node``) has the parameters where ``arguments`` has not all of them.
    """
    params = (arguments.select(F.col("param").alias("node")).distinct() if params is None else params).select("node", F.col("node").alias("param"))
    taking = params.select("node").union(flows.select("dst")).union(returns.select("dst"))
    live = rounds.keep(arguments.select("src").distinct().join(taking.select(F.col("node").alias("src")), "src", "left_semi"))
    every_return, still, arguments = returns, arguments.join(live, "src", "left_anti"), rounds.keep(arguments.join(live, "src", "left_semi").distinct())
    returns = rounds.keep(returns.join(arguments.select("site").distinct(), "site", "left_semi").distinct())
    taken, edges = [rounds.keep(params)], [rounds.keep(flows.select("dst", "src").distinct())]
    fresh = taken[0]
    while True:
        every, known = reduce(DataFrame.unionByName, edges), reduce(DataFrame.unionByName, taken)
        returned = fresh.join(returns.select("dst", F.col("src").alias("node"), "site"), "node").join(arguments, ["param", "site"])
        new = rounds.keep(returned.select("dst", "src").where("dst <> src").distinct().join(every, ["dst", "src"], "left_anti"))
        passed = fresh.join(every.unionByName(new), fresh.node == F.col("src")).select(F.col("dst").alias("node"), "param")
        again = known.join(new, known.node == F.col("src")).select(F.col("dst").alias("node"), "param")
        fresh = rounds.keep(passed.unionByName(again).distinct().join(known, ["node", "param"], "left_anti"))
        edges.append(new)
        if fresh.isEmpty():
            break
        taken.append(fresh)
    every, known = rounds.keep(reduce(DataFrame.unionByName, edges)), rounds.keep(reduce(DataFrame.unionByName, taken))
    rounds.drop(*edges, *taken)
    brought = every_return.select("dst", F.col("src").alias("node"), "site").join(known, "node").select("dst", "site", "param")
    last = rounds.keep(brought.join(still, ["param", "site"]).select("dst", "src").where("dst <> src"))
    return every.unionByName(last), known


def framed_origins(flows: DataFrame, returns: DataFrame, arguments: DataFrame, origins: DataFrame, steps: bool = True) -> DataFrame:
    """``node, verdict, steps`` of every value, as its own method sees it when nobody says who called that.

    ``origins`` (``node, verdict, evidence``) as for ``value_origins``. A parameter's own origin (a handler's, which the client sends) holds where no call is followed, and
    then its callers do not count. A parameter without own origin takes the worst of all its callers', and without callers it is UNKNOWN, as is what no origin reaches.
    ``steps`` lead from the value to where its verdict comes from, without the values between that take from one other alone; what has its verdict for want of an origin has none. Without ``steps`` none are followed, and that column is not there.
    Each call must have an argument for every parameter; one that is missing counts for nothing. Facts may repeat; rows with a null end lead nowhere.

    First what each value takes within calls, whoever calls: over flows, shortcuts and returns, from origins that are no parameters. Then what that and
    parameters bring, over flows, shortcuts and arguments.
    """
    if not steps:
        return framed_verdicts(flows, returns, arguments, origins)
    rounds = Rounds(flows.sparkSession, "framed_origins")
    own = origins.select("node", verdict_rank(F.col("verdict")).alias("rank"), "evidence")
    real = flows.select("dst", "src").where("dst <> src").distinct()
    params = arguments.select(F.col("param").alias("node")).distinct()
    # What takes from one value alone has that value's origin in every frame.
    chains = jumps(real, params.union(returns.select("dst")).union(own.select("node")), rounds)
    begins = chains.select(F.col("node").alias("src"), "to")
    begun = lambda df: df.join(begins, "src", "left").withColumn("src", F.coalesce("to", "src")).drop("to")
    returns, arguments = rounds.keep(begun(returns)), rounds.keep(begun(arguments))
    inner = begun(real.join(chains.select(F.col("node").alias("dst")), "dst", "left_anti"))
    edges, taken = shortcuts(inner, returns, arguments, rounds)
    within = edges.unionByName(returns.select("dst", "src"))
    ends = [edges.select("dst"), edges.select("src"), returns.select("dst"), returns.select("src"), arguments.select("param"), arguments.select("src"), own.select("node"), chains.select("to")]
    nodes = rounds.keep(reduce(DataFrame.union, [df.toDF("node") for df in ends]).where("node IS NOT NULL").distinct())

    bound = taken.select("node").distinct()
    inside = spread(within, own.join(params, "node", "left_anti"), rounds, nodes.join(bound, "node", "left_anti"))
    told = with_steps(inside, rounds).select("node", F.array_join("steps", BETWEEN, "").alias("evidence"))
    settled = inside.select("node", "rank").join(told, "node").union(own.join(params, "node", "left_semi").select("node", "rank", F.coalesce("evidence", "node")))
    called = arguments.select(F.col("param").alias("dst"), "src").join(own.select(F.col("node").alias("dst")), "dst", "left_anti")
    found = spread(edges.unionByName(called), settled, rounds, nodes)
    ways = with_steps(found, rounds).select("node", F.split(F.array_join("steps", BETWEEN, ""), BETWEEN).alias("steps"))
    whole = found.join(ways, "node").select("node", "rank", "steps")
    along = chains.join(whole.select(F.col("node").alias("to"), "rank", "steps"), "to").select("node", "rank", F.concat(F.array("node"), "steps").alias("steps"))
    known = F.when((F.size("steps") > 0) & (F.element_at("steps", -1) != ""), F.col("steps"))
    return whole.unionByName(along).select("node", verdict_name(F.col("rank")).alias("verdict"), known.alias("steps"))


def framed_verdicts(flows: DataFrame, returns: DataFrame, arguments: DataFrame, origins: DataFrame) -> DataFrame:
    """``node, verdict`` of ``framed_origins``, with rounds over what both takes and gives alone. Nodes and sites may be texts or numbers, which join faster.

    Most calls have a value that nothing takes and arguments that take from nothing. Such an argument has its own origin, or is UNKNOWN, and that counts for
    its parameter as an origin, before the rounds. Such a value is judged once, after them: by what its callee returns within calls, and by its site's arguments for
    the parameters that the callee's value takes from. Rounds have the other calls and flows, parameters, and what callees return.
    """
    rounds, unknown = Rounds(flows.sparkSession, "framed_verdicts"), F.lit(VERDICTS.index("UNKNOWN"))
    kind = dict(returns.dtypes)["dst"]
    node = lambda name: F.col(name).alias("node")
    union = lambda *some: reduce(DataFrame.union, some)
    # Rounds name nodes by texts.
    texts = lambda df, *names: df.withColumns({n: F.col(n).cast("string") for n in names})
    typed = lambda df, *names: df.withColumns({n: F.col(n).cast(kind) for n in names})
    nothing = F.lit(None).cast("string").alias("evidence")

    own = origins.groupBy("node").agg(F.max(F.coalesce(verdict_rank(F.col("verdict")), unknown)).alias("rank"))
    real = rounds.keep(flows.select("dst", "src").where("dst <> src").distinct())
    params = rounds.keep(arguments.select(node("param")).where("node IS NOT NULL").distinct())
    # Only what flows take to can be on a chain.
    other = union(params, returns.select(node("dst")), origins.select("node")).join(real.select(node("dst")).distinct(), "node", "left_semi")
    chains = jumps(real, rounds.keep(other.distinct()), rounds)
    begins = chains.select(F.col("node").alias("src"), "to")
    begun = lambda df: df.join(begins, "src", "left").withColumn("src", F.coalesce("to", "src")).drop("to")
    inner, callees = begun(real.join(chains.select(F.col("node").alias("dst")), "dst", "left_anti")), begun(returns.select("src").distinct())
    returns, arguments = begun(returns), begun(arguments)

    sources = rounds.keep(union(inner.select(node("src")), callees.select(node("src")), chains.select(node("to"))).where("node IS NOT NULL").distinct())
    giving = sources.union(arguments.select(node("src")))
    core = rounds.keep(union(inner.select(node("dst")), returns.select(node("dst"))).join(giving, "node", "left_semi").union(params).distinct())
    to_core = core.select(F.col("node").alias("dst"))
    last_flows, last = inner.join(to_core, "dst", "left_anti"), returns.join(to_core, "dst", "left_anti")
    inner, returns = rounds.keep(inner.join(to_core, "dst", "left_semi")), rounds.keep(returns.join(to_core, "dst", "left_semi").distinct())
    live = F.col("live").isNotNull()
    told = arguments.where("src IS NOT NULL").join(core.select(F.col("node").alias("src"), F.lit(True).alias("live")), "src", "left").join(own.withColumnRenamed("node", "src"), "src", "left")
    passed = rounds.keep(told.select("param", "site", F.when(live, F.col("src")).alias("src"), F.when(~live, F.coalesce("rank", unknown)).alias("rank")))

    nested = arguments.join(returns.select("site").distinct(), "site", "left_semi").distinct()
    args = texts(params, "node"), texts(rounds.keep(nested), "param", "src")
    edges, taken = shortcuts(texts(inner, "dst", "src"), texts(returns, "dst", "src"), args[1], rounds, args[0])
    edges, params, bound = rounds.keep(edges), args[0], taken.select("node").distinct()
    nodes = rounds.keep(union(texts(sources, "node"), texts(core, "node"), edges.select(node("src"))).where("node IS NOT NULL").distinct())
    begin = rounds.keep(texts(own.join(typed(nodes, "node"), "node", "left_semi"), "node").select("node", "rank", nothing))
    inside = spread(edges.unionByName(texts(returns, "dst", "src").select("dst", "src")), begin.join(params, "node", "left_anti"), rounds, nodes.join(bound, "node", "left_anti"))
    # A parameter's own origin stands for all its callers'.
    free = params.join(begin, "node", "left_anti")
    heard = rounds.keep(texts(passed.groupBy("param", "src").agg(F.max("rank").alias("rank")), "param", "src").join(free.withColumnRenamed("node", "param"), "param", "left_semi"))
    brought, called = heard.where("src IS NULL").select(node("param"), "rank", nothing), heard.where("src IS NOT NULL").select(F.col("param").alias("dst"), "src")
    settled = union(inside.select("node", "rank", "evidence"), begin.join(params, "node", "left_semi"), brought)
    found = typed(spread(edges.unionByName(called), settled, rounds, nodes).select("node", "rank"), "node")

    inside, taken = typed(inside.select("node", "rank"), "node"), typed(taken, "node", "param").withColumnRenamed("node", "src")
    at = found.withColumnRenamed("node", "src")
    returned = lambda df: df.join(inside.select(F.col("node").alias("src"), F.col("rank").alias("within")), "src", "left")
    asked = passed.join(taken.join(sources.withColumnRenamed("node", "src"), "src", "left_semi").select("param").distinct(), "param", "left_semi")
    given = asked.where("src IS NULL").select("param", "site", "rank").union(asked.where("src IS NOT NULL").drop("rank").join(at, "src").select("param", "site", "rank"))
    # Sites first: they are many, parameters few, and sorting compares the first alone where it can.
    through = returned(last.join(taken, "src")).join(given, ["site", "param"], "left").select(node("dst"), F.greatest("within", "rank").alias("rank"))
    aside = returned(last.join(taken.select("src").distinct(), "src", "left_anti")).select(node("dst"), F.col("within").alias("rank"))
    ends = last_flows.join(at, "src", "left").select(node("dst"), "rank")
    along = chains.join(found.withColumnRenamed("node", "to"), "to").select("node", "rank")
    alone = arguments.select(node("src"), F.lit(None).cast("int").alias("rank"))
    every = union(through, aside, ends, along, found, own, alone).where("node IS NOT NULL")
    return every.groupBy("node").agg(F.max("rank").alias("rank")).select("node", verdict_name(F.coalesce("rank", unknown)).alias("verdict"))
