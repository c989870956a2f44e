"""Mixing sources to target weights: blocks of words, multinomial draws per shard, permuted indexes.

Documents of a source are packed end to end, in the order of a hash of their row, into blocks of a fixed number of words. The mix is a
row of output shards with a fixed number of slots each; every slot draws its source, so a shard's counts are one multinomial draw
from the target weights. The slots of a source are counted through all shards, and a pseudorandom permutation of
the source's block indexes says which block each takes; beyond the last block a further permutation begins, so that no block is
taken twice before all are taken once. Slots meet blocks by a join on source and index.

Draws alone would miss the targets by a few blocks. What a source draws beyond its quota goes, slot by slot, to sources
that drew less, and the last block of a source is cut, so that each gets its target to the word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import ASCII_SPACE, cut, row_key, table
from siftline.llm.lines import STRIPPED

#: Words of a block, slots of an output shard, rounds of a permutation, cells in which draws meet sources.
BLOCK, SLOTS, ROUNDS, CELLS = 2048, 512, 64, 1024
#: Documents of a source are ranked in so many buckets by their hash, shards in runs of so many.
BUCKETS, RUN = 4096, 1024
#: Equal rows are expanded in runs of so many.
COPIES = 4096


@dataclass(frozen=True)
class Mix:
    """``sources`` (``s, source, source_size, target, quota``), ``slots`` (``shard, slot, s, epoch, block, take``) and ``spans``:
    ``s, key, copy, id, size, shard, slot, at, first, n``: the words ``first`` to ``first + n`` of a document, and where in its block they
    begin; a stretch that the mix does not take has no shard and ``n`` 0, so every document has a row."""

    sources: DataFrame
    slots: DataFrame
    spans: DataFrame


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+``, without an array of the words; null has none."""
    word = rf"[^{ASCII_SPACE[1:-1]}]+{ASCII_SPACE}*"
    return F.char_length(F.regexp_replace(F.ltrim(F.coalesce(text, F.lit("")), F.lit(STRIPPED)), word, "x")).cast("long")


def permuted(index: Column, size: Column, *keys: Column, inverse: bool = False) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 to ``size - 1`` that ``keys`` choose.

    A swap-or-not shuffle: each round pairs every index with another by a reflection and swaps the two or does
    not, as a hash of the greater says. Rounds are their own inverses, so the inverse has them in reverse.
    """
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def swapped(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), size) - x, size)
        return F.when(F.xxhash64(*keys, r, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.reverse(rounds) if inverse else rounds, index, swapped)


def sum_before(rows: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the same ``keys`` that come before, where a key may have any share of the rows.

    Rows come by ``block``, then by ``order``. Blocks are summed by themselves; each begins at the sum of those before it. ``rows`` is read twice.
    """
    marked = rows.withColumns({"__block": block, "__value": value})
    sums = marked.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    running = lambda by, order_, what: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(*order_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*keys, "__block", running(keys, ["__block"], "__sum").alias("__start"))
    within = marked.withColumn("__within", running([*keys, "__block"], order, "__value"))
    return within.join(starts, [*keys, "__block"]).select(*rows.columns, (F.col("__start") + F.col("__within")).alias(name))


def targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """``target`` of each source of ``sizes`` (``code, source_size``), and ``s``, its place by ``code``, whose weight is next in ``weights``, over and over.

    All share ``share`` times all sizes by weight; no target is above ``most`` times its source's size, and what is over goes to the others by
    weight until none is above. So targets are a level times the weight, or the cap. Each number of capped sources, in the order in which they
    reach their caps, gives a level that is too low if it is the wrong number; so the greatest is right. Sources are few rows, numbered in one task.
    """
    if min(weights) <= 0 or not 0 <= share <= most:
        raise ValueError("weights must be above 0, and the share at most the number of times that a source may be taken")
    place = F.row_number().over(Window.orderBy("code")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    known = sizes.select("code", "source_size", place.alias("s"), weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    levelled = known.withColumn("level", left / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max("level").over(everything)
    return levelled.withColumn("target", F.least("cap", level * F.col("weight"))).select("s", "code", "source_size", "target")


def quotas(known: DataFrame, block: int, seed: int) -> DataFrame:
    """``want`` words, ``blocks``, words of the ``last`` block, ``quota`` of slots, and ``rest``: words of the last, begun epoch.

    The quota is the least number of slots whose blocks have the wanted words; it depends on whether the short last block is among the begun
    epoch's first ones, so its ``place`` there is looked up by the inverse permutation.
    """
    size, want = F.col("source_size"), F.col("want")
    counted = known.withColumns({"want": F.round("target").cast("long"), "h": F.xxhash64(F.lit(seed), "code")})
    sized = counted.withColumns(
        {
            "blocks": F.ceil(size / block).cast("long"),
            "last": size - F.greatest(F.ceil(size / block).cast("long") - 1, F.lit(0)) * block,
            "epochs": F.when(size > 0, F.floor(want / size)).otherwise(0).cast("long"),
        }
    ).withColumn("rest", want - F.col("epochs") * size)
    placed = sized.withColumn("place", F.when(F.col("rest") > 0, permuted(F.col("blocks") - 1, F.col("blocks"), F.col("h"), F.col("epochs"), inverse=True)))
    plain = F.ceil(F.col("rest") / block).cast("long")
    begun = F.when(F.col("place") < plain, F.ceil((F.col("rest") + block - F.col("last")) / block).cast("long")).otherwise(plain)
    return placed.withColumn("quota", F.col("epochs") * F.col("blocks") + begun)


def drawn(sources: DataFrame, per_shard: int, seed: int) -> DataFrame:
    """``shard, slot, s, j``: each slot's source and the how-manieth of its source it is, through all shards in order."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).head()[0] or 0
    width = max(1, -(-total // CELLS))
    # A source has the draws from ``low`` on, as many as its quota; it meets them in the cells that these lie in.
    low = F.coalesce(F.sum("quota").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("low")
    bounds = sources.where("quota > 0").select("s", low, "quota")
    high = F.col("low") + F.col("quota")
    in_cells = bounds.select("s", "low", high.alias("high"), F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((high - 1) / width))).alias("cell"))
    numbered = spark.range(total).select(F.floor(F.col("id") / per_shard).alias("shard"), (F.col("id") % per_shard).cast("int").alias("slot"))
    draws = numbered.withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(1, total)))).withColumn("cell", F.floor(F.col("u") / width))
    picked = draws.join(in_cells, "cell").where("u >= low AND u < high").select("shard", "slot", "s")
    counts = cut(picked.groupBy("shard", "s").agg(F.count("*").alias("m")))
    offsets = sum_before(counts, ["s"], F.floor(F.col("shard") / RUN), ["shard"], F.col("m"), "before")
    rank = F.row_number().over(Window.partitionBy("shard", "s").orderBy("slot")) - 1
    placed = cut(picked.withColumn("rank", rank).join(offsets.select("shard", "s", "before"), ["shard", "s"]).select("shard", "slot", "s", (F.col("before") + F.col("rank")).alias("j")))
    got = counts.groupBy("s").agg(F.sum("m").alias("m"))
    owed = cut(sources.select("s", "quota").join(got, "s", "left").select("s", "quota", F.coalesce("m", F.lit(0)).alias("m")))
    before = lambda what: F.coalesce(F.sum(what).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = owed.where("m > quota").select("s", "quota", before(F.col("m") - F.col("quota")).alias("e0"))
    under = owed.where("m < quota").select("s", "quota", "m", before(F.col("quota") - F.col("m")).alias("e0"))
    given = under.select(F.explode(F.sequence(F.col("m"), F.col("quota") - 1)).alias("j"), "s", "m", "e0").select((F.col("e0") + F.col("j") - F.col("m")).alias("e"), F.col("s").alias("to"), F.col("j").alias("to_j"))
    marked = placed.join(over, "s", "left").withColumn("e", F.when(F.col("j") >= F.col("quota"), F.col("e0") + F.col("j") - F.col("quota")))
    stays = marked.where("e IS NULL").select("shard", "slot", "s", "j")
    moves = marked.where("e IS NOT NULL").join(given, "e").select("shard", "slot", F.col("to").alias("s"), F.col("to_j").alias("j"))
    return stays.unionByName(moves)


def filled(draws: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """``shard, slot, s, epoch, block, take``: the block of each slot and how many of its words are taken."""
    known = draws.join(sources.select("s", "h", "blocks", "last", "quota", "rest", "place"), "s")
    indexed = known.withColumns({"epoch": F.floor(F.col("j") / F.col("blocks")), "i": F.col("j") % F.col("blocks")})
    mapped = indexed.withColumn("block", permuted(F.col("i"), F.col("blocks"), F.col("h"), F.col("epoch")))
    whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("last")).otherwise(F.lit(block).cast("long"))
    before = F.col("i") * block - F.when(F.col("place") < F.col("i"), block - F.col("last")).otherwise(0)
    take = F.when((F.col("j") == F.col("quota") - 1) & (F.col("rest") > 0), F.col("rest") - before).otherwise(whole)
    return mapped.select("shard", "slot", "s", "epoch", "block", take.alias("take"))


def pieces(packed: DataFrame, block: int) -> DataFrame:
    """``s, key, copy, id, size, block, at, first, n``: the stretch of each document in each block that it reaches.

    Documents without words have one stretch of none, in a block of their own that no slot takes.
    """
    # Equal rows are one row until here. Many of them are first dealt out in runs, so that no task expands all.
    runs = packed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    dealt = runs.where(F.col("copies") <= COPIES).unionByName(runs.where(F.col("copies") > COPIES).repartition("key", "run"))
    copies = dealt.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + COPIES, F.col("copies")) - 1))).withColumn("begin", F.col("start") + F.col("copy") * F.col("size"))
    end = F.col("begin") + F.col("size")
    reached = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / block), F.floor((end - 1) / block))).otherwise(F.array(-1 - F.pmod(F.xxhash64("key", "copy"), F.lit(1 << 40))))
    cut_up = copies.withColumns({"end": end, "block": F.explode(reached)})
    low = F.when(F.col("size") > 0, F.greatest("begin", F.col("block") * block)).otherwise(F.col("begin"))
    n = F.when(F.col("size") > 0, F.least("end", (F.col("block") + 1) * block) - low).otherwise(0)
    return cut_up.select("s", "key", "copy", "id", "size", "block", F.when(F.col("size") > 0, low - F.col("block") * block).otherwise(0).alias("at"), (low - F.col("begin")).alias("first"), n.alias("n"))


def mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    most: int = 2,
    block: int = BLOCK,
    per_shard: int = SLOTS,
    seed: int = 42,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> Mix:
    """All documents' words mixed by source: see ``Mix`` for what is returned.

    Sources, by code point and null last, weigh ``weights``, over and over, and share ``share`` times all words; none is taken over ``most`` times.
    A null text has no words; null ids and ids that repeat are allowed, and equal rows (same id, text and source) each have a place; texts
    are read once for their number of words, and of any length; an empty table gives an empty mix; other columns are not read. The same rows and
    ``seed`` give the same mix, however the table is split. What is shuffled is some numbers a document, block and slot.
    """
    source = F.col(source_column).cast("string")
    code = F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))
    rows = docs.select(F.col(id_column).alias("id"), code.alias("code"), word_count(F.col(text_column)).alias("size"), row_key(id_column, text_column).alias("key"))
    distinct = cut(rows.groupBy("code", "key", "id", "size").agg(F.count("*").alias("copies")))
    sizes = distinct.groupBy("code").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = cut(quotas(targets(sizes, weights, share, most), block, seed))
    keyed = distinct.join(sources.select("code", "s"), "code").drop("code")
    bucket = F.shiftrightunsigned(F.xxhash64("key"), 52)
    packed = sum_before(cut(keyed.withColumn("order", F.xxhash64("key"))), ["s"], bucket, ["order", "key"], F.col("size") * F.col("copies"), "start")
    slots = cut(filled(drawn(sources, per_shard, seed), sources, block))
    met = pieces(packed, block).join(slots.select("s", "block", "shard", "slot", "take"), ["s", "block"], "left")
    held = F.when(F.col("take").isNull(), 0).otherwise(F.greatest(F.least("n", F.col("take") - F.col("at")), F.lit(0))).cast("long")
    reached = lambda c: F.when(held > 0, F.col(c)).alias(c)
    spans = met.select("s", "key", "copy", "id", "size", reached("shard"), reached("slot"), "at", "first", held.alias("n"))
    named = sources.withColumn("source", F.when(F.col("code") != "1", F.substring("code", 2, 1 << 30)))
    return Mix(named.select("s", "source", "source_size", "target", "quota"), slots, spans)


def mixed_texts(mixed: Mix, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``shard, slot, s, words``: the words of each slot, in the block's order; to be written, say, partitioned by shard.

    A text is split once for each run of its copies and its words are dealt to their slots; a slot has as many words as a block.
    """
    texts = docs.select(row_key(id_column, text_column).alias("key"), F.col(text_column).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    wanted = mixed.spans.where("n > 0").groupBy("key", F.floor(F.col("copy") / COPIES).alias("run")).agg(F.collect_list(F.struct("shard", "slot", "s", "at", "first", "n")).alias("spans"))
    split = wanted.join(texts, "key").withColumn("words", F.array_remove(F.split("text", f"{ASCII_SPACE}+", -1), ""))
    cut_out = split.select(F.inline(F.transform("spans", lambda x: F.struct(x["shard"].alias("shard"), x["slot"].alias("slot"), x["s"].alias("s"), x["at"].alias("at"), F.slice(F.col("words"), (x["first"] + 1).cast("int"), x["n"].cast("int")).alias("words")))))
    parts = F.array_sort(F.collect_list(F.struct("at", "words")))
    return cut_out.groupBy("shard", "slot", "s").agg(F.flatten(F.transform(parts, lambda x: x["words"])).alias("words"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each of the ``documents`` the mix takes; sources weigh 3, 1, 2 in turn."""
    mixed = mix(table(spark, sf_dir, "documents"), [3, 1, 2])
    taken = mixed.spans.groupBy("s", "key", "copy", "id", "size").agg(F.sum("n").alias("taken"))
    return taken.join(mixed.sources, "s").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


QUERIES = {"op12_mixing": op12_mixing}
#: Which blocks are taken follows from hashes in rounds, which is not for SQL; a plain version in the tests says the same.
ORACLES: dict[str, str] = {}
