"""SimHash near-duplicate detection by tiled exact comparison of 64-bit fingerprints.

A fingerprint bit is set if more than half of the hashes of a text's word shingles have it set.
Equal fingerprints are first made one. The others are laid out in tiles by their population
counts: one count for each of four 16-bit blocks. Two fingerprints that differ in ``radius`` bits
differ by no more than ``radius`` in the sum of their blocks' counts, so a tile meets only the
tiles whose counts lie that near; all other tile pairs are skipped. A tile that holds many
fingerprints is dealt in parts, and so are those that visit it, so that no task gets more than a
bounded number for one comparison. Within a task two parts are compared by numpy, all against
all, with exclusive-or and bit counts, in slabs of bounded size. A comparison returns a spanning
forest of the links it finds, not the pairs, so thousands of near copies return thousands of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import arrow_rows, cut, joined_with_hot, row_key, table
from siftline.llm.graph import components

BLOCKS, BLOCK_BITS = 4, 16
SKETCH = 64
#: A sketch's permutations of hashes: products with odd numbers modulo 2^64.
PERMUTATIONS = np.random.default_rng(4).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a sketch that make a band, and texts that a part of a band has on average, at most.
BAND, BAND_TEXTS = 4, 4096
#: Candidates' estimates may lie so many standard errors below the similarity.
ERRORS = 5
#: Texts, and their shingles, that a part of a group of candidates has on average, at most.
GROUP_TEXTS, GROUP_SHINGLES = 2048, 1 << 22
#: A byte's bits, each in a byte lane of a 64-bit word: 255 such words add up without a carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; of all its words if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    spans = map(slice, starts, ends[shingle_words - 1 :].tolist() or [len(joined)])
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(42)), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if over half of the hashes have it set; 0 of no hashes."""
    if not len(hashes):
        return 0
    lanes = LANES[hashes.view(np.uint8).reshape(-1, 8)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(lanes), 255):
        counts += lanes[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The 64-bit fingerprint of a text's word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle_words))


def sketch(hashes: np.ndarray) -> bytes:
    """A byte, not 0, of the least hash under each of ``SKETCH`` permutations; zeros of no hashes."""
    if not len(hashes):
        return bytes(SKETCH)
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * PERMUTATIONS).min(axis=0), out=least)
    return (((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def fingerprints(
    docs: DataFrame, shingle_words: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id``, ``fp`` (the fingerprint's 64 bits as a signed long) for each row of ``docs``.

    A null text counts as empty; texts without words get 0; repeated rows stay repeated.
    """

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in source:
            fp = fingerprint(text, shingle_words)
            yield key, fp - (fp >> 63 << 64)

    narrow = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    return arrow_rows(narrow, rows, "id bigint, fp bigint", [pa.int64(), pa.int64()], 16384)


def cell(fp: Column) -> Column:
    """The population counts of the four blocks, packed in one integer."""
    out = F.lit(0)
    for b in range(BLOCKS):
        block = F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        out = out + F.bit_count(block) * 32**b
    return out.cast("int")


def later_cells(radius: int) -> list[int]:
    """Differences between a cell and the cells after it that lie within ``radius``."""
    near = (d for d in product(range(-radius, radius + 1), repeat=BLOCKS) if 0 < sum(map(abs, d)) <= radius)
    return sorted(x for x in (sum(n * 32**b for b, n in enumerate(d)) for d in near) if x > 0)


def links(distinct: DataFrame, radius: int = 2, tile_rows: int = 1024, visitor_rows: int = 4096) -> DataFrame:
    """``a``, ``b``: links that join all of ``distinct``'s ``fp`` that lie within ``radius`` bits, directly or not.

    ``distinct`` must hold each ``fp`` once. The number of cells is at most 17^4, whatever the
    input, and so is the table that says in how many parts each cell is dealt, which is broadcast.
    """
    placed = distinct.select("fp", cell(F.col("fp")).alias("cell"))
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"))
    offsets = F.array(*[F.lit(x) for x in later_cells(radius)])
    # From each cell a fingerprint visits those before it that lie near, and the parts of its own after its part.
    visits = counts.select(F.explode(F.transform(offsets, lambda x: F.col("cell") - x)).alias("cell"), "n")
    visitors = visits.groupBy("cell").agg(F.sum("n").alias("v"))
    dealt = F.broadcast(
        counts.join(visitors, "cell", "left").select(
            F.col("cell").alias("home"),
            F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"),
            F.ceil((F.coalesce("v", F.lit(0)) + F.when(F.col("n") > tile_rows, F.col("n")).otherwise(0)) / visitor_rows)
            .cast("int")
            .alias("parts"),
        )
    )
    spread = F.abs(F.xxhash64("fp"))
    tile = (spread % F.col("tiles")).cast("int")
    part = (F.shiftright(spread, 20) % F.greatest("parts", F.lit(1))).cast("int")
    at_home = placed.join(dealt, placed.cell == dealt.home).select(
        "home", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("visits"), "fp"
    )
    away = (
        placed.select("fp", F.explode(F.transform(offsets, lambda x: F.col("cell") - x)).alias("home"))
        .join(dealt, "home")
        .select("home", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), part.alias("part"), F.lit(1).alias("visits"), "fp")
    )
    between = (
        placed.join(dealt, (placed.cell == dealt.home) & (dealt.tiles > 1))
        .select("home", tile.alias("own"), part.alias("part"), "tiles", "fp")
        .where(F.col("own") > 0)
        .select("home", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("tile"), "part", F.lit(1).alias("visits"), "fp")
    )
    meeting = ["home", "tile", "part"]
    together = at_home.union(away).union(between)
    together = together.repartition(*meeting).sortWithinPartitions(*meeting, "visits")
    return together.mapInArrow(partial(_compare, radius=radius, slab=visitor_rows), "a bigint, b bigint").distinct()


def _compare(batches: Iterator[pa.RecordBatch], radius: int, slab: int) -> Iterator[pa.RecordBatch]:
    """Compares each tile with itself and with its visitors; the rows of a meeting come together, the tile's first."""
    meeting, own, part = None, np.empty(0, np.uint64), 0
    for batch in batches:
        home, tile, part_of, visits, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        fp = fp.astype(np.int64).view(np.uint64)
        key = np.stack([home, tile, part_of, visits])
        begins = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
        for lo, hi in zip([0, *begins.tolist()], [*begins.tolist(), batch.num_rows], strict=True):
            now, rows = (home[lo], tile[lo], part_of[lo]), fp[lo:hi]
            if now != meeting:
                meeting, own, part = now, np.empty(0, np.uint64), int(part_of[lo])
            if visits[lo] == 0:
                before, own = own, np.concatenate([own, rows])
                pairs = [(rows, before), (rows, rows)] if part == 0 else []
            else:
                pairs = [(rows, own)]
            for left, right in pairs:
                for a, b in _near(left, right, radius, slab):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _near(left: np.ndarray, right: np.ndarray, radius: int, slab: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the pairs within ``radius``, slab by slab."""
    if not len(left) or not len(right):
        return
    step = max(1, (slab << 8) // len(right))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        i, j = np.nonzero(np.bitwise_count(some[:, None] ^ right[None, :]) <= radius)
        a, b = some[i], right[j]
        other = a != b
        if other.any():
            yield forest(a[other], b[other])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as join what the pairs join: each value with the smallest that it reaches."""
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(values))
    while True:
        was = root.copy()
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], least)
        np.minimum.at(root, root[right], least)
        root = root[root]
        if np.array_equal(root, was) and np.array_equal(root[left], root[right]):
            break
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def similar_texts(
    docs: DataFrame,
    radius: int = 22,
    similarity: float = 0.8,
    shingle_words: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``k``, ``keeper``: for each different row (``common.row_key``) the row that stays for its group.

    Rows are linked if the Jaccard similarity of their sets of shingles is ``similarity`` or more, by
    exact count. Only candidates are counted: texts that share a band of their sketches meet, and those whose
    fingerprints of the sets lie within ``radius`` bits and whose sketches within ``ERRORS`` standard errors join, directly or not,
    are compared all with all. A group is what links join, directly or not; the smallest id stays, of rows with the same
    id any one, null ids last. Rows without words are all alike.

    A sketch has ``SKETCH / BAND`` bands: a pair at a similarity of 0.8 shares none once in 4,600 times, one at 0.5
    shares one in two of three cases. A band that many texts share is dealt in parts.
    """

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for key, place, text in source:
            hashes = np.unique(shingle_hashes(text, shingle_words))
            fp, same = majority(hashes), xxhash.xxh3_128_digest(hashes.tobytes())
            yield key, place, same, len(hashes), fp - (fp >> 63 << 64), sketch(hashes)

    narrow = docs.select(row_key(id_column, text_column).alias("k"), F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    prints = cut(arrow_rows(narrow, rows, "k binary, id bigint, same binary, n bigint, fp bigint, sketch binary", types))
    # Texts with the same set of shingles are one text here; its number stays its own, as it is written.
    texts = prints.groupBy("same", "n", "fp", "sketch").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k")).alias("first"), F.count("*").alias("rows"))
    texts = cut(texts.withColumn("text", F.monotonically_increasing_id()))
    candidates = components(_similar_links(texts.select("text", "fp", "sketch"), radius, similarity))
    grouped = texts.select(F.col("text").alias("node"), "n", F.col("first.k").alias("k")).join(candidates, "node")
    near = components(_exact_links(grouped, narrow.select("k", "text"), similarity, shingle_words))
    rooted = texts.join(near.withColumnRenamed("node", "text"), "text", "left").withColumn("root", F.coalesce("root", "text"))
    rooted = cut(rooted.select("text", "same", "rows", "root", "first"))
    keepers = cut(rooted.groupBy("root").agg(F.min("first")["k"].alias("keeper"), F.count("*").alias("texts")))
    # A text may have any share of the rows, and a group any share of the texts.
    kept = cut(joined_with_hot(rooted.select("text", "same", "rows", "root"), keepers, ["root"], "texts", ["keeper"], F.xxhash64("text")))
    return joined_with_hot(prints.select("k", "same"), kept.select("same", "rows", "keeper"), ["same"], "rows", ["keeper"], F.xxhash64("k")).select("k", "keeper").distinct()


def _similar_links(texts: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``a``, ``b``: links that join all of ``texts`` (``text``, ``fp``, ``sketch``, written) that share a band and are alike, directly or not.

    A band's texts are dealt by classes of population counts, each in parts, and parts meet in pairs; classes that lie
    further apart than ``radius`` do not.
    """
    bands = [F.xxhash64(F.lit(b), F.substring("sketch", BAND * b + 1, BAND)) for b in range(SKETCH // BAND)]
    each = texts.select("text", F.explode(F.array_distinct(F.array(*bands))).alias("band"))
    shared = cut(each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(joined_with_hot(each, shared, ["band"], "n", ["n"], F.xxhash64("text")))
    placed = met.join(texts, "text").withColumn("parts", F.ceil(F.col("n") / BAND_TEXTS).cast("int"))
    class_ = F.floor(F.bit_count("fp") / (radius + 1)).cast("int")
    part = F.pmod(F.xxhash64("text"), "parts").cast("int")
    meets = F.transform(F.sequence(F.greatest(class_ - 1, F.lit(0)), class_ + 1), lambda c: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: c * F.col("parts") + p))
    # A band that is one part meets itself alone, whatever the classes.
    tile = F.when(F.col("parts") == 1, 0).otherwise(class_ * F.col("parts") + part)
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.flatten(meets))
    dealt = placed.select("band", "text", "fp", "sketch", tile.alias("tile"), F.explode(others).alias("other"))
    i, j = F.least("tile", "other"), F.greatest("tile", "other")
    together = dealt.select("band", i.alias("i"), j.alias("j"), (F.col("tile") != i).cast("int").alias("visits"), "fp", "text", "sketch")
    together = together.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "visits", "text")
    margin = ERRORS * (similarity * (1 - similarity) / SKETCH) ** 0.5
    return together.mapInArrow(partial(_compare_sketches, radius=radius, least=similarity - margin), "a bigint, b bigint").distinct()


def _compare_sketches(batches: Iterator[pa.RecordBatch], radius: int, least: float) -> Iterator[pa.RecordBatch]:
    """As ``_compare``; links carry the texts' numbers and hold only where sketches are alike, too."""
    meeting, sides = None, ([], [])

    def found() -> Iterator[pa.RecordBatch]:
        if meeting is None:
            return
        own, visitors = ([np.concatenate(c) for c in zip(*side, strict=True)] for side in sides)
        others = visitors if meeting[1] != meeting[2] else own
        if own and others:
            for a, b in _alike(own, others, radius, least):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        band, i, j, visits, fp, text = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:6])
        sketches = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
        fp = fp.astype(np.int64).view(np.uint64)
        key = np.stack([band, i, j, visits])
        begins = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
        for lo, hi in zip([0, *begins.tolist()], [*begins.tolist(), batch.num_rows], strict=True):
            if (band[lo], i[lo], j[lo]) != meeting:
                yield from found()
                meeting, sides = (band[lo], i[lo], j[lo]), ([], [])
            sides[visits[lo]].append((fp[lo:hi], text[lo:hi], sketches[lo:hi]))
    yield from found()


def _alike(left: list, right: list, radius: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forests of the pairs whose fingerprints and sketches are alike, slab by slab."""
    step = max(1, (1 << 20) // len(right[0]))
    for at in range(0, len(left[0]), step):
        i, j = np.nonzero(np.bitwise_count(left[0][at : at + step, None] ^ right[0][None, :]) <= radius)
        i += at
        other = left[1][i] < right[1][j] if left is right else left[1][i] != right[1][j]
        i, j = i[other], j[other]
        for some in range(0, len(i), 1 << 18):
            ii, jj = i[some : some + (1 << 18)], j[some : some + (1 << 18)]
            x, y = left[2][ii], right[2][jj]
            same = ((x == y) & (x > 0)).sum(axis=1)
            ok = same >= least * ((x > 0) | (y > 0)).sum(axis=1)
            if ok.any():
                yield forest(left[1][ii[ok]], right[1][jj[ok]])


def _exact_links(grouped: DataFrame, docs: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """``a``, ``b``: links that join all texts of a group of candidates (``node``, ``n``, ``k``, ``root``) that are alike, directly or not.

    ``docs`` (``k``, ``text``) has the texts. A large group is dealt in parts, each of which meets each.
    """
    tiles = F.greatest(F.ceil(F.count("*") / GROUP_TEXTS), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int")
    large = grouped.groupBy("root").agg(tiles.alias("tiles")).where("tiles > 1")
    placed = grouped.join(large, "root", "left").select("k", "root", "node", F.coalesce("tiles", F.lit(1)).alias("tiles"))

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for root, tiles, node, text in source:
            yield root, tiles, node, np.unique(shingle_hashes(text, shingle_words)).tobytes()

    fetched = docs.join(placed, "k").select("root", "tiles", "node", "text")
    sets = arrow_rows(fetched, rows, "root bigint, tiles int, node bigint, shingles binary", [pa.int64(), pa.int32(), pa.int64(), pa.binary()], 1024)
    tile = F.pmod(F.xxhash64("node"), "tiles").cast("int")
    met = sets.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    i, j = F.least("tile", "other"), F.greatest("tile", "other")
    met = met.select("root", i.alias("i"), j.alias("j"), (F.col("tile") != i).cast("int").alias("visits"), "node", "shingles")
    together = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "visits", "node")
    return together.mapInArrow(partial(_compare_sets, similarity=similarity), "a bigint, b bigint")


def _compare_sets(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Compares each part with itself or with its visitors; repeated rows come one after another and count once."""
    meeting, sides = None, ([], [])

    def found() -> Iterator[pa.RecordBatch]:
        if meeting and sides[0] and (sides[1] or meeting[1] == meeting[2]):
            pairs = list(_exactly_alike(sides[0], sides[1], similarity))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])

    for batch in batches:
        for root, i, j, visits, node, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, i, j) != meeting:
                yield from found()
                meeting, sides = (root, i, j), ([], [])
            if not sides[visits] or sides[visits][-1][0] != node:
                sides[visits].append((node, np.frombuffer(shingles, dtype=np.uint64)))
    yield from found()


def _exactly_alike(own: list[tuple], visitors: list[tuple], similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of ``own`` and ``visitors`` (of ``own`` alone if there are none) that are alike."""
    names = [name for name, _ in own + visitors]
    sets = [x for _, x in own + visitors]
    sizes = np.array([len(x) for x in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    held, group = np.zeros(len(values), dtype=bool), np.arange(len(sets))
    for a in range(len(own)):
        after = len(own) if visitors else a + 1
        other = sizes[after:]
        fit = np.minimum(other, sizes[a]) / np.maximum(other, sizes[a]) >= similarity
        b = after + np.flatnonzero(fit & (group[after:] != group[a]))
        if not len(b):
            continue
        held[ids[starts[a] : ends[a]]] = True
        if sizes[b].sum() * 4 > ends[-1] - starts[after]:
            common = np.add.reduceat(held[ids[starts[after] :]], starts[after:] - starts[after], dtype=np.int64)[b - after]
        else:
            common = np.array([np.count_nonzero(held[ids[starts[x] : ends[x]]]) for x in b])
        held[ids[starts[a] : ends[a]]] = False
        b = b[common / (sizes[b] + sizes[a] - common) >= similarity]
        joined, one = np.unique(group[b], return_index=True)
        group[np.isin(group, joined)] = group[a]
        yield from ((names[a], names[x]) for x in b[one])


def near_duplicates(
    docs: DataFrame,
    radius: int = 2,
    shingle_words: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id``, ``fp``, ``component_id`` for each row of ``docs``: the smallest id that links reach.

    Fingerprints link when they differ in ``radius`` bits or fewer. Null texts are empty, texts
    without words have fingerprint 0 and link like any other; rows with a null id stay, and a
    component of such rows alone has a null ``component_id``; repeated rows stay repeated. An empty table gives none; other columns
    are not read; texts are read whole, each with its words in memory; ids are whole numbers.
    """
    prints = cut(fingerprints(docs, shingle_words, id_column, text_column))
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Of a fingerprint, as of that of no words, there may be any number of rows.
    of_print = cut(rooted.select("fp", "n", "root").join(named, "root").select("fp", "n", "component_id"))
    return joined_with_hot(prints, of_print, ["fp"], "n", ["component_id"], F.xxhash64("id"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
