"""Phrase collocation mining: merged count-min sketches, exact counts of what survives, scores, subsumption.

A first pass over the texts counts the phrases of each task and adds them to a count-min sketch, whose cells stop counting at the
least count wanted. The sketches of all tasks are merged block by block, and of each merged cell one bit is left: whether it
reached that count. A sketch never counts too little, so a phrase one of whose cells is below the bound is rare for certain. A second
pass counts the others exactly; what the sketch let through by mistake is then dropped by its true count. So the
size of the sketch decides how much is shuffled, and never what is found.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import arrow_rows, cut, joined_with_hot, table
from siftline.llm.lines import LOWER, UPPER

#: Rows of a sketch; its cells a row, as a power of two between these for a text of so many bytes a cell; cells of a block.
DEPTH, LEAST_CELLS, MOST_CELLS, BYTES_A_CELL, BLOCK = 2, 1 << 16, 1 << 26, 32, 1 << 14
#: What a task holds before it passes counts on: words not yet counted, numbered words, distinct phrases; bytes of a text split at once.
WORDS, NUMBERED, PHRASES, SLICE = 1 << 19, 1 << 19, 1 << 21, 1 << 19
#: A phrase is a number of three fields of so many bits, which hold its words' numbers.
BITS = 21
LONGEST = 3

BOUNDARY = b"\n"
PLAIN = bytes.maketrans(UPPER.encode() + b".,;:!?\x0a\x0b\x0c\x0d\t", LOWER.encode() + BOUNDARY * 10 + b" ")
GAP = re.compile(rb"[ \n]")


class Numbers(dict):
    """Numbers of words from 1, given as they are met; 0 is the boundary of pieces, -1 what stands between two blanks."""

    def __init__(self) -> None:
        super().__init__({b"": -1, BOUNDARY: 0})
        self.words, self.hashes = [BOUNDARY], array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        self[word] = number = len(self.words) - 1
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return found[found >= 0]


def slices(text: str) -> Iterator[list[bytes]]:
    """A text's words, slice by slice, with boundaries between pieces and at the end, and nothing between two blanks."""
    data, at = text.encode().translate(PLAIN), 0
    while at < len(data):
        gap = GAP.search(data, at + SLICE)
        end = gap.end() if gap else len(data)
        yield data[at:end].replace(BOUNDARY, b" \n ").split(b" ")
        at = end
    yield [BOUNDARY]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(lang: str, keys: np.ndarray, numbers: Numbers, cells: int) -> Iterator[np.ndarray]:
    """The cell of each phrase in each row of a sketch; it depends on the language and the words alone."""
    hashes, field = np.array(numbers.hashes), (1 << BITS) - 1
    x = np.full(len(keys), xxhash.xxh64_intdigest(lang), dtype=np.uint64)
    for shift in range(BITS * (LONGEST - 1), -1, -BITS):
        x = mixed(x + hashes[(keys >> shift) & field])
    step = mixed(x) | np.uint64(1)
    for row in range(DEPTH):
        yield ((x + np.uint64(row) * step) & np.uint64(cells - 1)).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def phrases(rows: Iterator[tuple], wanted: Callable[[str, np.ndarray, Numbers], np.ndarray] | None = None) -> Iterator[tuple[str, np.ndarray, np.ndarray, Numbers, int]]:
    """``lang``, phrases as numbers, their counts, the numbering, and how many words there were, again and again.

    Counts are exact within what is passed on at once, and a phrase may be passed on many times. Memory is bounded by the constants above,
    whatever the texts. ``wanted`` says which phrases to count.
    """
    numbers = Numbers()
    waiting: dict[str, list[np.ndarray]] = {}
    carried: dict[str, np.ndarray] = {}
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    words: dict[str, int] = {}
    n_waiting = n_held = 0

    def count() -> int:
        """Counts the waiting words' phrases; a phrase's last word must be among these, others were waiting before."""
        nonlocal n_waiting
        found = 0
        for lang, parts in waiting.items():
            before = carried.get(lang, np.zeros(0, dtype=np.int64))
            ids = np.concatenate([before, *parts])
            keys, key, real = [], np.zeros(len(ids), dtype=np.int64), np.ones(len(ids), dtype=bool)
            for back in range(LONGEST):
                word = ids[: len(ids) - back]
                key[back:] |= word << (BITS * back)
                real[back:] &= word > 0
                real[:back] = False
                keys.append(key[len(before) :][real[len(before) :]])
            words[lang] = words.get(lang, 0) + len(keys[0])
            carried[lang] = ids[-(LONGEST - 1) :]
            distinct, n = np.unique(np.concatenate(keys), return_counts=True)
            if wanted:
                chosen = wanted(lang, distinct, numbers)
                distinct, n = distinct[chosen], n[chosen]
            held.setdefault(lang, []).append((distinct, n))
            found += len(distinct)
        waiting.clear()
        n_waiting = 0
        return found

    def passed() -> Iterator[tuple[str, np.ndarray, np.ndarray, Numbers, int]]:
        for lang, parts in held.items():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield lang, keys, counts, numbers, words.pop(lang, 0)
        held.clear()

    for lang, text in rows:
        for part in slices(text):
            ids = numbers.of(part)  # it may be another numbering than the last slice's
            waiting.setdefault(lang, []).append(ids)
            n_waiting += len(ids)
            if n_waiting < WORDS and len(numbers.words) < NUMBERED:
                continue
            n_held += count()
            full = n_held >= PHRASES
            if full:
                held.update({lang_: [summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for lang_, parts in held.items()})
                n_held = sum(len(keys) for ((keys, _),) in held.values())
            if full and n_held >= PHRASES // 2 or len(numbers.words) >= NUMBERED:
                yield from passed()
                n_held, old, numbers = 0, numbers, Numbers()
                for lang_, ids in carried.items():
                    carried[lang_] = np.array([numbers[old.words[i]] for i in ids], dtype=np.int64)
    count()
    yield from passed()


def sparse(block: np.ndarray) -> bytes:
    """The cells of a block that are not zero: how far each is from the last, by low and high byte, and their counts."""
    at = np.flatnonzero(block)
    gaps = np.diff(at, prepend=0)
    return b"".join(x.astype(np.uint8).tobytes() for x in (gaps & 255, gaps >> 8)) + block[at].tobytes()


def added(total: np.ndarray, packed: bytes, kind: np.dtype, most: int) -> None:
    """Adds what ``sparse`` made of a block of ``kind`` to ``total``, which counts to ``most``."""
    n = len(packed) // (2 + kind.itemsize)
    gaps = np.frombuffer(packed, np.uint8, n).astype(np.int64) + (np.frombuffer(packed, np.uint8, n, n).astype(np.int64) << 8)
    at = np.cumsum(gaps)
    total[at] = np.minimum(total[at] + np.frombuffer(packed, kind, n, 2 * n), most)


def sketched(texts: DataFrame, cells: int, least: int) -> DataFrame:
    """``block, cells``: the blocks of each task's sketch that are not empty, compressed; cells count to ``least``."""
    kind = np.min_scalar_type(least)

    def sketch(rows: Iterator[tuple]) -> Iterator[tuple]:
        table_ = np.zeros((DEPTH, cells), dtype=kind)
        for lang, keys, counts, numbers, _ in phrases(rows):
            for row, place in zip(table_, places(lang, keys, numbers, cells), strict=True):
                at, n = summed(place, np.minimum(counts, least))
                row[at] = np.minimum(row[at] + n, least)
        packer = zstandard.ZstdCompressor(level=1)
        for number, block in enumerate(table_.reshape(-1, BLOCK)):
            if block.any():
                yield number, packer.compress(sparse(block))

    return arrow_rows(texts, sketch, "block int, cells binary", [pa.int32(), pa.binary()], 512)


def reached(sketches: DataFrame, least: int) -> DataFrame:
    """``block, bits``: which cells of the merged sketch reach ``least``. A block's sketches are added up one after another."""
    kind = np.min_scalar_type(least)

    def merged(rows: Iterator[tuple]) -> Iterator[tuple]:
        unpacker, now, total = zstandard.ZstdDecompressor(), None, np.zeros(BLOCK, dtype=np.int64)
        for number, packed in rows:
            if number != now:
                if now is not None:
                    yield now, np.packbits(total >= least).tobytes()
                now, total = number, np.zeros(BLOCK, dtype=np.int64)
            added(total, unpacker.decompress(packed), kind, least)
        if now is not None:
            yield now, np.packbits(total >= least).tobytes()

    return arrow_rows(sketches.repartition("block").sortWithinPartitions("block"), merged, "block int, bits binary", [pa.int32(), pa.binary()])


def cells_for(n_bytes: int) -> int:
    """Cells of a row of the sketch for so many bytes of text."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (n_bytes // BYTES_A_CELL).bit_length()))


def survivors(texts: DataFrame, least: int, cells: int | None = None) -> DataFrame:
    """``lang, phrase, f``: exact counts of all phrases of one to three words with ``least`` occurrences or more, in bytes' order
    split by blanks; in the row with the empty phrase the number of words.

    ``texts`` (``lang, text``, neither null) is read twice. The sketch has a cell for ``BYTES_A_CELL`` bytes of text, but
    no more than ``MOST_CELLS`` a row: beyond some 2 GB for each of these, more rare phrases are counted exactly, then dropped, with the same
    result. All that is broadcast is a bit a cell, 17 MB at most. A task's counts travel in compressed runs of phrases that share a hash, whose rows meet
    in one task and are added up there first.
    """
    spark = texts.sparkSession
    size = cells or cells_for(texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0)
    bits = np.zeros((DEPTH * size // BLOCK, BLOCK // 8), dtype=np.uint8)
    for block, packed in reached(sketched(texts, size, least), least).collect():
        bits[block] = np.frombuffer(packed, dtype=np.uint8)
    common = spark.sparkContext.broadcast(bits.reshape(DEPTH, -1))

    def frequent(lang: str, keys: np.ndarray, numbers: Numbers) -> np.ndarray:
        chosen = np.ones(len(keys), dtype=bool)
        for row, place in zip(common.value, places(lang, keys, numbers, size), strict=True):
            chosen &= (row[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        return chosen

    n_runs = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exact(rows: Iterator[tuple]) -> Iterator[tuple]:
        packer = zstandard.ZstdCompressor(level=1)
        for lang, keys, counts, numbers, n in phrases(rows, frequent):
            yield lang, 0, packer.compress(b""), packer.compress(np.int64(n).tobytes())
            run = next(places(lang, keys, numbers, 1 << 62)) % n_runs
            order = np.argsort(run, kind="stable")
            ends, words, field = np.searchsorted(run[order], np.arange(n_runs + 1)).tolist(), numbers.words, (1 << BITS) - 1
            for number, (first, end) in enumerate(pairwise(ends)):
                if first < end:
                    at = order[first:end]
                    parts = ((key >> 2 * BITS, (key >> BITS) & field, key & field) for key in keys[at].tolist())
                    told = b"\n".join(b"%b %b %b" % (words[a], words[b], words[c]) if a else b"%b %b" % (words[b], words[c]) if b else words[c] for a, b, c in parts)
                    yield lang, number, packer.compress(told), packer.compress(counts[at].astype(np.min_scalar_type(counts[at].max())).tobytes())

    runs = arrow_rows(texts, exact, "lang string, run int, phrases binary, counts binary", [pa.string(), pa.int32(), pa.binary(), pa.binary()], 256)
    counted = unpacked(runs.repartition("run"))
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def unpacked(runs: DataFrame) -> DataFrame:
    """``lang, phrase, f`` of runs of phrases, which travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                told = unpacker.decompress(row["phrases"]).split(b"\n")
                packed = unpacker.decompress(row["counts"])
                counts = np.frombuffer(packed, dtype=f"u{len(packed) // len(told)}").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(told)), pa.array(told, pa.binary()).cast(pa.string()), pa.array(counts)], names=["lang", "phrase", "f"])

    return runs.mapInArrow(run, "lang string, phrase string, f long")


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 a a / (left right))`` over whole numbers; counts may have 16 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide(a) * wide(a), wide(left) * wide(right)).cast("long")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, n_words, a, k, l, r, score`` of each phrase of two words or more, cut where it scores least.

    Both parts of a phrase are as frequent as the phrase at least, so they are among ``counts``, which must be written. Very common words begin or end
    very many phrases; those are dealt by the phrase.
    """
    n_words = F.size(F.split("phrase", " "))
    part = lambda first, n: F.array_join(F.slice(F.split("phrase", " "), first, n), " ").alias("part")
    candidates = counts.where("phrase LIKE '% %'").select("lang", "phrase", F.col("f").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), n_words - 1)).alias("k"))
    known = lambda f: counts.where("phrase <> ''").select("lang", F.col("phrase").alias("part"), F.col("f").alias(f))
    with_left = joined_with_hot(cuts.select("*", part(F.lit(1), F.col("k"))), known("l"), ["lang", "part"], "l", ["l"], F.xxhash64("phrase"))
    tails = with_left.drop("part").select("*", part(F.col("k") + 1, n_words - F.col("k")))
    with_both = joined_with_hot(tails, known("r"), ["lang", "part"], "r", ["r"], F.xxhash64("phrase"))
    valued = with_both.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    least = valued.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", n_words.alias("n_words"), "a", "cut.k", "cut.l", "cut.r", "cut.score")


def without_parts(candidates: DataFrame, share: int) -> DataFrame:
    """``candidates`` without those that stand within a longer one that has ``share`` hundredths of their occurrences."""
    words = F.split("phrase", " ")
    longer = candidates.where("n_words > 2").select("lang", "a", words.alias("words"), F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m"))
    starts = longer.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("at"))
    inside = starts.groupBy("lang", F.array_join(F.slice("words", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longest"))
    return candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * share)).drop("longest")


def first_by(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key, with their ``rank``; a key's rows are first cut to as many in each of many parts."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = rows.withColumn("__part", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    cut_down = parts.withColumn("rank", rank(key, "__part")).where(F.col("rank") <= most).drop("rank", "__part")
    return cut_down.withColumn("rank", rank(key)).where(F.col("rank") <= most)


def collocations(
    docs: DataFrame,
    min_count: int = 10,
    share: int = 50,
    most: int = 2000,
    cells: int | None = None,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, n_words, a, l, r, k, n, score``: each language's ``most`` best phrases of two and three words.

    Texts, A-Z in lower case, are split at ``.,;:!?`` and U+000A to U+000D into pieces, and these at blanks and tabs into words; phrases
    stand within pieces. ``a`` counts a phrase, ``l`` and ``r`` the two parts where it scores least, ``n`` all words of the language; phrases
    under ``min_count`` do not count, nor those of which a longer phrase has ``share`` hundredths. Best are the highest scores, then counts, then bytes.

    A null text is empty, a null language ``und``; repeated rows count each; texts are read whole, slice by slice; an empty table, and a language without
    a frequent phrase, gives no row; other columns are not read. ``cells`` (a power of two) changes what is shuffled, not what is found.
    """
    if min_count < 1 or (cells or LEAST_CELLS) & ((cells or LEAST_CELLS) - 1) or (cells or BLOCK) < BLOCK:
        raise ValueError("a count of at least 1 is needed, and cells that are a power of two and fill a block")
    texts = docs.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counts = cut(survivors(texts, min_count, cells))
    candidates = cut(scored(counts))
    best = first_by(without_parts(candidates, share), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    words = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "n_words", "a", "l", "r", "k", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op11_collocations": op11_collocations}

ORACLES = {
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
        ), grams AS (
            SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
            FROM words, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size
        ), f AS (
            SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase
        ), totals AS (
            SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10
        ), cuts AS (
            SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
            FROM candidates c, (SELECT unnest([1, 2]) AS k) WHERE k < size
        ), valued AS (
            SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
                (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
        ), least AS (
            SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inside AS (
            SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE size = 3
        ), longest AS (
            SELECT lang, phrase, max(a) AS longest FROM inside GROUP BY lang, phrase
        ), kept AS (
            SELECT least.* FROM least LEFT JOIN longest USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """
}
