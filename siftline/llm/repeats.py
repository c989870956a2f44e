"""Removal of long repeated byte strings, by run-length indexes of the places that can hold them.

A string of ``LENGTH`` bytes is repeated if it starts at two places of the corpus. Each such string
has an anchor: of the ``GRAM``-byte strings in it, the one with the least hash. Equal strings have
equal anchors at the same offset, so strings are dealt by their anchors' hashes, and no string
meets a string with another anchor. Neighbouring strings with the same anchor make one context.

* An anchor that stands once has no repeated string.
* A context that stands twice is repeated whole; its XXH128 decides that.
* What is left is contexts that share an anchor and differ, at the borders of repeated passages.
  Their bytes are fetched, and tasks build over the contexts of whole anchors the run-compressed
  Burrows-Wheeler transform with positions sampled at both ends of its runs. Between two samples,
  in order of the text, the longest match with the neighbour in suffix order shrinks by one a
  byte, so the matching statistics of every position stream off the samples, and all starts with
  matches of ``LENGTH`` bytes or more are marked.
* An anchor with more different contexts than one index may hold is taken apart first: its strings
  are dealt anew by what all strings in a block of offsets share, and at last one by one.

Passages of ``WORDS`` words are found beside them, of any number of bytes, by the same steps: windows of words,
anchors of ``GRAM_WORDS`` words, whole contexts by XXH128; of what is left, the windows of an anchor are compared by their XXH128.
These are reported, not removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import arrow_rows, cut, joined_with_hot, table

LENGTH = 400
GRAM = 100
#: Words of a repeated passage, and of its anchor.
WORDS, GRAM_WORDS = 50, 8
#: Different contexts of an anchor that go into one index, each of under 2 * LENGTH bytes.
INDEXED = 4000
#: Offsets that share a block when an anchor is taken apart, then each offset alone.
BLOCKS = (24, 1)
#: Bytes of text that are hashed at a time, words, and bytes that are indexed.
CHUNK, CHUNK_WORDS, INDEX_BYTES = 1 << 18, 40_000, 1 << 18
#: What contexts are of.
OF_BYTES, OF_WORDS = 0, 1

# A context: its kind and anchor, its XXH128, its row, its first and last start, its anchor's place, its end.
PLACED = "kind int, a bigint, u1 bigint, u2 bigint, k bigint, lo int, hi int, at int, upto int"
PLACED_TYPES = [pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 4]
STORED = "kind int, a bigint, d bigint, k bigint, lo int, hi int, at int, upto int, data binary"
STORED_TYPES = [pa.int32(), *[pa.int64()] * 3, *[pa.int32()] * 4, pa.binary()]
FOUND = "kind int, k bigint, lo int, upto int"
FOUND_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]


def batch_of(columns: list, types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])


class Hashes:
    """A polynomial hash, modulo 2^64, of any stretch of a buffer. It deals strings out; it decides nothing."""

    base = 0x9E3779B97F4A7C15 | 1
    values = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))

    def __init__(self, data: np.ndarray) -> None:
        if len(Hashes.powers[0]) <= len(data):
            both = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                factors = np.full(max(CHUNK + 4 * LENGTH, len(data)) + 1, b, dtype=np.uint64)
                factors[0] = 1
                both.append(np.multiply.accumulate(factors))
            Hashes.powers = (both[0], both[1])
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * Hashes.powers[0][: len(data)], out=self.sums[1:])

    def of(self, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        back = Hashes.powers[1]
        h = (self.sums[hi] - self.sums[lo]) * (back[lo] if not isinstance(lo, slice) else back[: lo.stop])
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def strong(data: np.ndarray, lo: np.ndarray, upto: np.ndarray) -> list[np.ndarray]:
    """The XXH128 of stretches of a buffer, as two columns."""
    view = memoryview(np.ascontiguousarray(data))
    digests = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(lo.tolist(), upto.tolist(), strict=True)])
    return list(np.frombuffer(digests, dtype=np.int64).reshape(-1, 2).T)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by least from both ends of blocks of that width."""
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(gram: np.ndarray, width: int, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last window, and the anchor, of neighbouring windows with the same anchor; ``whole`` says which windows count."""
    places = np.arange(len(gram), dtype=np.uint64)
    least = sliding_least(gram >> np.uint64(28) << np.uint64(28) | places, width)
    start = np.flatnonzero(whole)
    owner = (least[start] & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(start) else start
    last = np.concatenate([first[1:] - 1, [len(start) - 1]]) if len(start) else start
    return start[first], start[last], owner[first]


def contexts(data: np.ndarray, ends: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """Anchors' hashes, first and last starts, anchors' places and ends of all contexts in a buffer of texts."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < LENGTH:
        return (none,) * 5
    n = len(data) - GRAM + 1
    gram = hashes.of(slice(0, n), slice(GRAM, GRAM + n))
    start = np.arange(len(data) - LENGTH + 1)
    end = np.repeat(ends, np.diff(ends, prepend=0))[: len(start)]
    lo, hi, at = runs(gram, LENGTH - GRAM + 1, start + LENGTH <= end)
    return gram[at].view(np.int64), lo, hi, at, hi + LENGTH


def word_edges(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in a buffer of texts; no word goes from a text into the next."""
    dark = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    inner = begins[begins < len(data)]
    first[inner] = dark[inner]
    inner = ends[ends > 0] - 1
    last[inner] = dark[inner]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_contexts(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: Hashes | None) -> Iterator[tuple[np.ndarray, ...]]:
    """As ``contexts`` for windows of words, so many words at a time; places are in bytes. ``hashes`` are of all the data, if it is not long."""
    first, last = word_edges(data, begins, ends)
    for w in range(0, len(first) - WORDS + 1, CHUNK_WORDS):
        begin, stop = first[w : w + CHUNK_WORDS + WORDS - 1], last[w : w + CHUNK_WORDS + WORDS - 1]
        skip = 0 if hashes else begin[0]
        n = len(begin) - GRAM_WORDS + 1
        gram = (hashes or Hashes(data[skip : stop[-1]])).of(begin[:n] - skip, stop[GRAM_WORDS - 1 :] - skip)
        whole = np.searchsorted(ends, begin[: len(begin) - WORDS + 1], side="right") == np.searchsorted(ends, begin[WORDS - 1 :], side="right")
        lo, hi, at = runs(gram, WORDS - GRAM_WORDS + 1, whole)
        # Anchors of words are not to meet anchors of bytes.
        yield (gram[at] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64), begin[lo], begin[hi], begin[at], stop[hi + WORDS - 1]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Keys and texts of rows ``k``, ``packed``, as many as have ``CHUNK`` bytes together, or one longer text; and all ``anchors`` of these, if there are such."""
    unpack = zstandard.ZstdDecompressor().decompress
    held: list[tuple] = []
    size = 0

    def told() -> tuple[np.ndarray, list[bytes], np.ndarray]:
        keys, texts, anchors = zip(*held, strict=True)
        return np.array(keys, dtype=np.int64), list(texts), np.concatenate(anchors)

    for batch in batches:
        lists = [a.values.to_numpy() for a in batch.column(2)] if batch.num_columns > 2 else [np.empty(0, np.int64)] * batch.num_rows
        for key, data, anchors in zip(batch.column(0).to_pylist(), batch.column(1), lists, strict=True):
            text = unpack(data.as_py())
            if held and size + len(text) > CHUNK:
                yield told()
                held, size = [], 0
            held.append((key, text, anchors))
            size += len(text)
    if held:
        yield told()


def _contexts(keys: np.ndarray, texts: list[bytes]) -> Iterator[tuple]:
    """Kind, anchors' hashes, texts' numbers and places of all contexts of some texts; long texts in overlapping stretches."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    found = []
    for skip in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
        some = data[skip : skip + CHUNK + LENGTH - 1]
        hashes = Hashes(some)
        a, *places = contexts(some, np.minimum(np.maximum(ends - skip, 0), len(some)) if len(texts) == 1 else ends, hashes)
        found.append((OF_BYTES, a, *[p + skip for p in places]))
    found += [(OF_WORDS, *c) for c in word_contexts(data, begins, ends, hashes if len(some) == len(data) else None)]
    for kind, a, *places in found:
        if len(a):
            yield kind, a, np.searchsorted(ends, places[0], side="right"), places, data, begins


def _anchors(batches: Iterator[pa.RecordBatch], of_rows: bool) -> Iterator[pa.RecordBatch]:
    """The anchors of rows ``k``, ``packed``, each as often as it has contexts; with ``of_rows`` once a row, and with its ``k``."""
    for key, texts, _ in _stretches(batches):
        for _, a, doc, *_ in _contexts(key, texts):
            if not of_rows:
                yield pa.RecordBatch.from_arrays([pa.array(a)], names=["a"])
                continue
            order = np.lexsort((a, doc))
            a, doc = a[order], doc[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(key[doc[new]])], names=["a", "k"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of rows ``k``, ``packed``, ``anchors`` that have one of the anchors.

    Rows are read together; an anchor that one of them has in common with others is in the list of each that has it.
    """
    for key, texts, anchors in _stretches(batches):
        for kind, a, doc, places, data, begins in _contexts(key, texts):
            wanted = np.isin(a, anchors)
            a, doc, (lo, hi, at, upto) = a[wanted], doc[wanted], (p[wanted] for p in places)
            if len(a):
                back = begins[doc]
                yield batch_of([np.full(len(a), kind), a, *strong(data, lo, upto), key[doc], *(x - back for x in (lo, hi, at, upto))], PLACED_TYPES, PLACED)


def _apart(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Contexts of bytes taken apart into blocks of ``width`` offsets, each dealt by the bytes that its strings share."""
    for batch in batches:
        for a, k, lo, hi, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(text, dtype=np.uint8)
            hashes = Hashes(data)
            start = np.arange(lo, hi + 1)
            block = (at - start) // width
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            b_lo, b_hi = start[first], start[np.concatenate([first[1:] - 1, [len(start) - 1]])]
            core_lo, core_hi = at - block[first] * width, at - block[first] * width - width + 1 + LENGTH
            core = hashes.of(core_lo - lo, core_hi - lo) ^ (np.uint64(a & (1 << 64) - 1) + block[first].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            n = len(first)
            u = strong(data, b_lo - lo, b_hi - lo + LENGTH)
            yield batch_of([np.full(n, OF_BYTES), core.view(np.int64), *u, np.full(n, k), b_lo, b_hi, np.full(n, at), b_hi + LENGTH], PLACED_TYPES, PLACED)


def windows(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of words begin and end in a buffer of texts."""
    first, last = word_edges(data, begins, ends)
    first, last = first[: max(0, len(first) - WORDS + 1)], last[WORDS - 1 :]
    whole = np.searchsorted(ends, first, side="right") == np.searchsorted(ends, last - 1, side="right")
    return first[whole], last[whole]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of words of the contexts ``k``, ``lo``, ``data``, with its XXH128."""
    for batch in batches:
        for k, lo, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = np.frombuffer(text, dtype=np.uint8)
            first, last = windows(data, np.array([0]), np.array([len(data)]))
            yield batch_of([*strong(data, first, last), np.full(len(first), k), first + lo, last + lo], [pa.int64()] * 3 + [pa.int32()] * 2, "u1 bigint, u2 bigint, k bigint, lo int, upto int")


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of some texts, with positions sampled at the ends of runs.

    Suffixes end with their text; equal ones are in the order of the texts. Order comes from
    ranking ever longer stretches, each twice the one before, up to the longest text.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.data))  # bytes up to the end of the text
        self.ranks: list[tuple[int, np.ndarray]] = []
        n, reach = len(self.data), 7
        key = np.zeros(n, dtype=np.int64)
        for i in range(reach):
            symbol = np.zeros(n, dtype=np.int64)
            symbol[: n - i] = self.data[i:].astype(np.int64) + 1
            symbol[self.left <= i] = 0
            key = key << 9 | symbol
        longest = int(sizes.max(initial=0))
        while True:
            order = np.argsort(key)
            climbs = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if n else np.empty(0, np.int64)
            rank = np.empty(n, dtype=np.int32)
            rank[order] = climbs + 1
            self.ranks.append((reach, rank))
            if reach >= longest or not n or climbs[-1] == n - 1:
                break
            second = np.zeros(n, dtype=np.int64)
            second[: n - reach] = rank[reach:]
            second[self.left <= reach] = 0
            key = rank.astype(np.int64) * (n + 1) + second
            reach *= 2
        order = np.argsort(rank.astype(np.int64) * n + np.arange(n))
        before = np.empty(n, dtype=np.int64)  # the symbol before each suffix; a text's start has one of its own
        before[1:] = self.data[:-1]
        before[self.begins] = -1 - np.arange(len(texts))
        transform = before[order]
        heads = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]])) if n else np.empty(0, np.int64)
        self.symbols = transform[heads]
        self.head_at, self.tail_at = order[heads], order[np.concatenate([heads[1:] - 1, [n - 1]])] if n else order
        #: For each run but the first: the samples at its head and at the tail before it, and their common prefix.
        self.common = self.prefix(self.tail_at[:-1], self.head_at[1:])

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes, from the ranks of ever shorter stretches."""
        a, b, size = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for reach, rank in reversed(self.ranks):
            same = (size + reach <= most) & (rank[np.minimum(a, len(rank) - 1)] == rank[np.minimum(b, len(rank) - 1)])
            a, b, size = a + same * reach, b + same * reach, size + same * reach
        for _ in range(self.ranks[0][0]):
            last = len(self.data) - 1
            same = (size < most) & (self.data[np.minimum(a, last)] == self.data[np.minimum(b, last)])
            a, b, size = a + same, b + same, size + same
        return size

    def long_matches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the neighbouring starts whose match elsewhere has ``length`` bytes or more.

        Matching statistics are streamed in order of the text, once against the suffix before and
        once against the suffix after: they are known at the samples, and fall by one a byte.
        """
        found = []
        alone = np.zeros(1, dtype=np.int64)  # the first suffix has none before it, the last none after
        for at, common in (
            (self.head_at, np.concatenate([alone, self.common])),
            (self.tail_at, np.concatenate([self.common, alone])),
        ):
            order = np.argsort(at)
            at, common = at[order], common[order]
            hi = np.minimum(at + common - length, np.concatenate([at[1:], [len(self.data)]]) - 1)
            found.append((at[common >= length], hi[common >= length]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _gathered(batches: Iterator[pa.RecordBatch], marked: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``marked`` finds in rows ``a``, ``k``, ``lo``, ``data`` that come in order of ``a``, of whole anchors, about ``INDEX_BYTES`` bytes at a time."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= INDEX_BYTES and row[0] != held[-1][0]:
                yield from marked(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield from marked(held)


def _marked(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Strings that the run index of these contexts finds twice."""
    index = RunIndex([row[3] for row in held])
    lo, hi = index.long_matches(LENGTH)
    if len(lo):
        of = np.searchsorted(index.begins, lo, side="right") - 1
        shift = np.array([row[2] for row in held], dtype=np.int64)[of] - index.begins[of]
        k = np.array([row[1] for row in held], dtype=np.int64)[of]
        yield batch_of([np.full(len(k), OF_BYTES), k, lo + shift, hi + shift + LENGTH], FOUND_TYPES, FOUND)


def _marked_words(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Windows of words that stand twice in these contexts; neighbours make one stretch."""
    data = np.frombuffer(b"".join([row[3] for row in held]), dtype=np.uint8)
    ends = np.cumsum([len(row[3]) for row in held])
    begins = np.concatenate([[0], ends[:-1]])
    first, last = windows(data, begins, ends)
    u, v = strong(data, first, last)
    order = np.argsort(u)
    same = (u[order][1:] == u[order][:-1]) & (v[order][1:] == v[order][:-1])
    twice = np.zeros(len(u), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    here = np.flatnonzero(twice)
    if len(here):
        context = np.searchsorted(ends, first[here], side="right")
        parts = np.flatnonzero(np.concatenate([[True], (np.diff(here) > 1) | (np.diff(context) > 0)]))
        begin, end, of = here[parts], here[np.concatenate([parts[1:] - 1, [len(here) - 1]])], context[parts]
        k, lo = (np.array([row[i] for row in held], dtype=np.int64)[of] for i in (1, 2))
        yield batch_of([np.full(len(k), OF_WORDS), k, first[begin] - begins[of] + lo, last[end] - begins[of] + lo], FOUND_TYPES, FOUND)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``k``, ``id``, ``text`` with the text compressed, as it will be written and shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(map(pack, some.column(2).to_pylist()), type=pa.binary())], names=["k", "id", "packed"])


def _sliced(rows: Iterator[tuple]) -> Iterator[tuple]:
    for key, data, wanted in rows:
        text = zstandard.decompress(data)
        for w in wanted:
            yield w["kind"], w["a"], w["d"], key, w["lo"], w["hi"], w["at"], w["upto"], text[w["lo"] : w["upto"]]


def repeated(texts: DataFrame) -> DataFrame:
    """``kind``, ``k``, ``lo``, ``upto``: stretches, in bytes, of repeated strings and passages in rows ``k``, ``packed``, which are written."""
    found: list[DataFrame] = []
    narrow = texts.select("k", "packed")
    place = F.xxhash64("k", "lo")
    common = _common(narrow.mapInArrow(partial(_anchors, of_rows=False), "a bigint"))
    rows = joined_with_hot(narrow.mapInArrow(partial(_anchors, of_rows=True), "a bigint, k bigint"), common, ["a"], "n", [], F.xxhash64("k"))
    # Written first, so that what is joined with the texts is as small as it turns out to be.
    of_row = cut(rows.groupBy("k").agg(F.collect_set("a").alias("anchors")))
    shared = cut(narrow.join(of_row, "k").mapInArrow(_placed, PLACED))
    stored = None
    for width in (*BLOCKS, None):
        same = cut(shared.groupBy("kind", "a", "u1", "u2").agg(F.count("*").alias("n"), F.min(F.struct("k", "lo", "hi", "at", "upto")).alias("one")))
        twice = same.where("n > 1").select("a", "u1", "u2", "n")
        found.append(joined_with_hot(shared, twice, ["a", "u1", "u2"], "n", [], place).select("kind", "k", "lo", "upto"))
        mixed = same.groupBy("a").agg(F.count("*").alias("d"), F.count_if(F.col("n") == 1).alias("single")).where("d > 1 AND single > 0")
        open_ = same.join(mixed, "a").select("kind", "a", "d", "one.*")
        if stored is None:
            wanted = open_.groupBy("k").agg(F.collect_list(F.struct("kind", "a", "d", "lo", "hi", "at", "upto")).alias("wanted"))
            fetched = arrow_rows(texts.join(wanted, "k").select("k", "packed", "wanted"), _sliced, STORED, STORED_TYPES, 512)
        else:
            inner = stored.select("k", F.col("lo").alias("from"), F.col("upto").alias("end"), F.col("data").alias("whole"))
            part = F.substring(F.col("whole"), F.col("lo") - F.col("from") + 1, F.col("upto") - F.col("lo"))
            fetched = open_.join(inner, "k").where("from <= lo AND upto <= end").select("kind", "a", "d", "k", "lo", "hi", "at", "upto", part.alias("data"))
        fetched = cut(fetched)
        of_bytes, of_words = (fetched.where(F.col("kind") == kind) for kind in (OF_BYTES, OF_WORDS))
        for some, marked in ((of_bytes, _marked), (of_words, _marked_words)):
            few = some.where(F.col("d") <= INDEXED).select("a", "k", "lo", "data")
            found.append(few.repartition("a").sortWithinPartitions("a").mapInArrow(partial(_gathered, marked=marked), FOUND))
        many_words = of_words.where(F.col("d") > INDEXED)
        if not many_words.isEmpty():
            found.append(repeated_windows(many_words))
        stored = of_bytes.where(F.col("d") > INDEXED).select("a", "k", "lo", "hi", "at", "upto", "data")
        if width is None or stored.isEmpty():
            break
        placed = stored.select("a", "k", "lo", "hi", "at", "data").mapInArrow(partial(_apart, width=width), PLACED)
        shared = cut(joined_with_hot(placed, _common(placed), ["a"], "n", [], place))
    return reduce(DataFrame.union, found)


def _common(anchors: DataFrame) -> DataFrame:
    return cut(anchors.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"))


def repeated_windows(fetched: DataFrame) -> DataFrame:
    """The windows of words that stand in several of the contexts of anchors with many, window by window."""
    each = cut(fetched.select("k", "lo", "data").mapInArrow(_windows, "u1 bigint, u2 bigint, k bigint, lo int, upto int"))
    counts = cut(each.groupBy("u1", "u2").agg(F.count("*").alias("n")).where("n > 1"))
    met = joined_with_hot(each, counts, ["u1", "u2"], "n", [], F.xxhash64("k", "lo"))
    return met.select(F.lit(OF_WORDS).alias("kind"), "k", "lo", "upto")


def joined_spans(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans that overlap or touch made one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``spans`` (removed runs as struct of lo, hi), ``passages`` (likewise), ``kept`` (binary) per row of ``docs``.

    Each byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed; strings
    never cross rows. ``passages`` are the stretches covered by ``WORDS`` words (what ASCII white space separates) that stand,
    with the same white space, elsewhere too; they stay. A null text is empty; repeated rows are each a place of their own; rows with
    a null id stay; an empty table gives none; other columns are not read. Texts are hashed in stretches, so a very long one
    needs memory for itself and a stretch.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("k"),
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"),
    )
    # Written, so that a row's number stays its own.
    texts = cut(source.mapInArrow(_packed, "k bigint, id bigint, packed binary"))
    by_row = repeated(texts).groupBy("k").agg(F.collect_set(F.struct("kind", "lo", "upto")).alias("found"))

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        for key, data, found in batch:
            text = zstandard.decompress(data)
            spans, passages = (joined_spans([(r["lo"], r["upto"]) for r in found or [] if r["kind"] == kind]) for kind in (OF_BYTES, OF_WORDS))
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[lo:hi] for lo, hi in zip(edges[::2], edges[1::2], strict=True))
            yield key, len(text), *([{"lo": lo, "hi": hi} for lo, hi in some] for some in (spans, passages)), kept

    joined = texts.join(by_row, "k", "left").select("id", "packed", "found")
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    schema = "id bigint, n_bytes bigint, spans array<struct<lo:int,hi:int>>, passages array<struct<lo:int,hi:int>>, kept binary"
    return arrow_rows(joined, rows, schema, [pa.int64(), pa.int64(), span, span, pa.binary()], 512)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed and left of every whole text of ``documents``; ``n_passage_bytes`` is covered by repeated passages of words."""
    left = drop_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"]).alias("n_passage_bytes"),
    )


QUERIES = {"op5_repeats": op5_repeats}
ORACLES: dict[str, str] = {}
