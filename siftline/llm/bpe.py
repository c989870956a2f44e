"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A text is cut by the vocabulary's pattern. Each piece's bytes are read as Latin-1, so that an
Aho-Corasick automaton over the vocabulary finds, in one pass, the longest token that starts at
each byte. The encoder takes the longest token that may stand beside its left neighbour, tries
shorter prefixes where it may not, and steps back where none fits; a position found to lead
nowhere is never tried again, so the work is linear in the piece. Two tokens may stand side by
side if merging their joined bytes by rank gives just these two tokens; that is remembered per
pair. A sequence whose neighbours are all compatible is the one that the merges would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftline.llm.common import arrow_rows, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that a task remembers before it keeps only those met again; token pairs before it starts afresh.
REMEMBERED = 250_000
#: Above every rank.
NEVER = 1 << 40


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read where the driver runs; the file has a fixed size."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def merged(data: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """The parts left when the lowest-ranked neighbours have been merged until ``least`` remain or nothing fits."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > least:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec(dict):
    """Maps a piece of text to its ids as little-endian 32-bit integers; fills itself on demand."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = REMEMBERED) -> None:
        self.ranks, self.remembered = ranks, remembered
        self.older: dict[str, bytes] = {}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.edges: dict[bytes, tuple[list, list]] = {}
        self.shorter_of: dict[bytes, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        out = self.older.get(piece)
        if out is None:
            out = b"".join([self.packed[t] for t in self.tokens(piece.encode("utf-8", "surrogatepass"))])
        if len(piece) <= 64:
            self[piece] = out
        return out

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether merging the joined bytes by rank leaves these two tokens."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.remembered:
                self.pairs.clear()
            known = self.pairs[left, right] = self.kept_apart(self.edge(left)[0], self.edge(right)[1])
        return known

    def edge(self, token: bytes) -> tuple[list, list]:
        """How the token's last and first part grow, from a byte to all of it: (part, rank of the merge that takes it in)."""
        known = self.edges.get(token)
        if known is None:
            parts = merged(token, self.ranks, 2)
            if len(parts) == 1:
                known = ([(token, NEVER)], [(token, NEVER)])
            else:
                rank = self.ranks[token]
                last, first = self.edge(parts[1])[0], self.edge(parts[0])[1]
                known = ([*last[:-1], (parts[1], rank), (token, NEVER)], [*first[:-1], (parts[0], rank), (token, NEVER)])
            self.edges[token] = known
        return known

    def kept_apart(self, last: list, first: list) -> bool:
        """Follows the merges at both sides of the border in order of rank until both tokens are whole."""
        ranks, i, j = self.ranks, 0, 0
        while True:
            (a, a_taken), (b, b_taken) = last[i], first[j]
            across = ranks.get(a + b, NEVER)
            if across < a_taken and across <= b_taken and across < NEVER:
                return False
            if a_taken == b_taken == NEVER:
                return True
            if a_taken <= b_taken:
                i += 1
            else:
                j += 1

    def shorter(self, token: bytes) -> bytes:
        """The longest token that is a proper prefix; empty if there is none."""
        known = self.shorter_of.get(token)
        if known is None:
            known = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), b"")
            self.shorter_of[token] = known
        return known

    def tokens(self, data: bytes) -> list[bytes]:
        if not data:
            return []
        if data in self.ranks:
            return [data]
        size_at = [0] * len(data)
        for end, size in self.automaton.iter(data.decode("latin-1")):
            size_at[end + 1 - size] = size  # matches come by their ends: the last is the longest
        pairs, compatible, shorter_of = self.pairs, self.compatible, self.shorter_of
        hopeless: set[int] = set()
        out: list[bytes] = []
        at, left, token = 0, b"", data[: size_at[0]]
        while True:
            while token:
                if at + len(token) not in hopeless and (not left or compatible(left, token) if (ok := pairs.get((left, token))) is None else ok):
                    break
                token = self.shorter(token) if (next_one := shorter_of.get(token)) is None else next_one
            if token:
                out.append(token)
                at += len(token)
                if at == len(data):
                    return out
                left, token = token, data[at : at + size_at[at]]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                hopeless.add(at)
                token = out.pop()
                at -= len(token)
                left = out[-1] if out else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


#: The codec that a Python worker made last, with its vocabulary: a worker does many tasks.
_made: dict[bytes, Codec] = {}


def codec_of(data: bytes) -> Codec:
    key = hashlib.sha256(data).digest()
    if key not in _made:
        _made.clear()
        _made[key] = Codec(parse_ranks(data))
    return _made[key]


def encode(
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id_column``, ``ids`` (binary, little-endian unsigned 32-bit) per row of ``docs``.

    A null text counts as empty and has no ids; repeated rows and null ids stay, each as a row;
    other columns are not read. The vocabulary file is read on the driver and sent to the tasks.
    """
    return _coded(docs, vocabulary, pattern, id_column, text_column, _ids, f"{id_column} {_type(docs, id_column)}, ids binary", [pa.binary()])


def decode(encoded: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column``, ``decoded`` (binary): the bytes that the ids stand for; null ids are none."""
    return _coded(encoded, vocabulary, "", id_column, ids_column, _bytes, f"{id_column} {_type(encoded, id_column)}, decoded binary", [pa.binary()])


def digests(
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded ids, a row per row of ``docs``.

    It encodes and decodes in one pass, so that ids do not travel between two Python tasks.
    """
    schema = f"{id_column} {_type(docs, id_column)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _coded(docs, vocabulary, pattern, id_column, text_column, _digests, schema, [pa.int64(), pa.string(), pa.string()])


def _ids(codec: Codec, pieces: Iterator[str]) -> tuple:
    return (b"".join(map(codec.__getitem__, pieces)),)


def _bytes(codec: Codec, ids: bytes) -> tuple:
    return (codec.decode(ids),)


def _digests(codec: Codec, pieces: Iterator[str]) -> tuple:
    (ids,) = _ids(codec, pieces)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def _type(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def _coded(docs, vocabulary, pattern, id_column, value_column, work, schema, types) -> DataFrame:
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary or public_tokenizers.path(VOCABULARY)))

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        codec = codec_of(data.value)
        cut = regex.compile(pattern) if pattern else None
        for key, value in source:
            yield (key, *work(codec, cut.findall(value or "") if cut else value or b""))

    kind = to_arrow_type(docs.schema[id_column].dataType)
    return arrow_rows(docs.select(F.col(id_column), F.col(value_column)), rows, schema, [kind, *types])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every whole text of ``documents``."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLES: dict[str, str] = {}
