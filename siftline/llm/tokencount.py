"""Token counts under a unigram model, by dynamic programming shared along the paths of a trie.

Different pre-tokens are inserted in a trie of characters. A node stands for a prefix, and the best
score of any cut of that prefix into pieces, with the number of pieces, depends on the prefix
alone: it is the best over the pieces that end there of the score of the node at which the piece
begins plus the piece's own. So it is computed once, when the node is made, and every pre-token
with that prefix shares it. The node at which a pre-token ends has its count.

Pieces come from a vocabulary file whose order is by falling frequency; a piece's probability is
taken as one over its rank (Zipf's law), normalised. Characters without a piece are as many
pieces as they have bytes, each rarer than the rarest piece.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import arrow_rows, table

VOCABULARY = "piece_bpe_32k.model"
#: What begins a pre-token.
BEGIN = "▁"
#: Trie nodes, and counts of pre-tokens, that a task holds before it starts afresh.
NODES, REMEMBERED = 300_000, 300_000
#: Scores are whole numbers of this part of a nat, so that sums are exact.
SCALE = 1_000_000


def read_pieces(path: str) -> dict[str, int]:
    """Scores of the vocabulary's pieces: log probabilities by rank, control and byte pieces left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    whole = math.log(sum(1 / (r + 1) for r in range(len(ids))))
    return {model.id_to_piece(i): round(-SCALE * (math.log(r + 1) + whole)) for r, i in enumerate(ids)}


class Trie(dict):
    """Maps a pre-token to its number of pieces and its score; fills itself on demand."""

    def __init__(self, pieces: dict[str, int], nodes: int = NODES, remembered: int = REMEMBERED) -> None:
        self.pieces, self.limit, self.remembered = pieces, nodes, remembered
        self.longest = max(map(len, pieces), default=1)
        # The pieces from their ends backwards, letter by letter; a piece's score is under the empty string.
        self.backwards: dict = {}
        for piece, own in pieces.items():
            node = self.backwards
            for letter in reversed(piece):
                node = node.setdefault(letter, {})
            node[""] = own
        self.rare = min(pieces.values(), default=0) - SCALE
        self.made = 0
        self.fresh()

    def fresh(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.count = [0], [0]

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= self.remembered:
            self.clear()
        if len(token) > self.limit // 2:
            return self.rolled(BEGIN + token)
        if len(self.score) + len(token) > self.limit:
            self.fresh()
        node = self.end(BEGIN + token)
        found = self.count[node], self.score[node]
        if len(token) <= 64:
            self[token] = found
        return found

    def rolled(self, token: str) -> tuple[int, int]:
        """Count and score of a pre-token that is too long for the trie, of whose prefixes only the last ones' scores are kept."""
        last: deque[tuple[int, int]] = deque([(0, 0)], maxlen=self.longest)
        for at, letter in enumerate(token, 1):
            size = len(letter.encode("utf-8", "surrogatepass"))
            ways = [(last[-1][0] + size * self.rare, -last[-1][1] - size)]
            for n in range(1, min(self.longest, at) + 1):
                own = self.pieces.get(token[at - n : at])
                if own is not None:
                    ways.append((last[-n][0] + own, -last[-n][1] - 1))
            score, fewest = max(ways)
            last.append((score, -fewest))
        return last[-1][1], last[-1][0]

    def end(self, token: str) -> int:
        """The node of ``token``; nodes missing on the way are made, each with its forward score."""
        path, children, scores, counts = [0], self.children, self.score, self.count
        node, backwards, rare = 0, self.backwards, self.rare
        for at, letter in enumerate(token):
            known = children[node]
            node = known.get(letter)
            if node is None:
                size = 1 if letter < "\x80" else len(letter.encode("utf-8", "surrogatepass"))
                before = path[-1]
                best, count = scores[before] + size * rare, counts[before] + size
                ends, begin = backwards.get(letter), at
                while ends is not None:
                    own = ends.get("")
                    if own is not None:
                        before = path[begin]
                        score = scores[before] + own
                        if score > best or score == best and counts[before] < count - 1:
                            best, count = score, counts[before] + 1
                    if not begin:
                        break
                    begin -= 1
                    ends = ends.get(token[begin])
                node = known[letter] = len(scores)
                scores.append(best)
                counts.append(count)
                children.append({})
                self.made += 1
            path.append(node)
        return node


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``n_pretokens``, ``n_tokens``, ``log_score`` (in nats) of each row.

    Pre-tokens are what white space separates, each with a mark of its beginning. A null text
    counts as empty and has none; repeated rows and null ids stay; other columns are not read.
    Tries live in the tasks, so no pre-token is shuffled, and no more than ``NODES`` nodes are held: a pre-token with half as many characters is scored
    beside the trie, with the scores of its last prefixes alone. Texts are read whole, of any length; an empty table gives none; ids are whole numbers.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary or public_tokenizers.path(VOCABULARY)))

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        trie = Trie(pieces.value)
        for key, text in source:
            tokens = (text or "").split()
            count = score = 0
            for n, s in map(trie.__getitem__, tokens):
                count += n
                score += s
            yield key, len(tokens), count, score / SCALE

    narrow = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    schema = "id bigint, n_pretokens bigint, n_tokens bigint, log_score double"
    return arrow_rows(narrow, rows, schema, [pa.int64(), pa.int64(), pa.int64(), pa.float64()], 16384)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
