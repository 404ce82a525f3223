"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens that add up to it. Distinct pre-tokens are put in a trie; each
node holds the best log probability of its prefix and the tokens of that segmentation, so
what pre-tokens share is computed once; the count at a terminal node is the pre-token's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: default vocabulary file; any other sentencepiece model may be named
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: a character that no piece covers costs so much more than the rarest piece
UNKNOWN_COST = 10.0
#: nodes a task keeps before it starts a new trie, and the characters of a pre-token that are kept
MOST_NODES = 1_500_000
LONG = 64
_PRE_TOKEN = re.compile(r" ?[^ \n]+|\n+| +")


def unigram_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Log probability of each ordinary piece of a vocabulary, by Zipf's law over its rank.

    The vocabulary is ordered by rank and carries no probabilities; control, unknown and byte
    pieces are left out (bytes are what unknown characters are counted in).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(test(i) for test in special)]
    total = math.log(sum(1 / (rank + 2) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 2) - total for rank, piece in enumerate(pieces)}


def pre_tokens(text: str) -> list[str]:
    """Words with the blank before them, runs of line ends and runs of further blanks; joined they are the text."""
    return _PRE_TOKEN.findall(text)


class Trie:
    """Pre-tokens seen so far; a node is [children, best score, tokens of the best segmentation]."""

    def __init__(self, scores: dict[str, float]):
        self.pieces: dict = {}  # by their characters from the last to the first; a score under ""
        for piece, score in scores.items():
            place = self.pieces
            for char in reversed(piece):
                place = place.setdefault(char, {})
            place[""] = score
        self.single = {piece for piece in scores if len(piece) == 1}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_COST
        self.reset()

    def reset(self) -> None:
        self.counts: dict[str, int] = {}
        self.root: list = [{}, 0.0, 0]
        self.nodes = 0

    def text_tokens(self, text: str) -> int:
        """Tokens of a text. Between texts the trie starts anew when it has grown to its bound."""
        if self.nodes > MOST_NODES:
            self.reset()
        words, counts, long = pre_tokens(text), self.counts, []
        for word in set(words).difference(counts):
            counts[word] = self._insert(word.replace(" ", "▁"))
            if len(word) > LONG:
                long.append(word)
        total = sum(map(counts.__getitem__, words))
        for word in long:
            del counts[word]
        return total

    def _insert(self, word: str) -> int:
        """Walks the known prefix, then computes forward scores for the rest (kept up to LONG characters)."""
        node, best, tokens = self.root, [0.0], [0]
        length, depth = len(word), 0
        for char in word:
            child = node[0] and node[0].get(char)
            if not child:
                break
            node = child
            best.append(node[1])
            tokens.append(node[2])
            depth += 1
        for end in range(depth + 1, length + 1):
            char = word[end - 1]
            if char in self.single:
                top, many = -math.inf, 0
            else:
                top = best[-1] + self.unknown
                many = tokens[-1] + len(char.encode("utf-8", "surrogatepass"))
            place, start = self.pieces.get(char), end - 1
            while place is not None:
                score = place.get("")
                if score is not None and best[start] + score > top:
                    top, many = best[start] + score, tokens[start] + 1
                start -= 1
                if start < 0:
                    break
                place = place.get(word[start])
            best.append(top)
            tokens.append(many)
            if end <= LONG:
                child = [None, top, many]
                if node[0] is None:
                    node[0] = {}
                node[0][char] = child
                node = child
                self.nodes += 1
        return tokens[-1]


def count_tokens(docs: DataFrame, scores: dict[str, float], text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with ``name``: the tokens of each whole text (0 if null or empty; the column is replaced if there).

    Characters without a piece count as their UTF-8 bytes. Each task keeps one trie over all
    its batches, of a bounded number of nodes; nothing is shuffled.
    """

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Trie(scores)
        for texts in batches:
            yield pd.Series([trie.text_tokens(t) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(name, counted(F.col(text)))
