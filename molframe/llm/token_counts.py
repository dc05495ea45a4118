"""Token counts under a unigram model by dynamic programming over a trie.

The distinct pre-tokens of a task's rows are put in a trie, which is kept from batch to batch. The forward score of a node
(best segmentation of the prefix that ends there, with its number of pieces) depends on the prefix alone, so it is
computed when the node is made, once for all pre-tokens that share the prefix; a pre-token's count is what its terminal
node holds. A text's count is the sum over its pre-tokens. Every task owns its trie, so nothing is shuffled or broadcast,
and a lost task is simply run again. Beyond a number of nodes the trie starts afresh, which bounds its memory.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import bound_batches
from .pieces import Pieces, best_ids, default_model_path, load_pieces, words_of

#: The trie starts afresh beyond so many nodes; results do not depend on it.
TRIE_NODES = 1_500_000
#: Longer pre-tokens are counted whole, but take no part in the trie.
LONGEST_KEPT = 64

_CODES = 0x110000


class CountingTrie:
    """Forward scores by node, counts by terminal.

    Ties go to the segmentation with fewer pieces. A character that is no piece counts its bytes.
    """

    def __init__(self, pieces: Pieces, most: int = TRIE_NODES):
        self.pieces, self.most = pieces, most
        self._clear()

    def _clear(self) -> None:
        self.children: dict[int, int] = {}  # node and next character -> node
        self.score, self.count = array("d", [0.0]), array("q", [0])
        self.terminal: dict[str, int] = {}

    def add(self, word: str) -> None:
        """Inserts a pre-token: makes the nodes that are missing on its path and stores its count."""
        children, score, count = self.children, self.score, self.count
        endings, byte_score = self.pieces.endings, self.pieces.byte_score
        path, node = [0], 0
        for end, c in enumerate(word, 1):
            key = node * _CODES + ord(c)
            below = children.get(key)
            if below is None:
                below = children[key] = len(score)
                s = endings.get(c)
                n = 1 if s is not None else len(c.encode("utf-8", "surrogatepass"))
                top, least = score[node] + (byte_score * n if s is None else s), count[node] + n
                for start in range(end - 2, -1, -1):
                    piece = word[start:end]
                    if piece not in endings:
                        break  # no piece ends so
                    s = endings[piece]
                    if s is not None:
                        new, k = score[path[start]] + s, count[path[start]] + 1
                        if new > top or new == top and k < least:
                            top, least = new, k
                score.append(top)
                count.append(least)
            path.append(below)
            node = below
        self.terminal[word] = count[node]

    def counts(self, texts: list[list[str]]) -> list[int]:
        """Pieces per text, given as lists of pre-tokens."""
        if len(self.score) > self.most:
            self._clear()
        unknown = set().union(*texts).difference(self.terminal) if texts else set()
        long = {w: len(best_ids(w, self.pieces)) for w in unknown if len(w) > LONGEST_KEPT}
        for word in unknown.difference(long):
            self.add(word)
        if not long:
            return [sum(map(self.terminal.__getitem__, words)) for words in texts]
        return [sum(long[w] if w in long else self.terminal[w] for w in words) for words in texts]


def _blocks(texts: pd.Series, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _counter(path: str):
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = words_of(path)
        trie = CountingTrie(load_pieces(path))
        for texts in parts:
            out = np.zeros(len(texts), np.int64)
            for a, b in _blocks(texts):
                out[a:b] = trie.counts([find(t) if t else [] for t in texts.iloc[a:b]])
            yield pd.Series(out)

    return F.pandas_udf(count, T.LongType())


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens``: pieces of the best unigram segmentation of every whole text.

    Null and empty texts count 0. A character that no piece covers counts its UTF-8 bytes. Texts are split only where no
    piece can cross. Repeated rows are counted one by one. An empty table gives no rows. Only the named columns are read,
    so other columns may have any name.
    """
    bound_batches(docs.sparkSession)
    counter = _counter(model_path or default_model_path())
    return docs.select(F.col(id_col).alias("doc_id"), counter(F.coalesce(F.col(text_col), F.lit(""))).alias("n_tokens"))
