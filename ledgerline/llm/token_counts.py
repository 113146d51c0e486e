"""Token counts under a unigram model by dynamic programming over a trie of the distinct pre-tokens.

The distinct pre-tokens of a block of documents are inserted in a trie. A node is a prefix; its forward score (the best
score of any segmentation of the prefix, and the tokens of that segmentation) is computed once for all pre-tokens that
share the prefix. A terminal node stores the count of its pre-token, and a document's count is the sum over its
pre-tokens.

No vocabulary at hand comes with the probabilities of a unigram model, and tokenizers are not trained here. Pieces have
those of Zipf's law by rank, so counts are of this model and not those of the merges from which the vocabulary stems.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, text_or_empty
from .tokenizing import distinct_words, totals

MARK = "▁"


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities for a vocabulary that is ordered by rank but carries none: those of Zipf's law."""
    norm = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return {p: -math.log(i + 1) - norm for i, p in reversed(list(enumerate(pieces)))}


def load_pieces(model_path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, by rank."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Trie:
    """Nodes of the prefixes of words that are inserted in sorted order; node 0 is the empty prefix.

    Each node holds the best score of any segmentation of its prefix and the tokens of that segmentation. They depend on
    the prefix alone, so they are computed when the node is made, once for all words below it.
    """

    def __init__(self, counter: TrieCounter):
        self.counter = counter
        self.best, self.used = array("d", [0.0]), array("q", [0])
        self.path, self.nodes = "", [0]  # the last word and its nodes

    def insert(self, word: str) -> int:
        """The word's terminal node."""
        scores, tails, longest, floor = self.counter.scores, self.counter.tails, self.counter.longest, self.counter.floor
        path, nodes, best, used = self.path, self.nodes, self.best, self.used
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del nodes[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            width = len(word[end - 1].encode("utf-8", "replace"))
            top, count = best[nodes[end - 1]] + floor * width, used[nodes[end - 1]] + width
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                part = word[start:end]
                if part not in tails:
                    break
                score = scores.get(part)
                if score is not None:
                    node = nodes[start]
                    total = best[node] + score
                    if total > top or (total == top and used[node] + 1 < count):
                        top, count = total, used[node] + 1
            nodes.append(len(best))
            best.append(top)
            used.append(count)
        self.path = word
        return nodes[-1]


class TrieCounter:
    """Token counts of pre-tokens. A character that no piece covers costs one token a UTF-8 byte, each below any piece."""

    #: Characters of pre-tokens whose counts are kept at most before they are forgotten.
    MOST = 8_000_000
    _made: dict[int, TrieCounter] = {}

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=0.0) - 10.0
        # Where a suffix ends no piece, no longer one does.
        self.tails = {p[i:] for p in scores for i in range(len(p))}
        self.counts: dict[str, int] = {}
        self.held = 0

    @classmethod
    def shared(cls, pieces: list[str]) -> TrieCounter:
        """One counter for each vocabulary and process."""
        key = hash(tuple(pieces))
        if key not in cls._made:
            cls._made[key] = cls(zipf_scores(pieces))
        return cls._made[key]

    def learn(self, words: list[str]) -> None:
        """A trie of the words that are new; the count at each terminal node is kept."""
        if self.held > self.MOST:
            self.counts, self.held = {}, 0
        new = sorted(w for w in words if w not in self.counts)
        trie = Trie(self)
        terminal = [trie.insert(MARK + w) for w in new]
        self.counts.update(zip(new, map(trie.used.__getitem__, terminal), strict=True))
        self.held += sum(map(len, new))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        counts, index, words = distinct_words(texts)
        words = words.to_numpy(zero_copy_only=False).tolist()
        self.learn(words)
        each = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(words))
        return counts, totals(each[index], counts)


def count_tokens(spark: SparkSession, docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens.

    Pre-tokens are runs of anything but ASCII white space, with the word mark before. A null or blank text has none. A
    row that repeats is counted again; a null doc_id stays null; an empty table gives no rows; further columns are
    ignored whatever their names. No row is shuffled.
    """
    ship(spark)
    sent = spark.sparkContext.broadcast(pieces)

    def run(batches):
        counter = TrieCounter.shared(sent.value)
        for b in batches:
            words, tokens = counter(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens)], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
