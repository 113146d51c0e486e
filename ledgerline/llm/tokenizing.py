"""Token ids of whole texts by a tokenizers file whose pre-tokens never span white space."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word of these letters, digits and signs is unchanged by NFC and has the same lower case everywhere.
PLAIN = r"^[!-;=-~À-ÖØ-öø-ÿ]+$"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\x20]+"


def distinct_words(texts: pa.Array, split: Callable[[pa.Array], pa.Array] = pc.ascii_split_whitespace) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words of each text, the words as places in the last, distinct words), words being what white space parts."""
    parts = split(texts)
    found = parts.flatten().dictionary_encode()
    index, counts = found.indices.to_numpy(), pc.list_value_length(parts).to_numpy().astype(np.int64)
    blank = pc.index(found.dictionary, pa.scalar("", found.dictionary.type)).as_py()
    if blank >= 0:  # white space at a text's ends gives empty words
        real = index != blank
        counts = np.bincount(np.repeat(np.arange(len(texts)), counts)[real], minlength=len(texts))
        index = index[real]
    return counts, index, found.dictionary


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The pieces of flat that starts and lengths give, in the order of index."""
    n = lengths[index]
    return flat[np.repeat(starts[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive groups of the given sizes, which may be 0."""
    up_to = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return up_to[ends] - up_to[ends - counts]


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes. Visible ones as themselves, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


class Slots(dict):
    """Numbers for pieces as they first occur; new ones also go to fresh."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = n = len(self)
        return n


class WordTokenizer:
    """Encodes each distinct pre-token once and gathers the ids of words and texts from there, in arrays.

    White space is dropped by the tokenizer and no pre-token holds any, so the ids of a text are those of its words in
    order. Plain words are cut into pre-tokens here and go to the bare merges, many as one string: a pre-token's last
    token carries the word-end mark, which tells them apart after. Other words are encoded by the whole tokenizer.
    """

    #: Characters of pre-tokens kept at most before they are forgotten.
    MOST = 4_000_000
    _made: dict[int, WordTokenizer] = {}

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        bare = json.loads(spec) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pieces = re.compile(PIECES)
        self.forget()

    def forget(self) -> None:
        self.slots, self.held = Slots(), 0
        self.flat, self.starts, self.lengths = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    @classmethod
    def shared(cls, spec: str) -> WordTokenizer:
        """One tokenizer and cache for each process."""
        key = hash(spec)
        if key not in cls._made:
            cls._made[key] = cls(spec)
        return cls._made[key]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, ids of each text)."""
        counts, index, words = distinct_words(texts)
        if self.held > self.MOST:
            self.forget()
        flat, starts, lengths = self.encoded(words)
        return ragged(flat, starts, lengths, index), totals(lengths[index], counts)

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all of them, and where each word's start and how many they are."""
        plain = pc.match_substring_regex(words, PLAIN)
        low = pc.utf8_lower(words.filter(plain))
        pieces = self.pieces.findall(" ".join(low.to_numpy(zero_copy_only=False)))
        slots = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        self.learn()
        flat = [ragged(self.flat, self.starts, self.lengths, slots)]
        lengths = np.empty(len(words), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        lengths[is_plain] = totals(self.lengths[slots], pc.count_substring_regex(low, PIECES).to_numpy())
        others = words.filter(pc.invert(plain)).to_pylist()
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths[~is_plain] = [len(x) for x in ids]
        starts = np.empty(len(words), np.int64)
        order = np.r_[np.flatnonzero(is_plain), np.flatnonzero(~is_plain)]
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(flat + ids), starts, lengths

    def learn(self, block: int = 512) -> None:
        """The ids of pre-tokens that are new."""
        new = [p if p.isascii() else "".join(map(LETTERS.__getitem__, p.encode())) for p in self.slots.fresh]
        self.held += sum(map(len, new))
        self.slots.fresh.clear()
        if not new:
            return
        joined = [" ".join(new[i : i + block]) for i in range(0, len(new), block)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):  # not a vocabulary with word ends: one by one
            each = [np.array(e.ids, "<u4") for e in self.bare.encode_batch_fast(new, add_special_tokens=False)]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        starts = np.r_[0, ends[:-1]]
        self.starts = np.r_[self.starts, starts + len(self.flat)]
        self.lengths = np.r_[self.lengths, ends - starts]
        self.flat = np.concatenate([self.flat, ids])
