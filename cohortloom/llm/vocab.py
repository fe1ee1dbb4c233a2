"""Public vocabularies, and the token ids of words with a bounded memory of words seen.

Both tokenizers used here never join text across the words' separators, so a word has the
same ids wherever it stands; each distinct word is encoded once per worker.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np

from .words import Slice, ragged

# A worker forgets its words when it holds more than so many; ids do not depend on it.
MEMORY_WORDS = 1_000_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def json_model(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_pieces(path: str) -> Callable[[Sequence[str]], list[list[int]]]:
    model = piece_model(path)
    return lambda texts: model.encode(list(texts), num_threads=1)


def encode_json(path: str, together: int = 500) -> Callable[[Sequence[str]], list[list[int]]]:
    """Ids of words by a vocabulary that marks word ends, lower-cases and parts letters from
    marks. Words of letters, with or without one closing mark, are encoded many at a time
    and parted again at the marked ends; any other word is encoded alone."""
    model = json_model(path)
    suffix = json.loads(model.to_str())["model"]["end_of_word_suffix"]
    ends = np.zeros(model.get_vocab_size() + 1, np.bool_)
    ends[[i for word, i in model.get_vocab().items() if suffix and word.endswith(suffix)]] = True

    def encode(words: Sequence[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(words)
        plain, alone = [], []
        for i, word in enumerate(words):
            marked = word[-1] in ".," and len(word) > 1
            head = word[:-1] if marked else word
            (plain if suffix and head.lower().isalpha() else alone).append((i, 1 + marked))
        groups = [plain[k : k + together] for k in range(0, len(plain), together)]
        texts = [" ".join(words[i] for i, _ in group) for group in groups]
        for group, found in zip(groups, model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = found.ids
            bounds = (np.flatnonzero(ends[ids]) + 1)[np.cumsum([n for _, n in group]) - 1].tolist()
            for (i, _), low, high in zip(group, [0, *bounds], bounds, strict=False):
                out[i] = ids[low:high]
        for (i, _), found in zip(alone, model.encode_batch_fast([words[i] for i, _ in alone], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    return encode


class WordIds:
    """Ids of words, found again by the 64-bit hash of the word; all state is numpy arrays.

    `encode(list of str)` gives the ids of each. Two of the at most MEMORY_WORDS words held
    share a hash with a chance below one in a million.
    """

    def __init__(self, encode: Callable):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.code = np.empty(0, np.int64)
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.start = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """`hashes` is sorted and new."""
        ids = self.encode(words)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        total, n = int(sizes.sum()), len(self.known)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.size = np.concatenate([self.size, np.empty_like(self.size)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.start[n : n + len(words)] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.size[n : n + len(words)] = sizes
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.code = np.insert(self.code, place, np.arange(n, n + len(words)))
        self.used += total

    def codes(self, part: Slice, hashes: np.ndarray) -> np.ndarray:
        """A code for each word of a slice, valid until the next call."""
        if len(self.known) > MEMORY_WORDS:
            self._clear()
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), np.bool_)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            at = first[new]
            raw = part.data.tobytes()
            words = [str(raw[a:b], "utf-8", "replace") for a, b in zip(part.starts[at].tolist(), part.ends[at].tolist(), strict=True)]
            self._learn(distinct[new], words)
            place = np.searchsorted(self.known, distinct)
        return self.code[place][inverse]

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        sizes = self.size[codes]
        return self.flat[ragged(self.start[codes], sizes)], sizes


@lru_cache(maxsize=4)
def worker_words(kind: str, path: str) -> WordIds:
    """The words a worker has seen; they outlive a task, as the worker does."""
    return WordIds(encode_pieces(path) if kind == "piece" else encode_json(path))
