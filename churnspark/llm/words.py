"""A bounded memory of the tokens of words, shared by the encoders that cut texts into words."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Distinct words and their characters remembered by a worker; beyond either the memory starts afresh, results stay the same.
WORDS, CHARACTERS = 500_000, 16_000_000


class Memory:
    """Tokens of every word met so far, in one array that doubles when it is full."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], words: int = WORDS, characters: int = CHARACTERS):
        self.encode_words, self.limits = encode, (words, characters)
        self._forget()

    def _forget(self) -> None:
        """Word k has tokens flat[start[k]:start[k] + size[k]]."""
        self.number: dict[str, int] = {}
        self.characters = self.used = 0
        self.flat, self.start, self.size = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    @staticmethod
    def _room(array: np.ndarray, wanted: int) -> np.ndarray:
        return array if wanted <= len(array) else np.concatenate((array, np.empty(max(wanted, len(array)), array.dtype)))

    def _learn(self, words: list[str]) -> None:
        tokens = self.encode_words(words)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        first, total = len(self.number), int(size.sum())
        self.flat = self._room(self.flat, self.used + total)
        self.start, self.size = self._room(self.start, first + len(words)), self._room(self.size, first + len(words))
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(tokens), np.int32, total)
        self.start[first:first + len(words)] = self.used + np.cumsum(size) - size
        self.size[first:first + len(words)] = size
        self.number.update(zip(words, range(first, first + len(words))))
        self.used += total
        self.characters += sum(map(len, words))

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, given as their words, in a row, and where each text begins and the last one ends."""
        if len(self.number) > self.limits[0] or self.characters > self.limits[1]:
            self._forget()
        known = self.number
        if new := [w for w in set(chain.from_iterable(texts)) if w not in known]:
            self._learn(new)
        words = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64)
        size = self.size[words]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.start[words] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[at], ends[np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)]
