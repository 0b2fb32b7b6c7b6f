"""Splitting of texts into pretokens, and a bounded memory of their ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import regex

CHUNK_CHARS = 1_000_000  # of text looked at together
CHUNK_WORDS = 200_000  # of one long text


class Ids:
    """Ids of pretokens, kept in two generations of bounded size: words in use survive."""

    def __init__(self, encode: Callable[[list[str]], list[tuple[int, ...]]], pattern: str, most: int = 250_000):
        self.encode, self.find, self.most = encode, regex.compile(pattern), most
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _know(self, words: set[str]) -> None:
        new = words.difference(self.young)
        for w in new.intersection(self.old):
            self.young[w] = self.old[w]
        new = list(new.difference(self.old))
        self.young.update(zip(new, self.encode(new)))

    def _age(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def _long(self, text: str) -> Iterator[np.ndarray]:
        found = (m.group() for m in self.find.finditer(text))
        while words := list(islice(found, CHUNK_WORDS)):
            self._know(set(words))
            yield np.fromiter(chain.from_iterable(map(self.young.__getitem__, words)), np.uint32)
            self._age()

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as uint32."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size + len(texts[end]) <= CHUNK_CHARS:
                size += len(texts[end])
                end += 1
            if end == at:
                yield np.concatenate([np.zeros(0, np.uint32), *self._long(texts[at])])
                at += 1
                continue
            split = [self.find.findall(t) for t in texts[at:end]]
            self._know(set().union(*split))
            get = self.young.__getitem__
            for words in split:
                yield np.fromiter(chain.from_iterable(map(get, words)), np.uint32)
            self._age()
            at = end
