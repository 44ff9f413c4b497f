"""Words of texts as arrays of 64-bit hashes, the common ground of the operators on word sequences."""

from __future__ import annotations

import re

import numpy as np
import xxhash

KEPT_WORDS = 300_000
NOT_WORD = re.compile(r"[\W_]+")


class LooseWords(dict):
    """Hash of a blank-separated word in lower case without punctuation; 0 where nothing is left."""

    def __missing__(self, word: str) -> int:
        plain = NOT_WORD.sub("", word.lower())
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(plain.encode("utf-8", "replace")) | 1 if plain else 0
        return found

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        found = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return found[found != 0]


class PlainWords(dict):
    """Hash of a word with A-Z in lower case, everything else as it is."""

    SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall
    LOWER = {65 + k: 97 + k for k in range(26)}

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        plain = word.translate(self.LOWER)
        self[word] = found = xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass"))
        return found

    def of(self, text: str) -> np.ndarray:
        words = self.SPLIT(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
