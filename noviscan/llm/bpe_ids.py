"""Token ids of whole texts by a public byte-level BPE file, and Arrow slices of bounded size for them."""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern's classes \p{L}, \p{N} and \s mean the same in every Unicode version below this character.
BEYOND = re.compile("[^\0-ɏ]")
#: A run of so many characters without a change of kind goes to the library that has no recursion in its pattern.
RUN = re.compile(r"\s{1000}|\w{1000}|[^\w\s]{1000}")


def sized_slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = 512, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of batches of at most ``rows`` rows and, beyond the first row, ``size`` bytes of text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if k > start and (k - start >= rows or held + n > size):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


class ByteBpe:
    """Ids by a ``tokenizers`` file of byte-level BPE.

    Texts of characters below U+0250 are encoded from the same vocabulary and merges as ranks, which is faster;
    the rest, and texts that hold the beginning of an added token, go to the ``tokenizers`` library.
    """

    def __init__(self, name: str, names_are_text: bool):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = names_are_text
        with open(path, encoding="utf-8") as lines:
            added = {x["content"]: x["id"] for x in json.load(lines)["added_tokens"]}
        own = {chr(c): b for b, c in byte_marks().items()}
        vocabulary = {t: k for t, k in self.library.get_vocab(with_added_tokens=False).items() if t not in added}
        self.bytes_of = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for token, k in vocabulary.items():
            self.bytes_of[k] = bytes(own[c] for c in token)
        ranks = {token: k for k, token in enumerate(self.bytes_of) if token}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.names = None if names_are_text or not added else re.compile("|".join(map(re.escape, added)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            if BEYOND.search(text) or RUN.search(text) or self.names and self.names.search(text):
                rest.append(k)
            else:
                out[k] = self.fast.encode_ordinary(text)
        for k, found in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = found.ids
        return out


def byte_marks() -> dict[int, int]:
    """The code point that stands for each byte in a byte-level vocabulary: itself where it is printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids after each other, and where each list ends (with a leading 0)."""
    ends = np.cumsum([0, *map(len, lists)])
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(ends[-1])), ends
