"""Byte-level BPE encoding and decoding by monoid tree reduction.

An encoding is an element of a monoid: two neighbours are joined by re-encoding a window around their
boundary that grows until the tokens outside provably stay. The proof used: a token sequence is the
encoding of its bytes exactly if each pair of neighbouring tokens, encoded alone, gives that pair again.
So a window is large enough once its first and last token agree with the tokens next to it.

A text is first cut where a character that is not white space is followed by white space. Every match of
the pattern ends there, so joining these parts needs no window, and equal parts are encoded once per task.
"""

from __future__ import annotations

import base64
import heapq
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import query, slices, table, text_of

RANKS = "byte_bpe_50k.tiktoken"
LEAF_BYTES = 6
HEAP_BYTES = 256
KEPT_PARTS = 400_000
KEPT_CHARS = 200
#: White space as the pattern understands it (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"
NONE = 1 << 60


class Encoder:
    """Encodes the bytes of one match of the pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.agrees: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.windows: dict[tuple[int, int], list[int]] = {}

    @classmethod
    def load(cls, path: str) -> Encoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost among equals, until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > HEAP_BYTES:
            return self._merge_by_heap(piece)
        get = self.ranks.get
        parts = [piece[k : k + 1] for k in range(len(piece))]
        cost = [get(piece[k : k + 2], NONE) for k in range(len(piece) - 1)]
        while cost and (best := min(cost)) < NONE:
            k = cost.index(best)
            joined = parts[k] = parts[k] + parts.pop(k + 1)
            del cost[k]
            if k < len(cost):
                cost[k] = get(joined + parts[k + 1], NONE)
            if k:
                cost[k - 1] = get(parts[k - 1] + joined, NONE)
        return [self.ranks[part] for part in parts]

    def _merge_by_heap(self, piece: bytes) -> list[int]:
        get, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(rank, k, k + 1, k + 2) for k in range(n - 1) if (rank := get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)

        def offer(k: int) -> None:
            if k >= 0 and end[k] < n:
                stop = end[end[k]]
                if (rank := get(piece[k:stop])) is not None:
                    heapq.heappush(heap, (rank, k, end[k], stop))

        while heap:
            _, k, middle, stop = heapq.heappop(heap)
            if not alive[k] or end[k] != middle or end[middle] != stop:
                continue
            alive[middle] = 0
            end[k] = stop
            if stop < n:
                before[stop] = k
            offer(k)
            offer(before[k])
        return [self.ranks[piece[k : end[k]]] for k in range(n) if alive[k]]

    def agree(self, left: int, right: int) -> bool:
        found = self.agrees.get((left, right))
        if found is None:
            found = kept(self.agrees)[left, right] = self.window((left, right)) == [left, right]
        return found

    def window(self, ids: tuple[int, ...]) -> list[int]:
        """The tokens of a window anew; those of the smallest windows are kept."""
        if len(ids) > 2:
            return self.merge(self.decode(ids))
        found = self.windows.get(ids)
        if found is None:
            found = kept(self.windows)[ids] = self.merge(self.decode(ids))
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two neighbours together."""
        if not left or not right:
            return left or right
        if self.agree(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.window((*left[len(left) - i :], *right[:j]))
            more_left = i < len(left) and not self.agree(left[-i - 1], window[0])
            more_right = j < len(right) and not self.agree(window[-1], right[j])
            if not (more_left or more_right):
                return left[: len(left) - i] + window + right[j:]
            i = min(len(left), 2 * i) if more_left else i
            j = min(len(right), 2 * j) if more_right else j

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            found = self.leaves.get(piece)
            if found is None:
                found = kept(self.leaves)[piece] = self.merge(piece) if piece else []
            return found
        middle = len(piece) // 2
        return self.join(self.encode(piece[:middle]), self.encode(piece[middle:]))

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[k] for k in ids])


def kept(memo: dict) -> dict:
    """The memo, emptied where it is full: it saves work only."""
    if len(memo) >= KEPT_PARTS:
        memo.clear()
    return memo


class Parts(dict):
    """Ids of a part of a text as little-endian 32-bit integers, encoded when first asked for."""

    def __init__(self, encoder: Encoder, pattern: str):
        import regex

        super().__init__()
        self.encoder, self.matches = encoder, regex.compile(pattern).findall

    def __missing__(self, part: str) -> bytes:
        ids = [k for piece in self.matches(part) for k in self.encoder.encode(piece.encode("utf-8", "replace"))]
        out = pack(f"<{len(ids)}I", *ids)
        if len(part) <= KEPT_CHARS:
            kept(self)[part] = out
        return out


def bpe_round_trip(
    df: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, decode: bool = True
) -> DataFrame:
    """Every row with ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and ``decoded`` bytes.

    Runs inside the scan, without a shuffle; a task holds some hundred texts and a bounded memo of parts.
    Null and empty texts give no ids and no bytes. Repeated rows are encoded like any other. Columns of
    the input that are called like a result are replaced by it. ``ranks`` names a public vocabulary.
    """
    kept = [c for c in df.columns if c not in ("ids", "n_tokens", "decoded")]
    source = df.select(*[F.col(f"`{c}`") for c in kept], text_of(f"`{text}`").alias("__text"))

    def run(batches):
        import re

        encoder = Encoder.load(public_tokenizers.path(ranks))
        parts, cut = Parts(encoder, pattern), re.compile(PARTS).findall
        for batch in slices(batches):
            ids, counts, back = [], [], []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                coded = b"".join([parts[p] for p in cut(value)])
                ids.append(coded)
                counts.append(len(coded) // 4)
                back.append(encoder.decode(np.frombuffer(coded, "<u4").tolist()) if decode else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(back, pa.binary())],
                [*batch.schema.names[:-1], "ids", "n_tokens", "decoded"],
            )

    fields = source.drop("__text").schema.add("ids", "binary").add("n_tokens", "long").add("decoded", "binary")
    return source.mapInArrow(run, fields)


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
