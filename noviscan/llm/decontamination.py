"""Benchmark decontamination with spaced seeds.

A seed is a hash of the words at the positions of a mask; words between them are ignored. The three masks
below are lossless: every window of ``WINDOW`` words with at most ``WINDOW - LEAST`` substituted ones holds
all words of at least one mask (checked in the tests over all substitutions). Seeds of documents are joined
with those of the benchmark; around every hit the two texts are compared word by word along the diagonal.

A shorter item is a window of its own length with the same share of equal words; it has short masks, as many
as are lossless for it. What of a window lies beyond the ends of the document counts as substituted.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import query, slices, table, text_of, without, written
from noviscan.llm.words import LooseWords

WINDOW = 20
LEAST = 16
MASKS = ("1101111", "1100010111", "10110111")
SHORTEST_ITEM = 5
SHORT_MASK = "11111"
#: For items below ``WINDOW`` words with substitutions; the longer ones need the first only.
SHORT_MASKS = ("1111", "11101", "11011", "10111")
ITEMS_PER_BLOCK = 20_000
WORDS_PER_BLOCK = 2_000_000
FILTER_BITS = 22

ODD = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask laid on each position of ``words``."""
    count = len(words) - len(mask) + 1
    out = np.full(max(count, 0), ODD[len(mask)], np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1" and count > 0:
            out += words[at : at + count] * ODD[at]
    return out ^ (out >> np.uint64(29))


def least_equal(n: int) -> int:
    """How many words of an item of ``n`` must be equal, in a window of at most ``WINDOW``."""
    return -(-min(n, WINDOW) * LEAST // WINDOW)


def lossless(n: int, masks: tuple[str, ...], missing: int) -> bool:
    """Whether ``n`` words with any ``missing`` substituted ones hold all words of a mask."""
    laid = [{s + k for k, bit in enumerate(m) if bit == "1"} for m in masks for s in range(n - len(m) + 1)]
    return all(any(seed.isdisjoint(gone) for seed in laid) for gone in combinations(range(n), missing))


@cache
def short_masks(n: int) -> tuple[str, ...]:
    """The fewest of ``SHORT_MASKS``, in their order, that find an item of ``n`` words."""
    return next(m for k in range(1, 5) if lossless(n, m := SHORT_MASKS[:k], n - least_equal(n)))


class Block:
    """The seeds and words of a bounded number of benchmark items; short items ``tolerant`` of substitutions or whole."""

    def __init__(self, items: list[tuple[int, np.ndarray]], tolerant: bool = False):
        self.items, self.tolerant = items, tolerant
        # an item that must occur whole is found by one seed at its begin
        whole = [n for n in (len(words) for _, words in items) if SHORTEST_ITEM <= n < WINDOW]
        if tolerant:
            self.masks = [*MASKS, *SHORT_MASKS[: max((len(short_masks(n)) for n in set(whole)), default=0)]]
        else:
            self.masks = [*MASKS, *[SHORT_MASK for n in whole[:1] if min(whole) < len(MASKS[0])]]
        parts = []
        for number, (_, words) in enumerate(items):
            wanted = range(len(MASKS)) if len(words) >= WINDOW else [0] if len(words) >= len(MASKS[0]) else range(len(MASKS), len(self.masks))
            if tolerant and len(words) < WINDOW:
                wanted = [len(MASKS) + k for k in range(len(short_masks(len(words))))] if len(words) >= SHORTEST_ITEM else []
            for kind in wanted:
                found = seeds(words, self.masks[kind])[: None if tolerant or len(words) >= WINDOW else 1]
                parts.append((found, np.full(len(found), kind), np.full(len(found), number), np.arange(len(found))))
        self.hashes, self.kinds, self.numbers, self.places = (
            np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint64 if not k else np.int64) for k in range(4)
        )
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.kinds, self.numbers, self.places = (x[order] for x in (self.hashes, self.kinds, self.numbers, self.places))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item number, diagonal) of joined seeds."""
        found = []
        for kind, mask in enumerate(self.masks):
            hashes = seeds(words, mask)
            at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
            first, last = (np.searchsorted(self.hashes, hashes[at], side) for side in ("left", "right"))
            for p, a, b in zip(at[first < last], first[first < last], last[first < last]):
                same = self.kinds[a:b] == kind
                found.append(np.stack([self.numbers[a:b][same], p - self.places[a:b][same]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def verify(self, words: np.ndarray, number: int, diagonal: int) -> tuple[int, int, int, int] | None:
        """(start in document, start in item, words, equal words) of the best overlap on a diagonal."""
        item = self.items[number][1]
        begin, end = max(0, -diagonal), min(len(item), len(words) - diagonal)
        equal = np.zeros(len(item), bool)
        equal[begin:end] = item[begin:end] == words[begin + diagonal : end + diagonal]
        if len(item) < WINDOW and not self.tolerant:
            return (diagonal, 0, len(item), len(item)) if equal.all() else None
        window = min(len(item), WINDOW)
        sums = np.concatenate([[0], np.cumsum(equal)])
        good = sums[window:] - sums[:-window] >= least_equal(len(item))
        best = None
        for run in np.split(np.flatnonzero(good), np.flatnonzero(np.diff(np.flatnonzero(good)) > window) + 1):
            if len(run):
                a, b = int(run[0]), int(run[-1]) + window
                inside = np.flatnonzero(equal[a:b])
                a, b = a + int(inside[0]), a + int(inside[-1]) + 1
                found = (a + diagonal, a, b - a, int(sums[b] - sums[a]))
                if best is None or found[3] > best[3]:
                    best = found
        return best


def benchmark_blocks(benchmark: DataFrame):
    """Items with their words in blocks of bounded size; a benchmark of any size is joined block by block, all rows against each."""
    words = LooseWords()
    held, size = [], 0
    for row in benchmark.select("item_id", text_of().alias("text")).toLocalIterator():
        found = words.of(row.text)
        if held and (len(held) >= ITEMS_PER_BLOCK or size + len(found) > WORDS_PER_BLOCK):
            yield held
            held, size = [], 0
        held.append((row.item_id, found))
        size += len(found)
    yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, tolerant: bool = False) -> DataFrame:
    """One row per pair of a document row (doc_id, text) and an item with a verified overlap.

    ``doc_start``, ``item_start``, ``n_words`` and ``n_equal`` place the overlap with most equal words, in
    words; ties go to the first. An overlap is a run of windows of 20 words with at least 16 equal ones, where
    words beyond an end of the document are not equal. Items of fewer than 20 words must occur whole and
    unchanged, or if ``tolerant`` with four of five words equal (rounded up), as the query and the stage ask;
    items of fewer than 5 words, and null or empty texts, never match. Repeated rows are reported each. An
    item id may be null.

    Documents are compared inside the scan, without a shuffle, whatever share of them holds one passage.
    """
    schema = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"
    names = [x.split()[0] for x in schema.split(", ")]
    source, out = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), None
    for block in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            words, block = LooseWords(), Block(shared.value, tolerant)
            for batch in slices(batches):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    seen, best = words.of(text), {}
                    for number, diagonal in block.hits(seen).tolist():
                        found = block.verify(seen, number, diagonal)
                        if found and (number not in best or (-found[3], found[0]) < (-best[number][3], best[number][0])):
                            best[number] = found
                    rows += [(doc_id, block.items[number][0], *found) for number, found in best.items()]
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), tolerant=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that overlap no benchmark item go on."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), tolerant=True).select("doc_id").distinct()
    return without(docs, written(found, "gone"))
