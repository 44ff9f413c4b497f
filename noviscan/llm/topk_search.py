"""Exact top-k search by BM25 over shards of an inverted index, a block of queries at a time.

Spark builds one index per shard of documents, sums lengths and document frequencies over all shards, and
runs the queries, in blocks of bounded size, against every shard with these global statistics. A task walks
a group of shards and keeps the best k of each query; the merge of the groups is exact.

Within a shard the common terms of all queries of a block are one matrix product, the postings of the rest
are added. Only documents that can reach the k-th best score of the task so far are scored exactly. Every
query meets every shard, so the job stays quadratic in the documents, with a small factor.
"""

from __future__ import annotations

from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noviscan.llm.base import query, sieve, sifted, slices, table, text_of, written
from noviscan.llm.words import LooseWords

K1, B = 1.2, 0.75
TOP = 10
SHARD_POSTINGS = 2_000_000
QUERIES_PER_BLOCK = 2_048
#: Tasks that the shards are dealt to for a block of queries; more tasks come from blocks run at once.
GROUPS = 16
BLOCKS_AT_ONCE = 8
#: Terms whose counts a task holds before it hands them over.
TERMS_HELD = 1 << 21
#: Terms in more than this share of a shard's documents are rows of its matrix, of 64 MB at most.
COMMON = 0.03
MATRIX_ROWS, MATRIX_CELLS = 1 << 12, 1 << 24
#: Queries, and scores, that a task makes at once.
QUERIES_AT_ONCE = 64
SCORES_HELD = 1 << 20
#: Above the error of a single-precision sum of ``MATRIX_ROWS`` positive products (about 2.5e-4).
RELATIVE = 1e-3
SLACK = 2e-6

SHARD_SCHEMA = (
    "shard long, n_docs long, n_words long, doc_ids array<bigint>, lengths binary, terms binary, starts binary, docs binary, counts binary"
)


def terms_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = np.unique(words.view(np.int64), return_counts=True)
    return terms, counts.astype(np.int32)


def build_shards(docs: DataFrame) -> DataFrame:
    """The inverted index of each run of documents with about ``SHARD_POSTINGS`` postings, one row each.

    Terms are sorted hashes; the postings of a term are document numbers in ascending order.
    """
    names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]

    def run(batches):
        words, number = LooseWords(), TaskContext.get().partitionId() << 24
        ids, lengths, terms, counts = [], [], [], []
        size = 0

        def shard():
            flat, owner = np.concatenate(terms), np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in terms])
            order = np.argsort(flat, kind="stable")
            unique, starts = np.unique(flat[order], return_index=True)
            blobs = [np.array(lengths, np.int32), unique, np.append(starts, len(flat)).astype(np.int64), owner[order], np.concatenate(counts)[order]]
            columns = [[number], [len(ids)], [sum(lengths)], [ids], *[[b.tobytes()] for b in blobs]]
            types = [*[pa.int64()] * 3, pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words.of(text)
                found, times = terms_of(own)
                ids.append(doc_id)
                lengths.append(len(own))
                terms.append(found)
                counts.append(times)
                size += max(1, len(found))
                if size >= SHARD_POSTINGS:
                    yield shard()
                    ids, lengths, terms, counts, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield shard()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SHARD_SCHEMA)


def query_terms(queries: DataFrame) -> DataFrame:
    """(q, query_id, term) of the distinct terms of each query row (doc_id, text)."""

    def run(batches):
        words = LooseWords()
        for batch in slices(batches):
            found = [terms_of(words.of(text))[0] for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["q", "query_id", "terms"])

    source = queries.select(F.monotonically_increasing_id().alias("q"), F.col("doc_id").cast("long").alias("query_id"), text_of().alias("text"))
    return source.mapInArrow(run, "q long, query_id long, terms array<bigint>")


def document_frequencies(shards: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) over all shards for the terms asked for, and a few others that pass a sieve of fixed size.

    A task adds up its group of shards, so a term leaves it once, not once a shard.
    """
    bitmap = shards.sparkSession.sparkContext.broadcast(sieve(terms.select(F.col("term").alias("key"))))

    def added(parts):
        terms, places = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        sums = np.zeros(len(terms), np.int64)
        np.add.at(sums, places, np.concatenate([n for _, n in parts]))
        return terms, sums

    def out(terms, sums):
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(sums)], ["term", "n"])

    def run(batches):
        held = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                terms, sizes = np.frombuffer(terms.as_buffer(), np.int64), np.diff(np.frombuffer(starts.as_buffer(), np.int64))
                keep = sifted(bitmap.value, terms)
                held = added([held, (terms[keep], sizes[keep])])
                if len(held[0]) > TERMS_HELD:
                    yield out(*held)
                    held = np.empty(0, np.int64), np.empty(0, np.int64)
        yield out(*held)

    found = shards.select("terms", "starts").coalesce(GROUPS).mapInArrow(run, "term long, n long")
    return found.groupBy("term").agg(F.sum("n").alias("df"))


class Shard:
    """One shard's index with impacts (the part of a score without idf), common terms as rows of a matrix.

    The matrix holds the terms of the most documents, ``MATRIX_CELLS`` numbers at most; the postings of all
    other terms are added one by one. Products are made in single precision, whose error on sums of positive
    numbers is below ``RELATIVE``, so they choose the candidates only; these are scored in double precision.
    """

    def __init__(self, ids: pa.Array, lengths, terms, starts, docs, counts, mean: float):
        self.null = np.asarray(ids.is_null())
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.terms, self.starts, self.docs = terms, starts, docs
        norm = K1 * (1 - B + B * lengths / mean)
        self.impacts = counts * (K1 + 1) / (counts + norm[docs])
        sizes, n = np.diff(starts), max(1, len(self.ids))
        common = np.flatnonzero(sizes > COMMON * n)
        common = common[np.argsort(-sizes[common], kind="stable")[: min(MATRIX_ROWS, MATRIX_CELLS // n)]]
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(self.ids)), np.float32)
        for row, t in enumerate(common.tolist()):
            a, b = starts[t], starts[t + 1]
            self.matrix[row, docs[a:b]] = self.impacts[a:b]

    def rough(self, block: list) -> np.ndarray:
        """Scores of all documents for each query (.., .., terms, idf) of a small block, in single precision."""
        n = len(self.ids)
        who = np.repeat(np.arange(len(block)), [len(q[2]) for q in block])
        terms, idf = np.concatenate([q[2] for q in block]), np.concatenate([q[3] for q in block])
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        who, at, idf = who[known], at[known], idf[known]
        row = self.row[at]
        weights = np.zeros((len(block), len(self.matrix)), np.float32)
        weights[who[row >= 0], row[row >= 0]] = idf[row >= 0]
        scores = weights @ self.matrix
        who, at, idf = who[row < 0], at[row < 0], idf[row < 0]
        sizes = self.starts[at + 1] - self.starts[at]
        place = np.arange(sizes.sum()) + np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes)
        cells = np.repeat(who * n, sizes) + self.docs[place]
        scores += np.bincount(cells, np.repeat(idf, sizes) * self.impacts[place], len(block) * n).reshape(len(block), n)
        return scores

    def candidates(self, block: list, floors: np.ndarray, top: int) -> list[np.ndarray]:
        """For each query of the block the documents that may be among its best, given its ``top``-th score so far."""
        out, step = [], max(1, min(QUERIES_AT_ONCE, SCORES_HELD // max(1, len(self.ids))))
        for start in range(0, len(block), step):
            for scores, floor in zip(self.rough(block[start : start + step]), floors[start : start + step]):
                found = np.flatnonzero((scores >= (floor - SLACK) * (1 - RELATIVE)) & (scores > 0))
                if len(found) > top:
                    least = np.partition(scores[found], -top)[-top]
                    found = found[scores[found] >= (least - SLACK) * (1 - RELATIVE)]
                out.append(found)
        return out

    def exact(self, block: list, found: list[np.ndarray]) -> list[np.ndarray]:
        """Scores of the documents found for each query, rounded to six decimals."""
        wanted = np.zeros(len(self.ids), bool)
        for some in found:
            wanted[some] = True
        place = np.flatnonzero(wanted[self.docs])
        place = place[np.argsort(self.docs[place], kind="stable")]
        starts = np.searchsorted(self.docs[place], np.arange(len(self.ids) + 1))
        term_of = np.repeat(self.terms, np.diff(self.starts))[place]
        impacts, out = self.impacts[place], []
        for (_, _, terms, idf), some in zip(block, found):
            if not len(some):
                out.append(np.empty(0))
                continue
            sizes = starts[some + 1] - starts[some]
            inside = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in some.tolist()])
            at = np.minimum(np.searchsorted(terms, term_of[inside]), len(terms) - 1)
            parts = np.where(terms[at] == term_of[inside], idf[at] * impacts[inside], 0.0)
            out.append(np.round(np.bincount(np.repeat(np.arange(len(some)), sizes), parts, len(some)), 6))
        return out


class Best:
    """The best of each query of a block over the shards of one task, ties by document id, nulls last."""

    def __init__(self, block: list, top: int):
        self.block, self.top = block, top
        self.floors = np.zeros(len(block))
        self.rows = [(np.empty(0), np.empty(0, np.int64), np.empty(0, bool))] * len(block)

    def add(self, shard: Shard) -> None:
        found = shard.candidates(self.block, self.floors, self.top)
        for k, (some, scores) in enumerate(zip(found, shard.exact(self.block, found))):
            if len(some):
                scores, ids, null = map(np.concatenate, zip(self.rows[k], (scores, shard.ids[some], shard.null[some])))
                order = np.lexsort((null, ids, -scores))[: self.top]
                self.rows[k] = scores[order], ids[order], null[order]
                if len(order) == self.top:
                    self.floors[k] = scores[order[-1]]

    def batch(self) -> pa.RecordBatch:
        sizes = [len(r[0]) for r in self.rows]
        scores, ids, null = map(np.concatenate, zip(*self.rows))
        q, query_id = (pa.array([x[c] for x, n in zip(self.block, sizes) for _ in range(n)], pa.int64()) for c in (0, 1))
        return pa.RecordBatch.from_arrays([q, query_id, pa.array(ids, mask=null), pa.array(scores)], ["q", "query_id", "doc_id", "score"])


def search(shards: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``top`` documents of each query row (doc_id, text).

    ``shards`` is a written index. BM25 over the distinct terms of the query; scores are rounded to six
    decimals and ties ranked by doc_id, nulls last. Documents without a common term are no answers, so a
    null, empty or unknown query has none. Every row counts as a document of its own, repeated ones too.
    """
    spark = shards.sparkSession
    asked = written(query_terms(queries), "query-terms")
    flat = asked.select("q", "query_id", F.explode("terms").alias("term"))
    known = document_frequencies(shards, asked.select(F.explode("terms").alias("term")).distinct())
    total = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words")).first()
    n, mean = float(total.n or 0), max(1.0, float(total.words or 0) / max(1, total.n or 0))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = flat.join(known, "term").select("q", "query_id", F.struct("term", idf.alias("idf")).alias("t"))
    ready = written(weighted.groupBy("q", "query_id").agg(F.array_sort(F.collect_list("t")).alias("t")), "queries")
    parts = []
    for blocks in batched(blocks_of(ready), BLOCKS_AT_ONCE):
        parts.append(written(reduce(DataFrame.unionByName, [answers(shards, block, mean, top) for block in blocks]), "answers"))
    if not parts:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    best = W.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "doc_id", "score", "rank")


def blocks_of(ready: DataFrame):
    """Blocks of at most ``QUERIES_PER_BLOCK`` queries; the driver holds ``BLOCKS_AT_ONCE`` of them at a time."""
    held = []
    for row in ready.toLocalIterator():
        held.append((row.q, row.query_id, np.array([x.term for x in row.t], np.int64), np.array([x.idf for x in row.t])))
        if len(held) == QUERIES_PER_BLOCK:
            yield held
            held = []
    if held:
        yield held


def answers(shards: DataFrame, block: list, mean: float, top: int) -> DataFrame:
    """The best of each of ``GROUPS`` groups of shards, at most, for every query of a block.

    A task reads its shards one by one and keeps the best so far, so its rows do not grow with the shards.
    """
    shared = shards.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        best = Best(shared.value, top)
        for batch in batches:
            for row in range(batch.num_rows):
                blobs = [batch.column(c)[row].as_buffer() for c in range(1, 6)]
                kinds = (np.int32, np.int64, np.int64, np.int32, np.int32)
                best.add(Shard(batch.column(0)[row].values, *[np.frombuffer(b, k) for b, k in zip(blobs, kinds)], mean))
        yield best.batch()

    stored = shards.select("doc_ids", "lengths", "terms", "starts", "docs", "counts").coalesce(GROUPS)
    return stored.mapInArrow(run, "q long, query_id long, doc_id long, score double")


@query("op7_topk_search")
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 as a query against all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(written(build_shards(docs), "shards"), docs.filter(F.col("doc_id") % 100 == 0))
