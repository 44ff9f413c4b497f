"""Packing of tokenized documents into sequences of fixed length: bounded-space online best-fit.

Everything happens inside the scan, without a shuffle. A task keeps a fixed number of open sequences in a
bitset keyed by free space: the lowest set bit from the wanted length on is the best fit. When one sequence too
many is open, the fullest closes. A placement never changes, so rows leave at once and a task holds lengths
only, besides the small window of pieces from which it feeds the longest first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import query, table, text_of
from noviscan.llm.bpe_ids import ByteBpe, sized_slices

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024
OPEN_SEQUENCES = 2048
WINDOW = 2048
#: Sequence numbers of a task; the task's partition stands above them.
SEQUENCE_BITS = 36
SCHEMA = "piece integer, start long, length long, ids binary, sequence_id long, offset long"


class OpenSequences:
    """Best fit among at most ``most`` open sequences of ``capacity``."""

    def __init__(self, capacity: int, most: int, number: int = 0):
        self.capacity, self.most, self.number = capacity, most, number
        self.bits, self.count = 0, 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, free: int) -> int:
        found = self.open[free].pop()
        self.count -= 1
        if not self.open[free]:
            self.bits ^= 1 << free
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``length``; a new sequence only where no open one has room."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self.take(free)
        else:
            free, sequence = self.capacity, self.number
            self.number += 1
        left = free - length
        if left:
            if self.count >= self.most:
                held = self.bits | 1 << left
                fullest = (held & -held).bit_length() - 1
                if fullest == left:
                    return sequence, self.capacity - free
                self.take(fullest)
            self.open[left].append(sequence)
            self.bits |= 1 << left
            self.count += 1
        return sequence, self.capacity - free


def cuts(n_ids: int, capacity: int) -> list[int]:
    """Where the pieces of a document start and end: full ones, only the first may be shorter."""
    first = (n_ids - 1) % capacity + 1
    return [0, *range(first, n_ids + 1, capacity)]


def packed(
    df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY,
    most_open: int = OPEN_SEQUENCES, window: int = WINDOW,
) -> DataFrame:
    """A row per piece of a document: the input's columns but the text, and piece, start, length, ids, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text is the end id alone; the name of an
    added token in a text becomes that token, as the library has it by default. Repeated rows are packed each, an
    empty table gives no rows, and columns of the input that are called like a result are replaced by it.
    Sequence numbers hold the number of the partition, so a task that runs again gives the same.
    """
    made = [part.split()[0] for part in SCHEMA.split(", ")]
    kept = [c for c in df.columns if c not in made and c != text]
    source = df.select(*[F.col(f"`{c}`") for c in kept], text_of(f"`{text}`").alias("__text"))
    fields = source.drop("__text").schema
    for part in SCHEMA.split(", "):
        fields = fields.add(*part.split())

    def run(batches):
        model = ByteBpe(tokenizer, names_are_text=False)
        bins = OpenSequences(capacity, most_open, TaskContext.get().partitionId() << SEQUENCE_BITS)
        rows, held = [], []

        def emit(batch_rows, pieces):
            """One batch of the window's pieces, longest first; ties in the order of the scan."""
            order = sorted(range(len(pieces)), key=lambda k: -len(pieces[k][3]))
            places = [bins.place(len(pieces[k][3]) // 4) for k in order]
            at = pa.array([pieces[k][0] for k in order], pa.int64())
            columns = [c.take(at) for c in pa.Table.from_batches(batch_rows).combine_chunks().to_batches()[0].columns[:-1]]
            columns += [
                pa.array([pieces[k][1] for k in order], pa.int32()), pa.array([pieces[k][2] for k in order], pa.int64()),
                pa.array([len(pieces[k][3]) // 4 for k in order], pa.int64()), pa.array([pieces[k][3] for k in order], pa.binary()),
                pa.array([s for s, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, fields.names)

        before = 0
        for batch in sized_slices(batches, "__text"):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rows.append(batch.set_column(batch.num_columns - 1, "__text", pa.nulls(batch.num_rows, pa.string())))
            for k, ids in enumerate(model.encode(texts)):
                coded = np.array([*ids, end_id], "<u4").tobytes()
                ends = cuts(len(coded) // 4, capacity)
                held += [(before + k, n, a, coded[4 * a : 4 * b]) for n, (a, b) in enumerate(zip(ends, ends[1:]))]
            before += batch.num_rows
            if len(held) >= window:
                yield emit(rows, held)
                rows, held, before = [], [], 0
        if held:
            yield emit(rows, held)

    return source.mapInArrow(run, fields)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, lengths) per sequence: its pieces' ids after each other, and where they end."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(inside.alias("parts"))
    hexed = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    return rows.select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.unhex(hexed).alias("ids"), F.col("parts.length").alias("lengths"),
    )


@query("op13_best_fit")
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select(
        F.col("doc_id").cast("long"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
