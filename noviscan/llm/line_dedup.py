"""Line deduplication with a segment-partition edit join.

A line is cut into ``DISTANCE`` + 1 segments; a line within that edit distance holds one of them unchanged at
nearly the same place. So a line is listed under its own segments, by length and segment number, and probes
the lists of all lengths it may match with the few substrings that can be the segment. Lines that meet are
compared by a bit-parallel edit distance over a band of 2 x ``DISTANCE`` + 1 diagonals. Of each class of
linked lines the first in the corpus stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noviscan.llm.base import parted, query, sieve, sifted, slices, table, text_of, written
from noviscan.llm.linking import linked_components

DISTANCE = 2
#: Shorter lines are compared for equality only: two edits would make different words of them.
LEAST_CHARS = 24


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def lines_of(text: str) -> list[str]:
    """The lines without white space at their ends; an empty one is no line to compare."""
    return [line.strip() for line in text.split("\n")]


def segments(length: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(start, size) of distance + 1 segments of nearly equal size, the longer ones last."""
    count = distance + 1
    size, longer = divmod(length, count)
    sizes = [size] * (count - longer) + [size + 1] * longer
    return [(sum(sizes[:k]), sizes[k]) for k in range(count)]


def probe_plan(length: int, distance: int = DISTANCE) -> list[tuple[int, int, int, int, int]]:
    """(length of the other line, segment, start here, size, side) of all substrings to look up.

    The start may be off by the edits before the segment and, seen from the end, by those after it. A
    line's own segments are index and probe at once (side 2), other substrings probe only (side 1).
    """
    out = []
    for other in range(max(length - distance, 0), length + 1):
        shift = length - other
        for k, (start, size) in enumerate(segments(other, distance)):
            first = max(0, start - k, start + shift - (distance - k))
            last = min(length - size, start + k, start + shift + (distance - k))
            for at in range(first, last + 1):
                out.append((other, k, at, size, 2 if not shift and at == start else 1))
    return out


def within(a: str, b: str, distance: int = DISTANCE) -> bool:
    """True if the edit distance is at most ``distance``."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > distance:
        return False
    head, limit = 0, len(b)
    while head < limit and a[head : head + 64] == b[head : head + 64]:
        head += 64
    head = min(head, limit)
    while head < limit and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail, limit = 0, len(b)
    while tail < limit and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not b:
        return len(a) <= distance
    places: dict[str, int] = {}
    for k, char in enumerate(a):
        places[char] = places.get(char, 0) | 1 << k
    # bit t of column j stands for row j - distance + t; rows below 1 count as j + |row|
    band = (1 << (2 * distance + 1)) - 1
    up, down, score = band & ~((1 << (distance + 1)) - 1), (1 << (distance + 1)) - 1, 0
    for j, char in enumerate(b, 1):
        up, down = (up >> 1) | (1 << (2 * distance)), down >> 1
        shift, found = j - distance - 1, places.get(char, 0)
        equal = (found >> shift if shift >= 0 else found << -shift) & band
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & band
        plus, minus = (down | ~(diagonal | up)) & band, diagonal & up
        score += not diagonal >> distance & 1
        if score > 2 * distance:
            return False
        plus = (plus << 1 | 1) & band
        up, down = ((minus << 1) | ~(diagonal | plus)) & band, plus & diagonal
    for t in range(distance + 1, distance + 1 + len(a) - len(b)):
        score += (up >> t & 1) - (down >> t & 1)
    return score <= distance


def bigram_parity(codes: np.ndarray) -> int:
    """64 bits, one per bucket of character pairs: odd or even count. An edit changes four pairs at most,
    so lines within ``distance`` edits differ in at most 4 x ``distance`` bits."""
    pairs = codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    odd = np.bincount((pairs >> np.uint64(58)).astype(np.int64), minlength=64) & 1
    return int(np.packbits(odd.astype(np.uint8)).view(">i8")[0])


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, ids) per row of ``docs`` (row, doc_id, text): the id of each line, null where it is empty."""

    def run(batches):
        for batch in slices(batches):
            found = [[line_id(x) if x else None for x in lines_of(text)] for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["row", "doc_id", "ids"])

    source = docs.select(F.col("row").cast("long"), F.col("doc_id").cast("long"), text_of().alias("text"))
    return source.mapInArrow(run, "row long, doc_id long, ids array<bigint>")


def segment_lists(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(key, id, size, pos, side) of the segments and substrings that two different lines at least have.

    ``pos`` is the parity of the line's character pairs, which rules most other pairs of a list out.
    """

    def run(batches):
        plans: dict[int, list] = {}
        seen: set[int] = set()
        mix = xxhash.xxh3_64_intdigest
        for batch in slices(batches, 128):
            keys, ids, sizes, sides, marks = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                for line in lines_of(text):
                    if len(line) < LEAST_CHARS or (one := line_id(line)) in seen:
                        continue
                    seen.add(one)
                    plan = plans.get(len(line))
                    if plan is None:
                        plan = plans[len(line)] = probe_plan(len(line), distance)
                    raw = line.encode("utf-32-le", "replace")
                    for other, k, at, size, side in plan:
                        keys.append(mix(raw[4 * at : 4 * (at + size)], seed=other * 8 + k) - (1 << 63))
                        sides.append(side)
                    ids += [one] * len(plan)
                    sizes += [len(line)] * len(plan)
                    marks += [bigram_parity(np.frombuffer(raw, np.uint32))] * len(plan)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sides, pa.int8()), pa.array(marks, pa.int64())],
                ["key", "id", "size", "side", "pos"],
            )

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "key long, id long, size int, side byte, pos long")
    list_of = W.partitionBy("key")
    shared = rows.withColumn("least", F.min("id").over(list_of)).withColumn("most", F.max("id").over(list_of))
    shared = shared.withColumn("index", F.max("side").over(list_of)).filter("least <> most and index = 2")
    return shared.groupBy("key", "id").agg(F.first("size").alias("size"), F.max("side").cast("int").alias("side"), F.first("pos").alias("pos"))


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line) of the wanted lines (id), each once."""
    bitmap = docs.sparkSession.sparkContext.broadcast(sieve(wanted.select(F.col("id").alias("key"))))

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            lines = {line_id(x): x for text in batch.column(0).to_pylist() for x in lines_of(text) if len(x) >= LEAST_CHARS}
            ids = np.array(list(lines), np.int64)
            new = [one for one in ids[sifted(bitmap.value, ids)].tolist() if one not in seen] if len(ids) else []
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([lines[x] for x in new], pa.string())], ["id", "line"])

    found = docs.select(text_of().alias("text")).mapInArrow(run, "id long, line string")
    return found.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))


def near_lines(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(id, root) of the lines that link to another, by chains of links; root is the least id of the class."""
    lists = written(segment_lists(docs, distance), "segment-lists")
    texts = written(line_texts(docs, lists.select("id").distinct()), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        x = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
        y = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))

        def compare(batches):
            for batch in slices(batches):
                keep = [within(p, q, distance) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep, pa.bool_())], ["a", "b", "linked"])

        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, linked boolean")
        return both.withColumn("distance", F.lit(None).cast("double"))

    def possible(x: str, y: str):
        near = F.abs(F.col(f"{x}.size") - F.col(f"{y}.size")) <= distance
        return near & (F.bit_count(F.col(f"{x}.pos").bitwiseXOR(F.col(f"{y}.pos"))) <= 4 * distance)

    return linked_components(lists, verify, possible, F.lit(0), 0)


def repeated_lines(docs: DataFrame, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (row, doc_id, text) the ids of its lines, and (row, removed): numbers of repeats.

    A line repeats if its class has an earlier line, by doc_id, row and line number. Equal lines of any
    length are one class; lines of ``LEAST_CHARS`` and more also link within ``distance`` edits. Empty lines
    are never repeats. A null text is one empty line; a null doc_id comes first.
    """
    numbered = written(numbered_lines(docs), "numbered-lines")
    roots = written(near_lines(docs, distance), "line-roots")
    lines = numbered.select("row", "doc_id", F.posexplode("ids").alias("number", "id")).filter("id is not null")
    lines = lines.join(roots, "id", "left").select("row", "doc_id", "number", F.coalesce("root", "id").alias("root"))
    lines = written(lines, "lines-with-root")
    place = F.struct("doc_id", "row", "number")
    classes = lines.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    classes = written(classes.filter("n > 1").select("root", "first"), "line-classes")
    repeats = lines.join(classes, "root").filter(~place.eqNullSafe(F.col("first")))
    removed = repeats.groupBy("row").agg(F.sort_array(F.collect_list("number")).alias("removed"))
    return numbered, removed


def dedupe_lines(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Every document with its text without repeated lines, all other columns as they are.

    The numbered copy of ``docs`` is written first, so that row numbers hold for all passes.
    """
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "documents-numbered")
    _, removed = repeated_lines(numbered.select(F.col("__row").alias("row"), "doc_id", "text"), distance)
    removed = written(removed, "removed-lines").withColumnRenamed("row", "__row").withColumnRenamed("removed", "__removed")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, k: ~F.array_contains("__removed", k))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    touched, whole = parted(numbered, "__row", removed)
    changed = touched.join(removed, "__row", "left").withColumn("text", text)
    return changed.select(*docs.columns).unionByName(whole.select(*docs.columns))


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document row: number of lines, number of repeats and their line numbers from 0, comma-joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    numbered, removed = repeated_lines(docs)
    joined = numbered.join(written(removed, "removed-lines"), "row", "left")
    found = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select(
        "doc_id", F.size("ids").cast("long").alias("n_lines"), F.size(found).cast("long").alias("n_removed"),
        F.array_join(found.cast("array<string>"), ",").alias("removed_lines"),
    )


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: texts lose their repeated lines, ``n_chars`` follows; documents of which nothing is left go."""
    kept = dedupe_lines(docs).filter(F.length(F.trim(text_of())) > 0)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept
