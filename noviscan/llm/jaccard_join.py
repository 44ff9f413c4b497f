"""Exact Jaccard join of word-shingle sets with skips by set relations.

Index level: a set enters the lists of its rarest shingles only (prefix), with its size and the position of
the shingle; lists are cut into blocks by size, and blocks and positions that cannot reach the threshold are
skipped. Answer level: equal sets are one item; similar sets take their answer from a set that was
compared before (see ``linking``), instead of being compared with every member of its group.

Rarity only orders the shingles, so a sketch of fixed size, summed over all sets, and a bitmap of shared
shingles are enough for it: any order used for all sets alike gives the same links. Shingles that only one
set has in its prefix never leave the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noviscan.llm.base import query, sieve, sifted, slices, table, text_of, without, written
from noviscan.llm.linking import linked_components
from noviscan.llm.words import PlainWords

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 21
SKETCH_CHUNK = 1 << 13
SALTS = 64
#: Largest sieve of shared prefix shingles, 64 MB; beyond some billion shingles it prunes less, answers stay exact.
SIEVE_BITS_MOST = 29
#: Prefix shingles that a task holds before it packs them.
KEYS_HELD = 1 << 20
#: Longs of a sketch of a whole set: 1 024 bits, sharp for sets of up to some 500 shingles.
SKETCH_LONGS = 16
#: A little over 100 / 75, so the sizes of linking sets are in the same or in neighbouring blocks.
BLOCK_RATIO = 1.34

ODD = np.random.default_rng(23).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the shingles; the whole sequence where it is shorter than one."""
    width = min(SHINGLE, len(words))
    if not width:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - width + 1, ODD[8 + width], np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * ODD[k]
    out ^= out >> np.uint64(32)
    return np.unique((out * ODD[7]) >> np.uint64(16))


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, size, id, shingles) per document row; ``id`` is a 64-bit hash of the set, null if it is empty."""

    def run(batches):
        words = PlainWords()
        for batch in slices(batches):
            found = [shingle_set(words.of(text)) for text in batch.column(1).to_pylist()]
            blobs = [packed(x) for x in found]
            ids = [int(np.uint64(xxhash.xxh3_64_intdigest(b)).astype(np.int64)) if b else None for b in blobs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())],
                ["doc_id", "size", "id", "shingles"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, size long, id long, shingles binary")


def rarity(sets: DataFrame) -> np.ndarray:
    """Level (0 to 255, eight per doubling) of the number of sets per counter of the sketch; 2 MB at any size."""

    def count(batches):
        sums = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches):
            blob = b"".join(batch.column(0).to_pylist())
            sums += np.bincount((unpacked(blob) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=sums.size)
        salt, parts = TaskContext.get().partitionId() % SALTS, np.minimum(sums, 255).astype(np.uint8).reshape(-1, SKETCH_CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int64()), pa.array([salt] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
            ["chunk", "salt", "counts"],
        )

    def add(kind):
        def run(group: pa.Table) -> pa.Table:
            total = np.zeros(SKETCH_CHUNK, np.int64)
            for counts in group.column("counts"):
                total += np.frombuffer(counts.as_buffer(), kind)
            return pa.table({"chunk": group.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

        return run

    per_task = sets.select("shingles").mapInArrow(count, "chunk long, salt long, counts binary")
    salted = per_task.groupBy("chunk", "salt").applyInArrow(add(np.uint8), "chunk long, counts binary")
    chunks = salted.groupBy("chunk").applyInArrow(add(np.int64), "chunk long, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in chunks.toLocalIterator():  # 256 rows of 64 KB
        out[row.chunk * SKETCH_CHUNK : (row.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(row.counts, np.int64)
    return np.minimum(255, 8 * np.log2(out + 1.0)).astype(np.uint8)


def least_common(size):
    """Least number of shingles that a set of this size shares with any set it links to."""
    return (PERCENT * size + 99) // 100


def distinct_sets(sets: DataFrame):
    """A function (work, schema) that maps the batches (id, shingles) of all sets, each once.

    Only sets that occur more than once, found by a sieve of their ids, are shuffled. The others are picked in the
    task that works on them, so a task has one Python worker, not one for each of two steps.
    """
    some = sets.filter("id is not null").select("id", "shingles")
    repeated = some.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("key"))
    bitmap = sets.sparkSession.sparkContext.broadcast(sieve(repeated))

    def pick(inside: bool):
        def run(batches):
            for batch in slices(batches):
                yield batch.filter(pa.array(sifted(bitmap.value, batch.column(0).to_numpy()) == inside))

        return run

    copies = some.mapInArrow(pick(True), some.schema).groupBy("id").agg(F.first("shingles").alias("shingles"))
    copies, alone = written(copies, "copies"), pick(False)

    def mapped(work, schema: str) -> DataFrame:
        return some.mapInArrow(lambda batches: work(alone(batches)), schema).unionByName(copies.mapInArrow(work, schema))

    return mapped


def prefix(values: np.ndarray, levels: np.ndarray, shared: np.ndarray | None) -> np.ndarray:
    """First shingles of a set, one more than it can miss: those not known as shared first, then by rarity."""
    order = levels[(values & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    if shared is not None:
        order |= sifted(shared, values).astype(np.uint64) << np.uint64(8)
    order = np.sort((order << np.uint64(48)) | values)
    return order[: len(values) - least_common(len(values)) + 1] & np.uint64((1 << 48) - 1)


def planes(values: np.ndarray) -> bytes:
    """Ascending numbers below 2^40 as differences, byte by byte of all of them, which Spark compresses well."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(5, -1).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def shared_keys(uniques, levels, shared, bits: int, cuts: int) -> np.ndarray:
    """Sieve (2^bits bits) of the prefix keys that two sets have at least.

    Keys are reduced to 40 bits, the slot of the sieve in front, and leave a task sorted, without repeats and
    packed, in 2^cuts slices; the task of a slice finds those that came twice. No key is missed; keys that
    are equal in 40 bits are marked too.
    """
    low, rest, per_slice = np.uint64((1 << bits) - 1), np.uint64(40 - bits), np.uint64(40 - cuts)

    def pack(found: list[np.ndarray]):
        keys = np.concatenate(found)
        keys = ((keys & low) << rest) | ((keys >> np.uint64(bits)) & ((np.uint64(1) << rest) - np.uint64(1)))
        keys, counts = np.unique(keys, return_counts=True)
        edges = np.searchsorted(keys, np.arange(1 << cuts, dtype=np.uint64) << per_slice).tolist() + [len(keys)]
        pieces = [(k, keys[x:y], keys[x:y][counts[x:y] > 1]) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pieces], pa.int64())] + [pa.array([planes(p[k]) for p in pieces], pa.binary()) for k in (1, 2)],
            ["slice", "keys", "twice"],
        )

    def run(batches):
        found, held = [], 0
        for batch in slices(batches, 256):
            for blob in batch.column(1):
                found.append(prefix(unpacked(blob.as_py()), levels.value, shared.value if shared else None))
                held += len(found[-1])
            if held > KEYS_HELD:
                yield pack(found)
                found, held = [], 0
        if found:
            yield pack(found)

    def mark(group: pa.Table) -> pa.Table:
        keys = np.concatenate([from_planes(x.as_py()) for name in ("keys", "twice") for x in group.column(name)])
        keys.sort()
        slots = (keys[1:][keys[1:] == keys[:-1]] >> rest) & np.uint64((1 << (bits - cuts)) - 1)
        flags = np.zeros(1 << (bits - cuts), np.uint8)
        flags[slots.astype(np.int64)] = 1
        return pa.table({"slice": group.column("slice")[:1], "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    packed_keys = uniques(run, "slice long, keys binary, twice binary")
    out, width = np.zeros(1 << (bits - 3), np.uint8), 1 << (bits - cuts - 3)
    for row in packed_keys.groupBy("slice").applyInArrow(mark, "slice long, bits binary").toLocalIterator():
        out[row.slice * width : (row.slice + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return out


def prefix_rows(uniques, levels, shared, common) -> DataFrame:
    """(key, id, size, pos, side) of the prefix keys that are in the sieve ``common``."""

    def run(batches):
        for batch in slices(batches, 256):
            columns = [[np.empty(0, np.int64)] for _ in range(4)]
            for one, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = unpacked(blob)
                keys = prefix(values, levels.value, shared.value)
                places = np.flatnonzero(sifted(common.value, keys))
                for column, x in zip(columns, (keys[places].astype(np.int64), np.full(len(places), one), np.full(len(places), len(values)), places)):
                    column.append(x)
            arrays = [pa.array(np.concatenate(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "id", "size", "pos"])

    return uniques(run, "key long, id long, size int, pos int").withColumn("side", F.lit(2))


def prefix_lists(sets: DataFrame) -> DataFrame:
    """(key, id, size, pos, side) of the prefix shingles that two different sets have, and of few others.

    A first round finds which prefix shingles are shared at all: by the order of the second these come last,
    so most sets drop out of all lists. The second finds the shared ones among its own prefixes, and only
    rows of these leave the scan.
    """
    context = sets.sparkSession.sparkContext
    levels = context.broadcast(rarity(sets))
    uniques = distinct_sets(sets)
    total = sets.agg(F.sum("size")).first()[0] or 0
    bits = min(max((total // 2).bit_length(), 20), SIEVE_BITS_MOST)
    cuts = min(max((total >> 20).bit_length(), 4), 14)
    shared = context.broadcast(shared_keys(uniques, levels, None, bits, cuts))
    common = context.broadcast(shared_keys(uniques, levels, shared, bits, cuts))
    return prefix_rows(uniques, levels, shared, common)


def possible(x: str, y: str):
    """Size and position filter: what two sets can share from the positions of a common shingle on."""
    a, b, i, j = (F.col(f"{s}.{c}").cast("long") for c in ("size", "pos") for s in (x, y))
    most = F.least(a - i, b - j)
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & ((100 + PERCENT) * most >= PERCENT * (a + b))


def picked(sets: DataFrame, wanted: DataFrame, schema: str, work=lambda batch: batch) -> DataFrame:
    """``work`` on the batches (id, shingles) of the sets whose id is in ``wanted`` (id), and of few others, each once a task."""
    bitmap = sets.sparkSession.sparkContext.broadcast(sieve(wanted.select(F.col("id").alias("key"))))

    def pick(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            ids = batch.column(0).to_numpy()
            keep = sifted(bitmap.value, ids)
            for k in np.flatnonzero(keep).tolist():
                if int(ids[k]) in seen:
                    keep[k] = False
                seen.add(int(ids[k]))
            yield work(batch.filter(pa.array(keep)))

    return sets.filter("id is not null").select("id", "shingles").mapInArrow(pick, schema)


def parities(values: np.ndarray) -> np.ndarray:
    """A bit per bucket of hashes: odd or even number of shingles. Two sets differ in no more bits than in shingles."""
    odd = np.bincount((values & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def sketcher(sets: DataFrame):
    """Maps ids (id) to (id, sketch), the parities of the whole sets."""
    kind = pa.struct([(f"w{k}", pa.int64()) for k in range(SKETCH_LONGS)])

    def draw(batch):
        found = np.array([parities(unpacked(x.as_py())) for x in batch.column(1)], np.int64).reshape(-1, SKETCH_LONGS)
        words = [pa.array(np.ascontiguousarray(found[:, k])) for k in range(SKETCH_LONGS)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(words, fields=list(kind))], ["id", "sketch"])

    def sketches(wanted: DataFrame) -> DataFrame:
        schema = "id long, sketch struct<" + ", ".join(f"w{k}: bigint" for k in range(SKETCH_LONGS)) + ">"
        found = picked(sets, wanted, schema, draw).join(wanted, "id", "left_semi")
        return found.groupBy("id").agg(F.first("sketch").alias("sketch"))

    return sketches


def near(x: str, y: str):
    """Sketch filter: sets that link differ in at most (100 - PERCENT) of (100 + PERCENT) of their summed sizes."""
    differ = sum((F.bit_count(F.col(f"{x}.sketch.w{k}").bitwiseXOR(F.col(f"{y}.sketch.w{k}"))) for k in range(SKETCH_LONGS)), F.lit(0))
    return (100 + PERCENT) * differ.cast("long") <= (100 - PERCENT) * (F.col(f"{x}.size").cast("long") + F.col(f"{y}.size"))


def verifier(sets: DataFrame):
    """Compares the whole sets of pairs (Jaccard distance); only the sets that occur in pairs are shuffled."""

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        some = picked(sets, wanted, "id long, shingles binary")
        some = written(some.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles")), "sets")
        left = some.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
        right = some.select(F.col("id").alias("b"), F.col("shingles").alias("y"))

        def compare(batches):
            for batch in slices(batches):
                linked, distance = [], []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = unpacked(x.as_py()), unpacked(y.as_py())
                    union = len(np.union1d(x, y))
                    common = len(x) + len(y) - union
                    linked.append(100 * common >= PERCENT * union)
                    distance.append(1.0 - common / union)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())], ["a", "b", "linked", "distance"]
                )

        both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return both.mapInArrow(compare, "a long, b long, linked boolean, distance double")

    return verify


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text).

    Two documents link if 100 x shared >= 75 x union of their shingle sets; the component is the least
    doc_id reachable. Null and empty texts have no shingles and link with nothing: their component is their
    own id. Rows that repeat an id are compared each; a null id is never the least unless all are null.
    """
    sets = written(shingle_sets(docs), "shingle-sets")
    lists = written(prefix_lists(sets), "prefix-lists")
    block = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(BLOCK_RATIO)))
    roots = written(linked_components(lists, verifier(sets), possible, block, 1, 1 - PERCENT / 100, sketcher(sets), near), "roots")
    rows = sets.select("doc_id", "size", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = written(rows, "rows-with-root")
    least = written(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least-ids")
    return rows.join(least, "root", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each component the document with the least id goes on, with all rows of that id."""
    kept = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")
    found = similar_documents(docs.select("doc_id", "text")).groupBy("doc_id").agg(kept)
    return without(docs, written(found.filter("NOT kept").select("doc_id"), "gone"))
