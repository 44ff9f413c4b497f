"""Registry and small helpers shared by the operators: tables, scratch folders, batches, sieves of hashed keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ROWS_PER_SLICE = 512


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with equivalent SQL where there is one."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, as in local tests, a temporary folder is set; on a cluster that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """Small pieces of Arrow batches, so that what a task builds per piece stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_of(column: str = "text"):
    """The column as a string, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


SIEVE_BITS = 26


def sieve(keys: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bitmap of fixed size (2^bits bits, 8 MB) of a column ``key`` of longs, made by Spark and collected.

    A set bit says "perhaps there": it only saves shuffling rows that cannot match, and an exact join
    follows. However many keys there are, its size stays the same, so it may be broadcast.
    """
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    blocks = (
        keys.select(F.shiftright(slot, 16).alias("block"), slot.bitwiseAND(F.lit(0xFFFF)).alias("slot"))
        .distinct()
        .groupBy("block")
        .agg(F.collect_list(F.col("slot").cast("int")).alias("slots"))
    )

    def pack(batches):
        for batch in slices(batches, 64):
            packed = []
            for slots in batch.column("slots"):
                flags = np.zeros(1 << 16, np.uint8)
                flags[slots.values.to_numpy()] = 1
                packed.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], ["block", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in blocks.mapInArrow(pack, "block long, bits binary").toLocalIterator():
        out[row.block << 13 : (row.block + 1) << 13] = np.frombuffer(row.bits, np.uint8)
    return out


def sifted(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where a key may be in the sieve."""
    slot = keys.astype(np.int64) & np.int64(bitmap.size * 8 - 1)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def parted(docs: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``column`` (long) may be in ``wanted``, by a sieve, and the rows where it is not.

    So that only rows that a join may touch are shuffled, whole texts and all; null counts as a value.
    """
    key = F.xxhash64(F.col(column).cast("long"))
    bitmap = docs.sparkSession.sparkContext.broadcast(sieve(wanted.select(key.alias("key"))))

    @F.arrow_udf("boolean")
    def inside(keys: pa.Array) -> pa.Array:
        return pa.array(sifted(bitmap.value, keys.to_numpy()))

    return docs.filter(inside(key)), docs.filter(~inside(key))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in the written table ``gone`` (doc_id); null is an id too."""
    perhaps, stay = parted(docs, "doc_id", gone)
    return stay.unionByName(perhaps.join(gone, perhaps.doc_id.eqNullSafe(gone.doc_id), "left_anti"))
