"""Index tables: fingerprints, diffs, upserts, statistics, health."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions.identity import note_hash
from noviscan.operators.ordering import one_row


def fingerprints(notes: DataFrame, cfg: EngineConfig = DEFAULTS, *more: Column) -> DataFrame:
    """note_path, hash, mtime and ``more`` columns of each note."""
    return notes.select(
        "note_path", note_hash(F.col("title"), F.col("aliases"), F.col("tags"), F.col("content"), cfg).alias("hash"), "mtime", *more
    )


def diff(current: DataFrame, stored: DataFrame, config_changed: Column | bool = False) -> DataFrame:
    """note_path, change: new, changed, unchanged or removed; a changed configuration rebuilds everything."""
    force = F.lit(config_changed) if isinstance(config_changed, bool) else config_changed
    c = current.select("note_path", F.col("hash").alias("h1"), F.col("mtime").alias("m1"), F.lit(True).alias("now"))
    s = stored.select("note_path", F.col("hash").alias("h0"), F.col("mtime").alias("m0"), F.lit(True).alias("before"))
    same = (F.col("h1") == F.col("h0")) & F.col("m1").eqNullSafe(F.col("m0"))
    change = (
        F.when(F.col("now").isNull(), "removed")
        .when(F.col("before").isNull(), "new")
        .when(force | ~F.coalesce(same, F.lit(False)), "changed")
        .otherwise("unchanged")
    )
    return c.join(s, "note_path", "full_outer").select("note_path", change.alias("change"))


def stale_count(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count_if(F.col("change") != "unchanged").alias("stale_notes"))


def removed_paths(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.select("note_path").distinct().join(current.select("note_path"), "note_path", "left_anti")


def upsert(table: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "note_path") -> DataFrame:
    """Table without the touched keys plus the fresh rows (touched keys without fresh rows vanish)."""
    keys = touched.select(key).distinct()
    return table.join(keys, key, "left_anti").unionByName(fresh.join(keys, key, "left_semi"))


def delete_note_chunks(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Drop all chunks of the given notes, by path column or, where that is null, by the id prefix."""
    keys = paths.select("note_path").distinct()
    owner = F.coalesce(F.col("note_path"), F.regexp_extract("chunk_id", r"(?s)^(.*)::\d+$", 1))
    marked = chunks.withColumn("__owner", owner)
    return marked.join(keys.withColumnRenamed("note_path", "__owner"), "__owner", "left_anti").select(*chunks.columns)


def upsert_report(touched: DataFrame, current: DataFrame) -> DataFrame:
    """Per touched path whether it was indexed or is missing."""
    have = current.select("note_path", F.lit(True).alias("__have"))
    return touched.select("note_path").distinct().join(have, "note_path", "left").select(
        "note_path", F.when(F.col("__have"), "indexed").otherwise("missing").alias("outcome")
    )


def index_stats(changes: DataFrame, notes: DataFrame, chunks: DataFrame, full: bool) -> DataFrame:
    """One row: notes, links, chunks, indexed, skipped, removed, chunks added, mode."""
    by_change = changes.agg(
        F.count_if(F.col("change").isin("new", "changed")).alias("indexed_notes"),
        F.count_if(F.col("change") == "unchanged").alias("skipped_notes"),
        F.count_if(F.col("change") == "removed").alias("removed_notes"),
    )
    note_totals = notes.agg(
        F.count(F.lit(1)).alias("note_count"), F.coalesce(F.sum(F.size("wikilinks")), F.lit(0)).cast("long").alias("link_count")
    )
    fresh = changes.filter(F.col("change").isin("new", "changed")).select("note_path", F.lit(True).alias("__fresh"))
    chunk_totals = chunks.join(fresh, "note_path", "left").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_if("__fresh").alias("chunks_added")
    )
    return one_row(note_totals, chunk_totals, by_change).withColumn("index_mode", F.lit("full" if full else "incremental"))


def embeddings_to_make(texts: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Distinct texts by content hash that are not in the embedding cache yet."""
    distinct = texts.select(F.sha1("text").alias("text_sha1"), "text").dropDuplicates(["text_sha1"])
    return distinct if cache is None else distinct.join(cache.select("text_sha1"), "text_sha1", "left_anti")


def index_meta(spark: SparkSession, vault_id: str, cfg: EngineConfig, chunk_count: int, note_count: int, mode: str, at: datetime | None = None) -> DataFrame:
    """One metadata row per (vault, space)."""
    row = (
        vault_id, cfg.space_id(), cfg.provider, cfg.model, cfg.chunk_size, cfg.chunk_overlap,
        int(chunk_count), int(note_count), at or datetime.now(UTC), mode,
    )
    return spark.createDataFrame(
        [row],
        "vault_id string, space_id string, provider string, model string, chunk_size int, chunk_overlap int, "
        "chunk_count long, note_count long, indexed_at timestamp, index_mode string",
    )


def latest_meta(meta: DataFrame) -> DataFrame:
    return (
        meta.groupBy("vault_id", "space_id")
        .agg(F.max_by(F.struct(*[c for c in meta.columns if c not in ("vault_id", "space_id")]), "indexed_at").alias("m"))
        .select("vault_id", "space_id", "m.*")
    )


def health_warnings(meta: DataFrame, stale: DataFrame, has_fingerprints: Column, cfg: EngineConfig = DEFAULTS, vault_id: str | None = None) -> DataFrame:
    """Warning rows of one or more index metadata rows joined with their stale note counts.

    ``meta``: vault_id, provider, model, chunk_size, chunk_count (null provider = metadata missing).
    ``stale``: vault_id, stale_notes.
    """
    m = meta.join(stale, "vault_id", "left")
    empty = F.col("chunk_count") <= 0
    missing = F.col("provider").isNull()
    model_changed = (F.col("provider") != cfg.provider) | (F.col("model") != cfg.model)
    rows = F.array_compact(
        F.array(
            F.when(model_changed, F.concat(
                F.lit("embedder: stored "), F.col("provider"), F.lit("/"), F.col("model"),
                F.lit(f", wanted {cfg.provider}/{cfg.model}"),
            )),
            F.when(F.col("chunk_size").isNull(), F.lit("chunk size: not stored")).when(F.col("chunk_size") != cfg.chunk_size, F.concat(
                F.lit("chunk size: stored "), F.col("chunk_size"), F.lit(f", wanted {cfg.chunk_size}"),
            )),
            F.when(F.lit(vault_id) != F.col("vault_id"), F.concat(
                F.lit("vault: stored "), F.col("vault_id"), F.lit(f", wanted {vault_id}"),
            )) if vault_id else F.lit(None).cast("string"),
            F.when(has_fingerprints & (F.col("stale_notes") > 0), F.concat(
                F.col("stale_notes"), F.lit(" stale notes"),
            )).when(~has_fingerprints, F.lit("fingerprints: not stored")),
        )
    )
    none = F.array(F.lit("empty index: every source counts as novel"))
    lost = F.array(F.lit("metadata: not stored"))
    return m.select("vault_id", F.posexplode(F.when(empty, none).when(missing, lost).otherwise(rows)).alias("warning_pos", "warning"))


def export_chunks(chunks: DataFrame, limit: int = 5000) -> DataFrame:
    """The first ``limit`` portable chunk rows in id order, with a flag telling whether more exist."""
    take = max(1, limit)
    # One row more than asked for shows whether something was left out.
    picked = chunks.select("chunk_id", "note_path", "text").orderBy("chunk_id").limit(take + 1)
    numbered = picked.select(
        "*", F.row_number().over(Window.orderBy("chunk_id")).alias("__at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__n")
    )
    return numbered.filter(F.col("__at") <= take).withColumn("truncated", F.col("__n") > take).drop("__at", "__n")


# Versioned snapshots: a snapshot directory per version and a one-row pointer file.


def write_snapshot(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> str:
    path = f"{root.rstrip('/')}/v={version}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark = df.sparkSession
    pointer = spark.createDataFrame([(version, path)], "version string, path string").coalesce(1)
    pointer.write.mode("overwrite").json(f"{root.rstrip('/')}/_current")
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    pointer = spark.read.schema("version string, path string").json(f"{root.rstrip('/')}/_current").first()
    return spark.read.parquet(pointer["path"])
