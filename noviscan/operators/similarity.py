"""Similarity joins: k nearest by cosine, and earliest neighbour above a threshold.

Two physical forms give the same rows:

* ``broadcast``: the index side is counted first; when ``rows * dim * 8`` fits
  ``cfg.broadcast_bytes`` it goes to the executors once and queries stay where they are (no shuffle).
* ``cells``: both sides are routed to cells by an equi-key and split into blocks of bounded size, so
  no task ever sees more than one index block and a bounded number of query blocks, however hot a
  cell or group is. Without a group column the cells come from a few hundred pivot vectors; a first
  pass over the nearest cells gives each query a lower bound for its k-th similarity, and a second
  pass visits those cells whose angular bound can still beat it. Small cells are put together in bins of
  about a block there, so a query is sent once a bin however many of its cells are open. The result is exact.

Only ``k`` rows per query and block leave a task; row pairs are never materialised, and a task holds a score
matrix of ``SCORES_AT_ONCE`` numbers at most. Scores in single precision only choose which pairs are scored.
Similarities are ranked after rounding to nine decimals, ties by id, so results do not depend on
how the matrices were blocked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.session import cut_lineage

RANK_DECIMALS = 9
QUERY_BLOCKS_PER_TASK = 2
BLOCK_BYTES = 8 * 1024 * 1024
SCORES_AT_ONCE = 1 << 20
#: Index rows whose scores are made at one time, so that many queries share one reading of them.
INDEX_AT_ONCE = 1 << 14
#: Pairs whose vectors are gathered at one time.
PAIRS_AT_ONCE = 1 << 13
#: Index rows from which a query costs more than moving it, so that queries are dealt out however few splits they have.
DEALT_FROM = 1 << 12
TASKS_PER_CORE = 4
#: Rows that routing hands over at one time, each with its vector.
ROUTED_ROWS = 8192


def unit_rows(vectors) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 1))
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    lengths[lengths == 0.0] = 1.0
    return matrix / lengths


def _skip_mask(left: np.ndarray | None, right: np.ndarray | None):
    if left is None or right is None:
        return None
    return left[:, None] == right[None, :]


def best_k(queries: np.ndarray, index: np.ndarray, k: int, skip=None, rough=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, index row, similarity) of the k best index rows per query row, all of them unit vectors.

    Scores in single precision (``rough``: both sides in it) choose the candidates, with room for their error; these
    are scored in double precision.
    """
    left, right = rough if rough is not None else (queries.astype(np.float32), index.astype(np.float32))
    scores = left @ right.T
    if skip is not None:
        scores[skip] = -np.inf
    take = min(k, scores.shape[1])
    # The k-th best of the peaks of column groups is a lower bound for the k-th best score.
    groups = max(1, min(scores.shape[1], 16 * take, 4096))
    even = scores.shape[1] // groups * groups
    peaks = scores[:, :even].reshape(len(scores), -1, groups).max(axis=1)
    peaks = np.concatenate([peaks, scores[:, even:]], axis=1)
    bound = np.partition(peaks, peaks.shape[1] - take, axis=1)[:, peaks.shape[1] - take] if take <= groups else np.full(len(scores), -np.inf)
    error = (queries.shape[1] + 4) * 2.0**-23 + 10.0**-RANK_DECIMALS
    rows, cols = np.nonzero(scores >= (bound - np.float32(2 * error))[:, None])
    finite = np.isfinite(scores[rows, cols])
    rows, cols = rows[finite], cols[finite]
    values = np.round(_cosines(queries, index, rows, cols), RANK_DECIMALS)
    keep = _first(rows, cols, values, take)
    return rows[keep], cols[keep], values[keep]


def _cosines(queries: np.ndarray, index: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    if len(rows) * 16 > len(queries) * len(index):
        return (queries @ index.T)[rows, cols]
    out = np.empty(len(rows))
    for start in range(0, len(rows), PAIRS_AT_ONCE):
        some = slice(start, start + PAIRS_AT_ONCE)
        out[some] = np.einsum("ij,ij->i", queries[rows[some]], index[cols[some]])
    return out


def _first(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, take: int) -> np.ndarray:
    """Places of the ``take`` best of each row, by value and then by column."""
    order = np.lexsort((cols, -values, rows))
    ranked = rows[order]
    return order[np.arange(len(ranked)) - np.searchsorted(ranked, ranked, side="left") < take]


def steps(queries: int, index: int) -> Iterator[slice]:
    """Slices of the query rows whose scores against the index rows are few enough to hold."""
    step = max(1, SCORES_AT_ONCE // max(1, index))
    return (slice(start, start + step) for start in range(0, queries, step))


def best_k_of(queries: np.ndarray, index: np.ndarray, k: int, left=None, right=None, rough=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_k`` tile by tile; rows whose ``left`` equals an index row's ``right`` skip it. ``rough``: the index in
    single precision, where it is at hand."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    small = queries.astype(np.float32), index.astype(np.float32) if rough is None else rough
    for some in steps(len(queries), min(len(index), INDEX_AT_ONCE)):
        parts = []
        for start in range(0, len(index), INDEX_AT_ONCE):
            block = slice(start, start + INDEX_AT_ONCE)
            skip = _skip_mask(left[some], right[block]) if left is not None and right is not None else None
            rows, cols, values = best_k(queries[some], index[block], k, skip, (small[0][some], small[1][block]))
            parts.append((rows + some.start, cols + start, values))
        if parts:
            rows, cols, values = (np.concatenate(part) for part in zip(*parts))
            keep = _first(rows, cols, values, k)
            found.append((rows[keep], cols[keep], values[keep]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _id_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _result_schema(queries: DataFrame, index: DataFrame, qid: str, cid: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", _id_type(queries, qid)),
            T.StructField("chunk_id", _id_type(index, cid)),
            T.StructField("base_similarity", T.DoubleType()),
        ]
    )


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy(F.desc("base_similarity"), "chunk_id")
    return pairs.withColumn("raw_rank", F.row_number().over(nearest)).filter(F.col("raw_rank") <= k)


def _dimension(df: DataFrame, vector: str) -> int:
    row = df.select(F.size(vector).alias("n")).first()
    return int(row["n"]) if row else 0


def top_k(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    *,
    cfg: EngineConfig = DEFAULTS,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    group: str | None = None,
    differ_on: str | None = None,
    strategy: str = "auto",
    probes: int = 8,
) -> DataFrame:
    """k nearest index rows per query by raw cosine.

    ``group``: column on both sides; only rows of the same group are compared.
    ``differ_on``: column on both sides; rows with equal values are not compared (no self match).
    ``strategy``: ``auto``, ``broadcast``, ``cells`` (exact) or ``probe`` (approximate: nearest cells only).
    Returns query_id, chunk_id, base_similarity, raw_rank.
    """
    extra = [c for c in (differ_on,) if c]
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("qv"), *_keys(group, extra, "q"))
    x = index.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).alias("xv"), *_keys(group, extra, "x"))
    schema = _result_schema(queries, index, query_id, chunk_id)

    if strategy == "broadcast" or (strategy == "auto" and group is None):
        fits = x.count() * max(1, _dimension(x, "xv")) * 8 <= cfg.broadcast_bytes
        if strategy == "broadcast" and not fits:
            raise ValueError(f"the index is larger than broadcast_bytes = {cfg.broadcast_bytes}")
        strategy = "broadcast" if fits else "cells"
    if strategy == "broadcast":
        return _rank(_broadcast_pairs(q, x, k, schema, bool(extra)), k)
    if group is not None:
        routed_q = q.withColumnRenamed("q_group", "cell")
        routed_x = x.withColumnRenamed("x_group", "cell")
        return _rank(_block_pairs(routed_q, routed_x, k, schema, bool(extra)), k)
    return _cell_pairs(q, x, k, schema, bool(extra), probes, exact=strategy != "probe")


def _keys(group: str | None, extra: list[str], side: str):
    columns = []
    if group:
        columns.append(F.col(group).alias(f"{side}_group"))
    columns += [F.col(c).alias(f"{side}_differ") for c in extra]
    return columns


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows in tasks of even size: a file of one row group is one task, whatever splits it has."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, by)


def _broadcast_pairs(q: DataFrame, x: DataFrame, k: int, schema: T.StructType, differs: bool) -> DataFrame:
    # top_k has checked the size of x against cfg.broadcast_bytes.
    table = x.toPandas().sort_values("chunk_id", kind="stable").reset_index(drop=True)
    payload = (
        table["chunk_id"].to_numpy(),
        unit_rows(table["xv"]),
        table["x_differ"].to_numpy() if differs else None,
    )
    shared = q.sparkSession.sparkContext.broadcast(payload)
    q = _dealt(q, "query_id") if len(table) >= DEALT_FROM else q

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, differ = shared.value
        if not len(ids):
            return
        small = matrix.astype(np.float32)
        for batch in batches:
            own = batch["q_differ"].to_numpy() if differs else None
            rows, cols, values = best_k_of(unit_rows(batch["qv"]), matrix, k, own, differ, small)
            yield pd.DataFrame(
                {"query_id": batch["query_id"].to_numpy()[rows], "chunk_id": ids[cols], "base_similarity": values}
            )

    return q.mapInPandas(nearest, schema)


def _block_rows(x: DataFrame) -> int:
    return max(16, BLOCK_BYTES // (8 * max(1, _dimension(x, "xv"))))


def _split(q: DataFrame, x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread every cell over bounded (index block, query slice) keys."""
    rows = _block_rows(x)
    sizes = (
        x.groupBy("cell").agg(F.count(F.lit(1)).alias("nx"))
        .join(q.groupBy("cell").agg(F.count(F.lit(1)).alias("nq")), "cell")
        .select(
            "cell",
            F.ceil(F.col("nx") / rows).cast("int").alias("blocks"),
            F.ceil(F.col("nq") / (rows * QUERY_BLOCKS_PER_TASK)).cast("int").alias("slices"),
        )
    )
    left = (
        q.join(sizes, "cell")
        .withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .drop("blocks", "slices")
    )
    right = (
        x.join(sizes, "cell")
        .withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .drop("blocks", "slices")
    )
    return left, right


def _block_pairs(q: DataFrame, x: DataFrame, k: int, schema: T.StructType, differs: bool) -> DataFrame:
    left, right = _split(q, x)

    def nearest(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if part.empty or block.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        block = block.sort_values("chunk_id", kind="stable")
        apart = (part["q_differ"].to_numpy(), block["x_differ"].to_numpy()) if differs else (None, None)
        rows, cols, values = best_k_of(unit_rows(part["qv"]), unit_rows(block["xv"]), k, *apart)
        return pd.DataFrame(
            {
                "query_id": part["query_id"].to_numpy()[rows],
                "chunk_id": block["chunk_id"].to_numpy()[cols],
                "base_similarity": values,
            }
        )

    keys = ["cell", "block", "slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, schema)


def _pivots(x: DataFrame, rows: int) -> np.ndarray:
    """A fixed number of index vectors (at most 256), picked by hash: bounded on the driver."""
    wanted = int(min(256, max(4, round(rows**0.5))))
    picked = x.select("xv", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(wanted).toPandas()
    return unit_rows(picked["xv"])


def _cell_pairs(
    q: DataFrame, x: DataFrame, k: int, schema: T.StructType, differs: bool, probes: int, exact: bool
) -> DataFrame:
    spark = q.sparkSession
    total = x.count()
    if total >= DEALT_FROM:
        q, x = _dealt(q, "query_id"), _dealt(x, "chunk_id")
    pivots = spark.sparkContext.broadcast(_pivots(x, total))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cosines = np.clip(unit_rows(batch["xv"]) @ pivots.value.T, -1.0, 1.0)
            cell = cosines.argmax(axis=1)
            yield batch.assign(cell=cell, angle=np.arccos(cosines[np.arange(len(batch)), cell]))

    x_schema = T.StructType([*x.schema.fields, T.StructField("cell", T.LongType()), T.StructField("angle", T.DoubleType())])
    placed = x.mapInPandas(assign, x_schema)
    radius_rows = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # one row per pivot
    reach, sizes = np.full(len(pivots.value), -np.inf), np.zeros(len(pivots.value), np.int64)
    for row in radius_rows:
        reach[row["cell"]], sizes[row["cell"]] = row["radius"], row["n"]
    order, bins, heads = _bins(sizes, pivots.value, _block_rows(x))
    radii = spark.sparkContext.broadcast(reach)

    def bounds(vectors) -> np.ndarray:
        """Upper bound of the cosine between each query and anything inside each cell."""
        angles = np.arccos(np.clip(unit_rows(vectors) @ pivots.value.T, -1.0, 1.0))
        best = np.cos(np.maximum(0.0, angles - radii.value))
        best[:, ~np.isfinite(radii.value)] = -np.inf
        return best

    def near(vectors) -> np.ndarray:
        return np.argsort(-bounds(vectors), axis=1, kind="stable")[:, :probes]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = near(batch["qv"])
            yield from routed(batch, np.repeat(np.arange(len(batch)), cells.shape[1]), cells.ravel())

    def routed(batch: pd.DataFrame, rows: np.ndarray, cells: np.ndarray) -> Iterator[pd.DataFrame]:
        for start in range(0, len(rows), ROUTED_ROWS):
            some = slice(start, start + ROUTED_ROWS)
            yield batch.iloc[rows[some]].assign(cell=cells[some].astype(np.int64))

    q_schema = T.StructType([*q.schema.fields, T.StructField("cell", T.LongType())])
    stored = placed.drop("angle")
    first = _rank(_block_pairs(q.mapInPandas(probe, q_schema), stored, k, schema, differs), k)
    if not exact:
        return first
    first = cut_lineage(first)  # k rows a query, read twice below

    floor = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("base_similarity").alias("kth"))
    waiting = q.join(floor, "query_id", "left").withColumn(
        "kth", F.when(F.col("found") >= k, F.col("kth")).otherwise(F.lit(-2.0))
    ).drop("found")

    def remaining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            limit = bounds(batch["qv"])
            open_cells = limit >= batch["kth"].to_numpy()[:, None] - 1e-8
            open_cells[np.arange(len(batch))[:, None], near(batch["qv"])] = False
            open_bins = np.logical_or.reduceat(open_cells[:, order], heads, axis=1)
            yield from routed(batch.drop(columns="kth"), *np.nonzero(open_bins))

    binned = spark.createDataFrame([(c, int(b)) for c, b in zip(order.tolist(), bins)], "cell long, bin long")
    in_bins = stored.join(F.broadcast(binned), "cell").drop("cell").withColumnRenamed("bin", "cell")
    second = _block_pairs(waiting.mapInPandas(remaining, q_schema), in_bins.select(stored.columns), k, schema, differs)
    # A bin may hold cells of the first pass too.
    return _rank(first.drop("raw_rank").unionByName(second).dropDuplicates(["query_id", "chunk_id"]), k)


def _bins(sizes: np.ndarray, pivots: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in an order of neighbours, the bin of each in that order, and where bins begin: cells are put
    together until a bin has ``rows`` rows."""
    order, left = [0], set(range(1, len(sizes)))
    while left:  # at most 256 cells
        rest = np.array(sorted(left))
        order.append(int(rest[(pivots[rest] @ pivots[order[-1]]).argmax()]))
        left.remove(order[-1])
    bins, filled, current = [], 0, 0
    for cell in order:
        if filled and filled + sizes[cell] > rows:
            current, filled = current + 1, 0
        bins.append(current)
        filled += sizes[cell]
    bins = np.array(bins)
    return np.array(order), bins, np.flatnonzero(np.diff(bins, prepend=-1))


def earliest_neighbour(items: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Per item the lowest-positioned candidate of its group that precedes it with cosine >= threshold.

    Both sides: cell (group), item_id, pos, embedding. Returns item_id, by_pos, by_id, similarity;
    at most one row per item and index block leaves a task.
    """
    q = items.select(F.col("cell").alias("cell"), F.col("item_id").alias("query_id"), F.col("pos").alias("q_pos"), F.col("embedding").alias("qv"))
    x = candidates.select(F.col("cell").alias("cell"), F.col("item_id").alias("chunk_id"), F.col("pos").alias("x_pos"), F.col("embedding").alias("xv"))
    left, right = _split(q, x)
    schema = T.StructType(
        [
            T.StructField("item_id", _id_type(items, "item_id")),
            T.StructField("by_pos", T.LongType()),
            T.StructField("by_id", _id_type(candidates, "item_id")),
            T.StructField("similarity", T.DoubleType()),
        ]
    )

    def first(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if part.empty or block.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        block = block.sort_values("x_pos", kind="stable")
        queries, index = unit_rows(part["qv"]), unit_rows(block["xv"])
        q_pos, x_pos = part["q_pos"].to_numpy(), block["x_pos"].to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for some in steps(len(queries), len(index)):
            scores = np.round(queries[some] @ index.T, RANK_DECIMALS)
            hits = (scores >= threshold) & (x_pos[None, :] < q_pos[some, None])
            rows = np.nonzero(hits.any(axis=1))[0]
            cols = hits[rows].argmax(axis=1)
            found.append((rows + some.start, cols, scores[rows, cols]))
        rows, cols, values = (np.concatenate(column) for column in zip(*found))
        return pd.DataFrame(
            {
                "item_id": part["query_id"].to_numpy()[rows],
                "by_pos": x_pos[cols],
                "by_id": block["chunk_id"].to_numpy()[cols],
                "similarity": values,
            }
        )

    keys = ["cell", "block", "slice"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(first, schema)
    return (
        found.groupBy("item_id")
        .agg(F.min(F.struct("by_pos", "by_id", "similarity")).alias("m"))
        .select("item_id", "m.by_pos", "m.by_id", "m.similarity")
    )
