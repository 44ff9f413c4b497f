"""Near-duplicate proposals: an earlier kept note claims every later note that is too similar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noviscan.config import DEFAULTS, EngineConfig
from noviscan.functions import text as X
from noviscan.functions import vectors as V
from noviscan.operators.similarity import RANK_DECIMALS, earliest_neighbour, unit_rows
from noviscan.session import cut_lineage

#: Sources of at most so many different vectors are walked in one task.
LOCAL_ITEMS = 4096
STRIP = 256
ITEMS_PER_PIVOT = 32
LEAST_PIVOTS, MOST_PIVOTS = 16, 1024
#: Pivots are the vectors farthest apart among so many times as many.
SAMPLE_PER_PIVOT = 4


def fingerprint_text(title: Column, content: Column) -> Column:
    """Compact text of a proposal: no header block, no heading marks, first 800 characters of the body."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^---[\s\S]*?---\s*", "")
    body = X.squeeze(F.regexp_replace(body, r"(?U)#{1,6}\s+", ""))
    return X.strip(F.concat(X.strip(title), F.lit("\n"), F.substring(body, 1, 800)))


def claim_duplicates(items: DataFrame, cfg: EngineConfig = DEFAULTS, local_items: int = LOCAL_ITEMS) -> DataFrame:
    """item_id, duplicate_of, similarity for every claimed item.

    ``items``: source_id, item_id, pos (claim order inside the source: novel first, then position),
    embedding. Equal vectors are folded to their first item before anything is compared, so a mass of
    copies costs one comparison each. Sources of at most ``local_items`` vectors are walked in order, one task a
    source, each vector against the kept ones. Larger sources are cut into angular cells and settled in rounds
    (``_rounds``). Zero and null vectors are similar to nothing; items at the same position do not claim each other.
    """
    threshold = cfg.duplicate_threshold
    # Rounding to 12 decimals makes vectors equal that differ only in float noise.
    unit = F.transform(V.normalize(F.col("embedding")), lambda v: F.round(v, 12))
    keyed = items.withColumn("cell", F.col("source_id").cast("string")).withColumn("vec_key", F.sha2(F.to_json(F.struct(unit.alias("u"))), 256))
    firsts = keyed.groupBy("cell", "vec_key").agg(F.min_by(F.struct("item_id", "pos", "embedding"), "pos").alias("f"))
    leaders = firsts.select("cell", "vec_key", "f.*")
    apart = leaders.filter(V.norm(F.col("embedding")) > 0).select("cell", "item_id", "pos", "embedding")
    sizes = apart.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    everyone = cut_lineage(apart.join(sizes, "cell"))
    small = everyone.filter(F.col("n") <= local_items)
    claimed = small.groupBy("cell").applyInPandas(_walk(threshold), _claim_schema(items))
    large = everyone.filter(F.col("n") > local_items).drop("n")
    if not large.isEmpty():
        claimed = claimed.unionByName(_rounds(large, threshold))
    groups = leaders.select("cell", "vec_key", F.col("item_id").alias("leader")).join(
        claimed.select(F.col("item_id").alias("leader"), "by_id", "similarity"), "leader", "left"
    )
    filled = V.norm(F.col("embedding")) > 0
    members = keyed.withColumn("__filled", filled).select("cell", "vec_key", "item_id", "__filled").join(groups, ["cell", "vec_key"])
    copy = (F.col("item_id") != F.col("leader")) & F.col("__filled")
    return members.select(
        "item_id",
        F.coalesce("by_id", F.when(copy, F.col("leader"))).alias("duplicate_of"),
        F.round(F.coalesce("similarity", F.when(copy, F.lit(1.0))), 3).alias("similarity"),
    ).filter(F.col("duplicate_of").isNotNull())


def _claim_schema(items: DataFrame) -> T.StructType:
    kind = items.schema["item_id"].dataType
    return T.StructType([T.StructField("item_id", kind), T.StructField("by_id", kind), T.StructField("similarity", T.DoubleType())])


def _walk(threshold: float):
    """Claims inside one source of bounded size: a strip of vectors against those kept before it, then in itself."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pos", "item_id"], kind="stable")
        vectors, pos = unit_rows(group["embedding"]), group["pos"].to_numpy()
        kept: list[int] = []
        claims: list[tuple[int, int, float]] = []
        for start in range(0, len(pos), STRIP):
            strip = vectors[start : start + STRIP]
            before = np.array(kept, dtype=np.int64)
            scores = np.round(strip @ vectors[before].T, RANK_DECIMALS)
            hits = (scores >= threshold) & (pos[before][None, :] < pos[start : start + STRIP, None])
            inner = np.round(strip @ strip.T, RANK_DECIMALS)
            fresh: list[int] = []
            for i in range(len(strip)):
                if hits[i].any():
                    j = int(hits[i].argmax())
                    claims.append((start + i, kept[j], scores[i, j]))
                    continue
                near = [j for j in fresh if inner[i, j] >= threshold and pos[start + j] < pos[start + i]]
                if near:
                    claims.append((start + i, start + near[0], inner[i, near[0]]))
                else:
                    fresh.append(i)
            kept += [start + i for i in fresh]
        ids = group["item_id"].to_numpy()
        rows, owners, similar = zip(*claims) if claims else ((), (), ())
        return pd.DataFrame({"item_id": ids[list(rows)], "by_id": ids[list(owners)], "similarity": np.array(similar, dtype=float)})

    return walk


def _rounds(everyone: DataFrame, threshold: float) -> DataFrame:
    """Claims inside large sources: item_id, by_id, similarity.

    Rounds run until every item is settled, however many it takes: an item without an earlier open neighbour is
    kept, an item with an earlier kept neighbour is a repeat. At the end each repeat is given to its earliest
    kept neighbour. A pass compares an item with the angular cells that may hold a neighbour of it and
    emits at most one row per item and block.
    """
    everyone = cut_lineage(angular_cells(everyone, threshold))

    def nearest(some: DataFrame, candidates: DataFrame) -> DataFrame:
        return earliest_neighbour(some.withColumn("cell", F.explode("visits")), candidates.withColumn("cell", F.col("home")), threshold)

    open_items, kept = everyone, None
    while not open_items.isEmpty():
        blocked = nearest(open_items, open_items).select("item_id")
        fresh = cut_lineage(open_items.join(blocked, "item_id", "left_anti"))
        kept = fresh if kept is None else kept.unionByName(fresh)
        rest = open_items.join(fresh.select("item_id"), "item_id", "left_anti")
        lost = nearest(rest, fresh).select("item_id")
        open_items = cut_lineage(rest.join(lost, "item_id", "left_anti"))
    repeated = everyone.join(kept.select("item_id"), "item_id", "left_anti")
    return nearest(repeated, kept).select("item_id", "by_id", "similarity")


def farthest_apart(vectors: np.ndarray, wanted: int) -> np.ndarray:
    """``wanted`` of the unit ``vectors``, each the one least similar to those before it."""
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < min(wanted, len(vectors)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def angular_cells(items: DataFrame, threshold: float) -> DataFrame:
    """``items`` with ``home``, the cell of its nearest pivot inside its source, and ``visits``, all cells of the
    source that may hold a vector with a cosine of ``threshold`` or more.

    A vector is at least (angle to the pivot - radius of the cell) away from anything in a cell, so no neighbour is
    lost. The pivots are far apart in a sample picked by hash, one per ``ITEMS_PER_PIVOT`` of the largest source and
    at most ``MOST_PIVOTS``: bounded on the driver. Where a vector has to visit more than an eighth of the cells, the
    bound does not pay for the copies it sends, and each source is one cell.
    """
    largest = items.groupBy("cell").count().agg(F.max("count")).first()[0]
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, largest // ITEMS_PER_PIVOT)))
    picked = items.select("embedding").orderBy(F.xxhash64("item_id", "cell")).limit(SAMPLE_PER_PIVOT * wanted).toPandas()
    apart = farthest_apart(unit_rows(picked["embedding"]), wanted)
    pivots = items.sparkSession.sparkContext.broadcast(apart)

    def angles(vectors) -> np.ndarray:
        return np.arccos(np.clip(unit_rows(vectors) @ pivots.value.T, -1.0, 1.0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = angles(batch["embedding"])
            yield batch.assign(pivot=found.argmin(axis=1), angle=found.min(axis=1) if len(batch) else [])

    placed = items.mapInPandas(assign, T.StructType([*items.schema.fields, T.StructField("pivot", T.LongType()), T.StructField("angle", T.DoubleType())]))
    placed = cut_lineage(placed)
    radii = np.full(len(apart), -np.inf)
    for row in placed.groupBy("pivot").agg(F.max("angle").alias("radius")).collect():  # one row per pivot
        radii[row["pivot"]] = row["radius"]
    reach = radii + np.arccos(np.clip(threshold - 10.0**-RANK_DECIMALS, -1.0, 1.0)) + 1e-6

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = angles(batch["embedding"]) <= reach
            yield batch.assign(open=[np.flatnonzero(row).tolist() for row in near])

    routed = cut_lineage(placed.mapInPandas(route, T.StructType([*placed.schema.fields, T.StructField("open", T.ArrayType(T.LongType()))])))
    if routed.agg(F.avg(F.size("open"))).first()[0] > len(apart) / 8:
        return items.withColumn("home", F.col("cell")).withColumn("visits", F.array("cell"))

    def named(pivot):
        return F.concat_ws("/", pivot.cast("string"), "cell")

    return routed.withColumn("home", named(F.col("pivot"))).withColumn("visits", F.transform("open", named)).drop("pivot", "angle", "open")
