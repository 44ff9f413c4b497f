"""Ordered operations that do not gather a whole key into one task.

A window over ``partitionBy(source)`` sorts all rows of that source in one task. Where the order is
an integer position, the functions here cut each key into blocks of ``BLOCK`` positions: rows are
shuffled once by (key, block), block totals are scanned per key, and the running value is block
offset + value inside the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def prefix_sums(df: DataFrame, keys: list[str], pos: str, values: dict[str, Column | str]) -> DataFrame:
    """Add, per output name, the sum of its value over all *earlier* positions of the key."""
    cols = {name: (F.expr(v) if isinstance(v, str) else v) for name, v in values.items()}
    staged = df.withColumn("__block", F.floor(F.col(pos) / BLOCK))
    for name, col in cols.items():
        staged = staged.withColumn(f"__v_{name}", F.coalesce(col.cast("long"), F.lit(0)))
    by = [*keys, "__block"]
    totals = staged.groupBy(*by).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in cols])
    earlier_blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, *[F.coalesce(F.sum(f"__t_{n}").over(earlier_blocks), F.lit(0)).alias(f"__o_{n}") for n in cols]
    )
    inside = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = staged.select(
        "*", *[F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)).alias(f"__l_{n}") for n in cols]
    )
    joined = local.join(offsets, by)
    for name in cols:
        joined = joined.withColumn(name, F.col(f"__o_{name}") + F.col(f"__l_{name}"))
    return joined.select(*df.columns, *cols)


def dense_index(df: DataFrame, keys: list[str], pos: str, out: str) -> DataFrame:
    """0-based gap-free index of each row inside its key, in ``pos`` order."""
    return prefix_sums(df, keys, pos, {out: F.lit(1)})


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns behind a one-row generator.

    Later filters and join keys on them stay above this point: the optimizer would otherwise copy
    these large expressions down into every filter it pushes. Costs no exchange.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))


def one_row(*frames: DataFrame) -> DataFrame:
    """Put several one-row tables side by side without a join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def keep_first(df: DataFrame, identity: list, order: list[str]) -> DataFrame:
    """One row per identity: the one with the smallest order columns (partial aggregation).

    Columns are kept one by one, so those that nobody reads, such as texts, are not carried.
    """
    keys = [c if isinstance(c, Column) else F.col(c) for c in identity]
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    first = df.select(*named, F.struct(*[F.col(c) for c in order]).alias("__ord"), *df.columns)
    return (
        first.groupBy(*[f"__k{i}" for i in range(len(keys))])
        .agg(*[F.min_by(c, "__ord").alias(c) for c in df.columns])
        .select(*df.columns)
    )


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    schema,
    step: Callable[[object, tuple], tuple[object, list[tuple]]],
    finish: Callable[[object], list[tuple]] | None = None,
) -> DataFrame:
    """Greedy, order-dependent scan with constant memory.

    Rows arrive sorted by keys and order; ``step(state, row)`` gets ``None`` at each new key and
    returns the next state and output rows. Only the state is held, so a key may be of any length.
    """
    names = df.columns
    key_at = [names.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, seen = None, None, False
        fields = [f.name for f in schema.fields]
        for batch in batches:
            produced: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                key = tuple(row[i] for i in key_at)
                if not seen or key != current:
                    if seen and finish is not None:
                        produced += finish(state)
                    state, current, seen = None, key, True
                state, out = step(state, row)
                produced += out
            yield pd.DataFrame(produced, columns=fields)
        if seen and finish is not None:
            yield pd.DataFrame(finish(state), columns=fields)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
