"""Links among items that share signatures, without ever listing all pairs of a group.

``lists`` holds a row (key, id, size, pos, side) for each signature of an item. A pair is a candidate if an
index row and a probe row (``side`` 0 and 1, or 2 for both) meet under a key. Whole answers in three rounds:

1. Every probe of a list is compared with one leader of the list only, so a list of g near copies costs g
   comparisons. The leader is the member with the least ``pos``: where rare signatures come first, it is the
   one with the fewest parts of its own, the middle of a group of variants. The links found give first components.
2. A list with one component is finished. A member outside the largest component of its lists is compared
   with one member of it in ``SAMPLES`` of these lists.
3. What is left are pairs of different components; two members of the largest component of a list never
   meet. Where both were compared with the same leader, the triangle inequality answers for many of them; in
   lists of more than ``CROWDED`` rows, sketches of the whole items answer for nearly all others.

The joins are by equal keys on written tables, so Spark can split keys that many rows share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noviscan.llm.base import written

#: Lists in which an item outside the largest component is compared with a member of it.
SAMPLES = 3
#: Rows of a list from which on its members carry their sketches; a shorter list has no more than so many pairs a row.
CROWDED = 8

Verify = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the connected components of ``edges`` (a, b); root is the least id.

    A pass gives every id the least label of its neighbours' labels, and of its own, so paths shorten by
    jumps. Each pass is one written table, and the loop ends when no label changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("above"))
        raised = labels.join(up, "root", "left").select("id", "root", F.least("root", "above").alias("above"))
        near = both.join(raised.select(F.col("id").alias("b"), "above"), "b").groupBy(F.col("a").alias("id")).agg(F.min("above").alias("near"))
        step = raised.join(near, "id").select("id", F.col("root").alias("was"), F.least("above", "near").alias("root"))
        step = written(step, "labels")
        labels = step.select("id", "root")
        if step.filter("was <> root").isEmpty():
            return labels


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) after more ``links`` (a, b): only components that these join are worked on again."""
    of_a, of_b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
    joined = links.select("a", "b").join(of_a, "a", "left").join(of_b, "b", "left")
    joined = joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct()
    joined = written(joined, "joined-roots")
    if joined.isEmpty():
        return roots
    ends = joined.select(F.col("a").alias("id")).union(joined.select(F.col("b").alias("id"))).withColumn("root", F.col("id"))
    above = components(joined).select(F.col("id").alias("root"), F.col("root").alias("top"))
    known = roots.unionByName(ends).distinct().join(above, "root", "left")
    return written(known.select("id", F.coalesce("top", "root").alias("root")), "roots")


def linked_components(
    lists: DataFrame, verify: Verify, possible: Callable[[str, str], Column], block: Column, reach: int, limit: float | None = None,
    sketches: Callable[[DataFrame], DataFrame] | None = None, near: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """(id, root) of all items with a link, for written ``lists``; a key of one id costs its row only.

    ``verify`` maps pairs (a, b) to (a, b, linked, distance). ``possible(x, y)`` is a condition on the size
    and pos of two rows that every linking pair fulfils at one of its keys at least. ``block`` is a number by
    size; rows whose blocks differ by more than ``reach`` never link, so such blocks of a list are skipped.
    ``limit`` is the largest distance of linking items, for a distance that is a metric. ``sketches`` maps ids (id)
    to (id, sketch), and ``near(x, y)`` is a condition on the size and sketch of two rows that every linking pair fulfils.
    """
    index = lists.filter("side in (0, 2)").withColumn("block", block)
    probe = lists.filter("side in (1, 2)").withColumn("block", block)
    leaders = index.groupBy("key", "block").agg(F.min(F.struct("pos", "id", "size")).alias("y"))
    leaders = written(leaders.select("key", "block", "y.*"), "leaders")
    met = probe.alias("x").join(leaders.alias("y"), ["key", "block"]).filter(F.col("x.id") != F.col("y.id")).filter(possible("x", "y"))
    tested = written(verify(written(ordered(met).distinct(), "star-pairs")), "tested")
    first = components(tested.filter("linked"))

    rooted = written(with_root(lists, first), "lists-with-root")
    open_lists = written(mixed(rooted).withColumn("block", block), "open-lists")
    if open_lists.isEmpty():
        return first
    outside = open_lists.filter("root <> top and side in (1, 2)")
    picks = [F.min_by(F.struct("key", "block", "size", "pos"), F.xxhash64("key", F.lit(k))) for k in range(SAMPLES)]
    outside = outside.groupBy("id").agg(F.array_distinct(F.array(*picks)).alias("picks")).select("id", F.inline("picks"))
    inside = open_lists.filter("root = top and side in (0, 2)").groupBy("key", "block")
    samples = written(inside.agg(F.min_by(F.struct("id", "size", "pos"), F.struct("pos", F.xxhash64("id", "key"))).alias("y")).select("key", "block", "y.*"), "samples")
    met = outside.alias("x").join(samples.alias("y"), ["key", "block"]).filter(possible("x", "y"))
    second = written(ordered(met).distinct().join(tested, ["a", "b"], "left_anti"), "sample-pairs")
    again = written(verify(second), "tested")
    roots, tested = extended(first, again.filter("linked")), tested.union(again)

    if limit is not None:
        open_lists = with_leader(open_lists, leaders, tested)
    else:
        open_lists = open_lists.withColumns({"leader": F.lit(None).cast("long"), "far": F.lit(None).cast("double")})
    open_lists = written(mixed(with_root(open_lists.drop("root", "top", "rows"), roots)), "open-lists")
    if sketches is not None:
        crowded = open_lists.filter(F.col("rows") > CROWDED)
        drawn = written(sketches(crowded.select("id").distinct()), "sketches")
        few = open_lists.filter(F.col("rows") <= CROWDED).withColumn("sketch", F.lit(None).cast(drawn.schema["sketch"].dataType))
        open_lists = few.unionByName(written(crowded.join(drawn, "id", "left"), "crowded-lists"))
    answered = F.coalesce(
        (F.col("x.leader") == F.col("y.leader")) & (F.abs(F.col("x.far") - F.col("y.far")) > (limit or 0.0) + 1e-9), F.lit(False)
    )
    left, right = open_lists.filter("side in (1, 2)"), open_lists.filter("side in (0, 2)")
    pairs = None
    for x, y in ((left.filter("root <> top"), right), (left.filter("root = top"), right.filter("root <> top"))):
        spread = x.withColumn("block", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)))
        met = spread.alias("x").join(y.alias("y"), ["key", "block"])
        met = met.filter("x.root <> y.root").filter(possible("x", "y")).filter(~answered)
        met = ordered(met if near is None else met.filter(F.coalesce(near("x", "y"), F.lit(True))))
        pairs = met if pairs is None else pairs.union(met)
    rest = written(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "cross-pairs")
    return extended(roots, verify(rest).filter("linked"))


def with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of their id, the id itself where it has no link."""
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def mixed(rows: DataFrame) -> DataFrame:
    """The rows of lists with more than one root, with ``top``, the root of most rows of the list, and its number of ``rows``."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    lists = counts.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("rows"))
    return rows.join(written(lists.filter("roots > 1").select("key", F.col("top.root").alias("top"), "rows"), "mixed-lists"), "key")


def with_leader(rows: DataFrame, leaders: DataFrame, tested: DataFrame) -> DataFrame:
    """``rows`` with the leader of their list and block and the distance to it, null where it is not known."""
    led = rows.join(leaders.select("key", "block", F.col("id").alias("leader")), ["key", "block"], "left")
    led = led.withColumns({"a": F.least("id", "leader"), "b": F.greatest("id", "leader")})
    known = led.join(tested.select("a", "b", "distance"), ["a", "b"], "left").drop("a", "b")
    return known.withColumn("far", F.when(F.col("id") == F.col("leader"), 0.0).otherwise(F.col("distance"))).drop("distance")


def ordered(met: DataFrame) -> DataFrame:
    """The ids of the two sides as a pair (a, b) with a < b."""
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
