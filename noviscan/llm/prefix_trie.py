"""Trie of conversation prefixes, with subtree totals by parallel tree contraction.

A prefix is known by the sums of the hashes of its turns, each hashed together with its position, so prefixes
come from running sums over blocks of positions and no conversation is gathered in one task. Equal prefixes
are one node.

Totals over subtrees come from join rounds. *Rake*: a leaf adds its values to its parent and leaves the tree.
*Compress*: a chain of nodes with one child each becomes its top node; the others wait for the node below the
chain. Afterwards the rounds are gone through backwards, and each waiting node adds the total of that node to
what stood between. To compress a long chain in one round, a node is labelled by the member with the least hash.
The nodes of a label are one downward path, and a chain changes its label only where that member ends, on
any path expectedly O(log members) times. So a shuffle by label and block of depths brings chains together; blocks grow
by a factor per round as long as none holds more than ``GROUP_ROWS`` nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noviscan.llm.base import query, table, text_of, written
from noviscan.operators.ordering import prefix_sums

FAMILY = 5
HEADS = 9
BLOCK_GROWTH = 64
GROUP_ROWS = 4096
IDS_PER_PIECE = 4096
SUMS = ("s0", "s1", "s2", "s3")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, n_bytes) of every row with a conv_id; pos counts from 1 in the order of turn.

    A null turn comes first, rows of equal turn follow each other by the hash of role and text, a null role or
    text is empty. Rows are dealt out in ranges of this order and counted per range, so a conversation may be
    of any length. Other columns are not read.
    """
    role, text = text_of("`role`"), text_of("`text`")
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("turn_hash"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("turn_hash")]
    dealt = turns.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "dealt-turns")
    inside = W.partitionBy("conv_id", "part")
    local = dealt.withColumn("pos", F.row_number().over(inside.orderBy(*order)).cast("long"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).filter("before > 0")
    placed = local.join(before, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_hash", "n_bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv_id, length) after each conversation got the head of its family's first one.

    Conversation c takes the first h turns of conversation c - c % family (all if fewer), then its own turns
    after its first h; h is the CRC-32 of the decimal id modulo ``heads``. ``%`` keeps the sign of c. Only
    the first turns of a family's first conversation are copied, ``family`` times at most.
    """
    turns = written(turns, "turns")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    convs = convs.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % family, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    })
    convs = written(convs, "conversations")
    first = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    itself = F.col("conv_id") == F.col("base")
    length = F.when(itself, F.col("own")).otherwise(F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = written(convs.withColumn("length", length), "conversations")
    rest = turns.join(convs.select("conv_id", "base", "h", "taken", "length"), "conv_id")
    rest = rest.filter(itself | (F.col("pos") > F.col("h")))
    rest = rest.withColumn("pos", F.when(itself, F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("taken")))
    top = turns.filter(F.col("pos") < heads).filter(F.col("conv_id") % family == 0).withColumnRenamed("conv_id", "base")
    heirs = convs.filter(~itself).filter("taken > 0").select("conv_id", "base", "taken", "length")
    top = heirs.join(top, "base").filter("pos <= taken")
    columns = ["conv_id", "pos", "length", "turn_hash", "n_bytes"]
    return rest.select(columns).unionByName(top.select(columns)), convs.select("conv_id", "length")


def prefix_of(sums) -> F.Column:
    return F.unhex(F.md5(F.concat_ws(",", *sums)))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row (id, parent, depth, conv_id, n_bytes, ends) per conversation and prefix of it, the empty one included."""
    parts = {}
    for seed in (0, 1):
        whole = F.xxhash64(F.lit(seed), F.col("pos"), F.col("turn_hash"))
        parts[SUMS[2 * seed]] = F.shiftrightunsigned(whole, 32)
        parts[SUMS[2 * seed + 1]] = whole.bitwiseAND(F.lit(0xFFFFFFFF))
    valued = written(turns.select("*", *[v.alias(f"v_{k}") for k, v in parts.items()]).drop("turn_hash"), "hashed-turns")
    summed = prefix_sums(valued, ["conv_id"], "pos", {k: F.col(f"v_{k}") for k in SUMS})
    rows = summed.select(
        prefix_of([F.col(k) + F.col(f"v_{k}") for k in SUMS]).alias("id"), prefix_of(SUMS).alias("parent"),
        F.col("pos").alias("depth"), "conv_id", "n_bytes", (F.col("pos") == F.col("length")).alias("ends"),
    )
    root = prefix_of([F.lit(0)] * 4)
    roots = convs.select(
        root.alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id",
        F.lit(0).cast("long").alias("n_bytes"), (F.col("length") == 0).alias("ends"),
    )
    return rows.unionByName(roots)


def trie(rows: DataFrame) -> DataFrame:
    """(id, parent, depth, conv_id, n_convs, n_bytes, label) per distinct prefix."""
    return rows.groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes"),
        F.min_by("conv_id", F.struct(F.xxhash64("conv_id"), "conv_id")).alias("label"),
    )


def contraction_round(live: DataFrame, values: list[str], width: int) -> DataFrame:
    """Each live node with its part in the round.

    ``kind`` is raked, spliced or live. ``rest_*`` are a raked node's totals, or the sums from a chain's node to
    the chain's end; ``head`` is the chain's top, ``last`` its bottom and ``next`` the node below it.
    """
    kids = live.filter("parent is not null").groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("kids"), F.min("id").alias("only"))
    rows = live.join(kids, F.col("id") == F.col("up"), "left").drop("up").withColumn("kids", F.coalesce("kids", F.lit(0)))
    rows = rows.withColumns({"n_children": F.coalesce("n_children", "kids"), "block": F.floor(F.col("depth") / width)})
    path = W.partitionBy("label", "block").orderBy("depth")
    rows = rows.withColumn("runs_on", (F.col("kids") == 1) & F.col("only").eqNullSafe(F.lead("id").over(path)))
    rows = rows.withColumn("starts", F.when(F.lag("runs_on", 1, False).over(path), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("starts").over(path.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("label", "block", "run")
    whole = run.orderBy("depth").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    below = run.orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    unary = F.col("kids") == 1
    rows = rows.withColumns({
        "raked": F.max(F.col("kids") == 0).over(whole), "head": F.first("id").over(whole),
        "last": F.last(F.when(unary, F.col("id")), True).over(whole), "next": F.last(F.when(unary, F.col("only")), True).over(whole),
        **{f"rest_{v}": F.sum(F.when(F.col("kids") <= 1, F.col(v)).otherwise(0)).over(below) for v in values},
    })
    kind = F.when(F.col("raked"), "raked").when(unary & (F.col("id") != F.col("head")), "spliced").otherwise("live")
    kept = {v: F.when(unary, F.col(f"rest_{v}")).otherwise(F.col(v)) for v in values}
    return rows.withColumn("kind", kind).withColumns(kept).select(
        "id", "parent", "label", "depth", "n_children", "kind", "head", "last", "next", *values, *[f"rest_{v}" for v in values]
    )


def survivors(step: DataFrame, values: list[str]) -> DataFrame:
    """The live nodes after a round: below a spliced chain its top is the parent, and raked totals are added."""
    moves = step.filter("kind = 'spliced' and id = last").select(F.col("id").alias("parent"), F.col("head").alias("top"))
    moved = step.filter("kind = 'live' or kind = 'raked' and id = head").join(moves, "parent", "left")
    moved = moved.withColumn("parent", F.coalesce("top", "parent"))
    gains = moved.filter("kind = 'raked' and parent is not null").groupBy(F.col("parent").alias("up"))
    gains = gains.agg(*[F.sum(f"rest_{v}").alias(f"gain_{v}") for v in values])
    live = moved.filter("kind = 'live'").join(gains, F.col("id") == F.col("up"), "left")
    added = [(F.col(v) + F.coalesce(f"gain_{v}", F.lit(0))).alias(v) for v in values]
    return live.select("id", "parent", "label", "depth", "n_children", *added)


def subtree_totals(tree: DataFrame, values: list[str], growth: int = BLOCK_GROWTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, n_children, *values): per node the sums of ``values`` over its subtree, itself included.

    ``tree`` has a row (id, parent, label, depth, *values) per node; a root's parent is null, and there may be
    several. The nodes of a label lie on one path downwards, at most one per depth; any such labels give right
    totals, and those of random members few rounds. A tree without nodes gives no rows.
    """
    live = written(tree.select("id", "parent", "label", "depth", F.lit(None).cast("long").alias("n_children"), *values), "live-nodes")
    rounds, width = [], growth
    left, deepest = live.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0))).first()
    while left:
        step = written(contraction_round(live, values, width), "round")
        rounds.append(step)
        live = written(survivors(step, values), "live-nodes")
        groups = live.groupBy("label", F.floor(F.col("depth") / (width * growth))).agg(F.count("*").alias("n"))
        left, most = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if most <= group_rows and width <= deepest:
            width *= growth
    done = tree.select("id", F.lit(0).cast("long").alias("n_children"), *values).limit(0)
    for step in reversed(rounds):
        raked = step.filter("kind = 'raked'").select("id", "n_children", *[F.col(f"rest_{v}").alias(v) for v in values])
        done = done.unionByName(raked)
        waiting = step.filter("kind = 'spliced'")
        if not waiting.isEmpty():
            known = done.select(F.col("id").alias("next"), *[F.col(v).alias(f"total_{v}") for v in values])
            waiting = waiting.join(known, "next")
            added = [(F.col(f"rest_{v}") + F.col(f"total_{v}")).alias(v) for v in values]
            done = done.unionByName(written(waiting.select("id", "n_children", *added), "expanded"))
    return done


def end_hashes(rows: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the prefixes at which conversations end: SHA-256 of their sorted, comma-joined ids.

    Ids are joined in ranges of (id, conv_id), so the ends of one prefix are spread over tasks; what meets
    for one prefix are pieces of some thousand ids, hashed one after another as they stream in.
    """

    def join(batches):
        node, first, held = None, None, []
        out: list[tuple] = []
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (key != node or len(held) >= IDS_PER_PIECE):
                    out.append((node, first, ",".join(held)))
                    held = []
                if not held:
                    node, first = key, conv
                held.append(str(conv))
            yield from pieces(out)
            out = []
        if held:
            yield from pieces([(node, first, ",".join(held))])

    def pieces(out):
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "first", "joined"])

    def digest(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for key, joined in zip(batch.column(0).to_pylist(), batch.column(2)):
                text = joined.as_py().encode()
                if key == node:
                    state.update(b"," + text)
                    continue
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(text)
            if out:
                yield hashes(out)
        if state is not None:
            yield hashes([(node, state.hexdigest())])

    def hashes(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], ["id", "ends_sha256"])

    ends = rows.filter("ends").select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    joined = written(ends.mapInArrow(join, "id binary, first long, joined string"), "end-pieces")
    return joined.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digest, "id binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations, with members, children and subtree totals.

    Columns: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Rows without a conv_id belong to no conversation and are left out; repeated rows are turns of
    their own; an empty table has no nodes. Conversations of equal turns share their nodes.
    """
    turns, convs = rebuilt(numbered_turns(conversations), family, heads)
    rows = written(prefixes(turns, convs), "prefixes")
    nodes = written(trie(rows), "trie-nodes")
    up = nodes.select(F.col("id").alias("parent"), F.lit(0).alias("inner")).join(
        nodes.select(F.col("parent").alias("of")).distinct(), F.col("parent") == F.col("of"), "left_semi"
    )
    inner = nodes.join(up.withColumnRenamed("parent", "id"), "id", "left")
    tree = inner.select(
        "id", "parent", "label", "depth", F.when(F.col("inner").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(above, "parent", "left")
    full = named.join(totals, "id").join(end_hashes(rows), "id", "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


@query("op11_prefix_trie")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
