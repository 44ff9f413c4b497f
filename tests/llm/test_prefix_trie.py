"""Conversation prefix trie against a plain trie of tuples, and tree contraction against sums by recursion."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF
from noviscan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, label long, `pos` int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Rows (conv_id, turn, role, text); turns that tie keep the order in which they are given."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        whole[conv] = tuple(own.get(conv - conv % 5, [])[:h] + turns[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        ends[turns].append(conv)
    kids = collections.Counter(node[:-1] for node in members if node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, convs in members.items():
        worth = (len(convs) - 1) * (len(node[-1][1].encode()) if node else 0)
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += worth
    out = []
    for node, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        above = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), above, len(convs), kids[node], leaves[node], saved[node], digest))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select(COLUMNS).collect()], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3, 4) for r in rows], SCHEMA)


def test_given_conversations(spark):
    got = prefix_trie.op11_prefix_trie(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(got) == brute([tuple(r) for r in rows])


def test_odd_rows(spark):
    """Null turns, roles and texts, a very long text, copies of a conversation, one without turns after rebuilding."""
    rows = [(0, None, None, "a"), (0, 1, "u", None), (0, 2, "u", ""), (1, 0, "u", "x" * 300_000), (1, 5, "v", "é" * 9)]
    for conv in range(20, 60):
        rows += [(conv, t, "user" if t % 2 else None, f"t{t}") for t in range(conv % 4 + 1)]
    rows += [(conv, t, "user", "same") for conv in (100, 101, 102, 103, 104, 900) for t in range(12)]
    rows += [(7001, 0, "u", "alone"), (7002, 0, "u", "alone"), (7003, 0, "u", "alone"), (10**12, 3, "u", "far")]
    assert any(depth == 0 for _, depth, *_ in brute(rows))
    lone = [c for c in {r[0] for r in rows} if zlib.crc32(str(c).encode()) % 9 > 0 and c % 5 and c - c % 5 not in {r[0] for r in rows}]
    assert lone
    assert found(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_rows_without_id_and_ties(spark):
    rows = [(5, 1, "u", "b"), (5, 1, "u", "b"), (5, 1, "u", "b"), (6, 0, "u", "z")]
    assert found(prefix_trie.prefix_trie(frame(spark, [*rows, (None, 0, "u", "b")]))) == brute(rows)
    tied = [(10, 2, "a", "p"), (10, 2, "a", "q")]
    got = found(prefix_trie.prefix_trie(frame(spark, tied)))
    assert got in (brute(tied), brute(tied[::-1]))
    assert found(prefix_trie.prefix_trie(frame(spark, []))) == []


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr("noviscan.operators.ordering.BLOCK", 50)
    rows = [(35, t, "u", f"w{t % 3}") for t in range(700)] + [(35 + k, t, "u", f"w{t % 3}") for k in range(1, 9) for t in range(40 * k)]
    assert found(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)


def random_tree(rng, kind, n):
    """Parents of nodes 1 to n - 1."""
    if kind == "chain":
        return [k - 1 for k in range(1, n)]
    if kind == "star":
        return [0] * (n - 1)
    if kind == "comb":  # a spine of nodes, each with a chain longer than the rest of the spine
        parents, spine, length = [], 0, 0
        while len(parents) < n - 1:
            length += 1
            at = spine
            for _ in range(rng.randint(1, 5)):
                parents.append(at)
                at = len(parents)
            parents.append(spine)
            spine = len(parents)
        return parents[: n - 1]
    return [rng.randint(max(0, k - 4), k - 1) if kind == "deep" else rng.randrange(k) for k in range(1, n)]


@pytest.mark.parametrize("kind", ["chain", "star", "comb", "deep", "bushy"])
def test_contraction_equals_recursion(spark, kind):
    rng = random.Random(kind)
    parents = [None, *random_tree(rng, kind, 300)]
    depth, kids = [0] * len(parents), collections.defaultdict(list)
    for k, p in enumerate(parents[1:], 1):
        depth[k] = depth[p] + 1
        kids[p].append(k)
    label = [rng.random() for _ in parents]
    for k in range(len(parents) - 1, 0, -1):  # the least of all below, as the trie's labels are
        label[parents[k]] = min(label[parents[k]], label[k])
    label = [sorted(set(label)).index(x) for x in label]
    value = [rng.randint(-5, 50) for _ in parents]
    totals = list(value)
    for k in range(len(parents) - 1, 0, -1):
        totals[parents[k]] += totals[k]
    key = lambda k: None if k is None else k.to_bytes(4, "big")
    tree = spark.createDataFrame(
        [(key(k), key(p), label[k], depth[k], value[k]) for k, p in enumerate(parents)],
        "id binary, parent binary, label long, depth long, v long",
    )
    got = {int.from_bytes(r.id, "big"): (r.n_children, r.v) for r in prefix_trie.subtree_totals(tree, ["v"], 4, 50).collect()}
    assert got == {k: (len(kids[k]), totals[k]) for k in range(len(parents))}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    taken = []
    one_round = prefix_trie.contraction_round
    monkeypatch.setattr(prefix_trie, "contraction_round", lambda *a: taken.append(1) or one_round(*a))
    n = 20_000
    key = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    tree = spark.range(n).select(
        key(F.col("id")).alias("id"), F.when(F.col("id") > 0, key(F.col("id") - 1)).alias("parent"), F.lit(1).cast("long").alias("label"),
        F.col("id").alias("depth"), F.lit(1).cast("long").alias("v"),
    )
    got = prefix_trie.subtree_totals(tree, ["v"])
    assert got.agg(F.sum("v")).first()[0] == n * (n + 1) // 2 and len(taken) <= 4
