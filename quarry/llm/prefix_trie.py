"""A prefix trie of conversations, built as double-array tries per prefix shard.

Every distinct sequence of the first ``d`` turns (role, text) of some conversation is a node of depth ``d``; the
conversations that start with it are its members. The work is split by prefix: nodes above ``SHARD_DEPTH`` are few
kinds of rows and are counted by Spark's grouping; every longer conversation belongs to the shard of its first
``SHARD_DEPTH`` turns, and each shard is one double-array trie. Its turns get dense ids in the shard, and two integer
arrays hold the whole trie: a child of state ``s`` by turn ``t`` is state ``BASE[s] + t`` if ``CHECK[BASE[s] + t] == s``.
The arrays are packed from the sorted sequences breadth first; a traversal of each sequence then finds its nodes, and
subtree sums run from the last state to the first. The shard roots' totals meet the upper nodes' own figures in
Spark.

Before any of this, conversations that are equal turn for turn are one sequence with a weight, their smallest id
and the digest of all their ids; so the one conversation that a third of all rows repeat is one row in its shard.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_DEPTH = 2
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn's role and text, unambiguous for any strings (the role's length goes first)."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


class DoubleArray:
    """A trie over sequences of small positive integers in two arrays, packed once from sorted sequences."""

    def __init__(self, sequences: list[tuple[int, ...]]):
        self.base, self.check = [0], [-1]
        self.order = [0]  # states breadth first
        self.depth = [0]
        self.free_from = 1
        frontier = [(0, 0, len(sequences), 0)]
        while frontier:
            following = []
            for state, lo, hi, depth in frontier:
                groups: list[tuple[int, int, int]] = []
                for i in range(lo, hi):
                    if len(sequences[i]) > depth:
                        label = sequences[i][depth]
                        if groups and groups[-1][0] == label:
                            groups[-1] = (label, groups[-1][1], i + 1)
                        else:
                            groups.append((label, i, i + 1))
                if not groups:
                    continue
                labels = [g[0] for g in groups]
                base = self._place(labels)
                self.base[state] = base
                for label, start, end in groups:
                    child = base + label
                    self.check[child] = state
                    self.order.append(child)
                    self.depth[child] = depth + 1
                    following.append((child, start, end, depth + 1))
            frontier = following

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = size - len(self.check)
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.depth.extend([0] * more)

    def _place(self, labels: list[int]) -> int:
        """The smallest base at which all ``base + label`` are free."""
        base = max(1, self.free_from - labels[0])
        while True:
            self._grow(base + labels[-1] + 1)
            if all(self.check[base + label] == -1 for label in labels):
                break
            base += 1
        while self.free_from < len(self.check) and self.check[self.free_from] != -1:
            self.free_from += 1
        return base

    def walk(self, sequence: tuple[int, ...]) -> list[int]:
        """States of all prefixes, the root's included."""
        states, state = [0], 0
        for label in sequence:
            nxt = self.base[state] + label
            if nxt >= len(self.check) or self.check[nxt] != state:
                raise KeyError(sequence)
            states.append(nxt)
            state = nxt
        return states


def shard_nodes(group: pd.DataFrame, depth_above: int) -> pd.DataFrame:
    """Nodes of one shard: its root (all sequences share their first ``depth_above`` turns) and everything below.

    The root's ``parent_conv_id`` is left null; Spark fills it in from the upper nodes.
    """
    dense: dict[tuple[str, str], int] = {}
    keyed = []
    for turns, weight, first, ends in zip(group["turns"], group["weight"], group["first_id"], group["ends"]):
        tail = [(t["role"], t["text"]) for t in turns][depth_above:]
        labels = tuple(dense.setdefault(turn, len(dense) + 1) for turn in tail)
        keyed.append((labels, tail, int(weight), int(first), ends))
    keyed.sort(key=lambda row: row[0])
    trie = DoubleArray([row[0] for row in keyed])
    size = len(trie.check)
    n_convs, first_id, ends = [0] * size, [None] * size, [EMPTY_SHA256] * size
    last_bytes, children = [0] * size, [0] * size
    for labels, tail, weight, first, digest in keyed:
        states = trie.walk(labels)
        for position, state in enumerate(states):
            n_convs[state] += weight
            first_id[state] = first if first_id[state] is None else min(first_id[state], first)
            if position:
                last_bytes[state] = len(tail[position - 1][1].encode("utf-8"))
        ends[states[-1]] = digest
    if depth_above:
        first_turns = group["turns"].iat[0]
        last_bytes[0] = len(first_turns[depth_above - 1]["text"].encode("utf-8"))
    leaves, saved = [0] * size, [0] * size
    for state in reversed(trie.order):
        parent = trie.check[state]
        if leaves[state] == 0:
            leaves[state] = 1
        saved[state] += (n_convs[state] - 1) * last_bytes[state]
        if state:
            children[parent] += 1
            leaves[parent] += leaves[state]
            saved[parent] += saved[state]
    rows = [
        (
            first_id[s],
            depth_above + trie.depth[s],
            first_id[trie.check[s]] if s else None,
            n_convs[s],
            children[s],
            leaves[s],
            saved[s],
            ends[s],
        )
        for s in trie.order
    ]
    out = pd.DataFrame(rows, columns=[f.split()[0] for f in NODES.split(", ")])
    out["parent_conv_id"] = out["parent_conv_id"].astype("Int64")
    out["shard_root"] = [s == 0 for s in trie.order]
    return out


def rebuilt_conversations(turns: DataFrame, keep: int = 9, family: int = 5) -> DataFrame:
    """``conv_id, turns``: each conversation ``c`` rebuilt from the first ``h`` turns of conversation ``c - c % family``
    (``h = crc32(decimal c) % keep``; all if fewer, none if absent) and its own turns after its first ``h``.

    Turns are ordered by ``turn`` (nulls first, then role and text); null role or text is empty; rows with a null
    ``conv_id`` belong to no conversation. A conversation left without turns has an empty array.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1).drop("turn")
    convs = rows.select("conv_id").distinct()
    cut = (F.crc32(F.col("conv_id").cast("string")) % keep).cast("long")
    own = rows.filter(F.col("pos") >= cut)
    # A conversation lends its first turns to those whose id rounds to its own; offsets cover both signs.
    lent = (
        rows.filter((F.col("conv_id") % family == 0) & (F.col("pos") < keep - 1))
        .withColumn("borrower", F.explode(F.sequence(F.col("conv_id") - (family - 1), F.col("conv_id") + (family - 1))))
        .filter(F.col("borrower") - F.col("borrower") % family == F.col("conv_id"))
        .filter(F.col("pos") < (F.crc32(F.col("borrower").cast("string")) % keep).cast("long"))
        .select(F.col("borrower").alias("conv_id"), "pos", "role", "text")
        .join(convs, "conv_id", "left_semi")
    )
    both = own.unionByName(lent)
    gathered = both.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns")
    )
    empty = F.array().cast("array<struct<pos:bigint,role:string,text:string>>")
    return convs.join(gathered, "conv_id", "left").select(
        "conv_id",
        F.transform(F.coalesce("turns", empty), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(
            "turns"
        ),
    )


def prefix_trie(conversations: DataFrame, shard_depth: int = SHARD_DEPTH) -> DataFrame:
    """One row per node of the prefix trie of ``conversations`` (``conv_id, turns`` as ``rebuilt_conversations`` gives):
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes in its subtree, itself included), ``saved_tokens`` (over its subtree, each node's
    ``n_convs - 1`` times the UTF-8 bytes of its last text; the root has none) and ``ends_sha256`` (SHA-256 of the ids of
    members with exactly ``depth`` turns, ascending, comma-joined; of the empty string if none).

    Conversations without turns are members of the root alone. No conversations: no rows.
    """
    digests = F.transform("turns", lambda t: turn_digest(t["role"], t["text"]))
    sequences = (
        conversations.withColumn("key", F.sha2(F.array_join(digests, ""), 256))
        .groupBy("key")
        .agg(
            F.first("turns").alias("turns"),
            F.count("*").alias("weight"),
            F.min("conv_id").alias("first_id"),
            F.sha2(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ","), 256).alias("ends"),
        )
        .withColumn("n", F.size("turns"))
        .withColumn("digests", digests)
    )

    def prefix_key(depth: int) -> Column:
        return F.sha2(F.array_join(F.slice("digests", 1, depth), "") if depth else F.lit(""), 256)

    upper = []
    for depth in range(shard_depth):
        upper.append(
            sequences.filter(F.col("n") >= depth)
            .groupBy(prefix_key(depth).alias("key"))
            .agg(
                F.lit(depth).cast("long").alias("depth"),
                F.sum("weight").alias("n_convs"),
                F.min("first_id").alias("conv_id"),
                F.max(F.when(F.col("n") == depth, F.col("ends"))).alias("ends"),
                F.count_distinct(F.when(F.col("n") > depth, F.col("digests")[depth])).alias("n_children"),
                F.max(F.octet_length(F.col("turns")[depth - 1]["text"]) if depth else F.lit(0)).cast("long").alias("bytes"),
                F.first(prefix_key(depth - 1) if depth else F.lit(None).cast("string")).alias("parent_key"),
            )
        )
    shards = (
        sequences.filter(F.col("n") >= shard_depth)
        .groupBy(prefix_key(shard_depth).alias("shard"), prefix_key(shard_depth - 1).alias("parent_key"))
        .applyInPandas(
            lambda key, group: shard_nodes(group, shard_depth).assign(parent_key=key[1]),
            NODES + ", shard_root boolean, parent_key string",
        )
    )
    # Subtree sums of the upper nodes, deepest first: own figures plus those of their children's subtrees.
    below = shards.filter("shard_root").groupBy("parent_key").agg(
        F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below")
    )
    finished = None
    for depth in reversed(range(shard_depth)):
        level = upper[depth].join(below.withColumnRenamed("parent_key", "key"), "key", "left").select(
            "key",
            "parent_key",
            "conv_id",
            "depth",
            "n_convs",
            "n_children",
            F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("leaves_below")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes") + F.coalesce("saved_below", F.lit(0))).cast("long").alias("saved_tokens"),
            F.coalesce("ends", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
        finished = level if finished is None else finished.unionByName(level)
        below = level.groupBy("parent_key").agg(
            F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below")
        )
    keys = finished.select(F.col("key").alias("up_key"), F.col("conv_id").alias("up_id"))
    columns = [f.split()[0] for f in NODES.split(", ")]
    named = finished.join(keys, F.col("parent_key") == F.col("up_key"), "left").withColumn("parent_conv_id", F.col("up_id"))
    shard_rows = shards.join(keys, F.col("parent_key") == F.col("up_key"), "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", F.when(F.col("shard_root"), F.col("up_id")))
    )
    return named.select(*columns).unionByName(shard_rows.select(*columns))
