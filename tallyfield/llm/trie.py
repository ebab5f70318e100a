"""Prefix trie of conversations, by collapsing whole sequences.

A turn is known by two hashes of 64 bits of its place, role and text, and a prefix by the exclusive
or of its turns' hashes, so prefixes are compared without moving a text. Equal conversations become
one weighted sequence with the list of those that end there. Sequences that are a proper prefix of
another are dropped by an anti-join; what stays are the leaves. The nodes are the distinct prefixes
of the sequences, and every figure of a node is a weighted aggregate over the sequences that pass it,
combined before the shuffle: a turn that all conversations begin with is one row per task.

Sums over a subtree need no walk either. A node belongs to the smallest conversation that passes it,
and the nodes that belong to a conversation are its last ones, from some depth on. So a sequence
gives each prefix the words from that depth to its end, once per member, and takes away the words
of the nodes that belong to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.text import count_words, whole
from tallyfield.operators.ordered import Ordered, row_number, running_sum, running_xor
from tallyfield.session import checkpoint

NODE = ["depth", "p1", "p2"]


def zero() -> Column:
    """0 as a long."""
    return F.lit(0).cast("long")


def numbered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, a, b, words): turns of each conversation from 1 on, with two hashes of role and text.

    Turns are in the order of ``turn``, null first; those of equal ``turn`` in an order that
    their role and text decide. Rows that repeat are turns of their own. A null role or text is
    empty. Rows without a conversation id belong to no conversation and are left out.
    """
    t = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.xxhash64(whole(role), whole(text)).alias("a"), F.xxhash64(F.lit(1), whole(role), whole(text)).alias("b"),
        count_words(text).alias("words"),
    )
    # hashes, not texts, are what is sorted and shuffled
    o = Ordered(t, ["conv"], [F.col("turn").asc_nulls_first(), "a", "b"]).add(pos=row_number())
    return o.result().select("conv", "pos", "a", "b", "words")


def rebuilt(turns: DataFrame, base: Column, n: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``n`` turns are replaced by those of another one.

    ``base`` and ``n``, of at most ``most``, are columns over ``conv``. A base with fewer turns gives
    all it has, one that is not there gives none; a conversation keeps its own turns after its
    first ``n``. Returns (turns like ``turns``, conversations as conv): one without turns is only in
    the second.
    """
    turns = checkpoint(turns)  # read for the heads, for the conversations, and for the rest
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({"base": base, "n": n.cast("long")})
    # at most ``most`` turns each
    heads = turns.where(F.col("pos") <= most).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("head")
    )
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:long,a:long,b:long,words:long>>")), F.lit(1), F.col("n").cast("int"))
    # own heads are all there is to move
    plan = convs.where("n > 0 and base <> conv").join(heads, "base", "left").select("conv", "n", head.alias("head"))
    plan = checkpoint(plan)
    given = plan.select("conv", F.explode("head").alias("t")).select("conv", "t.*")
    moved = plan.select(F.col("conv").alias("of"), "n", (F.size("head") - F.col("n")).alias("by"))
    own = turns.join(moved, turns["conv"] == moved["of"], "left").where("n is null or pos > n")
    own = own.select("conv", (F.col("pos") + F.coalesce("by", zero())).alias("pos"), "a", "b", "words")
    return own.unionByName(given), convs.select("conv")


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal sequences, each as one row: its weight, smallest id, and digest of all its ids.

    A digest is fed batch by batch; no list of ids is ever held.
    """
    held, digest, first, n = None, hashlib.sha256(), 0, 0
    for frame in frames:
        out = []
        keys = frame[NODE].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)
        ids, keys = frame["conv"].tolist(), keys[starts].tolist()
        starts = starts.tolist()
        for key, lo, hi in zip(keys, starts, [*starts[1:], len(ids)], strict=True):
            if key != held:
                if held is not None:
                    out.append((*held, first, n, digest.hexdigest()))
                held, digest, first, n = key, hashlib.sha256(), ids[lo], 0
            digest.update((("," if n else "") + ",".join(map(str, ids[lo:hi]))).encode())
            n += hi - lo
        yield pd.DataFrame(out, columns=[*NODE, "conv", "weight", "ends"])
    if held is not None:
        yield pd.DataFrame([(*held, first, n, digest.hexdigest())], columns=[*NODE, "conv", "weight", "ends"])


def collapsed(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, p1, p2, conv, weight, ends): each distinct sequence with its conversations.

    ``weight`` is their number, ``conv`` the smallest and ``ends`` the SHA-256 of all of them,
    ascending, with commas between. ``turns`` has (conv, x1, x2), hashes of each turn at its place.
    """
    sums = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    named = convs.withColumnRenamed("conv", "of")
    whole_ = named.join(sums, named["of"] == sums["conv"], "left").select(
        F.col("of").alias("conv"), *[F.coalesce(c, zero()).alias(c) for c in NODE]
    )
    # A digest is one pass over its ids, so the conversations of one sequence pass one task, as a stream
    sorted_ = whole_.repartition(*NODE).sortWithinPartitions(*NODE, "conv")
    return sorted_.mapInPandas(_ends, "depth long, p1 long, p2 long, conv long, weight long, ends string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per distinct prefix of the conversations, the empty one included.

    ``turns`` has (conv, pos, a, b, words), pos from 1 on without gaps, ``convs`` every conversation,
    also those without turns. Columns: conv_id, the smallest member; depth; parent_conv_id; n_convs,
    members; n_children; n_leaves, nodes without children in its subtree; saved_tokens, the words of
    the subtree's nodes, each times its members but one; ends_sha256, see :func:`collapsed`. Without
    conversations there are no rows. A single conversation of any length is split by ranges.
    """
    x = [F.xxhash64(F.lit(seed), "pos", "a", "b").alias(f"x{seed}") for seed in (1, 2)]
    placed = checkpoint(turns.select("conv", "pos", "words", *x))
    sequences = checkpoint(collapsed(placed, convs))
    # the prefixes of one conversation per sequence
    rows = placed.join(sequences.select("conv", "weight"), "conv")
    o = Ordered(rows, ["conv"], ["pos"]).add(p1=running_xor(F.col("x1")), p2=running_xor(F.col("x2")), upto=running_sum(F.col("words")))
    prefixes = checkpoint(o.result().withColumnRenamed("pos", "depth"))
    # a sequence that another goes on from is no leaf
    inner = prefixes.select("depth", "x1", "x2", "p1", "p2").select(
        (F.col("depth") - 1).alias("depth"), F.col("p1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("p2")
    ).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select(F.col("conv").alias("of"), F.lit(1).alias("leaf"))
    total = prefixes.groupBy("conv").agg(F.max("upto").alias("total"))
    known = sequences.select(F.col("conv").alias("of"), F.col("weight").alias("w")).join(leaves, "of", "left")
    known = known.join(total.withColumnRenamed("conv", "of"), "of", "left")
    known = checkpoint(known.select("of", "w", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("total", zero()).alias("total")))
    seen = prefixes.join(known, prefixes["conv"] == known["of"]).select(
        "conv", "depth", "p1", "p2", "x1", "x2", "words", "upto", "w", "leaf", "total"
    )
    root = known.select(
        F.col("of").alias("conv"), *[zero().alias(c) for c in ("depth", "p1", "p2", "x1", "x2", "words", "upto")], "w", "leaf", "total"
    )
    seen = checkpoint(seen.unionByName(root))
    nodes = seen.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.sum("w").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.first("x1").alias("x1"), F.first("x2").alias("x2"), F.first("words").alias("words"),
    )
    nodes = checkpoint(nodes)
    # where a conversation's own nodes begin, and the words before them
    own = nodes.groupBy(F.col("conv").alias("of")).agg(F.min(F.struct("depth", "words")).alias("o"))
    at = seen.select("conv", "depth", "upto", "words").join(own, (F.col("conv") == F.col("of")) & (F.col("depth") == F.col("o.depth")))
    own = at.select(F.col("conv").alias("of"), (F.col("upto") - F.col("words")).alias("before"))
    shares = seen.join(own, seen["conv"] == own["of"], "left")
    from_here = F.col("total") - F.col("upto") + F.col("words")
    of_own = F.least(from_here, F.col("total") - F.coalesce("before", F.col("total")))
    saved = shares.groupBy(*NODE).agg(F.sum(F.col("w") * from_here - of_own).alias("saved_tokens"))
    up = nodes.select(
        F.col("depth").alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "conv", "n_convs", "n_leaves",
        F.when(F.col("depth") > 0, F.col("depth") - 1).alias("depth"),
        F.col("p1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("p2"),
    )
    children = up.where("d > 0").groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    figures = reduce(
        lambda d, more: d.join(more, NODE, "left"),
        (children, saved, sequences.select(*NODE, "ends")),
        nodes.select(*NODE, F.col("conv").alias("parent")),
    )
    figures = figures.select(
        F.col("depth").alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "n_children", "saved_tokens", "ends"
    )
    # children of one node, the root's above all, may be many: the join splits that key's rows at run time
    parents = nodes.select(*NODE, F.col("conv").alias("parent"))
    up = up.join(parents, NODE, "left").select("d", "q1", "q2", "conv", "n_convs", "n_leaves", "parent")
    out = up.join(figures, ["d", "q1", "q2"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero()).alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", zero()).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
