"""Connected components by repeated contraction, and small fixed-size membership filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` of every node of ``edges``; nodes of one component share a root, one of them.

    In each round every node moves to whichever of itself and its neighbours
    comes first, and the edges between the nodes moved to go on. Every other
    round uses a random order, in which a constant share of the nodes goes
    whatever the graph's shape; the rounds between use the nodes' own order,
    in which stars around their smallest node go at once. Minima are combined
    before they are shuffled.
    """
    left = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    moves = []
    while not left.isEmpty():
        spread = len(moves) % 2 == 1
        order = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(len(moves))) if spread else F.lit(0)).alias("order"), F.col(c).alias("node"))  # noqa: E731, B023
        both = left.select("a", order("b").alias("to")).unionByName(left.select(F.col("b").alias("a"), order("a").alias("to")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("to").alias("to"))
        to = stage(to.select("node", F.least("to", order("node"))["node"].alias("next")), "moves")
        moves.append(to)
        moved = left.join(to.select(F.col("node").alias("a"), F.col("next").alias("p")), "a").join(to.select(F.col("node").alias("b"), F.col("next").alias("q")), "b")
        left = stage(moved.where(F.col("p") != F.col("q")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[0].select("node", F.col("next").alias("root"))
    for later in moves[1:]:
        found = found.join(later.select(F.col("node").alias("root"), "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stage(found, "components")


def extended(roots: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``roots`` as ``components`` returns them, with more ``edges``; only these are contracted, between the roots of their ends."""
    between = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    for end in ("a", "b"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        between = between.join(named, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    moved = components(between, "a", "b")
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    # nodes that had no edge before
    return stage(old.unionByName(moved.join(roots, "node", "left_anti").select("node", "root")), "components")


FILTER_BITS = 1 << 23


def membership(values: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size (1 MB) over a column of longs: bit ``value mod 2**23`` is set if some value has it.

    It may pass others too, so a join follows; it only spares that join rows.
    """
    place = F.pmod(F.col(column), F.lit(FILTER_BITS))
    found = values.groupBy(F.bitmap_bucket_number(place + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in found.collect():  # at most 257 rows of 4 KB
        own = np.frombuffer(row["bits"], np.uint8)
        begin = (row["part"] - 1) * 4096
        bits[begin : begin + len(own)] |= own[: len(bits) - begin]
    return bits


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of some 64-bit values the filter passes."""
    place = values.view(np.int64) & (FILTER_BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
