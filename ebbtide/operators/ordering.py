"""Running totals and ranks over a global order, without a global sort in one task.

Rows are first combined to one row per (group, value) and dealt to value ranges
of about equal size, however many rows there are; a small table is one range.
Each range is summed, a window over the range totals gives every range its
starting offset, and the windows over rows run inside the ranges. A group
holding most of the rows is therefore spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.columns import null_safe_on
from ebbtide.session import stage

ROWS_PER_RANGE = 250_000


def running_totals(
    combined: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
    needed: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive) and ``all_<s>`` (group total) for each column in ``sums``.

    ``combined`` holds one row per (by, order) and no missing value in
    ``order``, which may have any type that can be ordered.
    ``needed(before, inside, total)`` may tell from the first sum which value
    ranges the caller has a use for; rows of other ranges may then be left out
    before the shuffle.
    """
    by = list(by)
    base = stage(combined, "ordered")
    ranges = max(1, math.ceil(base.count() / rows_per_range))
    direction = F.col(order).desc() if descending else F.col(order).asc()
    # equal values share a range; where the cuts fall depends on a sample, the result doesn't
    numbered = stage(base.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()), "ranged")
    per_range = numbered.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = group.orderBy(F.col("_range").desc() if descending else F.col("_range").asc()).rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = stage(
        per_range.select(
            *by,
            "_range",
            F.col(sums[0]).alias("_inside"),
            *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
            *[F.sum(s).over(group).alias(f"all_{s}") for s in sums],
        ),
        "offsets",
    )
    if needed is not None:
        offsets = offsets.filter(needed(F.col(f"_off_{sums[0]}"), F.col("_inside"), F.col(f"all_{sums[0]}")))
    keys = [*by, "_range"]
    joined = numbered.join(offsets, null_safe_on(numbered, offsets, keys)).select(
        numbered["*"], *[offsets[c] for c in offsets.columns if c not in (*keys, "_inside")]
    )
    inside = W.partitionBy(*keys).orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
    return joined.select(
        *combined.columns,
        *[(F.col(f"_off_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
    )


def hash_order(key: str, seed: int) -> Column:
    """Seeded pseudo-random order of a key, the same on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), at_most: int | None = None) -> DataFrame:
    """Add ``hash_rank``: 1..n per group in seeded random order of a unique key.

    The hash prefix is the value range, so ranges are even by construction; it
    is as long as the number of rows asks for. With ``at_most`` the ranges that start beyond it are left out before the
    shuffle.
    """
    by = list(by)
    chars = 1 + math.ceil(math.log(max(1.0, df.count() / ROWS_PER_RANGE), 16))
    keyed = df.withColumn("_hash", hash_order(key, seed)).withColumn("_range", F.substring("_hash", 1, chars))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = keyed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if at_most is not None:
        offsets = offsets.filter(F.col("_off") < at_most)
    offsets = stage(offsets, "hash-ranges")
    keys = [*by, "_range"]
    joined = keyed.join(offsets, null_safe_on(keyed, offsets, keys)).select(keyed["*"], offsets["_off"])
    inside = W.partitionBy(*keys).orderBy("_hash", F.col(key))
    ranked = joined.withColumn("hash_rank", F.col("_off") + F.row_number().over(inside))
    if at_most is not None:
        ranked = ranked.filter(F.col("hash_rank") <= at_most)
    return ranked.drop("_hash", "_range", "_off")


def sample_n(df: DataFrame, n: int, seed: int, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows (per group if ``by`` is given) without replacement, or all where there are fewer."""
    return hash_rank(df, key, seed, by, at_most=n).drop("hash_rank")


def combine(df: DataFrame, order: str, sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per (by, order) with summed columns; rows without an order value, NULL or NaN, are left out."""
    there = F.col(order).isNotNull()
    if isinstance(df.schema[order].dataType, (T.FloatType, T.DoubleType)):
        there &= ~F.isnan(order)
    return (
        df.filter(there)
        .groupBy(*by, order)
        .agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])
    )
