"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """DOUBLE division, NULL where the denominator is 0 or missing."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * F.lit(100.0), whole)


def known(value: Column) -> Column:
    """NULL for NaN, so that both kinds of missing are treated alike."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also when it is NULL)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def right_closed_bin(value: Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """Label of the bin (edge[i], edge[i+1]] a value falls in; NULL outside."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    ladder = F.when(value <= F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        ladder = ladder.when(value <= F.lit(upper), F.lit(label))
    return ladder


def one_hot(value: Column, named_values: dict[str, object]) -> list[Column]:
    """A fixed list of 0/1 columns, one per named category."""
    return [flag(value == F.lit(v)).alias(name) for name, v in named_values.items()]


def total_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def normalise_name(name: str) -> str:
    return name.replace(" ", "_").replace("-", "_")


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_name(c) for c in df.columns])


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition matching NULL keys to NULL keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])
