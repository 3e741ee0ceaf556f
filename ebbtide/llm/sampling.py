"""Bounded labelled samples for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def held_out(doc_id: Column, n: int, at: int) -> Column:
    return F.coalesce(crc_mod(doc_id, n) == at, F.lit(False))


def thinned(rows: DataFrame, label: str, per_label: int, max_labels: int, order: list[str]) -> DataFrame:
    """About ``per_label`` rows of each of the commonest labels, chosen by a hash, which is added as ``_spot``.

    A label with no more rows keeps all of them. Every row has its own chance,
    so a repeated id doesn't crowd out others.
    """
    sizes = rows.groupBy(F.col(label).alias("_label_value")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_label_value").limit(max_labels)
    # a hash of the row and of its place in the input: also equal rows differ
    spot = F.xxhash64(*order, F.monotonically_increasing_id())
    return (
        rows.withColumn("_spot", spot)
        .join(F.broadcast(sizes), F.col(label) == F.col("_label_value"))  # at most max_labels rows
        .where(F.pmod("_spot", F.lit(1 << 30)) < F.lit(float(1 << 30)) * per_label / F.col("_n"))
        .drop("_label_value", "_n")
    )


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows in the order of ``_spot``."""
    return rows.orderBy("_spot").limit(most)
