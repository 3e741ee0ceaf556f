"""From the feature table to the matrix the learners read."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.audit import segment_onehot
from ebbtide.operators.master import feature_columns
from ebbtide.session import stage

# Fits that run side by side on one cluster; each is itself a distributed job.
PARALLEL_FITS = 8
# Rows per written file of the matrix, so that every pass of a fit can use the whole cluster.
ROWS_PER_FILE = 50_000


def model_matrix(segmented: DataFrame) -> tuple[DataFrame, list[str]]:
    """(msno, split, is_churn, feature columns, features vector) as a written table, and the feature names."""
    encoded = segment_onehot(segmented)
    names = feature_columns(encoded.columns)
    plain = encoded.select(
        "msno",
        "split",
        F.col("is_churn").cast("double").alias("is_churn"),
        *[F.col(c).cast("double").alias(c) for c in names],
    )
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(plain)
    files = max(1, -(-segmented.count() // ROWS_PER_FILE))
    return stage(assembled.repartition(files, "msno"), "matrix"), names


def without(df: DataFrame, names: Sequence[str], excluded: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The matrix with some features left out of the vector."""
    kept = [n for n in names if n not in set(excluded)]
    slicer = VectorSlicer(inputCol="_all", outputCol="features", indices=[list(names).index(n) for n in kept])
    return slicer.transform(df.withColumnRenamed("features", "_all")).drop("_all"), kept


def balance(df: DataFrame, label: str = "is_churn") -> tuple[float, float]:
    """Balanced weights n / (2 n_c) of class 0 and class 1, from two counts."""
    n, pos = df.agg(F.count(F.lit(1)), F.sum(label)).first()
    if not pos or pos == n:
        raise ValueError("both classes are needed to fit a classifier")
    return n / (2.0 * (n - pos)), n / (2.0 * pos)


def class_weights(df: DataFrame, label: str = "is_churn") -> Column:
    """The balanced weight of each row."""
    negative, positive = balance(df, label)
    return F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(negative))


def tree_depth(params: Mapping) -> int:
    """Depth of a boosted tree; a number of leaves becomes the depth of a full tree with about as many."""
    return params["depth"] if "depth" in params else max(2, round(math.log2(params["leaves"])))


def column_strategy(params: Mapping) -> str:
    """Share of the columns tried at each split, in Spark's notation."""
    share = params.get("column_share", 1.0)
    return str(share) if share < 1 else "all"


def side_by_side(jobs: Sequence[Callable[[], object]], workers: int = PARALLEL_FITS) -> list:
    """Run independent fits from a few driver threads; results keep the order of ``jobs``."""
    if len(jobs) == 1:
        return [jobs[0]()]
    in_session = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return [f.result() for f in [pool.submit(in_session(j)) for j in jobs]]
