"""Feature contributions of fitted models as long tables.

Tree models: the contribution of a feature is its Shapley value in the game
where an absent feature sends a row down both branches in proportion to the
training rows that took them. For one leaf that game is a product over the
features on its path, p_j = 1 or 0 when present (does the row pass j's tests?)
and r_j when absent (share of rows that passed). Its Shapley value for i is

    leaf · (p_i − r_i) · ∫₀¹ Π_{j≠i} (r_j (1−u) + p_j u) du

and the integral of that polynomial is exact with a few Gauss–Legendre nodes.

An ensemble is the sum of its leaves, so leaves can be dealt out freely. A
Spark job flattens each tree to leaf rows; leaves are cut into spans and rows
into blocks of bounded size, each (block, span) pair is one group of a cogroup,
and the partial sums of a row add up to its contributions. The base value, the
score with every feature absent, is added up in the same way.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.operators.attribution import linear_attributions
from ebbtide.session import stage, staging_dir

# The batch functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Leaves of a span and rows of a block: a group holds a few MB of each.
LEAVES_PER_SPAN = 16_384
ROWS_PER_BLOCK = 8_192
# Tasks that work on groups; with more groups a task takes several, one after the other.
MOST_TASKS = 10_000

LEAF = "tree int, features array<int>, low array<double>, high array<double>, share array<double>, value double"


@dataclass(frozen=True)
class Leaf:
    """One leaf: interval (low, high] and pass share per feature on its path."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    """The nodes of a fitted tree ensemble as a table, from Spark's own saved form."""
    path = f"{staging_dir(spark).rstrip('/')}/ebbtide/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.impurityStats").alias("stats"),
        F.col("nodeData.rawCount").alias("rows"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("threshold"),
    )


def flattened(tree: pd.DataFrame, above: Mapping = {}) -> pd.DataFrame:
    """The leaves of one tree, given its nodes; or of a part of one, with what is ``above`` it: (low, high, share) by feature."""
    nodes = {r.node: r for r in tree.itertuples(index=False)}
    leaves = []
    pending: list[tuple[int, dict]] = [(0, dict(above))]
    while pending:
        at, path = pending.pop()
        node = nodes[at]
        if node.left < 0:
            names = sorted(path)
            low, high, share = ([path[f][i] for f in names] for i in range(3))
            leaves.append((node.tree, names, low, high, share, node.value))
            continue
        low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node.left, (low, min(high, node.cut))), (node.right, (max(low, node.cut), high))):
            pending.append((child, {**path, node.feature: (*bounds, share * nodes[child].rows / node.rows)}))
    return pd.DataFrame(leaves, columns=["tree", "features", "low", "high", "share", "value"])


def leaf_table(spark: SparkSession, model) -> DataFrame:
    """Leaves of an ensemble in the unit of its raw score, one row each, flattened tree by tree.

    Boosted classifier: log-odds. Forest classifier: probability. Regressors: the predicted value.
    """
    if hasattr(model, "leaf_table"):
        return model.leaf_table()
    kind = type(model).__name__
    weights = list(model.treeWeights)
    scale = {"GBTClassificationModel": 2.0, "GBTRegressionModel": 1.0}.get(kind, 1.0 / sum(weights))
    value = F.col("prediction")
    if kind == "RandomForestClassificationModel":
        value = F.get("stats", F.lit(1)) / F.aggregate("stats", F.lit(0.0), lambda a, s: a + s)
    weight = F.element_at(F.array(*[F.lit(float(w) * scale) for w in weights]), F.col("tree") + 1)
    nodes = tree_nodes(spark, model).select(
        "tree", "node", "left", "right", "feature", F.get("threshold", F.lit(0)).alias("cut"), "rows", (value * weight).alias("value")
    )
    # a function of two arguments would be given the key as its first
    return nodes.groupBy("tree").applyInPandas(lambda tree: flattened(tree), LEAF)


def in_spans(leaves: DataFrame, per_span: int = LEAVES_PER_SPAN) -> tuple[DataFrame, int]:
    """The leaves with their ``span``, all of about the same size and none above ``per_span``; and how many spans there are.

    Places run on from tree to tree, so small trees share a span and a large tree takes several.
    The windows see one row a tree and the leaves of one tree.
    """
    kept = stage(leaves, "leaves")
    sizes = kept.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("tree").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("tree", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(W.partitionBy("tree").orderBy("features", "low", "high")) - 1
    spans = max(1, -(-kept.count() // per_span))
    return kept.join(starts, "tree").withColumn("span", (place / per_span).cast("int")).drop("start"), spans


def patterns(passes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a table of truth values, and which of them each row is."""
    codes = np.zeros(len(passes), dtype=np.int64)
    for start in range(0, passes.shape[1], 32):
        part = passes[:, start : start + 32]
        _, codes = np.unique((codes << part.shape[1]) | (part @ (1 << np.arange(part.shape[1]))), return_inverse=True)
    _, first = np.unique(codes, return_index=True)
    return first, codes


def leaf_contributions(x: np.ndarray, leaves: Iterable[Leaf]) -> np.ndarray:
    """Contributions (rows × features) for a block of feature rows.

    Rows that pass and fail the same tests of a leaf get the same, so the integral is worked out once for each pattern.
    """
    columns = np.ascontiguousarray(x.T)
    out = np.zeros_like(columns)
    for leaf in leaves:
        m = len(leaf.features)
        if m == 0:
            continue
        seen = columns[leaf.features]
        first, which = patterns(((seen > leaf.low[:, None]) & (seen <= leaf.high[:, None])).T)
        passes = ((seen[:, first] > leaf.low[:, None]) & (seen[:, first] <= leaf.high[:, None])).T.astype(float)
        nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
        u = (nodes + 1) / 2
        factors = leaf.share * (1 - u)[:, None, None] + passes * u[:, None, None]
        before = np.ones_like(factors)
        after = np.ones_like(factors)
        np.cumprod(factors[:, :, :-1], axis=2, out=before[:, :, 1:])
        after[:, :, :-1] = np.cumprod(factors[:, :, :0:-1], axis=2)[:, :, ::-1]
        integral = np.tensordot(weights / 2, before * after, axes=1)
        found = leaf.value * (passes - leaf.share) * integral
        # features of a leaf are all different
        out[leaf.features] += found.T[:, which]
    return out.T


def as_leaves(table: pd.DataFrame) -> list[Leaf]:
    return [
        Leaf(np.asarray(r.features, dtype=int), *[np.asarray(a, dtype=float) for a in (r.low, r.high, r.share)], float(r.value))
        for r in table.itertuples(index=False)
    ]


def base_of(leaves: Iterable[Leaf]) -> float:
    """What leaves add to the score when every feature is absent."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))


def tree_attributions(
    df: DataFrame,
    leaves: DataFrame,
    names: Sequence[str],
    key: str = "msno",
    leaves_per_span: int = LEAVES_PER_SPAN,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """(key, feature, contribution, value, base_value) for every row and feature.

    contributions + base_value = raw score of a row. Rows of the same key stay rows of their own.
    A missing feature value passes no test.
    """
    columns = list(names)
    # the number given to a row is written with it, so a repeated task can't deal it out anew
    rows = stage(
        df.select(
            F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
        ),
        "explained-rows",
    )
    dealt, spans = in_spans(leaves, leaves_per_span)
    blocks = max(1, -(-rows.count() // rows_per_block))
    tasks = min(blocks * spans, MOST_TASKS)
    groups = ["_block", "_span"]
    many = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")).withColumn(
        "_span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))
    )
    spread = dealt.withColumnRenamed("span", "_span").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    xs = [f"_x{i}" for i in range(len(columns))]
    parts = [f"_c{i}" for i in range(len(columns))]
    schema = T.StructType(
        [rows.schema["_row"], rows.schema["_key"], *[rows.schema[c] for c in xs]]
        + [T.StructField(c, T.DoubleType()) for c in [*parts, "_base"]]
    )

    def of_group(block: pd.DataFrame, span: pd.DataFrame) -> pd.DataFrame:
        inside = as_leaves(span)
        values = block[xs].to_numpy(dtype=float)
        found = pd.DataFrame(leaf_contributions(values, inside), columns=parts, index=block.index).assign(_base=base_of(inside))
        return pd.concat([block[["_row", "_key", *xs]], found], axis=1)

    partial = (
        many.repartition(tasks, *groups)
        .groupBy(*groups)
        .cogroup(spread.repartition(tasks, *groups).groupBy(*groups))
        .applyInPandas(of_group, schema)
    )
    whole = partial.groupBy("_row").agg(
        F.first("_key").alias(key), *[F.first(c).alias(c) for c in xs], *[F.sum(c).alias(c) for c in parts], F.sum("_base").alias("base_value")
    )
    cells = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(c).alias("contribution"), F.col(x).alias("value")) for n, c, x in zip(columns, parts, xs)]
    )
    return whole.select(key, "base_value", F.inline(cells)).select(key, "feature", "contribution", "value", "base_value")


def scaled_linear(model: PipelineModel, names: Sequence[str]) -> Mapping[str, float]:
    """Coefficients per original unit of a scaler followed by a linear learner."""
    scaler, learner = model.stages[0], model.stages[-1]
    std = scaler.std.toArray()
    return {n: float(w / s) if s else 0.0 for n, w, s in zip(names, learner.coefficients.toArray(), std)}


def attributions(df: DataFrame, model: PipelineModel, names: Sequence[str], background: DataFrame | None = None) -> DataFrame:
    """Contributions of any fitted learner of this package.

    ``background`` gives a linear learner's feature means (default: ``df``);
    its base value is the score at those means.
    """
    learner = model.stages[-1]
    if hasattr(learner, "treeWeights"):
        return tree_attributions(df, leaf_table(df.sparkSession, learner), names)
    per_unit = scaled_linear(model, names)
    centre = dict(zip(names, model.stages[0].mean.toArray()))
    at_means = [(F.avg(c) - float(centre[c])) * b for c, b in per_unit.items()]
    base = (df if background is None else background).agg(
        reduce(lambda a, b: a + b, at_means, F.lit(float(learner.intercept))).alias("base")
    ).scalar()
    return linear_attributions(df, per_unit, background).withColumn("base_value", base)
