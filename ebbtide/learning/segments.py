"""K-Means segments over standardised listening columns.

All numbers of clusters and all starts are fitted together: each pass over the
one written matrix moves every set of centres.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.segments import CLUSTER_FEATURES, apply_names, assign_centroid, cluster_profile, name_segments, standardize
from ebbtide.session import stage

SEED, STARTS = 42, 10
PASSES, TOLERANCE = 100, 1e-4
SAMPLE = 5_000  # rows among which starting centres are chosen


def cluster_matrix(master: DataFrame, columns: Sequence[str] = CLUSTER_FEATURES, fit_on: Column | None = None) -> DataFrame:
    """Master rows with a ``scaled`` vector, written once since every start reads it."""
    scaled = standardize(master, columns, fit_on)
    z = [f"z_{c}" for c in columns]
    return stage(VectorAssembler(inputCols=z, outputCol="scaled").transform(scaled).drop(*z), "cluster-matrix")


def first_centres(matrix: DataFrame, ks: Sequence[int], starts: int, seed: int, rows: int = SAMPLE) -> dict[tuple[int, int], np.ndarray]:
    """Seeded starting centres for each k and start, spread by squared distance (k-means++).

    They are chosen among ``rows`` rows, the first in a hash order; the passes that follow read all rows.
    """
    point = vector_to_array("scaled")
    order = F.xxhash64(point, F.lit(seed))
    sample = np.array([r[0] for r in matrix.select(point, order).distinct().orderBy(order).limit(rows).collect()])
    out = {}
    for k in ks:
        for start in range(starts):
            rng = np.random.default_rng([seed, k, start])
            chosen = [sample[rng.integers(len(sample))]]
            near = ((sample - chosen[0]) ** 2).sum(axis=1)
            while len(chosen) < k:
                spread = near.sum()
                at = rng.choice(len(sample), p=near / spread) if spread > 0 else rng.integers(len(sample))
                chosen.append(sample[at])
                near = np.minimum(near, ((sample - sample[at]) ** 2).sum(axis=1))
            out[k, start] = np.array(chosen)
    return out


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each centre."""
    total = np.zeros((len(centres), len(points)))
    for p, c in zip(np.ascontiguousarray(points.T), centres.T):
        step = p - c[:, None]
        step *= step
        total += step
    return total


def points(matrix: DataFrame) -> DataFrame:
    """The rows' coordinates as plain numbers; ``matrix`` itself, where it is no more than these."""
    return matrix if matrix.columns == ["p"] else matrix.select(vector_to_array("scaled").alias("p"))


def one_pass(matrix: DataFrame, centres: Sequence[np.ndarray]) -> list[list[dict]]:
    """What one look at all rows tells about every set of centres.

    Each task adds up its rows for all sets; the sums of tasks are combined by
    Spark. Returned are, for each centre of each set, the rows nearest to it
    (the first of equally near ones): their number, sum, sum of squares and
    squared distance.
    """
    dims = centres[0].shape[1]
    shape = np.cumsum([0] + [len(c) for c in centres])
    together = np.concatenate(centres)

    def add_up(batches):
        total = np.zeros((shape[-1], dims + 3))
        for batch in batches:
            points = np.array(batch.column(0).flatten()).reshape(-1, dims)
            for first in range(0, len(points), 4096):
                part = points[first : first + 4096]
                far = _squared(part, together)
                near = np.stack([begin + far[begin:end].argmin(axis=0) for begin, end in zip(shape, shape[1:])])
                held = [np.ones(near.shape), (part**2).sum(axis=1), far[near, np.arange(len(part))], *part.T]
                # counted, not multiplied: a product of matrices would start threads in every task
                total += np.stack([np.bincount(near.ravel(), np.broadcast_to(h, near.shape).ravel(), shape[-1]) for h in held], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[-1])), *[pa.array(c) for c in total.T]], names=names)

    names = ["centre", "n", "square", "cost", *[f"s{i}" for i in range(dims)]]
    rows = points(matrix).mapInArrow(add_up, "centre long, " + ", ".join(f"{n} double" for n in names[1:]))
    found = rows.groupBy("centre").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()  # a row for each centre
    place = {r["centre"]: r for r in found}
    empty = dict.fromkeys(names[1:], 0.0)
    out = []
    for begin, own in zip(shape, centres):
        each = [place.get(int(begin) + i) for i in range(len(own))]
        each = [empty if r is None else r.asDict() for r in each]
        out.append([{"n": r["n"], "square": r["square"], "cost": r["cost"], "sum": np.array([r[f"s{i}"] for i in range(dims)])} for r in each])
    return out


def moved(centres: np.ndarray, found: Sequence[Mapping]) -> np.ndarray:
    """Each centre at the mean of its rows; one without rows stays."""
    return np.array([r["sum"] / r["n"] if r["n"] else c for c, r in zip(centres, found)])


def lloyd(matrix: DataFrame, sets: Mapping, passes: int = PASSES, tolerance: float = TOLERANCE) -> dict:
    """Every set of centres moved until none moves further than ``tolerance``, all in the same passes.

    A set that has settled takes no part in the passes that follow.
    """
    done, going = {}, dict(sets)
    for _ in range(passes):
        if not going:
            break
        keys = list(going)
        for key, found in zip(keys, one_pass(matrix, [going[k] for k in keys])):
            new = moved(going[key], found)
            still = (((new - going[key]) ** 2).sum(axis=1) <= tolerance**2).all()
            going[key] = new
            if still:
                done[key] = going.pop(key)
    return {k: (done | going)[k] for k in sets}


def fit_starts(matrix: DataFrame, ks: Sequence[int], starts: int = STARTS, seed: int = SEED) -> dict[int, tuple[np.ndarray, list[dict]]]:
    """For each k the centres of least cost of several starts, and what a pass tells of them."""
    # every pass reads numbers, without turning vectors into arrays each time
    plain = stage(points(matrix), "points")
    settled = lloyd(plain, first_centres(matrix, ks, starts, seed))
    found = one_pass(plain, list(settled.values()))
    best: dict[int, tuple[float, np.ndarray, list[dict]]] = {}
    for ((k, _), centres), rows in zip(settled.items(), found):
        cost = sum(r["cost"] for r in rows)
        if k not in best or cost < best[k][0]:
            best[k] = (cost, centres, rows)
    return {k: (centres, rows) for k, (_, centres, rows) in best.items()}


def silhouettes(matrix: DataFrame, fits: Mapping[int, tuple[np.ndarray, list[dict]]]) -> dict[int, float]:
    """Mean silhouette of each k by squared distances, exact from the clusters' sums, in one pass over all rows."""
    ks = list(fits)

    def add_up(batches):
        total, n = np.zeros(len(ks)), 0
        for batch in batches:
            dims = fits[ks[0]][0].shape[1]
            points = np.array(batch.column(0).flatten()).reshape(-1, dims)
            n += len(points)
            square = (points**2).sum(axis=1)
            for i, k in enumerate(ks):
                centres, rows = fits[k]
                size = np.array([r["n"] for r in rows])
                some = np.maximum(size, 1)
                mean = np.array([r["sum"] for r in rows]) / some[:, None]
                own = _squared(points, centres).argmin(axis=0)
                # mean squared distance to each cluster's rows
                far = square[:, None] - 2 * points @ mean.T + np.array([r["square"] for r in rows]) / some
                at = np.arange(len(points))
                inside = far[at, own] * size[own] / np.maximum(size[own] - 1, 1)
                far[at, own] = np.inf
                far[:, size == 0] = np.inf
                outside = far.min(axis=1)
                value = (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300)
                total[i] += np.where((size[own] > 1) & np.isfinite(outside), value, 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(total), pa.array(np.full(len(ks), float(n)))], names=["k", "total", "n"])

    rows = matrix.select(vector_to_array("scaled").alias("p")).mapInArrow(add_up, "k long, total double, n double")
    return {r["k"]: r["s"] for r in rows.groupBy("k").agg((F.sum("total") / F.sum("n")).alias("s")).collect()}


def k_sweep(matrix: DataFrame, ks: Sequence[int] = tuple(range(2, 9)), starts: int = STARTS, seed: int = SEED) -> DataFrame:
    """Cost and silhouette per k, the largest silhouette marked."""
    fits = fit_starts(matrix, ks, starts, seed)
    found = silhouettes(matrix, fits)
    best = max(ks, key=lambda k: found[k])
    rows = [(k, float(sum(r["cost"] for r in fits[k][1])), float(found[k]), k == best) for k in ks]
    return matrix.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, recommended boolean")


def assigned(matrix: DataFrame, centres: np.ndarray) -> DataFrame:
    """Matrix rows with the number of their nearest centre as ``cluster``."""
    point = vector_to_array("scaled")
    spread = matrix.withColumns({f"_z{i}": point[i] for i in range(centres.shape[1])})
    near = assign_centroid(spread, [f"_z{i}" for i in range(centres.shape[1])], [[float(v) for v in c] for c in centres])
    return near.select(*matrix.columns, "cluster")


def kmeans_segments(matrix: DataFrame, k: int = 4, starts: int = STARTS, seed: int = SEED) -> DataFrame:
    """Matrix rows with ``cluster`` and a ``segment_label`` derived from each cluster's profile."""
    clustered = assigned(matrix, fit_starts(matrix, [k], starts, seed)[k][0])
    named = name_segments(cluster_profile(clustered)).collect()  # k rows
    return apply_names(clustered, {r["cluster"]: r["segment_label"] for r in named})


def fixed_passes(matrix: DataFrame, centres: Sequence[Sequence[float]], passes: int) -> DataFrame:
    """Clusters after some passes from given centres: number, rows, cost and centre."""
    own = np.array(centres, float)
    for _ in range(passes):
        own = moved(own, one_pass(matrix, [own])[0])
    found = one_pass(matrix, [own])[0]
    rows = [(i, int(r["n"]), float(r["cost"]), *[float(v) for v in c]) for i, (c, r) in enumerate(zip(own, found))]
    return matrix.sparkSession.createDataFrame(rows, "cluster int, n_rows long, cost double, " + ", ".join(f"c{i} double" for i in range(own.shape[1])))


def pca_projection(matrix: DataFrame, dims: int = 2) -> tuple[DataFrame, list[float]]:
    """Plane coordinates per row and the share of variance of each axis.

    The columns are already centred, as Spark's projection does not do it.
    """
    model = PCA(k=dims, inputCol="scaled", outputCol="_plane").fit(matrix)
    plane = vector_to_array("_plane")
    projected = model.transform(matrix).select("msno", *[plane[i].alias(f"pca{i + 1}") for i in range(dims)])
    return projected, [float(v) for v in model.explainedVariance]


def variance_columns(projected: DataFrame, shares: Sequence[float]) -> DataFrame:
    return reduce(lambda d, i: d.withColumn(f"pca{i + 1}_variance", F.lit(shares[i])), range(len(shares)), projected)
