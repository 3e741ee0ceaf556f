"""Forests of unlimited depth whose trees never stand whole in one place.

The leaves of such trees grow with the rows, so neither the driver nor one task may
hold a tree. Features are cut into at most 32 bins. As long as a node holds more
than ``ROWS_PER_PART`` rows, it is split from counts that all tasks add up, a level
of all trees in one pass; these few upper nodes are on the driver. The rows of
a smaller node are brought together, and its part of the tree is finished in a task. The nodes
of the parts are a written table, which rows meet by part when they are scored.

The rules are those of Spark's forest: Poisson(1) counts as bootstrap, the square root of the
features (rounded up) tried at a node, Gini impurity of weighted classes, the least number of rows of a
leaf, and sibling leaves of the same prediction joined. Draws depend on the seed, the tree
and the node's path only: the first trees of a forest are the smaller forest.

Cases: a missing or NaN feature value falls to the right; a forest of one tree takes
all rows once and tries all features, as Spark's does.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.learning.explain import LEAF, flattened
from ebbtide.session import stage

# The batch functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
DEEPEST = 30
# Rows (with repeats) of a node that is finished in one task, and rows scored there at once.
ROWS_PER_PART = 50_000
LEAST_GAIN = 1e-12

NODES = "tree int, part int, node int, left int, right int, feature int, bin int, n0 long, n1 long, gain double"
FIELDS = ("left", "right", "feature", "bin", "n0", "n1", "gain")
CHUNKS = "tree int, part int, n long, ids binary, cells binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_hash(seed: int, number: int) -> np.ndarray:
    return mixed(np.array([seed * 1_000_003 + number + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def drawn(ids: np.ndarray, root: np.ndarray) -> np.ndarray:
    """How often a tree takes each row: Poisson(1) of a hash."""
    u = (mixed(mixed(ids.view(np.uint64) + root) ^ root) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]), u, "right").astype(np.uint8)


def child_hash(h: np.ndarray, right: int) -> np.ndarray:
    return mixed(h * np.uint64(3) + np.uint64(1 + right))


def tried(h: np.ndarray, features: int, most: int) -> np.ndarray:
    """The features tried at nodes of these hashes, in rising order."""
    if most >= features:
        return np.tile(np.arange(features), (len(h), 1))
    order = mixed(h[:, None] + np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argpartition(order, most, axis=1)[:, :most], axis=1)


@dataclass(frozen=True)
class Rules:
    """``trees`` names each tree's number and least rows of a leaf."""

    trees: tuple[tuple[int, int], ...]
    cuts: tuple[tuple[float, ...], ...]
    weights: tuple[float, float]
    most: int
    bootstrap: bool
    seed: int
    depth: int = DEEPEST


def impurity(w0, w1):
    total = w0 + w1
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1 - (w0**2 + w1**2) / np.maximum(total, 1e-300) ** 2, 0.0)


def best_bins(n0: np.ndarray, n1: np.ndarray, cuts: np.ndarray, weights, least: int):
    """For each node the best bin of one feature, its gain and the counts on its left; counts are nodes by bins."""
    l0, l1 = np.cumsum(n0, axis=1), np.cumsum(n1, axis=1)
    t0, t1 = l0[:, -1:], l1[:, -1:]
    r0, r1 = t0 - l0, t1 - l1
    left, right = l0 * weights[0] + l1 * weights[1], r0 * weights[0] + r1 * weights[1]
    inside = left * impurity(l0 * weights[0], l1 * weights[1]) + right * impurity(r0 * weights[0], r1 * weights[1])
    gain = impurity(t0 * weights[0], t1 * weights[1]) - inside / np.maximum(left + right, 1e-300)
    good = (l0 + l1 >= least) & (r0 + r1 >= least) & (np.arange(BINS) < cuts[:, None])
    gain = np.where(good, gain, -1.0)
    at = gain.argmax(axis=1)
    own = np.arange(len(at))
    return at, gain[own, at], l0[own, at], l1[own, at]


def settled(n0, n1, depth: int, least: int, rules: Rules):
    """Whether a node stays a leaf whatever the features."""
    return (n0 == 0) | (n1 == 0) | (n0 + n1 < 2 * least) | (depth >= rules.depth)


def joined(left: np.ndarray, right: np.ndarray, predicted: np.ndarray) -> None:
    """Sibling leaves of the same prediction become one; children come after their parents. Changes the arrays."""
    for i in range(len(left) - 1, -1, -1):
        a, b = left[i], right[i]
        if a >= 0 and left[a] == -1 and left[b] == -1 and predicted[a] == predicted[b]:
            left[i] = right[i] = -1


def finished(cells: np.ndarray, root: np.ndarray, depth: int, least: int, rules: Rules) -> dict[str, np.ndarray]:
    """The nodes below one of few rows; ``cells`` has the rows' bins, class and number of repeats."""
    features = cells.shape[1] - 2
    cuts = np.array([len(c) for c in rules.cuts])
    y, k = cells[:, -2].astype(float), cells[:, -1].astype(float)
    out = {f: [np.array([-1])] for f in FIELDS[:4]}
    out |= {"n0": [np.array([(k * (1 - y)).sum()])], "n1": [np.array([(k * y).sum()])], "gain": [np.array([0.0])]}
    flat = {f: [] for f in FIELDS}
    made, h = 0, root
    # the level's nodes: hashes, and for rows still on their way the place of their node in the level
    rows, at = np.arange(len(cells)), np.zeros(len(cells), np.int64)
    while True:
        level = {f: v[-1].copy() for f, v in out.items()}
        made += len(level["left"])
        going = ~settled(level["n0"], level["n1"], depth, least, rules)
        if going.any() and len(rows):
            number = np.cumsum(going) - 1
            stay = going[at]
            rows, at = rows[stay], number[at[stay]]
            own = h[going]
            choice = tried(own, features, rules.most)
            best = [np.zeros(len(own), np.int64), np.full(len(own), -1.0), np.zeros(len(own)), np.zeros(len(own))]
            feature = np.full(len(own), -1)
            for j in range(choice.shape[1]):
                place = at * BINS + cells[rows, choice[at, j]]
                ones = np.bincount(place, k[rows] * y[rows], len(own) * BINS).reshape(-1, BINS)
                every = np.bincount(place, k[rows], len(own) * BINS).reshape(-1, BINS)
                found = best_bins(every - ones, ones, cuts[choice[:, j]], rules.weights, least)
                better = found[1] > best[1]
                best = [np.where(better, new, old) for new, old in zip(found, best)]
                feature = np.where(better, choice[:, j], feature)
            split = best[1] > LEAST_GAIN
            nodes = np.flatnonzero(going)[split]
            child = made + 2 * np.arange(len(nodes))
            level["left"][nodes], level["right"][nodes] = child, child + 1
            level["feature"][nodes], level["bin"][nodes], level["gain"][nodes] = feature[split], best[0][split], best[1][split]
        else:
            nodes = np.zeros(0, np.int64)
        for f in FIELDS:
            flat[f].append(level[f])
        if not len(nodes):
            break
        l0, l1 = best[2][split], best[3][split]
        n0, n1 = level["n0"][nodes], level["n1"][nodes]
        pair = lambda a, b: np.stack([a, b], axis=1).ravel()
        out = {f: [np.full(2 * len(nodes), -1)] for f in FIELDS[:4]}
        out |= {"n0": [pair(l0, n0 - l0)], "n1": [pair(l1, n1 - l1)], "gain": [np.zeros(2 * len(nodes))]}
        h = pair(child_hash(own[split], 0), child_hash(own[split], 1))
        stay = split[at]
        rows, at = rows[stay], at[stay]
        goes = cells[rows, feature[at]] > best[0][at]
        at = 2 * (np.cumsum(split) - 1)[at] + goes
        depth += 1
    found = {f: np.concatenate(v) for f, v in flat.items()}
    joined(found["left"], found["right"], found["n1"] * rules.weights[1] > found["n0"] * rules.weights[0])
    return found


def reached(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(left), bool)
    seen[0] = True
    for i in np.flatnonzero(left >= 0):
        if seen[i]:
            seen[left[i]] = seen[right[i]] = True
    return seen


def compact(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Only nodes that can be reached, numbered anew."""
    left = nodes["left"]
    seen = reached(left, nodes["right"])
    number = np.cumsum(seen) - 1
    kept = {f: v[seen] for f, v in nodes.items()}
    for f in ("left", "right"):
        kept[f] = np.where(kept["left"] >= 0, number[kept[f]], -1) if f == "right" else kept[f]
    kept["left"] = np.where(kept["left"] >= 0, number[kept["left"]], -1)
    return kept


def routed(cells: np.ndarray, left, right, feature, cut) -> np.ndarray:
    """The node at which each row ends."""
    at = np.zeros(len(cells), np.int64)
    going = np.arange(len(cells)) if left[0] >= 0 else np.zeros(0, np.int64)
    while len(going):
        node = at[going]
        at[going] = np.where(cells[going, feature[node]] <= cut[node], left[node], right[node])
        going = going[left[at[going]] >= 0]
    return at


class Upper:
    """The upper nodes of one tree; a node without children is a leaf or the root of a part."""

    def __init__(self, root: np.ndarray):
        self.rows = [dict(left=-1, right=-1, feature=-1, bin=-1, n0=0, n1=0, gain=0.0)]
        self.hash, self.depth, self.up = [root], [0], [-1]
        self.parts: set[int] = set()

    def split(self, node: int, found) -> tuple[int, int]:
        own = self.rows[node]
        first = len(self.rows)
        own.update(left=first, right=first + 1, feature=found["feature"], bin=found["bin"], gain=found["gain"], n0=found["n0"], n1=found["n1"])
        for right, (n0, n1) in enumerate([(found["l0"], found["l1"]), (found["n0"] - found["l0"], found["n1"] - found["l1"])]):
            self.rows.append(dict(left=-1, right=-1, feature=-1, bin=-1, n0=n0, n1=n1, gain=0.0))
            self.hash.append(child_hash(self.hash[node], right))
            self.depth.append(self.depth[node] + 1)
            self.up.append(node)
        return first, first + 1

    def arrays(self) -> dict[str, np.ndarray]:
        return {f: np.array([r[f] for r in self.rows]) for f in FIELDS}


def _cells(column: pa.Array, cuts) -> np.ndarray:
    x = np.array(column.flatten()).reshape(-1, len(cuts)) if len(column) else np.zeros((0, len(cuts)))
    return np.stack([np.searchsorted(np.array(c, float), x[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def bin_facts(train: DataFrame, features: str) -> DataFrame:
    """Quantiles and ends of the known values of each feature, a row a feature: ``i``, ``quantiles``, ``least``, ``most``.

    A row's vector is turned into numbers once, and the summaries of different features are merged by different tasks.
    """
    shares = [i / BINS for i in range(1, BINS)]
    known = train.select(F.posexplode(vector_to_array(features)).alias("i", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    return known.groupBy("i").agg(F.percentile_approx("v", shares, 10_000).alias("quantiles"), F.min("v").alias("least"), F.max("v").alias("most"))


def bin_cuts(train: DataFrame, features: str) -> tuple[tuple[float, ...], ...]:
    """The values that part the bins of each feature: quantiles of all rows, and the smallest value."""
    n = train.select(F.size(vector_to_array(features))).first()[0]
    facts = {r["i"]: r for r in bin_facts(train, features).collect()}  # a row a feature
    out = []
    for i in range(n):
        values = {*facts[i]["quantiles"], facts[i]["least"]} - {facts[i]["most"]} if i in facts else set()
        out.append(tuple(sorted(values))[-(BINS - 1) :])
    return tuple(out)


def grow(train: DataFrame, trees: Sequence[tuple[int, int]], features: str, weights: tuple[float, float], seed: int, bootstrap: bool = True, rows_per_part: int = ROWS_PER_PART) -> dict:
    """All trees, given by number and least rows of a leaf, in common passes over the rows."""
    cuts = bin_cuts(train, features)
    d = len(cuts)
    rules = Rules(tuple(trees), cuts, weights, math.ceil(math.sqrt(d)) if bootstrap else d, bootstrap, seed)
    table = train.select(F.xxhash64("msno").alias("id"), F.col("is_churn").cast("int").alias("y"), vector_to_array(features).alias("x"))

    def binned(batches):
        for batch in batches:
            cells = np.column_stack([_cells(batch.column("x"), cuts), batch.column("y").to_numpy().astype(np.uint8)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in cells], pa.binary())], names=["id", "cells"])

    rows = stage(table.mapInArrow(binned, "id long, cells binary"), "binned")
    n = rows.count()
    roots = [tree_hash(seed, number) for number, _ in trees]
    upper = [Upper(r) for r in roots]
    active = [(t, 0) for t in range(len(trees))] if n > rows_per_part else []
    if not active:
        for u in upper:
            u.parts.add(0)

    def unpacked(batch):
        cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(batch.num_rows, d + 1)
        return batch.column("id").to_numpy(), cells

    while active:
        shape = [u.arrays() for u in upper]
        places = {}
        for i, (t, node) in enumerate(active):
            places.setdefault(t, {})[node] = i
        choice = np.concatenate([tried(upper[t].hash[node], d, rules.most) for t, node in active])
        width = rules.most * BINS

        def counted(batches):
            total = np.zeros((2, len(choice) * width), np.int64)
            for batch in batches:
                ids, cells = unpacked(batch)
                for t, own in places.items():
                    s = shape[t]
                    where = np.full(len(s["left"]), -1)
                    where[list(own)] = list(own.values())
                    at = where[routed(cells, s["left"], s["right"], s["feature"], s["bin"])]
                    k = drawn(ids, roots[t]) if bootstrap else np.ones(len(ids), np.uint8)
                    on = np.flatnonzero((at >= 0) & (k > 0))
                    at, kk, y = at[on], k[on].astype(float), cells[on, d]
                    low = min(own.values())
                    size = (max(own.values()) - low + 1) * width
                    for j in range(rules.most):
                        place = (at - low) * width + j * BINS + cells[on, choice[at, j]]
                        for c in (0, 1):
                            total[c, low * width : low * width + size] += np.bincount(place, kk * (y == c), size).astype(np.int64)
            some = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array((some // width).astype(np.int32)), pa.array((some % width).astype(np.int32)), *[pa.array(v[some]) for v in total]], names=["place", "cell", "n0", "n1"])

        size = np.array([len(c) for c in cuts])

        def chosen(part: pa.Table) -> pa.Table:
            i = part.column("place")[0].as_py()
            n0, n1 = np.zeros(width), np.zeros(width)
            cell = part.column("cell").to_numpy()
            n0[cell], n1[cell] = part.column("n0").to_numpy(), part.column("n1").to_numpy()
            n0, n1 = n0.reshape(-1, BINS), n1.reshape(-1, BINS)
            at, gain, l0, l1 = best_bins(n0, n1, size[choice[i]], rules.weights, trees[active[i][0]][1])
            j = int(gain.argmax())
            row = dict(place=i, feature=int(choice[i][j]), bin=int(at[j]), gain=float(gain[j]), n0=int(n0[0].sum()), n1=int(n1[0].sum()), l0=int(l0[j]), l1=int(l1[j]))
            return pa.table({f: [v] for f, v in row.items()}, schema=best_schema)

        best_schema = pa.schema([("place", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), *[(f, pa.int64()) for f in ("n0", "n1", "l0", "l1")]])
        sums = rows.mapInArrow(counted, "place int, cell int, n0 long, n1 long").groupBy("place", "cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        # a row for each node that is split, of which there are one for each so many rows
        found = sums.groupBy("place").applyInArrow(chosen, "place int, feature int, bin int, gain double, n0 long, n1 long, l0 long, l1 long").collect()
        later = []
        for r in sorted(found, key=lambda r: r["place"]):
            t, node = active[r["place"]]
            u, least = upper[t], trees[t][1]
            if node == 0:
                u.rows[0].update(n0=r["n0"], n1=r["n1"])
            if r["gain"] <= LEAST_GAIN:
                continue
            for child in u.split(node, r.asDict()):
                own = u.rows[child]
                if settled(own["n0"], own["n1"], u.depth[child], least, rules):
                    continue
                if own["n0"] + own["n1"] > rows_per_part:
                    later.append((t, child))
                else:
                    u.parts.add(child)
        active = later

    shape = [u.arrays() for u in upper]
    wanted = [np.isin(np.arange(len(u.rows)), list(u.parts)) for u in upper]

    def dealt(batches):
        for batch in batches:
            ids, cells = unpacked(batch)
            for t, s in enumerate(shape):
                if not wanted[t].any():
                    continue
                at = routed(cells, s["left"], s["right"], s["feature"], s["bin"])
                k = drawn(ids, roots[t]) if bootstrap else np.ones(len(ids), np.uint8)
                on = np.flatnonzero((k > 0) & wanted[t][at])
                yield from chunks(t, at[on], None, np.column_stack([cells[on], k[on]]))

    hashes = [u.hash for u in upper]
    depths = [u.depth for u in upper]

    def finish(part: pa.Table) -> pa.Table:
        t, own = part.column("tree")[0].as_py(), part.column("part")[0].as_py()
        cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(-1, d + 2)
        # in one order, whatever way the chunks came
        nodes = compact(finished(cells, hashes[t][own], depths[t][own], trees[t][1], rules))
        return pa.Table.from_batches([_as_batch(t, own, nodes)])

    parts = rows.mapInArrow(dealt, CHUNKS).groupBy("tree", "part").applyInArrow(finish, NODES)
    nodes = stage(parts, "forest-parts")
    # a part that is a leaf belongs to the upper nodes: a sibling may be of the same prediction
    for r in nodes.filter("node = 0 and left < 0").collect():
        upper[r["tree"]].rows[r["part"]].update(n0=r["n0"], n1=r["n1"])
        upper[r["tree"]].parts.discard(r["part"])
    tops, leaves = [], []
    for t, u in enumerate(upper):
        s = u.arrays()
        left = s["left"].copy()
        left[list(u.parts)] = -2  # no leaf
        joined(left, s["right"], s["n1"] * weights[1] > s["n0"] * weights[0])
        s["left"] = np.where(left == -2, -1, left)
        seen = reached(s["left"], s["right"])
        for i in np.flatnonzero(seen & (s["left"] < 0)):
            if i not in u.parts:
                leaves.append((t, int(i), 0, -1, -1, -1, -1, int(s["n0"][i]), int(s["n1"][i]), 0.0))
        tops.append({**s, "up": np.array(u.up), "seen": seen})
    whole = nodes.join(nodes.filter("node = 0 and left >= 0").select("tree", "part"), ["tree", "part"], "left_semi")
    whole = stage(whole.unionByName(train.sparkSession.createDataFrame(leaves, NODES)), "forest-nodes")
    return {"rules": rules, "tops": tops, "nodes": whole, "features": features}


def _as_batch(tree: int, part: int, nodes: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(nodes["left"])
    whole = [pa.array(np.full(n, v, np.int32)) for v in (tree, part)] + [pa.array(np.arange(n, dtype=np.int32))]
    whole += [pa.array(nodes[f].astype(np.int32)) for f in FIELDS[:4]] + [pa.array(nodes[f].astype(np.int64)) for f in ("n0", "n1")]
    return pa.RecordBatch.from_arrays([*whole, pa.array(nodes["gain"].astype(float))], names=["tree", "part", "node", *FIELDS])


def chunks(tree: int, at: np.ndarray, ids: np.ndarray | None, cells: np.ndarray):
    """The rows of a batch, one record for each node."""
    order = np.argsort(at, kind="stable")
    at, cells = at[order], np.ascontiguousarray(cells[order])
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(at))
    held = [None] * len(begin) if ids is None else [ids[order[a:b]].tobytes() for a, b in zip(begin, end)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(begin), tree, np.int32)), pa.array(at[begin].astype(np.int32)), pa.array((end - begin).astype(np.int64)),
            pa.array(held, pa.binary()), pa.array([cells[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()),
        ],
        names=["tree", "part", "n", "ids", "cells"],
    )


class GrownForest:
    """Some trees of what ``grow`` made, used like a fitted pipeline of one stage."""

    def __init__(self, grown: dict, trees: Sequence[int]):
        self.grown, self.trees = grown, list(trees)
        self.stages = [self]
        self.treeWeights = [1.0] * len(self.trees)

    def nodes(self) -> DataFrame:
        return self.grown["nodes"].filter(F.col("tree").isin(self.trees))

    def scored(self, df: DataFrame, columns: Sequence) -> DataFrame:
        """``columns`` of every row and its ``probability`` of class 1, to 12 decimals."""
        rules, tops, mine = self.grown["rules"], self.grown["tops"], self.trees
        d = len(rules.cuts)
        # the number given to a row is written with it, so a repeated task can't deal it out anew
        rows = stage(df.select(F.monotonically_increasing_id().alias("_row"), *columns, vector_to_array(self.grown["features"]).alias("_x")), "rows-to-score")

        def dealt(batches):
            for batch in batches:
                cells, ids = _cells(batch.column("_x"), rules.cuts), batch.column("_row").to_numpy()
                for t in mine:
                    s = tops[t]
                    yield from chunks(t, routed(cells, s["left"], s["right"], s["feature"], s["bin"]), ids, cells)

        dealt_rows = stage(rows.select("_row", "_x").mapInArrow(dealt, CHUNKS), "dealt-rows")
        # a part that many rows fall into is sent to as many tasks as these need
        sizes = dealt_rows.groupBy("tree", "part").agg(F.ceil(F.sum("n") / ROWS_PER_PART).alias("lots"))
        sizes = stage(sizes, "part-sizes")
        lots = dealt_rows.join(sizes, ["tree", "part"]).select("tree", "part", F.pmod(F.xxhash64("ids"), F.col("lots")).alias("lot"), "ids", "cells")
        again = sizes.select("tree", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))
        nodes = self.nodes().join(again, ["tree", "part"]).select("lot", *self.nodes().columns)
        w0, w1 = rules.weights

        def score(key, found: pa.Table, part: pa.Table) -> pa.Table:
            if not found.num_rows:
                return pa.table({"_row": pa.array([], pa.int64()), "p": pa.array([], pa.float64())})
            part = part.sort_by("node")
            s = {f: part.column(f).to_numpy() for f in FIELDS}
            cells = np.frombuffer(b"".join(found.column("cells").to_pylist()), np.uint8).reshape(-1, d)
            at = routed(cells, s["left"], s["right"], s["feature"], s["bin"])
            p = s["n1"] * w1 / (s["n0"] * w0 + s["n1"] * w1)
            return pa.table({"_row": np.frombuffer(b"".join(found.column("ids").to_pylist()), np.int64), "p": p[at]})

        keys = ["tree", "part", "lot"]
        each = lots.groupBy(*keys).cogroup(nodes.groupBy(*keys)).applyInArrow(score, "_row long, p double")
        mean = each.groupBy("_row").agg(F.round(F.sum("p") / len(mine), 12).alias("probability"))
        return rows.drop("_x").join(mean, "_row").drop("_row")

    @property
    def featureImportances(self) -> DenseVector:
        """Weighted gains of each feature, every tree's adding up to one, as Spark has it."""
        rules, tops = self.grown["rules"], self.grown["tops"]
        w0, w1 = (F.lit(w) for w in rules.weights)
        total = {t: np.zeros(len(rules.cuts)) for t in self.trees}
        for t in self.trees:
            s = tops[t]
            own = s["seen"] & (s["left"] >= 0)
            np.add.at(total[t], s["feature"][own], (s["gain"] * (s["n0"] * rules.weights[0] + s["n1"] * rules.weights[1]))[own])
        gains = self.nodes().filter("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * (F.col("n0") * w0 + F.col("n1") * w1)).alias("g"))
        for r in gains.collect():  # a row for each tree and feature
            total[r["tree"]][r["feature"]] += r["g"]
        whole = sum(v / v.sum() if v.sum() else v for v in total.values())
        return DenseVector(whole / whole.sum() if whole.sum() else whole)

    def leaf_table(self) -> DataFrame:
        """The forest's leaves as in ``explain.leaf_table``, flattened part by part."""
        rules, tops, trees = self.grown["rules"], self.grown["tops"], len(self.trees)
        w0, w1 = rules.weights

        def above(tree: int, part: int) -> dict:
            """Bounds and share of the path from the root to a part."""
            s, way, path = tops[tree], [part], {}
            while s["up"][way[-1]] >= 0:
                way.append(int(s["up"][way[-1]]))
            for node, child in zip(way[::-1], way[-2::-1]):
                f = int(s["feature"][node])
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                cut = rules.cuts[f][s["bin"][node]]
                rows = (s["n0"] + s["n1"]).astype(float)
                bounds = (low, min(high, cut)) if child == s["left"][node] else (max(low, cut), high)
                path[f] = (*bounds, share * rows[child] / rows[node])
            return path

        def flatten(part: pd.DataFrame) -> pd.DataFrame:
            value = part["n1"] * w1 / (part["n0"] * w0 + part["n1"] * w1) / trees
            cut = [rules.cuts[f][b] if f >= 0 else 0.0 for f, b in zip(part["feature"], part["bin"])]
            ready = part.assign(value=value, cut=cut, rows=part["n0"] + part["n1"])
            return flattened(ready, above(int(part["tree"].iloc[0]), int(part["part"].iloc[0])))

        return self.nodes().groupBy("tree", "part").applyInPandas(flatten, LEAF)
