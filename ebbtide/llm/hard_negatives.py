"""Hard negatives by cover trees over norm-augmented vectors.

A candidate gets one more component, the root of what its squared length lacks
of the block's largest; all then have the same length, and a query with 0 there
is the nearer to a candidate the larger their inner product is. The
candidates of a label are dealt to blocks of bounded size, and each block becomes a
cover tree: centres of a level lie further apart than the level's radius, points
of the next level hang on a centre within it, and radii shrink by a fixed
factor. Every centre knows for each level how far what hangs on it from there on
reaches, so the distance to the centre bounds the inner products of all of it from
both sides. After the root's children, which all searches compare in one product of
matrices, a search takes the nodes of the highest upper bounds first, a few and then
twice as many in each step, compares their children exactly and goes on with those whose
bounds meet a window that isn't yet full of better ones. Sums are of whole numbers, so scores are exact, and
the result is that of comparing all.

First each anchor's best rows of its own label are sought, without a window; their
scores set the windows for rows of other labels. A task holds one block of
anchors and a few trees, and takes what it has found in one tree to the next.

Cases: rows with a null id, a null label, a null or empty vector, or a component
that is null, not finite or 2**20 or more in absolute value take no part, nor do
vectors of another length than the commonest (the longer of two equally common);
zero vectors do; a repeated vec_id counts once, with its smallest label
and vector; ties go to the smaller vec_id; an anchor without positives, and a
positive without a negative in its window, has no rows; a positive score below 0
has an empty window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import stage


@dataclass(frozen=True)
class Settings:
    scale: int = 256  # components are multiplied by this and rounded down
    positives: int = 5
    negatives: int = 3
    window: tuple[int, int] = (50, 95)  # hundredths of the positive's score
    block_rows: int = 4096  # candidates of a tree
    trees: int = 16  # trees that a task holds at once
    anchors: int = 512  # anchors that a task holds at once
    shrink: float = 1.3  # a level's radius over the next one's
    levels: int = 24


def usable(vectors: DataFrame, label: Column, is_anchor: Column, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, label, whole-numbered vector (array<int>) and is_anchor of the rows that take part."""
    rows = vectors.select(
        vectors[vec_id].cast("long").alias("vec_id"), label.alias("label"), vectors[embedding].cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")
    ).where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("x") > 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 20)))
    )
    whole = F.transform("x", lambda v: F.floor(v * settings.scale).cast("int"))
    rows = rows.select("vec_id", F.struct("label", whole.alias("x"), "is_anchor").alias("row")).groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1)
    return rows.join(F.broadcast(common.select("n")), F.size("x") == F.col("n"), "left_semi")  # one row


class Tree:
    """A cover tree of a block's rows.

    Rows stand in the order in which groups list their children. Group g hangs
    on row ``point[g]``, has the rows ``begin[g]:end[g]`` as children of one level, and
    reaches ``radius[g]`` far with them and all below, and with the point's
    further levels, whose next group is ``then[g]`` (-1: none). ``entry`` names
    each row's first group.
    """

    ARRAYS = {"ids": np.int64, "x": np.float64, "entry": np.int32, "point": np.int32, "begin": np.int32, "end": np.int32, "then": np.int32, "radius": np.float64}

    def __init__(self, **arrays):
        for name, kind in self.ARRAYS.items():
            setattr(self, name, np.frombuffer(arrays[name], kind) if isinstance(arrays[name], bytes) else arrays[name])
        self.x = self.x.reshape(len(self.ids), -1)
        self.reach = float((self.x**2).sum(axis=1).max())
        self.most = float(np.abs(self.x).max())
        # the root and its children of all levels
        root = np.flatnonzero(self.point == 0)
        self.top = int(self.end[root[-1]]) if len(root) else 1

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in self.ARRAYS.items()}

    def products(self, rows: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows with a whole-numbered query, or one a column: in doubles where no sum can leave their 53 bits."""
        if self.most * float(np.abs(query).max()) * len(query) < 2**53:
            return (self.x[rows] @ query).astype(np.int64)
        return self.x[rows].astype(np.int64) @ query.astype(np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, settings: Settings) -> Tree:
        n = len(ids)
        first = np.lexsort((ids,))
        ids, x = ids[first], x[first].astype(np.float64)
        square = (x**2).sum(axis=1)
        extra = np.sqrt(square.max() - square)
        far = lambda c, rows: np.sqrt(np.maximum(square[rows] + square[c] - 2 * (x[rows] * x[c]).sum(axis=-1) + (extra[rows] - extra[c]) ** 2, 0))
        from_all = lambda c: np.sqrt(np.maximum(square + square[c] - 2 * (x @ x[c]) + (extra - extra[c]) ** 2, 0))
        # farthest first: each next centre is the row furthest from all before it
        parent, level = np.zeros(n, np.int64), np.zeros(n, np.int64)
        near, nearest = from_all(0), np.zeros(n, np.int64)
        above = nearest.copy()  # nearest centre of the levels above
        taken = np.zeros(n, bool)
        taken[0] = True
        step, bound = 1, near.max() / settings.shrink
        order = [0]
        while len(order) < n and step < settings.levels:
            c = int(np.argmax(np.where(taken, -1.0, near)))
            if near[c] <= 0:
                break
            if near[c] < bound:  # the level is full
                above = nearest.copy()
                step, bound = step + 1, bound / settings.shrink
                continue
            parent[c], level[c], taken[c] = above[c], step, True
            order.append(c)
            d = from_all(c)
            closer = d < near
            near[closer], nearest[closer] = d[closer], c
        rest = np.flatnonzero(~taken)  # equal to a centre, or of the last level
        parent[rest], level[rest] = nearest[rest], settings.levels
        # groups: one for each row and level at which something hangs on it
        inner = np.setdiff1d(np.arange(n), [0])
        key = parent * (settings.levels + 1) + level
        groups, member = np.unique(key[inner], return_inverse=True)
        point, depth = groups // (settings.levels + 1), groups % (settings.levels + 1)
        radius = np.zeros(len(groups))
        top, below = inner, inner
        group_of = np.full(n, -1)
        group_of[inner] = member
        while len(top):
            g = group_of[top]
            np.maximum.at(radius, g, far(point[g], below))
            top = point[g]
            up = top != 0
            top, below = top[up], below[up]
        then = np.full(len(groups), -1)
        same = np.flatnonzero(point[1:] == point[:-1])
        then[same] = same + 1
        for g in same[::-1].tolist():  # what hangs on later levels is reached from the earlier ones too
            radius[g] = max(radius[g], radius[g + 1])
        radius = radius * (1 + 1e-9) + 1e-6
        entry = np.full(n, -1)
        entry[point[::-1]] = np.arange(len(groups))[::-1]
        # rows in the order of their groups
        rows = np.concatenate([[0], inner[np.argsort(member, kind="stable")]])
        place = np.empty(n, np.int64)
        place[rows] = np.arange(n)
        ends = 1 + np.cumsum(np.bincount(member, minlength=len(groups))) if len(groups) else np.zeros(0, np.int64)
        begin = np.concatenate([[1], ends[:-1]]) if len(groups) else ends
        return cls(ids=ids[rows], x=x[rows], entry=entry[rows].astype(np.int32), point=place[point].astype(np.int32), begin=begin.astype(np.int32), end=ends.astype(np.int32), then=then.astype(np.int32), radius=radius)


class Search:
    """The best rows of one query in each of its windows, over several trees.

    A window takes scores from ``low`` to ``high``, both included.
    """

    def __init__(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, besides: int | None = None):
        self.query, self.low, self.high, self.k, self.besides = query.astype(np.float64), low, high, k, besides
        self.bar = low.astype(np.int64)  # what a score must reach to be of use
        self.best: list[list[tuple[int, int]]] = [[] for _ in low]
        self.seen = 0

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        self.seen += len(ids)
        for w, best in enumerate(self.best):
            good = np.flatnonzero((scores >= self.bar[w]) & (scores <= self.high[w]))
            if self.besides is not None:
                good = good[ids[good] != self.besides]
            if not len(good):
                continue
            if len(good) > self.k:
                least = np.partition(scores[good], len(good) - self.k)[len(good) - self.k]
                good = good[scores[good] >= least]  # equal ones too
                good = good[np.lexsort((ids[good], -scores[good]))[: self.k]]
            best += zip((-scores[good]).tolist(), ids[good].tolist())
            best.sort()
            del best[self.k :]
            if len(best) == self.k:
                self.bar[w] = max(self.bar[w], -best[-1][0])

    def descend(self, tree: Tree, top: np.ndarray) -> None:
        """Look through a tree; ``top`` has the scores of its first ``tree.top`` rows, the root and its children."""
        whole = tree.reach + float(self.query @ self.query)
        slack = 1e-9 * whole + 1e-6

        def bounds(score, radius):
            d = np.sqrt(np.maximum(whole - 2.0 * score, 0))
            return (whole - (d + radius) ** 2) / 2 - slack, (whole - np.maximum(d - radius, 0) ** 2) / 2 + slack

        self.offer(tree.ids[: tree.top], top)
        inner = np.flatnonzero(tree.entry[: tree.top] >= 0)
        inner = inner[inner > 0]
        # nodes that may hold rows of use: groups, their rows' scores and bounds
        groups, at = tree.entry[inner], top[inner]
        waiting = (groups, at, *bounds(at, tree.radius[groups]))
        batch = 4 * self.k
        while len(waiting[0]):
            groups, at, low, high = waiting
            use = ((high[:, None] >= self.bar) & (low[:, None] <= self.high)).any(axis=1)
            order = np.flatnonzero(use)
            order = order[np.argsort(-high[order], kind="stable")]
            now, later = order[:batch], order[batch:]
            batch *= 2
            groups_now, at_now = groups[now], at[now]
            size = tree.end[groups_now] - tree.begin[groups_now]
            rows = np.repeat(tree.begin[groups_now] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            scores = tree.products(rows, self.query)
            self.offer(tree.ids[rows], scores)
            entry, then = tree.entry[rows], tree.then[groups_now]
            groups_new = np.concatenate([entry[entry >= 0], then[then >= 0]])
            at_new = np.concatenate([scores[entry >= 0], at_now[then >= 0]])
            more = (groups_new, at_new, *bounds(at_new, tree.radius[groups_new]))
            waiting = tuple(np.concatenate([old[later], new]) for old, new in zip(waiting, more))


def look_through(tree: Tree, searches: list[Search]) -> None:
    """All searches over one tree; they share one product of matrices with the tree's top."""
    for begin in range(0, len(searches), 256):
        own = searches[begin : begin + 256]
        top = tree.products(slice(0, tree.top), np.stack([s.query for s in own], axis=1))
        for n, search in enumerate(own):
            search.descend(tree, np.ascontiguousarray(top[:, n]))


def trees(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each block of a label's candidates: label, part, parts and the tree's arrays."""
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / settings.block_rows).alias("parts"))
    dealt = rows.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"label {kind}, part long, parts long, " + ", ".join(f"{name} binary" for name in Tree.ARRAYS)

    def build(block: pa.Table) -> pa.Table:
        x = np.array(block.column("x").combine_chunks().flatten()).reshape(len(block), -1)
        tree = Tree.build(block.column("vec_id").to_numpy(), x, settings)
        head = {c: block.column(c).slice(0, 1) for c in ("label", "part", "parts")}
        return pa.table({**head, **{name: pa.array([raw], pa.binary()) for name, raw in tree.packed().items()}})

    return dealt.select("label", "part", "parts", "vec_id", "x").groupBy("label", "part").applyInArrow(build, schema)


def _search(asking: DataFrame, forest: DataFrame, keys: list[str], k: int, same_label: bool) -> DataFrame:
    """Each anchor's best rows in the trees that share its ``keys``: a row for each window and row found."""
    schema = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            dims = len(left.column("x")[0])
            x = np.array(left.column("x").combine_chunks().flatten()).reshape(len(left), dims)
            ids, labels = left.column("vec_id").to_pylist(), left.column("label").to_pylist()
            windows = [left.column(c).to_pylist() for c in ("positive_id", "positive_score", "low", "high")]
            found = [Search(x[i], np.array(windows[2][i]), np.array(windows[3][i]), k, ids[i]) for i in range(len(ids))]
            for row in right.to_pylist():
                tree = Tree(**{name: row[name] for name in Tree.ARRAYS})
                look_through(tree, [search for label, search in zip(labels, found) if (label == row["label"]) == same_label])
            for i, search in enumerate(found):
                for p, s, best in zip(windows[0][i], windows[1][i], search.best):
                    out += [(ids[i], p, s, v, -score) for score, v in best]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("anchor_id", "positive_id", "positive_score", "vec_id", "score"), columns)})

    return asking.groupBy(*keys).cogroup(forest.groupBy(*keys)).applyInArrow(meet, schema)


def mine(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` as from ``usable``."""
    rows = stage(rows, "vectors")
    anchors, total = rows.agg(F.count_if("is_anchor"), F.count("*")).first()
    asked = max(1, math.ceil(anchors / settings.anchors))
    forest = stage(trees(rows, settings), "trees")
    asking = rows.where("is_anchor").select("vec_id", "label", "x", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asked)).alias("asked"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long")))

    # the best of the same label, over all its blocks
    group = F.pmod("part", F.ceil(F.col("parts") / settings.trees))
    own = forest.withColumn("group", group).withColumn("asked", every)
    groups = own.select(F.col("label").alias("label"), F.col("group").alias("group")).distinct()
    bare = asking.withColumn("positive_id", F.array(F.lit(-1).cast("long"))).withColumn("positive_score", F.array(F.lit(0).cast("long")))
    open_ = bare.withColumn("low", F.array(F.lit(-(1 << 62)))).withColumn("high", F.array(F.lit(1 << 62)))
    near = _search(open_.join(groups, "label"), own, ["label", "group", "asked"], settings.positives, True)
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    positives = near.withColumn("rank", first).where(F.col("rank") <= settings.positives)
    # five at most; the window in whole numbers: low * 100 >= 50 * score, high * 100 <= 95 * score
    low, high = settings.window
    hundredth = lambda part, up: F.floor((F.col("score").cast("decimal(20,0)") * part + (99 if up else 0)) / 100).cast("long")
    windows = positives.select("anchor_id", F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), hundredth(low, True).alias("low"), hundredth(high, False).alias("high")).alias("w"))
    windows = windows.where("w.low <= w.high").groupBy("anchor_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    names = ("positive_id", "positive_score", "low", "high")
    windowed = stage(asking.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "x", "asked", *[F.col(f"w.{c}").alias(c) for c in names]), "windows")

    # trees of all labels, dealt evenly
    deals = max(1, math.ceil(total / (settings.block_rows * settings.trees)))
    every_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long")))
    others = forest.withColumn("group", F.pmod(F.xxhash64("label", "part"), F.lit(deals))).withColumn("asked", every)
    hard = _search(windowed.withColumn("group", every_group), others, ["group", "asked"], settings.negatives, False)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    best = hard.withColumn("rank", rank).where(F.col("rank") <= settings.negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
