"""Churn classifiers: linear, forest and boosted trees, tuning, stacking, selection."""

from __future__ import annotations

import itertools
import math
import random
import time
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.learning.explain import tree_nodes
from ebbtide.learning.forest import GrownForest, grow
from ebbtide.learning.matrix import balance, class_weights, column_strategy, side_by_side, tree_depth
from ebbtide.learning.newton import Fitted, fit_newton
from ebbtide.operators.metrics import classification_metrics, roc_auc
from ebbtide.operators.ordering import hash_rank
from ebbtide.session import stage, staging_dir

SEED = 42

# Fixed value: rounds without a better AUC after which boosting stops.
PATIENCE = 30
# Rounds of a trial's first fit; twice as many follow until it stops.
FIRST_ROUNDS = 64
# A finished trial in a search's ledger; the format is part of the folder's name.
CURVE = "model string, params string, round int, auc double"
LEDGER_FORMAT = 1

# The forest grid; None stands for unlimited depth.
FOREST_GRID = {"trees": (100, 300), "depth": (5, 10, None), "min_leaf": (1, 5, 20)}
DEEPEST = 30

# Search ranges of the two boosted learners.
BOOST_RANGES = {
    "rounds": (200, 1000),
    "depth": (3, 8),
    "rate": (0.01, 0.3),
    "row_share": (0.6, 1.0),
    "column_share": (0.6, 1.0),
    "min_leaf": (1, 10),
}
LEAFWISE_RANGES = {
    "rounds": (200, 1000),
    "leaves": (20, 150),
    "rate": (0.01, 0.3),
    "row_share": (0.5, 1.0),
    "column_share": (0.5, 1.0),
    "min_leaf": (10, 100),
}


@dataclass(frozen=True)
class Spec:
    """What to fit: ``kind`` is linear, forest or boosted."""

    name: str
    kind: str
    params: Mapping = field(default_factory=dict)
    balanced: bool = True


def _estimators(spec: Spec, features: str) -> list:
    p = dict(spec.params)
    common = {"labelCol": "is_churn", "predictionCol": "predicted"}
    if spec.balanced:
        common["weightCol"] = "_weight"
    if spec.kind == "forest":
        return [
            RandomForestClassifier(
                featuresCol=features,
                numTrees=p["trees"],
                maxDepth=DEEPEST if p["depth"] is None else p["depth"],
                minInstancesPerNode=p["min_leaf"],
                seed=SEED,
                **common,
            )
        ]
    return [
        GBTClassifier(
            featuresCol=features,
            maxIter=p["rounds"],
            maxDepth=tree_depth(p),
            stepSize=p["rate"],
            subsamplingRate=p.get("row_share", 1.0),
            featureSubsetStrategy=column_strategy(p),
            minInstancesPerNode=p.get("min_leaf", 1),
            seed=SEED,
            **common,
        )
    ]


class LinearModel:
    """A logistic fit by Newton steps, used like a fitted pipeline of a scaler and a learner.

    The scaler is Spark's; coefficients belong to the scaled features.
    """

    def __init__(self, scaler, fitted: Fitted, features: str):
        self.stages = [scaler, self]
        self.fitted, self.features = fitted, features
        self.intercept, self.coefficients = fitted.steps[-1][0], DenseVector(fitted.steps[-1][1:])

    def probability(self) -> Column:
        x = vector_to_array(self.features)
        return self.fitted.probability({n: x[i] for i, n in enumerate(self.fitted.names)})

    def scored(self, df: DataFrame, columns: Sequence) -> DataFrame:
        """``columns`` of every row and its ``probability`` of class 1."""
        return df.select(*columns, self.probability().alias("probability"))


def fit_linear(train: DataFrame, spec: Spec, features: str = "features") -> LinearModel:
    """Inverse penalty C on the sum of weighted losses; about ten passes over plain columns, written once."""
    x = vector_to_array(features)
    names = [f"x{i}" for i in range(train.select(F.size(x)).first()[0])]
    weight = F.col("_weight") if spec.balanced else F.lit(1.0)
    rows = stage(train.select("is_churn", weight.alias("_weight"), *[x[i].alias(n) for i, n in enumerate(names)]), "linear-rows")
    fitted = fit_newton(rows, names, weight="_weight", penalty=1.0 / spec.params.get("c", 1.0), max_steps=spec.params.get("max_iter", 50))
    scaler = StandardScaler(inputCol=features, outputCol="scaled", withMean=True, withStd=True).fit(train)
    return LinearModel(scaler, fitted, features)


def unlimited(spec: Spec) -> bool:
    """Whether the leaves of a model's trees grow with the rows."""
    return spec.kind == "forest" and spec.params["depth"] is None


def grown_forests(train: DataFrame, specs: Sequence[Spec], features: str = "features") -> list[GrownForest]:
    """Forests of unlimited depth, grown in common passes; of two that differ in their number of trees one holds the other."""
    found: dict[int, GrownForest] = {}
    for balanced, bootstrap in sorted({(s.balanced, s.params["trees"] > 1) for s in specs}):
        own = [i for i, s in enumerate(specs) if (s.balanced, s.params["trees"] > 1) == (balanced, bootstrap)]
        trees = sorted({(n, specs[i].params["min_leaf"]) for i in own for n in range(specs[i].params["trees"])})
        made = grow(train, trees, features, balance(train) if balanced else (1.0, 1.0), SEED, bootstrap)
        for i in own:
            p = specs[i].params
            found[i] = GrownForest(made, [t for t, (n, least) in enumerate(trees) if least == p["min_leaf"] and n < p["trees"]])
    return [found[i] for i in range(len(specs))]


def fit_classifier(train: DataFrame, spec: Spec, features: str = "features") -> PipelineModel | GrownForest | LinearModel:
    """Fit on the given rows; balanced weights are worked out on the same rows."""
    if unlimited(spec):
        return grown_forests(train, [spec], features)[0]
    weighted = train.withColumn("_weight", class_weights(train)) if spec.balanced else train
    if spec.kind == "linear":
        return fit_linear(weighted, spec, features)
    return Pipeline(stages=_estimators(spec, features)).fit(weighted)


def staged_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(is_churn, round, churn_prob): the score of every row after each round of a boosted model.

    Spark names the leaf of every tree a row falls into; leaf outputs are joined
    and summed along the rounds. Rows are dealt out before they are unfolded to
    rounds, so the running sum needs no shuffle of the unfolded rows. Scores
    carry 12 decimals: leaves of equal output differ in their last digits, and
    these would otherwise rank rows that the model holds equal.
    """
    learner = model.stages[-1].copy().setLeafCol("_leaf")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in learner.treeWeights]), F.col("tree") + 1)
    # leaves are counted from left to right, which is the order of node ids
    place = F.row_number().over(W.partitionBy("tree").orderBy("node")) - 1
    outputs = stage(
        tree_nodes(df.sparkSession, learner).filter("left < 0").select("tree", place.alias("leaf"), (F.col("prediction") * weight).alias("output")),
        "leaf-outputs",
    )
    fallen = learner.transform(df).select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("is_churn").cast("int").alias("is_churn"),
        F.transform(vector_to_array("_leaf"), lambda x: x.cast("int")).alias("_leaves"),
    )
    unfolded = stage(fallen, "fallen").repartition("_row").select("_row", "is_churn", F.posexplode("_leaves").alias("tree", "leaf"))
    along = W.partitionBy("_row").orderBy("tree").rowsBetween(W.unboundedPreceding, 0)
    # a boosted model's raw score is half the log-odds
    score = 1 - 1 / (1 + F.exp(2 * F.sum("output").over(along)))
    return unfolded.join(outputs, ["tree", "leaf"]).select(
        "is_churn", (F.col("tree") + 1).alias("round"), F.round(score, 12).alias("churn_prob")
    )


def staged_aucs(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(round, auc) after each round of a boosted model, in one pass over the rows."""
    return roc_auc(staged_scores(model, df), "is_churn", "churn_prob", ["round"])


def stopped_rounds(curves: DataFrame, by: Sequence[str], patience: int = PATIENCE) -> DataFrame:
    """(by, auc, stopped_round): the best round before ``patience`` rounds in a row bring nothing better.

    Where no AUC is known (one class only) nothing stops and every round is kept.
    """
    order = W.partitionBy(*by).orderBy("round")
    so_far, earlier = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    best = F.max("auc").over(earlier)
    judged = curves.withColumn("_better", F.col("auc").isNotNull() & (best.isNull() | (F.col("auc") > best)))
    judged = judged.withColumn("_since", F.col("round") - F.max(F.when(F.col("_better"), F.col("round"))).over(so_far))
    reached = F.coalesce(F.max(F.coalesce(F.col("_since"), F.lit(0))).over(earlier), F.lit(0)) < patience
    judged = judged.withColumn("_reached", reached)
    return judged.groupBy(*by).agg(
        F.max(F.when(F.col("_reached"), F.col("auc"))).alias("auc"),
        F.coalesce(F.max(F.when(F.col("_reached") & F.col("_better"), F.col("round"))), F.max("round")).alias("stopped_round"),
    )


def has_stopped(aucs: Sequence[float | None], patience: int = PATIENCE) -> bool:
    """Whether ``stopped_rounds`` stops within the given rounds, so that later ones play no part."""
    best, at = None, None
    for i, auc in enumerate(aucs):
        if auc is not None and (best is None or auc > best):
            best, at = auc, i
        elif at is not None and i - at >= patience:
            return True
    return False


def churn_scores(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """(msno, is_churn, split, model, churn_prob)."""
    if hasattr(model, "scored"):
        scored = model.scored(df, ["msno", F.col("is_churn").cast("int").alias("is_churn"), "split"])
        return scored.select("msno", "is_churn", "split", F.lit(name).alias("model"), F.col("probability").alias("churn_prob"))
    scored = model.transform(df)
    return scored.select(
        "msno",
        F.col("is_churn").cast("int").alias("is_churn"),
        "split",
        F.lit(name).alias("model"),
        vector_to_array("probability")[1].alias("churn_prob"),
    )


def evaluate(scored: DataFrame, by: Sequence[str] = ("model",), threshold: float = 0.5) -> DataFrame:
    auc = roc_auc(scored, "is_churn", "churn_prob", by)
    return auc.join(classification_metrics(scored, "is_churn", "churn_prob", threshold, by), list(by))


def _aucs(scores: Sequence[DataFrame]) -> list[float]:
    """AUC of each model on the same rows, in one job over all their scores; models are named 0, 1, ..."""
    scored = reduce(lambda a, b: a.unionByName(b), scores)
    found = {r["model"]: r["auc"] for r in roc_auc(scored, "is_churn", "churn_prob", ["model"]).collect()}
    return [float("nan") if found.get(str(i)) is None else found[str(i)] for i in range(len(scores))]


def coefficient_table(spark: SparkSession, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    weights = model.stages[-1].coefficients.toArray()
    return spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, coefficient double")


def top_coefficients(coefficients: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest and ``k`` smallest coefficients, a feature listed once."""
    high = coefficients.orderBy(F.col("coefficient").desc(), "feature").limit(k)
    low = coefficients.orderBy("coefficient", "feature").limit(k)
    return high.unionByName(low).dropDuplicates(["feature"])


def largest_coefficients(coefficients: DataFrame, k: int = 10) -> DataFrame:
    return coefficients.orderBy(F.abs("coefficient").desc(), "feature").limit(k)


def importance_table(spark: SparkSession, model: PipelineModel, names: Sequence[str], k: int = 15) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(k)


def forest_grid(train: DataFrame, val: DataFrame, grid: Mapping[str, Sequence] = FOREST_GRID) -> tuple[DataFrame, Spec]:
    """AUC on the fixed validation split for every grid point, and the best point."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]

    def scored(i: int, p: dict) -> DataFrame:
        # written at once, so that no forest is kept once it has been scored
        return stage(churn_scores(fit_classifier(train, Spec("forest", "forest", p)), val, str(i)), "grid-scores")

    specs = [Spec("forest", "forest", p) for p in points]
    deep = [i for i, s in enumerate(specs) if unlimited(s)]
    limited = [i for i in range(len(points)) if i not in deep]
    found = dict(zip(limited, side_by_side([lambda i=i: scored(i, points[i]) for i in limited])))
    grown = zip(deep, grown_forests(train, [specs[i] for i in deep]))
    found |= dict(zip(deep, side_by_side([lambda i=i, m=m: stage(churn_scores(m, val, str(i)), "grid-scores") for i, m in grown])))
    aucs = _aucs([found[i] for i in range(len(points))])
    rows = [(i, p["trees"], p["depth"] or DEEPEST, p["min_leaf"], a) for i, (p, a) in enumerate(zip(points, aucs))]
    table = train.sparkSession.createDataFrame(rows, "point int, trees int, depth int, min_leaf int, auc double")
    best = max(range(len(points)), key=lambda i: (aucs[i], -i))
    return table, Spec("Random Forest", "forest", points[best])


def draw(ranges: Mapping[str, Sequence], rng: random.Random) -> dict:
    """One random point: whole numbers evenly, shares evenly, the learning rate on a log scale."""
    point = {}
    for name, (low, high) in ranges.items():
        if name == "rate":
            point[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        elif isinstance(low, int):
            point[name] = rng.randint(low, high)
        else:
            point[name] = rng.uniform(low, high)
    return point


def fingerprint(*tables: DataFrame) -> str:
    """Tells matrices with other rows, labels or features apart, in whatever order rows come."""
    row = F.xxhash64("msno", "is_churn", "features")
    sums = [t.agg(F.count(F.lit(1)), F.sum(F.pmod(row, F.lit(2**31))), F.bit_xor(row)).first() for t in tables]
    return f"{zlib.crc32(repr([tuple(r) for r in sums]).encode()):08x}"


def search_ledger(train: DataFrame, val: DataFrame, ranges: Mapping[str, Sequence], seed: int, name: str) -> str:
    """The folder of a search's finished trials: one for the same rows, ranges, seed and name."""
    search = f"{LEDGER_FORMAT} {name} {seed} {sorted(ranges.items())} {fingerprint(train, val)}"
    return f"{staging_dir(train.sparkSession).rstrip('/')}/ebbtide/search-{zlib.crc32(search.encode()):08x}"


def tune(
    train: DataFrame,
    val: DataFrame,
    ranges: Mapping[str, Sequence],
    trials: int = 50,
    seed: int = SEED,
    name: str = "boosted",
    ledger: str | None = None,
    patience: int = PATIENCE,
) -> tuple[DataFrame, Spec]:
    """Seeded random search scored by AUC on the fixed validation split.

    A trial is fitted on train alone; its AUC after every round tells where it stops.
    The first rounds of a long fit are those of a shorter one, so a trial is fitted with
    few rounds and then with twice as many until it stops or has its most rounds: the
    same stopped round for less than four times the rounds it takes. That curve is written to the ``ledger`` (a shared
    folder; default: one that belongs to these rows and ranges) and the model is
    let go. A search that broke off goes on with the trials that have no curve
    there that reaches their stop; more trials can be added to a finished one.

    Returns the trials with their stopped round and the best AUC so far, and the
    best point with the stopped round as its ``rounds`` (``most_rounds``: as drawn).
    """
    spark = train.sparkSession
    ledger = ledger or search_ledger(train, val, ranges, seed, name)
    rng = random.Random(seed)
    points = [draw(ranges, rng) for _ in range(trials)]
    described = [str(sorted(p.items())) for p in points]

    def curves() -> DataFrame:
        return spark.read.schema(f"{CURVE}, trial int").parquet(ledger)

    def run(i: int) -> None:
        most = points[i]["rounds"]
        rounds = min(FIRST_ROUNDS, most)
        while True:
            model = fit_classifier(train, Spec(name, "boosted", {**points[i], "rounds": rounds}))
            curve = stage(staged_aucs(model, val), "curve")
            if rounds == most or has_stopped([r["auc"] for r in curve.orderBy("round").collect()], patience):
                break
            rounds = min(2 * rounds, most)
        curve = curve.select(F.lit(name).alias("model"), F.lit(described[i]).alias("params"), "round", "auc")
        # one file, so a trial is there as a whole or not at all
        curve.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/trial={i}")

    spark.createDataFrame([], f"{CURVE}, trial int").write.mode("ignore").partitionBy("trial").parquet(ledger)
    there: dict[tuple[int, str], list] = {}
    for r in curves().select("trial", "params", "round", "auc").orderBy("trial", "round").collect():
        there.setdefault((r["trial"], r["params"]), []).append(r["auc"])
    # a shorter patience may have left a curve that this one doesn't stop in
    done = {i for i in range(trials) if (aucs := there.get((i, described[i]))) and (len(aucs) == points[i]["rounds"] or has_stopped(aucs, patience))}
    missing = [i for i in range(trials) if i not in done]
    if missing:
        side_by_side([lambda i=i: run(i) for i in missing])
    kept = curves().filter(F.col("trial") < trials)
    so_far = W.partitionBy("model").orderBy("trial").rowsBetween(W.unboundedPreceding, 0)
    table = stage(
        stopped_rounds(kept, ["trial", "model", "params"], patience).withColumn("best_so_far", F.max("auc").over(so_far)), "trials"
    )
    best = table.orderBy(F.col("auc").desc_nulls_last(), "trial").first()
    point = points[best["trial"]]
    return table, Spec(name, "boosted", {**point, "rounds": best["stopped_round"], "most_rounds": point["rounds"]})


def two_step(train: DataFrame, val: DataFrame, test: DataFrame, spec: Spec) -> tuple[DataFrame, PipelineModel, PipelineModel, float]:
    """Fit on train to judge on val, then on train and val together to judge on test.

    Returns the scores of both steps, both models and the seconds of the first fit.
    """

    def timed(rows: DataFrame) -> tuple[PipelineModel, float]:
        start = time.monotonic()
        return fit_classifier(rows, spec), time.monotonic() - start

    (first, seconds), (final, _) = side_by_side([lambda: timed(train), lambda: timed(train.unionByName(val))])
    scores = churn_scores(first, val, spec.name).unionByName(churn_scores(final, test, spec.name))
    return scores, first, final, seconds


def assign_folds(df: DataFrame, folds: int = 5, seed: int = SEED, label: str = "is_churn", key: str = "msno") -> DataFrame:
    """Add ``fold`` 0..folds-1: each class is dealt out evenly in seeded random order."""
    ranked = hash_rank(df, key, seed, [label])
    return ranked.withColumn("fold", ((F.col("hash_rank") - 1) % folds).cast("int")).drop("hash_rank")


def out_of_fold(folded: DataFrame, specs: Sequence[Spec], folds: int = 5) -> DataFrame:
    """Scores of every train row from models that never saw its fold; weights are set per fold."""

    def run(fold: int, spec: Spec) -> DataFrame:
        model = fit_classifier(folded.filter(F.col("fold") != fold), spec)
        held = folded.filter(F.col("fold") == fold)
        return churn_scores(model, held, spec.name).withColumn("fold", F.lit(fold))

    parts = side_by_side([lambda f=f, s=s: run(f, s) for f in range(folds) for s in specs])
    return reduce(lambda a, b: a.unionByName(b), parts)


def meta_features(scores: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """One row per subscriber with one score column per base model."""
    columns = [f"p{i}" for i in range(len(specs))]
    wide = scores.groupBy("msno", "is_churn", "split").agg(
        *[F.max(F.when(F.col("model") == s.name, F.col("churn_prob"))).alias(c) for s, c in zip(specs, columns)]
    )
    typed = wide.withColumn("is_churn", F.col("is_churn").cast("double"))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(typed)


def fit_meta(oof_meta: DataFrame, val_meta: DataFrame, boosted_rounds: int = 100) -> tuple[str, PipelineModel, DataFrame]:
    """Linear and boosted meta learners on out-of-fold scores; the better AUC on val is kept."""
    linear = LogisticRegression(
        featuresCol="features", labelCol="is_churn", regParam=1.0 / oof_meta.count(), standardization=False, maxIter=500
    )
    boosted = Spec("boosted", "boosted", {"rounds": boosted_rounds, "depth": 3, "rate": 0.05}, balanced=False)
    models = side_by_side(
        [lambda: Pipeline(stages=[linear]).fit(oof_meta), lambda: fit_classifier(oof_meta, boosted)]
    )
    aucs = _aucs([churn_scores(m, val_meta, str(i)) for i, m in enumerate(models)])
    table = oof_meta.sparkSession.createDataFrame(
        [("linear", aucs[0]), ("boosted", aucs[1])], "meta_learner string, auc double"
    )
    pick = 1 if aucs[1] > aucs[0] else 0
    return ("linear", "boosted")[pick], models[pick], table


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
