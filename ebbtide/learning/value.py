"""Value regressors: ridge, forest and two boosted configurations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.learning.matrix import column_strategy, side_by_side, tree_depth
from ebbtide.operators.metrics import regression_metrics

SEED = 42
# Ridge penalties tried, forest settings.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
FOREST = {"trees": 300, "depth": 10, "min_leaf": 5}


def fit_ridges(train: DataFrame, alphas: Sequence[float]) -> list[PipelineModel]:
    """For each penalty ``alpha`` on the sum of squares a model, solved from one pass of cross products.

    Spark averages the loss and this solver scales the label by its population
    deviation, so the same optimum needs alpha · deviation / n. What doesn't
    depend on the penalty is worked out once.
    """
    n, deviation = train.agg(F.count(F.lit(1)), F.stddev_pop("clv")).first()
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    scaled = scaler.transform(train).select("scaled", "clv")

    def fit(alpha: float) -> PipelineModel:
        learner = LinearRegression(
            featuresCol="scaled", labelCol="clv", predictionCol="predicted_clv", elasticNetParam=0.0,
            regParam=alpha * (deviation or 1.0) / n, standardization=False, solver="normal",
        )
        return PipelineModel(stages=[scaler, learner.fit(scaled)])

    return side_by_side([lambda a=a: fit(a) for a in alphas])


def fit_ridge(train: DataFrame, alpha: float) -> PipelineModel:
    return fit_ridges(train, [alpha])[0]


def fit_forest(train: DataFrame, trees: int, depth: int, min_leaf: int) -> PipelineModel:
    return Pipeline(
        stages=[
            RandomForestRegressor(
                featuresCol="features", labelCol="clv", predictionCol="predicted_clv", numTrees=trees, maxDepth=depth,
                minInstancesPerNode=min_leaf, seed=SEED,
            )
        ]
    ).fit(train)


def fit_boosted(train: DataFrame, params: Mapping) -> PipelineModel:
    """Boosted regressor from classifier settings; what only concerns classes is left out."""
    return Pipeline(
        stages=[
            GBTRegressor(
                featuresCol="features", labelCol="clv", predictionCol="predicted_clv", maxIter=params["rounds"],
                maxDepth=tree_depth(params), stepSize=params["rate"], subsamplingRate=params.get("row_share", 1.0),
                featureSubsetStrategy=column_strategy(params), minInstancesPerNode=params.get("min_leaf", 1), seed=SEED,
            )
        ]
    ).fit(train)


def predictions(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """(msno, split, model, actual_clv, predicted_clv); actual is NULL where no value is known."""
    scored = model.transform(df)
    actual = F.col("clv") if "clv" in df.columns else F.lit(None).cast("double")
    return scored.select("msno", "split", F.lit(name).alias("model"), actual.alias("actual_clv"), "predicted_clv")


def ridge_alpha_sweep(train: DataFrame, val: DataFrame, alphas: Sequence[float] = ALPHAS) -> tuple[DataFrame, float, PipelineModel]:
    """Validation errors per penalty, the best penalty and its model."""
    models = fit_ridges(train, alphas)
    scored = reduce(
        lambda a, b: a.unionByName(b),
        [predictions(m, val, str(a)).withColumn("alpha", F.lit(float(a))) for a, m in zip(alphas, models)],
    )
    table = regression_metrics(scored, "actual_clv", "predicted_clv", ["alpha"])
    best = table.orderBy("rmse", "alpha").first()["alpha"]
    return table, best, models[list(map(float, alphas)).index(best)]


def compare(scored: DataFrame) -> DataFrame:
    """RMSE, MAE and R² per model and split."""
    return regression_metrics(scored, "actual_clv", "predicted_clv", ["model", "split"])


def best_model(comparison: DataFrame, split: str = "val") -> str:
    """Name of the model with the smallest error on one split."""
    return comparison.filter(F.col("split") == split).orderBy("rmse", "model").first()["model"]
