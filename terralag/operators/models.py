"""Regression models on Spark ML, addressed by name with the parameters the scripts tune.

Parameters without a Spark counterpart are mapped to the nearest one or dropped with a warning:
depth is held to Spark's limit of 30, ``num_leaves`` becomes a depth, ``min_samples_split`` half as
many rows per node, ``gamma`` a minimum gain, ``min_child_weight`` rows per node; leaf penalties on
boosted trees (``reg_alpha``, ``reg_lambda``) have none.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    FMRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, functions as F

from terralag.operators.boosting import DeepTree, PackedBoosting
from terralag.operators.predictors import moment_regression
from terralag.operators.steps import SCALERS, Assembler, Bagging, MedianImputer, Penalised, step_name

MAX_DEPTH = 30
SEED = 42
BOOSTING_BINS = 255  # split candidates per feature of the boosters that are stood in for


def _depth(value, default: int = MAX_DEPTH) -> int:
    """Without a limit trees grow to Spark's own."""
    if value is None:
        if default == MAX_DEPTH:
            warnings.warn(f"unlimited depth held to {MAX_DEPTH}", stacklevel=3)
        return default
    if value > MAX_DEPTH:
        warnings.warn(f"depth {value} held to {MAX_DEPTH}", stacklevel=3)
    return min(int(value), MAX_DEPTH)


def _subset(value) -> str:
    """``max_features`` / ``colsample`` to a feature subset strategy."""
    if value in (None, 1, 1.0):
        return "all"
    return value if isinstance(value, str) else str(float(value))


def _unused(params: dict) -> None:
    for name in params:
        warnings.warn(f"{name} has no Spark ML counterpart and is ignored", stacklevel=3)


def forest(
    n_estimators=100, max_depth=None, min_samples_split=2, min_samples_leaf=1, max_features=None, max_samples=1.0, **other
) -> RandomForestRegressor:
    _unused(other)
    return RandomForestRegressor(
        numTrees=n_estimators,
        maxDepth=_depth(max_depth),
        minInstancesPerNode=max(min_samples_leaf, min_samples_split // 2, 1),
        featureSubsetStrategy=_subset(max_features),
        subsamplingRate=max_samples,
        seed=SEED,
    )


def extra_trees(n_estimators=100, max_depth=None, max_features=1 / 3, **other) -> RandomForestRegressor:
    """Spark has no random split thresholds; a smaller feature subset keeps the trees different."""
    return forest(n_estimators, max_depth, max_features=max_features, **other)


def bagging(n_estimators=10, max_samples=1.0, max_features=1.0, max_depth=None, **other) -> Bagging:
    _unused(other)
    return Bagging(n_estimators, max_samples, max_features, _depth(max_depth), SEED)


def boosting(
    n_estimators=None,
    max_iter=None,
    max_depth=None,
    learning_rate=0.1,
    subsample=1.0,
    colsample_bytree=None,
    num_leaves=None,
    gamma=0.0,
    min_child_weight=1,
    min_samples_split=2,
    **other,
) -> GBTRegressor:
    _unused(other)
    if num_leaves and max_depth is None:
        max_depth = math.ceil(math.log2(num_leaves))
    return GBTRegressor(
        maxIter=n_estimators or max_iter or 100,
        maxDepth=_depth(max_depth, 5),
        stepSize=learning_rate,
        subsamplingRate=subsample,
        featureSubsetStrategy=_subset(colsample_bytree),
        maxBins=BOOSTING_BINS,
        minInfoGain=float(gamma),
        minInstancesPerNode=max(int(min_child_weight), min_samples_split // 2, 1),
        seed=SEED,
    )


class MeanModel:
    def __init__(self, value: float | None):
        self.value = value

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value).cast("double"))


class MeanBaseline:
    """Predicts the training mean."""

    def __init__(self, label: str):
        self.label = label

    def fit(self, df: DataFrame) -> MeanModel:
        return MeanModel(df.agg(F.avg(self.label)).first()[0])


MODELS: dict[str, Callable[..., Estimator]] = {
    "extra_trees": extra_trees,
    "random_forest": forest,
    "bagging": bagging,
    "hist_gradient_boosting": boosting,
    "gradient_boosting": boosting,
    "lightgbm": boosting,
    "xgboost": boosting,
    "linear": lambda **p: LinearRegression(**p),
    "ridge": lambda alpha=1.0, **p: Penalised(alpha, None, **p),
    "lasso": lambda alpha=1.0, **p: Penalised(alpha, 1.0, **p),
    "elastic_net": lambda alpha=1.0, l1_ratio=0.5, **p: Penalised(alpha, l1_ratio, **p),
    "glm": lambda **p: GeneralizedLinearRegression(family="gaussian", link="identity", **p),
    "decision_tree": lambda max_depth=None, **p: DeepTree(DecisionTreeRegressor(maxDepth=_depth(max_depth), seed=SEED, **p)),
    "factorization": lambda **p: FMRegressor(seed=SEED, **p),
    "huber": moment_regression("huber"),
    "quantile": moment_regression("quantile"),
    "ransac": moment_regression("consensus"),
    "lasso_lars_ic": moment_regression("lasso_path"),
    "kernel_ridge": moment_regression("kernel"),
}

def make_pipeline(
    model: str,
    features: Sequence[str],
    label: str,
    scaler: str | None = None,
    degree: int = 1,
    select: tuple | None = None,
    packed: bool = False,
    imputer=None,
    **params,
):
    """Fill gaps with training medians, optionally scale, select and expand, then fit ``model``.

    Every row that is transformed gets a prediction. ``scaler=None`` passes through; for ``select`` see
    :class:`terralag.operators.steps.Assembler`. ``packed`` grows a booster's trees in one task, see
    :mod:`terralag.operators.boosting`; ``imputer`` are medians that were found before for the same rows.
    """
    if model == "mean":
        return MeanBaseline(label)
    columns = [step_name(c) for c in features]
    stages = [imputer or MedianImputer(features)]
    if scaler:
        stages.append(SCALERS[scaler](columns))
    stages.append(Assembler(columns, label, "_raw", select))
    column = "_raw"
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol=column, outputCol="_poly"))
        column = "_poly"
    estimator = MODELS[model](**params)
    stages.append((PackedBoosting(estimator) if packed else estimator).setFeaturesCol(column).setLabelCol(label))
    return Pipeline(stages=stages)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
