"""Pipeline steps that are fitted on one table and applied to another.

A fitted step of scalars is an ``SQLTransformer``; the others are transformers with parameters
(:mod:`terralag.operators.predictors`). Either runs in the JVM and is saved with its pipeline.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from terralag.operators import scaling
from terralag.operators.boosting import DeepTree
from terralag.operators.predictors import QuantileModel
from terralag.operators.quantiles import exact_quantiles
from terralag.schemas import finite


MEMBERS_AT_ONCE = 4  # trees of a bag that are grown side by side


def _number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def step_name(column: str) -> str:
    """The working column of a feature; the feature itself is never changed."""
    return f"_f_{column}"


class MedianImputer(Estimator):
    """Exact medians for missing and non-finite features; a feature without any value becomes 0."""

    def __init__(self, features: Sequence[str]):
        super().__init__()
        self.features = list(features)

    def _fit(self, df: DataFrame) -> Transformer:
        medians = exact_quantiles(df, {c: finite(F.col(c)) for c in self.features}, [0.5])
        terms = []
        for c in self.features:
            x = f"CAST(`{c}` AS DOUBLE)"
            known = f"CASE WHEN abs({x}) < CAST('Infinity' AS DOUBLE) THEN {x} END"
            terms.append(f"coalesce({known}, {_number(medians[c][0] or 0.0)}) AS `{step_name(c)}`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


class AffineScaler(Estimator):
    """``fit`` gives (shift, scale) per column, see :mod:`terralag.operators.scaling`."""

    def __init__(self, columns: Sequence[str], fit: Callable):
        super().__init__()
        self.columns, self.rule = list(columns), fit

    def _fit(self, df: DataFrame) -> Transformer:
        params = self.rule(df, self.columns)
        terms = [f"(`{c}` - {_number(a)}) / {_number(b or 1.0)} AS `{c}`" for c, (a, b) in params.items() if a is not None]
        if not terms:
            return SQLTransformer(statement="SELECT * FROM __THIS__")
        drop = ", ".join(f"`{c}`" for c, (a, _) in params.items() if a is not None)
        return SQLTransformer(statement=f"SELECT * EXCEPT ({drop}), {', '.join(terms)} FROM __THIS__")


class QuantileScaler(Estimator):
    def __init__(self, columns: Sequence[str], n: int = 100, output: str = "normal"):
        super().__init__()
        self.columns, self.n, self.output = list(columns), n, output

    def _fit(self, df: DataFrame) -> Transformer:
        return QuantileModel(points=json.dumps(scaling.fit_quantiles(df, self.columns, self.n)), output=self.output)


SCALERS: dict[str, Callable[[Sequence[str]], Estimator]] = {
    "standard": lambda columns: AffineScaler(columns, scaling.fit_standard),
    "minmax": lambda columns: AffineScaler(columns, scaling.fit_minmax),
    "robust": lambda columns: AffineScaler(columns, scaling.fit_robust),
    "quantile": QuantileScaler,
}


class Assembler(Estimator):
    """The feature vector of the columns that a selection keeps.

    ``select`` is None, ``("variance", threshold)``, ``("k_best", k)`` or ``("importance", factor)``; the
    last keeps columns with at least ``factor`` times the mean importance in a small forest. A selection
    that would keep nothing keeps the first column of its ranking.
    """

    def __init__(self, columns: Sequence[str], label: str, output: str, select: tuple | None = None):
        super().__init__()
        self.columns, self.label, self.output, self.select = list(columns), label, output, select

    def _keep(self, df: DataFrame) -> list[str]:
        kind, value = self.select
        if kind == "variance":
            kept = scaling.variance_threshold(df, self.columns, value)
        elif kind == "k_best":
            kept = [r["column"] for r in scaling.select_k_best(df, self.columns, self.label, value).collect()]
        elif kind == "importance":
            vector = VectorAssembler(inputCols=self.columns, outputCol="_v")
            forest = RandomForestRegressor(featuresCol="_v", labelCol=self.label, numTrees=20, maxDepth=8, seed=42)
            weight = forest.fit(vector.transform(df.select(*self.columns, self.label))).featureImportances.toArray()
            kept = [c for c, w in zip(self.columns, weight) if w >= value * weight.mean()]
        else:
            raise ValueError(f"unknown selection {kind}")
        return [c for c in self.columns if c in kept] or self.columns[:1]

    def _fit(self, df: DataFrame) -> Transformer:
        return VectorAssembler(inputCols=self._keep(df) if self.select else self.columns, outputCol=self.output)


class Penalised(Estimator):
    """Linear regression with the penalties of the usual objectives.

    Ridge (``l1_ratio`` None) adds ``alpha * |w|^2`` to the sum of squared errors; the elastic net adds
    ``alpha * (l1_ratio * |w|_1 + (1 - l1_ratio) / 2 * |w|^2)`` to half their mean. Spark divides the squared
    part of its penalty by the label's standard deviation, which is undone here.
    """

    def __init__(self, alpha: float, l1_ratio: float | None, **params):
        super().__init__()
        self.alpha, self.l1_ratio, self.options = alpha, l1_ratio, params
        self.features, self.label = "features", "label"

    def setFeaturesCol(self, name: str):
        self.features = name
        return self

    def setLabelCol(self, name: str):
        self.label = name
        return self

    def _fit(self, df: DataFrame) -> Transformer:
        n, spread = df.agg(F.count(self.label), F.stddev_pop(self.label)).first()
        spread = spread or 1.0
        if self.l1_ratio is None:
            absolute, squared = 0.0, self.alpha * spread / max(n, 1)
        else:
            absolute, squared = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio) * spread
        total = absolute + squared
        share = absolute / total if total else 0.0
        extra = {"solver": "normal"} if not absolute else {"maxIter": 1000, "tol": 1e-10}
        return LinearRegression(
            featuresCol=self.features, labelCol=self.label, regParam=total, elasticNetParam=share, standardization=False, **(extra | self.options)
        ).fit(df)


class Bagging(Estimator):
    """Regression trees on bootstrap samples of rows, each on its own slice of the columns; the mean predicts.

    The fitted form is a pipeline of slicers, trees and one SQL step, so it is saved like any other.
    """

    def __init__(self, members: int, max_samples: float, max_features: float, depth: int, seed: int):
        super().__init__()
        self.members, self.max_samples, self.max_features, self.depth, self.seed = members, max_samples, max_features, depth, seed
        self.features, self.label = "features", "label"

    def setFeaturesCol(self, name: str):
        self.features = name
        return self

    def setLabelCol(self, name: str):
        self.label = name
        return self

    def _fit(self, df: DataFrame) -> Transformer:
        rows = df.select(self.features, self.label)
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        width, rng = first[0].size, random.Random(self.seed)
        subsets = [sorted(rng.sample(range(width), max(1, round(self.max_features * width)))) for _ in range(self.members)]
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)

        def member(i: int) -> list:
            cut = VectorSlicer(inputCol=self.features, outputCol=f"_s{i}", indices=subsets[i])
            # rows remember their node, so that a level of a deep tree does not walk all levels above it
            tree = DecisionTreeRegressor(featuresCol=f"_s{i}", labelCol=self.label, predictionCol=f"_p{i}", maxDepth=self.depth, seed=self.seed, cacheNodeIds=True)
            sample = rows.sample(withReplacement=True, fraction=self.max_samples, seed=self.seed + i)
            return [cut, DeepTree(tree).fit(cut.transform(sample))]

        inherit = inheritable_thread_target(df.sparkSession)
        try:
            with ThreadPoolExecutor(MEMBERS_AT_ONCE) as pool:
                stages = [s for part in pool.map(inherit(member), range(self.members)) for s in part]
        finally:
            rows.unpersist()
        names = [f"_p{i}" for i in range(self.members)]
        mean = reduce(lambda a, b: f"{a} + {b}", names)
        drop = ", ".join([*names, *(f"_s{i}" for i in range(self.members))])
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({drop}), ({mean}) / {self.members} AS prediction FROM __THIS__"))
        return PipelineModel(stages)
