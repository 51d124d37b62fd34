"""Fitted pipeline steps of our own, with parameters that are saved and read like those of any other step.

Regressions that are found from moments (:mod:`terralag.operators.moments`) are estimators over a feature vector here, so
they stand in pipelines, grids and the model zoo beside Spark's own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from terralag.operators import moments as mo
from terralag.operators import scaling


def _floats(owner, name: str, doc: str) -> Param:
    return Param(owner, name, doc, TypeConverters.toListFloat)


class QuantileModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Columns mapped through their own distributions; ``points`` is JSON, so that columns without a value have null."""

    points = Param(Params._dummy(), "points", "quantiles of each column, as JSON", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "uniform or normal", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, points: str | None = None, output: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return scaling.apply_quantiles(df, json.loads(self.getOrDefault("points")), self.getOrDefault("output"))


class LinearPredictor(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A linear function of the feature vector."""

    intercept = Param(Params._dummy(), "intercept", "constant term", TypeConverters.toFloat)
    coefficients = _floats(Params._dummy(), "coefficients", "one per feature")

    @keyword_only
    def __init__(self, *, intercept: float | None = None, coefficients: list[float] | None = None, featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.getFeaturesCol()))
        out = F.lit(self.getOrDefault("intercept"))
        for i, w in enumerate(self.getOrDefault("coefficients")):
            if w:
                out = out + x[i] * F.lit(w)
        return df.withColumn(self.getPredictionCol(), out)


class KernelPredictor(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A weighted sum of cosines of the standardised feature vector."""

    mean = _floats(Params._dummy(), "mean", "of each feature")
    spread = _floats(Params._dummy(), "spread", "of each feature")
    waves = _floats(Params._dummy(), "waves", "frequencies, feature by feature")
    phases = _floats(Params._dummy(), "phases", "one per cosine")
    weights = _floats(Params._dummy(), "weights", "one per cosine")
    offset = Param(Params._dummy(), "offset", "mean of the label", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, mean=None, spread=None, waves=None, phases=None, weights=None, offset=None, featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def fit_object(self) -> mo.KernelFit:
        mean, spread, waves, phases, weights = (np.array(self.getOrDefault(n)) for n in ("mean", "spread", "waves", "phases", "weights"))
        return mo.KernelFit(mean, spread, waves.reshape(len(mean), -1), phases, weights, self.getOrDefault("offset"))

    def _transform(self, df: DataFrame) -> DataFrame:
        fit = self.fit_object()

        @F.pandas_udf(DoubleType())
        def predict(x):
            import pandas as pd

            return pd.Series(fit.predict(np.array(x.tolist(), dtype=float))) if len(x) else pd.Series([], dtype="float64")

        return df.withColumn(self.getPredictionCol(), predict(vector_to_array(F.col(self.getFeaturesCol()))))


class MomentRegression(Estimator):
    """A regression found from moments over a feature vector; ``rule(rows, features, label)`` fits it."""

    def __init__(self, rule: Callable, **options):
        super().__init__()
        self.rule, self.options = rule, options
        self.features, self.label = "features", "label"

    def setFeaturesCol(self, name: str):
        self.features = name
        return self

    def setLabelCol(self, name: str):
        self.label = name
        return self

    def _fit(self, df: DataFrame) -> Transformer:
        first = df.select(self.features).first()
        if first is None:
            raise ValueError("no rows to fit")
        names = [f"x{i}" for i in range(first[0].size)]
        x = vector_to_array(F.col(self.features))
        rows = df.select(*[x[i].alias(n) for i, n in enumerate(names)], F.col(self.label).cast("double").alias("y"))
        found = self.rule(rows, names, "y", **self.options)
        if isinstance(found, mo.KernelFit):
            parts = {n: [float(v) for v in np.ravel(getattr(found, n))] for n in ("mean", "spread", "waves", "phases", "weights")}
            return KernelPredictor(**parts, offset=float(found.offset), featuresCol=self.features)
        return LinearPredictor(intercept=float(found.intercept), coefficients=[float(w) for w in found.coefficients], featuresCol=self.features)


def _consensus(rows: DataFrame, names, label: str, **options):
    # rows have no id here; equal rows may share one
    return mo.consensus(rows.withColumn("_key", F.xxhash64(*names, label)), names, label, "_key", **options)


def _path(rows: DataFrame, names, label: str, criterion: str = "aic"):
    m = mo.grouped_moments(rows, [*names, label]).get(None)
    if m is None or not m.n:
        raise ValueError("no rows to fit")
    return mo.choose_lasso(m, criterion)


RULES: dict[str, Callable] = {"huber": mo.huber, "quantile": mo.quantile_regression, "consensus": _consensus, "lasso_path": _path, "kernel": mo.kernel_regression}


def moment_regression(name: str) -> Callable[..., MomentRegression]:
    return lambda **options: MomentRegression(RULES[name], **options)
