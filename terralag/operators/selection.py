"""Feature selection by tree importance and by forward cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from terralag.operators.models import make_pipeline
from terralag.operators.moments import FORWARD_SCHEMA
from terralag.operators.tuning import fold_scores, summarise_folds
from terralag.session import spread


def importance_table(
    df: DataFrame, features: Sequence[str], label: str, model: str = "extra_trees", **params
) -> DataFrame:
    """``(feature, importance)``, most important first."""
    fitted = make_pipeline(model, features, label, **params).fit(spread(df.select(*features, label)))
    weights = fitted.stages[-1].featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def select_from_model(importances: DataFrame, factor: float = 1.0) -> DataFrame:
    """Features whose importance is at least ``factor`` times the mean importance."""
    mean = importances.agg(F.avg("importance")).first()[0]
    return importances.filter(F.col("importance") >= factor * mean)



def forward_selection(
    df: DataFrame,
    ranked: Sequence[str],
    label: str,
    folds: int = 10,
    model: str = "extra_trees",
    scaler: str | None = "standard",
    parallelism: int = 2,
    **params,
) -> DataFrame:
    """Cross-validate each prefix of ``ranked``; one row per prefix."""
    data = spread(df.select(*ranked, label, "fold")).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        for n in range(1, len(ranked) + 1):
            subset = list(ranked[:n])
            s = summarise_folds(
                fold_scores(
                    data, lambda: make_pipeline(model, subset, label, scaler, **params), label, folds, parallelism=parallelism
                )
            )
            rows.append(
                (n, subset, s["r2_mean"], s["r2_std"], s["mape_fraction_mean"], s["mape_fraction_std"])
            )
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, FORWARD_SCHEMA)


def smallest(report: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return report.orderBy(column, tie).limit(n)
