"""Cross-validation and parameter search.

Folds come from a column (see :mod:`terralag.operators.folds`), so every configuration sees the
same rows. Independent fits run concurrently from a small thread pool; Spark schedules their tasks.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from statistics import fmean, pstdev

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame, functions as F

from terralag.functions.metrics import METRICS
from terralag.operators.models import make_pipeline
from terralag.operators.steps import MedianImputer
from terralag.session import spread

FOLD_METRICS = ("r2", "mape_fraction")
#: What a configuration that cannot be fitted raises; anything else, a lost cluster say, ends the search.
FIT_ERRORS = (IllegalArgumentException, ValueError, ZeroDivisionError)


class MapeEvaluator(Evaluator):
    """Mean absolute percentage error for ``CrossValidator``; smaller is better."""

    def __init__(self, label: str, prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        value = dataset.agg(METRICS["mape_fraction"](F.col(self.label), F.col(self.prediction))).first()[0]
        return math.inf if value is None else value

    def isLargerBetter(self) -> bool:
        return False


def score(df: DataFrame, label: str, metrics: Sequence[str], prediction: str = "prediction") -> dict:
    y, p = F.col(label), F.col(prediction)
    row = df.agg(*[METRICS[m](y, p).alias(m) for m in metrics]).first()
    return row.asDict()


def _run(df: DataFrame, tasks: Sequence[Callable], parallelism: int) -> list:
    inherit = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]


def fold_scores(
    df: DataFrame,
    pipeline: Callable[[], object],
    label: str,
    folds: int,
    metrics: Sequence[str] = FOLD_METRICS,
    fold: str = "fold",
    parallelism: int = 2,
    scorer: Evaluator | None = None,
) -> list[dict]:
    """One dict of metrics per fold. ``pipeline()`` gives a fresh estimator."""

    def one(i: int) -> dict:
        model = pipeline().fit(df.filter(F.col(fold) != i))
        scored = model.transform(df.filter(F.col(fold) == i))
        found = {"fold": i, **score(scored, label, metrics)}
        return found | {"scorer": scorer.evaluate(scored)} if scorer else found

    return _run(df, [lambda i=i: one(i) for i in range(folds)], parallelism)


def summarise_folds(scores: Sequence[Mapping], metrics: Sequence[str] = FOLD_METRICS) -> dict:
    """Mean and population standard deviation per metric."""
    out = {}
    for m in metrics:
        values = [s[m] for s in scores if s[m] is not None]
        out[f"{m}_mean"] = fmean(values) if values else None
        out[f"{m}_std"] = pstdev(values) if values else None
    return out


def cross_validate(df: DataFrame, pipeline, label: str, folds: int, metrics=FOLD_METRICS, parallelism: int = 2):
    """Per-fold metrics as a table ``(fold, metric..)``."""
    rows = fold_scores(df, pipeline, label, folds, metrics, parallelism=parallelism)
    schema = ", ".join(["fold int", *[f"{m} double" for m in metrics]])
    return df.sparkSession.createDataFrame([(r["fold"], *[r[m] for m in metrics]) for r in rows], schema)


def grid(model: str, scalers: Iterable[str | None] = (None,), **axes: Sequence) -> list[dict]:
    """Configurations ``{model, scaler, params}`` for every combination."""
    names = list(axes)
    return [
        {"model": model, "scaler": s, "params": dict(zip(names, values))}
        for s, values in product(scalers, list(product(*axes.values())))
    ]


def random_draws(model: str, n: int, space: Mapping[str, tuple], seed: int = 42, scaler: str | None = None) -> list[dict]:
    """``n`` seeded draws. A space entry is ``("int", low, high)`` with ``high`` left out, or
    ``("uniform", loc, scale)``: the interval from ``loc`` to ``loc + scale``."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        params = {
            name: rng.randrange(a, b) if kind == "int" else rng.uniform(a, a + b)
            for name, (kind, a, b) in space.items()
        }
        out.append({"model": model, "scaler": scaler, "params": params})
    return out


SEARCH_SCHEMA = (
    "experiment int, model string, scaler string, params map<string,string>, features array<string>, "
    "r2_mean double, r2_std double, mape_mean double, mape_std double, scorer double, failed boolean, error string"
)


def search(
    df: DataFrame,
    configs: Sequence[Mapping],
    features: Sequence[str],
    label: str,
    folds: int,
    parallelism: int = 2,
    scorer: Evaluator | None = None,
) -> DataFrame:
    """Cross-validate every configuration: one row each, see ``SEARCH_SCHEMA``.

    ``scorer`` is any evaluator, :class:`MapeEvaluator` say; its mean over the folds is the column
    ``scorer``. A configuration that cannot be fitted is kept with its message, ``r2_mean`` minus infinity,
    ``mape_mean`` infinity and the worst ``scorer``, so it never wins. A configuration may carry its own
    ``features``, ``select`` and ``packed``.
    """
    needed = {label, "fold", *features, *[f for c in configs for f in c.get("features", ())]}
    data = spread(df.select(*sorted(needed))).persist(StorageLevel.MEMORY_AND_DISK)

    def one(number: int, config: Mapping) -> tuple:
        names = list(config.get("features", features))
        failed, error, found = False, None, None
        try:
            scores = fold_scores(data, lambda: pipeline_of(config, names, label), label, folds, parallelism=1, scorer=scorer)
            s = summarise_folds(scores)
            if s["r2_mean"] is None or s["mape_fraction_mean"] is None:
                raise ValueError("no score")
            values = (s["r2_mean"], s["r2_std"], s["mape_fraction_mean"], s["mape_fraction_std"])
            found = fmean(x["scorer"] for x in scores) if scorer else None
        except FIT_ERRORS as e:
            values, failed, error = (-math.inf, None, math.inf, None), True, str(e)
            found = (-math.inf if scorer.isLargerBetter() else math.inf) if scorer else None
        params = {k: str(v) for k, v in config["params"].items()}
        return (number, config["model"], config.get("scaler"), params, names, *values, found, failed, error)

    try:
        rows = _run(df, [lambda n=n, c=c: one(n, c) for n, c in enumerate(configs, 1)], parallelism)
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, SEARCH_SCHEMA)


def best_config(report: DataFrame, configs: Sequence[Mapping], by: str = "mape_mean", larger: bool = False) -> Mapping:
    """The configuration with the lowest ``by`` (or highest for R²), ties to the earlier one."""
    sign = F.col(by).desc() if by.startswith("r2") or larger else F.col(by).asc()
    return configs[report.orderBy(sign, "experiment").first()["experiment"] - 1]


def pipeline_of(config: Mapping, features: Sequence[str], label: str):
    return make_pipeline(
        config["model"], features, label, config.get("scaler"), select=config.get("select"), packed=config.get("packed", False), **config["params"]
    )


def refit(df: DataFrame, config: Mapping, features: Sequence[str], label: str):
    return pipeline_of(config, list(config.get("features", features)), label).fit(df)


def model_zoo_report(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    folds: int = 5,
    models: Mapping[str, Mapping] | None = None,
    threshold: float = 0.7,
    parallelism: int = 2,
) -> DataFrame:
    """``(model, r2, rmse, mape, classification)``: fold means, best R² first."""
    zoo = models if models is not None else ZOO
    metrics = ("r2", "rmse", "mape_percent_eps")
    data = spread(df.select(*features, label, "fold")).persist(StorageLevel.MEMORY_AND_DISK)

    def medians(i: int):
        return MedianImputer(features).fit(data.filter(F.col("fold") != i))

    def one(name: str, params: Mapping, i: int) -> tuple:
        fitted = make_pipeline(name, features, label, imputer=imputers[i], **params).fit(data.filter(F.col("fold") != i))
        found = score(fitted.transform(data.filter(F.col("fold") == i)), label, metrics)
        return (name, i, *[found[m] for m in metrics])

    try:
        # all models of a fold are fitted on the same rows, which have the same medians
        imputers = _run(df, [lambda i=i: medians(i) for i in range(folds)], parallelism)
        rows = _run(df, [lambda n=n, p=p, i=i: one(n, p, i) for n, p in zoo.items() for i in range(folds)], parallelism)
    finally:
        data.unpersist()
    table = df.sparkSession.createDataFrame(rows, "model string, fold int, r2 double, rmse double, mape double")
    return classify_models(table, threshold)


def classify_models(folds: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Mean of the fold metrics per model, ``good`` when R² reaches ``threshold``."""
    means = folds.groupBy("model").agg(*[F.avg(m).alias(m) for m in ("r2", "rmse", "mape")])
    label = F.when(F.col("r2") >= threshold, "good").otherwise("poor")
    return means.withColumn("classification", label).orderBy(F.col("r2").desc(), "model")


ZOO: dict[str, dict] = {
    "mean": {},
    "linear": {},
    "ridge": {},
    "lasso": {},
    "elastic_net": {},
    "glm": {},
    "decision_tree": {},
    "random_forest": {"n_estimators": 20, "max_depth": 6},
    "gradient_boosting": {"n_estimators": 20, "max_depth": 4},
    "factorization": {"maxIter": 20, "stepSize": 0.01, "factorSize": 4},
    "huber": {},
    "quantile": {},
    "ransac": {},
    "lasso_lars_ic": {},
    "kernel_ridge": {},
}

