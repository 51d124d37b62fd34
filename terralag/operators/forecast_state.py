"""Fitted forecast models as a keyed table: coefficients, and the last values that forecasts start from.

A row holds everything the next months need, so a table that is written to Parquet and read in another session gives
the same forecasts without the training rows and without fitting again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from terralag.operators import forecasting as fc

_ARRAYS = ("coef", "weights", "ar", "ma", "poly", "y_tail", "w_tail", "e_tail", "x_tail")
_KIND = {"ar": "array<int>", "ma": "array<int>"}
STATE = f"{fc.ORDER_SCHEMA}, last timestamp, uses_x boolean, n int, sse double, aic double, " + ", ".join(f"{a} {_KIND.get(a, 'array<double>')}" for a in _ARRAYS)
_NAMES = [c.strip().split()[0] for c in STATE.split(", ")]


def _tail(values, count: int) -> list[float]:
    return [float(v) for v in np.asarray(values, dtype=float)[len(values) - count :]] if count else []


def _state(fit: fc.SeasonalFit) -> dict:
    deep = len(fit.poly) - 1
    return {
        "coef": [float(c) for c in fit.coef],
        "weights": [float(c) for c in fit.weights],
        "ar": [int(i) for i in fit.ar],
        "ma": [int(i) for i in fit.ma],
        "poly": [float(c) for c in fit.poly],
        "y_tail": _tail(fit.y, deep),
        "w_tail": _tail(fit.w, max(fit.ar, default=0)),
        "e_tail": _tail(fit.e, max(fit.ma, default=0)),
        "x_tail": _tail(fit.x, deep) if fit.x is not None else [],
    }


def fit_models(panel: DataFrame, best: DataFrame, key: str, ts: str, value: str, exog: str | None = None, exog_keys: Sequence | None = None) -> DataFrame:
    """``(key, order, last, uses_x, n, sse, aic, coefficients, tails)``: one row per series whose order can be fitted."""
    allowed = None if exog_keys is None else set(exog_keys)
    arrays = fc._arrays(panel, key, ts, value, exog)
    rows = arrays.join(best.select(key, *fc.ORDER_FIELDS), key).withColumn("last", F.element_at("times", -1).cast("timestamp")).drop("times")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                order = tuple(int(r[f]) for f in fc.ORDER_FIELDS)
                xs = fc._clean_x(r["x"], allowed is None or r[key] in allowed)
                try:
                    fit = fc.SeasonalFit(r["y"], order, xs)
                except (ValueError, np.linalg.LinAlgError):
                    continue
                found = _state(fit) | dict(zip(fc.ORDER_FIELDS, order))
                found |= {key: r[key], "last": r["last"], "uses_x": xs is not None, "n": len(fit.resid), "sse": float(fit.resid @ fit.resid), "aic": fit.aic}
                out.append(found)
            yield pd.DataFrame(out, columns=[key, *_NAMES])

    return fc._spread(rows, key).mapInPandas(run, f"`{key}` {dict(arrays.dtypes)[key]}, {STATE}")


def save_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str, key: str = "produto", key_type: str = "string") -> DataFrame:
    return spark.read.schema(f"`{key}` {key_type}, {STATE}").parquet(path)


def _ahead(r: dict, steps: int, future: list[float]) -> list[float]:
    """Forecasts of one stored model; unknown residuals are zero."""
    poly, weights = np.asarray(r["poly"]), np.asarray(r["weights"])
    y, w, e, x = (list(r[f"{c}_tail"]) for c in "ywex")
    out = []
    for i in range(steps):
        parts = [w[-k] for k in r["ar"]] + [e[-k] for k in r["ma"]]
        if r["uses_x"]:
            x.append(future[i])
            parts.append(float(poly @ np.asarray(x[len(x) - len(poly) :])[::-1]))
        step = float(weights @ np.asarray(parts)) if parts else 0.0
        guess = step - float(poly[1:] @ np.asarray(y[::-1][: len(poly) - 1]))
        for held, new in ((y, guess), (w, step), (e, 0.0)):
            held.append(new)
        out.append(guess)
    return out


def forecast_models(models: DataFrame, key: str, ts: str, steps: int, future: DataFrame | None = None, exog: str | None = None) -> DataFrame:
    """``(key, ts, step, predicted)``: the ``steps`` month ends after each model's last month.

    ``future`` has ``(key, ts, exog)`` for models with a regressor; a month without a value takes the one before, or 0.
    """
    rows = models
    if future is not None:
        known = future.select(F.col(key).alias("_k"), F.to_date(ts).alias("_t"), F.col(exog).cast("double").alias("_x"))
        months = models.select(key, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_i"), F.to_date("last").alias("_last"))
        months = months.withColumn("_t", F.last_day(F.add_months("_last", F.col("_i"))))
        met = months.join(known, (months[key] == known["_k"]) & (months["_t"] == known["_t"]), "left")
        given = met.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_future"))
        rows = models.join(given, key, "left")
    else:
        rows = models.withColumn("_future", F.lit(None).cast("array<double>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                given = [] if r["_future"] is None else list(r["_future"])
                filled = pd.Series([*r["x_tail"][-1:], *given, *[np.nan] * steps], dtype="float64").ffill().fillna(0.0).tolist()
                ahead = _ahead(r, steps, filled[len(r["x_tail"][-1:]) :])
                out += [(r[key], r["last"], i, float(g)) for i, g in enumerate(ahead, 1)]
            yield pd.DataFrame(out, columns=[key, "last", "step", "predicted"])

    made = rows.mapInPandas(run, f"`{key}` {dict(models.dtypes)[key]}, last timestamp, step int, predicted double")
    return made.select(key, F.last_day(F.add_months(F.to_date("last"), F.col("step"))).alias(ts), "step", "predicted")
