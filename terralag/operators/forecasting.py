"""Seasonal ARX/ARMA order search, rolling and recursive forecasts for many series.

A series is monthly, so its arrays are short; parallelism comes from the number of
(series, order block) and (series, origin) pairs, each an independent small least-squares fit.
Orders without seasonal lags are fitted by the two-stage Hannan-Rissanen regression: a long autoregression supplies
innovations, then one regression on lagged values, lagged innovations and the regressor. Orders with seasonal lags
multiply the plain and the seasonal polynomial and are fitted by conditional least squares
(:mod:`terralag.operators.seasonal`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from terralag.functions.metrics import evaluate
from terralag.operators.correlation import safe_corr
from terralag.operators.seasonal import fit_products
from terralag.operators.stationarity import series_arrays

Order = tuple[int, int, int, int, int, int]  # p, d, q, seasonal P, D, Q
PERIOD = 12
FALLBACK: Order = (1, 1, 1, 0, 1, 1)  # used when no candidate order can be fitted
ORDER_FIELDS = ("p", "d", "q", "sp", "sd", "sq")
ORDER_SCHEMA = ", ".join(f"{f} int" for f in ORDER_FIELDS)


def order_grid(p=range(3), d=range(3), q=range(3), sp=range(3), sd=range(3), sq=range(3)) -> list[Order]:
    return list(product(p, d, q, sp, sd, sq))


def _difference_poly(d: int, seasonal: int, period: int) -> np.ndarray:
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    step = np.zeros(period + 1)
    step[0], step[-1] = 1.0, -1.0
    for _ in range(seasonal):
        poly = np.convolve(poly, step)
    return poly


def residual_start(n: int, order: Order, period: int = PERIOD) -> int:
    """Months of a series of ``n`` that the fit of ``order`` spends before its first residual."""
    p, d, q, sp, sd, sq = order
    lost = d + period * sd
    if sp or sq:
        return lost + p + period * sp
    start = min(max(p, q) + 1, (n - lost) // 3) + q if q else 0
    return lost + max(start, p)


def common_start(n: int, orders: Sequence[Order], period: int = PERIOD) -> int:
    """The first month that all compared orders have a residual for.

    Information criteria are only comparable over the same months, so orders that would leave less than a
    third of the series are not compared, and the others only from this month on.
    """
    starts = [residual_start(n, o, period) for o in orders]
    return max([s for s in starts if n - s >= max(n // 3, 3)], default=n)


class SeasonalFit:
    """One fitted model; raises ``ValueError`` when the series is too short for the order.

    ``coef`` has plain and seasonal autoregressive, then plain and seasonal moving-average coefficients, then that of
    the regressor.
    """

    def __init__(self, y, order: Order, x=None, period: int = PERIOD):
        p, d, q, sp, sd, sq = order
        self.y = np.asarray(y, dtype=float)
        self.x = None if x is None else np.asarray(x, dtype=float)
        self.poly = _difference_poly(d, sd, period)
        lost = len(self.poly) - 1
        if len(self.y) <= lost + 2:
            raise ValueError("series too short")
        self.w = np.convolve(self.y, self.poly, "valid")
        self.xw = None if self.x is None else np.convolve(self.x, self.poly, "valid")
        if sp or sq:
            self._fit_products(p, q, sp, sq, period)
        else:
            self._fit_lags(range(1, p + 1), range(1, q + 1))
        m = len(self.resid)
        sse = float(self.resid @ self.resid)
        if not math.isfinite(sse):
            raise ValueError("no finite fit")
        self.aic = m * math.log(max(sse, 1e-300) / m) + 2 * (len(self.coef) + 1)
        self.offset = lost + self.start  # position of the first residual in y

    def _fit_products(self, p: int, q: int, sp: int, sq: int, period: int) -> None:
        lags = ([*range(1, p + 1), *(period * i for i in range(1, sp + 1))], [*range(1, q + 1), *(period * i for i in range(1, sq + 1))])
        try:
            self._fit_lags(*lags)
            first = self.coef
        except (ValueError, np.linalg.LinAlgError):
            first = None  # too short for the regressions, perhaps not for the model
        found = fit_products(self.w, self.xw, p, q, sp, sq, period, first)
        self.coef, self.e, self.start = found.coef, found.e, found.start
        self.ar = [int(i) for i in np.flatnonzero(found.ar) if i]
        self.ma = [int(j) for j in np.flatnonzero(found.ma) if j]
        self.weights = np.concatenate([-found.ar[self.ar], found.ma[self.ma], found.coef[len(found.coef) - (self.x is not None) :]])
        self.resid = found.e[found.start :]

    def _fit_lags(self, ar, ma) -> None:
        """The two-stage regression on single lags."""
        self.ar, self.ma = list(ar), list(ma)
        n = len(self.w)
        start = 0
        self.e = np.zeros(n)
        if self.ma:
            deep = min(max(self.ar + self.ma) + 1, n // 3)
            start = deep
            z = self._lags(self.w, range(1, deep + 1), deep)
            target = self.w[deep:]
            if len(target) <= deep:
                raise ValueError("series too short")
            coef, *_ = np.linalg.lstsq(z, target, rcond=None)
            self.e[deep:] = target - z @ coef
            start += max(self.ma)
        self.start = max([start, *self.ar]) if self.ar else start
        z, target = self._design(self.start, n)
        k = z.shape[1]
        if len(target) < k + 3:
            raise ValueError("series too short")
        if k:
            self.coef, *_ = np.linalg.lstsq(z, target, rcond=None)
            fitted = z @ self.coef
        else:
            self.coef, fitted = np.zeros(0), np.zeros(len(target))
        self.weights = self.coef
        self.resid = target - fitted

    def aic_from(self, first: int) -> float:
        """The criterion over the months from ``first`` on; a change of unit shifts it for all orders alike."""
        resid = self.resid[first - self.offset :]
        if first < self.offset or len(resid) < len(self.coef) + 3:
            raise ValueError("series too short")
        m = len(resid)
        return m * math.log(max(float(resid @ resid), 1e-300) / m) + 2 * (len(self.coef) + 1)

    @staticmethod
    def _lags(v: np.ndarray, lags, start: int) -> np.ndarray:
        rows = np.arange(start, len(v))
        return np.column_stack([v[rows - i] for i in lags])

    def _design(self, start: int, stop: int):
        rows = np.arange(start, stop)
        cols = [self.w[rows - i] for i in self.ar] + [self.e[rows - j] for j in self.ma]
        if self.xw is not None:
            cols.append(self.xw[rows])
        return (np.column_stack(cols) if cols else np.zeros((len(rows), 0))), self.w[rows]

    def forecast(self, x_next: float | None = None) -> float:
        """The next value, one step after the series."""
        n = len(self.w)
        parts = [self.w[n - i] for i in self.ar] + [self.e[n - j] for j in self.ma]
        if self.x is not None:
            tail = np.append(self.x[len(self.x) - len(self.poly) + 1 :], x_next)
            parts.append(float(self.poly @ tail[::-1]))
        step = float(np.dot(self.weights, parts)) if parts else 0.0
        back = self.y[::-1][: len(self.poly) - 1]
        return step - float(self.poly[1:] @ back)


def _arrays(panel: DataFrame, key: str, ts: str, value: str, exog: str | None) -> DataFrame:
    needed = [value] + ([exog] if exog else [])
    rows = panel.select(key, ts, *[F.col(c).cast("double").alias(c) for c in needed]).dropna(subset=[value])
    packed = series_arrays(rows, key, ts, needed)
    names = packed.withColumnsRenamed({value: "y", ts: "times"})
    return names.withColumnRenamed(exog, "x") if exog else names.withColumn("x", F.lit(None).cast("array<double>"))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Spread rows over all cores. An explicit count keeps AQE from merging the small, costly rows."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *by)


def _clean_x(x, use: bool, known: int | None = None):
    """Gaps take the value before them; leading gaps the first value among the first ``known`` months."""
    if not use or x is None:
        return None
    filled = pd.Series(np.asarray(x, dtype=float)).ffill()
    seen = filled.iloc[:known].dropna()
    return filled.fillna(seen.iloc[0] if len(seen) else 0.0).to_numpy()


def fit_orders(
    panel: DataFrame,
    key: str,
    ts: str,
    value: str,
    orders: Sequence[Order],
    exog: str | None = None,
    exog_keys: Sequence | None = None,
    block: int = 27,
) -> DataFrame:
    """``(key, p, d, q, sp, sd, sq, aic)`` for each order that could be fitted.

    All orders of a series are judged on the same months, see :func:`common_start`. ``exog_keys`` limits
    the regressor to some series.
    """
    orders = [tuple(o) for o in orders]
    blocks = math.ceil(len(orders) / block)
    arrays = _arrays(panel, key, ts, value, exog).drop("times")
    tasks = arrays.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = dict(arrays.dtypes)[key]
    allowed = None if exog_keys is None else set(exog_keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, y, x, b in zip(batch[key], batch["y"], batch["x"], batch["block"]):
                xs = _clean_x(x, allowed is None or name in allowed)
                first = common_start(len(y), orders)
                for order in orders[b * block : (b + 1) * block]:
                    try:
                        rows.append((name, *order, SeasonalFit(y, order, xs).aic_from(first)))
                    except (ValueError, np.linalg.LinAlgError):
                        continue  # an order the series cannot carry is skipped
            yield pd.DataFrame(rows, columns=[key, *ORDER_FIELDS, "aic"])

    return _spread(tasks, key, "block").mapInPandas(run, f"`{key}` {kind}, {ORDER_SCHEMA}, aic double")


def best_orders(fits: DataFrame, keys: DataFrame, key: str, fallback: Order = FALLBACK) -> DataFrame:
    """The order with the lowest AIC per key; keys without any fit get ``fallback`` and a NULL AIC."""
    pick = F.min_by(F.struct(*ORDER_FIELDS, "aic"), F.struct("aic", *ORDER_FIELDS))
    best = fits.groupBy(key).agg(pick.alias("_b")).select(key, "_b.*")
    filled = keys.select(key).distinct().join(best, key, "left")
    return filled.withColumns({f: F.coalesce(f, F.lit(v)) for f, v in zip(ORDER_FIELDS, fallback)})


def search_orders(panel, key, ts, value, orders, exog=None, exog_keys=None) -> DataFrame:
    return best_orders(fit_orders(panel, key, ts, value, orders, exog, exog_keys), panel, key)


def linear_in_coefficients(order: Order) -> bool:
    """Whether the fit is one least-squares problem: no moving average, no product of two polynomials."""
    p, _, q, sp, _, sq = order
    return not q and not sq and not (p and sp)


def recursive_guesses(y: np.ndarray, order: Order, origins: Sequence[int], x: np.ndarray | None = None, period: int = PERIOD) -> list[float | None]:
    """The one-step forecasts of a linear order at all ``origins``, by recursive least squares over the series once.

    Equal to a refit at each origin; None where the months before an origin are too few. Raises ``LinAlgError``
    when the design is too close to singular for updates.
    """
    p, d, _, sp, sd, _ = order
    poly = _difference_poly(d, sd, period)
    lost = len(poly) - 1
    w = np.convolve(y, poly, "valid")
    lags = [*range(1, p + 1), *(period * i for i in range(1, sp + 1))]
    first = max(lags, default=0)
    rows = np.arange(first, len(w))
    columns = [w[rows - i] for i in lags] + ([np.convolve(x, poly, "valid")[rows]] if x is not None else [])
    z = np.column_stack(columns) if columns else np.zeros((len(rows), 0))
    k, out, coef, inverse, seen = z.shape[1], {}, None, None, 0
    for origin in sorted(set(origins)):
        known = origin - lost - first  # rows whose target is before the origin
        if origin <= lost + 2 or known < k + 3:
            out[origin] = None
            continue
        if coef is None and k:
            gram = z[:known].T @ z[:known]
            if not np.isfinite(gram).all() or np.linalg.cond(gram) > 1e10:
                raise np.linalg.LinAlgError("the design is close to singular")
            inverse, seen = np.linalg.inv(gram), known
            coef = inverse @ (z[:known].T @ w[rows[:known]])
        for i in range(seen, known) if k else ():
            v = inverse @ z[i]
            v_scaled = v / (1.0 + z[i] @ v)
            coef = coef + v_scaled * (w[rows[i]] - z[i] @ coef)
            inverse = inverse - np.outer(v_scaled, v)
        seen = max(seen, known)
        step = float(z[known] @ coef) if k else 0.0
        out[origin] = step - float(poly[1:] @ y[:origin][::-1][:lost])
    return [out[o] for o in origins]


def _forecast_tasks(arrays: DataFrame, best: DataFrame, key: str, positions, together) -> DataFrame:
    """A row per (key, origin), or per key with all origins where ``together``."""
    origins = F.when(together, F.array("origins")).otherwise(F.transform("origins", lambda x: F.array(x)))
    rows = arrays.join(best, key).withColumn("origins", positions).withColumn("origins", F.explode(origins))
    return _spread(rows, key, "origins")


def rolling_forecasts(
    panel: DataFrame,
    best: DataFrame,
    key: str,
    ts: str,
    value: str,
    test_size: int,
    exog: str | None = None,
    exog_keys: Sequence | None = None,
    horizon: int = 1,
) -> DataFrame:
    """``(key, ts, actual, predicted)`` for the last ``test_size`` rows of each series.

    With ``horizon=1`` every row is predicted from the actual rows before it: orders that are linear in their
    coefficients take one pass of recursive least squares over a series, the others a refit for each row, and these
    are independent tasks. With a longer horizon every ``horizon``-th origin predicts that many
    steps, feeding its own predictions back. Nothing at or after the origin is seen except the
    regressor's value for the predicted month.
    """
    arrays = _arrays(panel, key, ts, value, exog)
    n = F.size("y")
    first = F.greatest(n - test_size, F.lit(1))
    origins = F.when(n > 1, F.sequence(first, n - 1, F.lit(horizon)))
    return _forecast_at(arrays, best, key, ts, origins, exog_keys, horizon)


def _forecast_at(arrays, best, key, ts, origins, exog_keys, horizon) -> DataFrame:
    allowed = None if exog_keys is None else set(exog_keys)
    schema = f"`{key}` {dict(arrays.dtypes)[key]}, pos int, predicted double"

    def refits(r, order, y) -> list[tuple]:
        rows = []
        for origin in r["origins"]:
            history = list(y[:origin])
            for pos in range(origin, min(origin + horizon, len(y))):
                xs = _clean_x(r["x"], allowed is None or r[key] in allowed, pos)
                try:
                    fit = SeasonalFit(history, order, None if xs is None else xs[:pos])
                    guess = fit.forecast(None if xs is None else xs[pos])
                except (ValueError, np.linalg.LinAlgError):
                    guess = history[-1]  # too little history for the order: last value
                rows.append((r[key], pos, float(guess)))
                history.append(guess)
        return rows

    def one_pass(r, order, y) -> list[tuple]:
        origins = [int(o) for o in r["origins"]]
        xs = _clean_x(r["x"], allowed is None or r[key] in allowed, min(origins))
        if xs is not None and not np.array_equal(xs, _clean_x(r["x"], True, max(origins))):
            return refits(r, order, y)  # a leading gap of the regressor is filled otherwise at later origins
        try:
            guesses = recursive_guesses(y, order, origins, xs)
        except (ValueError, np.linalg.LinAlgError):
            return refits(r, order, y)
        return [(r[key], o, float(y[o - 1] if g is None else g)) for o, g in zip(origins, guesses, strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                y = np.asarray(r["y"], dtype=float)
                order = tuple(int(r[f]) for f in ORDER_FIELDS)
                rows += (one_pass if horizon == 1 and linear_in_coefficients(order) else refits)(r, order, y)
            yield pd.DataFrame(rows, columns=[key, "pos", "predicted"])

    together = F.lit(horizon == 1) & (F.col("q") == 0) & (F.col("sq") == 0) & ((F.col("p") == 0) | (F.col("sp") == 0))
    tasks = _forecast_tasks(arrays.drop("times"), best.select(key, *ORDER_FIELDS), key, origins, together)
    guesses = tasks.mapInPandas(run, schema)
    cells = F.arrays_zip(F.col("times").alias("t"), F.col("y").alias("v"))
    actual = arrays.select(key, F.posexplode(cells).alias("pos", "c"))
    return actual.join(guesses, [key, "pos"]).select(
        key, F.col("c.t").alias(ts), F.col("c.v").alias("actual"), "predicted", F.col("pos").cast("bigint").alias("pos")
    )


def residual_table(panel, best, key, ts, value, exog=None, exog_keys=None) -> DataFrame:
    """``(key, ts, residual)`` in-sample residuals of the chosen orders."""
    allowed = None if exog_keys is None else set(exog_keys)
    arrays = _arrays(panel, key, ts, value, exog)
    rows = arrays.join(best.select(key, *ORDER_FIELDS), key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                try:
                    fit = SeasonalFit(
                        r["y"],
                        tuple(int(r[f]) for f in ORDER_FIELDS),
                        _clean_x(r["x"], allowed is None or r[key] in allowed),
                    )
                except (ValueError, np.linalg.LinAlgError):
                    continue
                out += [(r[key], fit.offset + i, float(e)) for i, e in enumerate(fit.resid)]
            yield pd.DataFrame(out, columns=[key, "pos", "residual"])

    schema = f"`{key}` {dict(arrays.dtypes)[key]}, pos int, residual double"
    got = _spread(rows.drop("times"), key).mapInPandas(run, schema)
    stamps = arrays.select(key, F.posexplode("times").alias("pos", ts))
    return stamps.join(got, [key, "pos"]).select(key, ts, "residual")


def residual_correlation(residuals: DataFrame, panel: DataFrame, key: str, ts: str, exog: str) -> DataFrame:
    """``(key, r)``: in-sample residuals against a regressor the model did not use."""
    joined = residuals.join(panel.select(key, ts, exog), [key, ts])
    return joined.groupBy(key).agg(safe_corr("residual", exog).alias("r"))


def boost_stumps(x: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.1):
    """Squared-error boosting of one-split trees on a small table: the start value and ``(column, cut, below, above)`` each."""
    start = float(y.mean())
    left, trees = y - start, []
    orders = np.argsort(x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, orders, axis=0)
    open_ = ranked[1:] > ranked[:-1]  # a split lies between two different values
    if not open_.any():
        return start, trees
    below = np.arange(1, len(y))[:, None]
    for _ in range(rounds):
        sums = np.cumsum(left[orders], axis=0)
        low, all_ = sums[:-1], sums[-1:]
        gain = np.where(open_, low**2 / below + (all_ - low) ** 2 / (len(y) - below), -np.inf)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        cut = (ranked[i, j] + ranked[i + 1, j]) / 2
        down, up = rate * low[i, j] / (i + 1), rate * (all_[0, j] - low[i, j]) / (len(y) - i - 1)
        trees.append((int(j), float(cut), float(down), float(up)))
        left = left - np.where(x[:, j] <= cut, down, up)
    return start, trees


def _residual_steps(values: np.ndarray, lags: int, steps: int, trees: int) -> list[float]:
    """The next residuals of one series, later lags being earlier results; none if it is too short."""
    if len(values) < 2 * lags + 2:
        return []
    table = np.lib.stride_tricks.sliding_window_view(values, lags + 1)
    start, found = boost_stumps(table[:, -2::-1], table[:, -1], trees)
    state, out = list(values[: -lags - 1 : -1]), []
    for _ in range(steps):
        guess = start + sum(down if state[j] <= cut else up for j, cut, down, up in found)
        out.append(float(guess))
        state = [guess, *state[:-1]]
    return out


def hybrid_forecasts(forecasts: DataFrame, residuals: DataFrame, key: str, ts: str, lags: int = 3, trees: int = 100) -> DataFrame:
    """Adds ``residual_forecast`` and ``hybrid`` to rolling forecasts.

    Every series has its own boosted model of the next residual from the previous ``lags``, fitted on its residuals
    before the first forecast and then applied step by step, later lags being its own output. All series are one job
    over packed arrays. A series too short for a model keeps its plain forecast.
    """
    start = forecasts.groupBy(key).agg(F.min(ts).alias("_start"), F.count(F.lit(1)).cast("int").alias("_steps"))
    past = residuals.join(start, key).filter(F.col(ts) < F.col("_start"))
    packed = past.groupBy(key, "_steps").agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col("residual").alias("e")))).alias("_rows"))
    packed = packed.select(key, "_steps", F.col("_rows.e").alias("_e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, steps, e in zip(batch[key], batch["_steps"], batch["_e"]):
                values = np.asarray(e, dtype=float)
                out += [(name, i, g) for i, g in enumerate(_residual_steps(values[np.isfinite(values)], lags, int(steps), trees))]
            yield pd.DataFrame(out, columns=[key, "_step", "residual_forecast"])

    guesses = _spread(packed, key).mapInPandas(run, f"`{key}` {dict(packed.dtypes)[key]}, _step int, residual_forecast double")
    step = F.row_number().over(Window.partitionBy(key).orderBy(ts)) - 1
    joined = forecasts.withColumn("_step", step).join(guesses, [key, "_step"], "left").drop("_step")
    return joined.withColumn("hybrid", F.col("predicted") + F.coalesce(F.col("residual_forecast"), F.lit(0.0)))


def rolling_cv(panel, best, key, ts, value, n_splits: int = 5, exog=None, exog_keys=None) -> DataFrame:
    """``(key, fold, rmse, mae, mape_percent)`` with one-step forecasts inside each validation block."""
    arrays = _arrays(panel, key, ts, value, exog)
    n = F.size("y")
    size = F.floor(n / (n_splits + 1)).cast("int")
    first = n - n_splits * size
    origins = F.when(size > 0, F.sequence(F.greatest(first, F.lit(1)), n - 1))
    got = _forecast_at(arrays, best, key, ts, origins, exog_keys, 1)
    sizes = arrays.select(key, size.alias("_size"), first.alias("_first"))
    fold = F.floor((F.col("pos") - F.col("_first")) / F.col("_size"))
    rows = got.join(sizes, key).withColumn("fold", fold.cast("bigint"))
    return evaluate(rows, "actual", "predicted", [key, "fold"], ("rmse", "mae", "mape_percent"))


def summarise(forecasts: DataFrame, key: str, predicted: str = "predicted") -> DataFrame:
    return evaluate(forecasts, "actual", predicted, [key], ("rmse", "mae", "mape_percent"))
