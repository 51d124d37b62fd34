"""Linear models from second moments: one scan for all folds, subsets and penalties.

Rows with a gap in any used column are left out. What a scan sends to the driver is a matrix of the columns' size per
fold, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from terralag.operators.quantiles import exact_quantiles
from terralag.session import cut_lineage

#: One row per prefix, as in :func:`terralag.operators.selection.forward_selection`.
FORWARD_SCHEMA = "num_features int, features array<string>, r2_mean double, r2_std double, mape_mean double, mape_std double"


@dataclass
class Moments:
    """Weight, means and centred products of some columns; the last one is the label."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))


def complete(df: DataFrame, columns: Sequence[str], *others: str) -> DataFrame:
    """The columns as doubles, and ``others``, of the rows without a gap."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *others)
    return rows.filter(reduce(lambda a, b: a & b, [F.abs(F.col(c)) < math.inf for c in columns]))


def grouped_moments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict:
    """``Moments`` of the columns for each value of ``by``, by one aggregation that stays exact far from zero."""
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)]]
    aggs += [F.covar_pop(columns[i], columns[j]).alias(f"c_{i}_{j}") for i, j in pairs]
    rows = complete(df, columns, *([by] if by else []))
    out = {}
    for r in (rows.groupBy(by) if by else rows.groupBy()).agg(*aggs).collect():
        cross = np.zeros((p, p))
        for i, j in pairs:
            cross[i, j] = cross[j, i] = (r[f"c_{i}_{j}"] or 0.0) * r["n"]
        out[r[by] if by else None] = Moments(float(r["n"]), np.array([r[f"m_{i}"] or 0.0 for i in range(p)]), cross)
    return out


def without(folds: Mapping[int, Moments], fold: int) -> Moments:
    """The moments of all rows but those of one fold."""
    rest = [m for f, m in folds.items() if f != fold]
    if not rest:
        raise ValueError("a fold holds all rows")
    return reduce(lambda a, b: a + b, rest)


def prefix_coefficients(m: Moments, alpha: float = 0.0) -> list[np.ndarray]:
    """Coefficients of the regressions on the first 1, 2, .. columns, from one Cholesky factor.

    The factor of a leading block is the leading block of the factor, so one forward substitution serves all prefixes. A
    column that depends on those before it gets no weight. ``alpha`` is added to the squares.
    """
    p = len(m.mean) - 1
    gram = m.cross[:p, :p] + alpha * np.eye(p)
    factor, usable = np.zeros((p, p)), np.zeros(p, dtype=bool)
    for j in range(p):
        row = np.zeros(j)
        for i in range(j):
            row[i] = (gram[j, i] - row[:i] @ factor[i, :i]) / factor[i, i] if usable[i] else 0.0
        left = gram[j, j] - row @ row
        usable[j] = left > 1e-12 * max(gram[j, j], 1e-300)
        factor[j, :j], factor[j, j] = (row, math.sqrt(left)) if usable[j] else (0.0, 1.0)
    z = np.zeros(p)
    for j in range(p):
        z[j] = (m.cross[j, p] - factor[j, :j] @ z[:j]) / factor[j, j] if usable[j] else 0.0
    out = []
    for size in range(1, p + 1):
        b = np.zeros(size)
        for j in range(size - 1, -1, -1):
            b[j] = (z[j] - factor[j + 1 : size, j] @ b[j + 1 :]) / factor[j, j] if usable[j] else 0.0
        out.append(b)
    return out


def pick(m: Moments, places: Sequence[int]) -> Moments:
    at = [*places, len(m.mean) - 1]
    return Moments(m.n, m.mean[at], m.cross[np.ix_(at, at)])


def squared_error(m: Moments, intercept: float, coef: np.ndarray) -> float:
    """The sum of squared errors of a linear function over the rows behind the moments."""
    p = len(m.mean) - 1
    centred = m.cross[p, p] - 2 * coef @ m.cross[:p, p] + coef @ m.cross[:p, :p] @ coef
    return float(max(centred, 0.0) + m.n * (m.mean[p] - intercept - coef @ m.mean[:p]) ** 2)


def _percentage_errors(df: DataFrame, features: Sequence[str], label: str, fold: str, weights: Mapping[int, np.ndarray]) -> dict:
    """Mean absolute percentage errors ``{fold: array over models}`` in one scan; weights have the intercept first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for batch in batches:
            for f, part in batch.groupby(fold):
                x, y = part[list(features)].to_numpy(), part[label].to_numpy()
                known = y != 0.0  # the ratio is undefined at zero, as in the metric
                guess = weights[int(f)][0] + x[known] @ weights[int(f)][1:]
                n, sums = total.get(int(f), (0, 0.0))
                total[int(f)] = (n + int(known.sum()), sums + np.abs((y[known, None] - guess) / y[known, None]).sum(axis=0))
        yield pd.DataFrame([(f, i, n, float(s)) for f, (n, sums) in total.items() for i, s in enumerate(sums)], columns=["f", "i", "n", "s"])

    rows = complete(df, [*features, label], fold).mapInPandas(run, "f int, i int, n bigint, s double")
    out = {f: np.full(w.shape[1], np.nan) for f, w in weights.items()}
    for r in rows.groupBy("f", "i").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mape")).collect():
        out[r["f"]][r["i"]] = np.nan if r["mape"] is None else r["mape"]
    return out


SCORE_SCHEMA = "model int, features array<string>, alpha double, fold int, intercept double, coefficients array<double>, r2 double, rmse double, mape_fraction double"


def fold_report(df: DataFrame, subsets: Sequence[Sequence[str]], label: str, penalties: Sequence[float] = (0.0,), fold: str = "fold") -> list[tuple]:
    """One row per model and fold, see ``SCORE_SCHEMA``: every subset with every ridge penalty.

    Two scans whatever the number of subsets, penalties and folds: moments per fold, then the percentage errors of all
    models at once. Subsets that are prefixes of a longer one share its factor.
    """
    features = list(dict.fromkeys(f for s in subsets for f in s))
    folds = grouped_moments(df, [*features, label], fold)
    train = {f: without(folds, f) for f in folds}
    models = [(list(s), float(a)) for s in subsets for a in penalties]
    weights, found = {}, {}
    for f, m in train.items():
        solved: dict[tuple, list[np.ndarray]] = {}
        w = np.zeros((len(features) + 1, len(models)))
        for i, (subset, alpha) in enumerate(models):
            longest = next((s for s, a in solved if a == alpha and list(s[: len(subset)]) == subset), None)
            if longest is None:
                longest = max((tuple(s) for s in subsets if list(s[: len(subset)]) == subset), key=len)
                solved[longest, alpha] = prefix_coefficients(pick(m, [features.index(c) for c in longest]), alpha)
            coef = solved[longest, alpha][len(subset) - 1]
            places = [features.index(c) for c in subset]
            intercept = float(m.mean[-1] - coef @ m.mean[places])
            w[0, i] = intercept
            w[[p + 1 for p in places], i] = coef
            test = pick(folds[f], places)
            sse, spread = squared_error(test, intercept, coef), float(test.cross[-1, -1])
            found[i, f] = (intercept, [float(c) for c in coef], 1.0 - sse / spread if spread else None, math.sqrt(sse / test.n))
        weights[f] = w
    mape = _percentage_errors(df, features, label, fold, weights)
    rows = []
    for i, (subset, alpha) in enumerate(models):
        for f in sorted(folds):
            share = float(mape[f][i])
            rows.append((i, subset, alpha, int(f), *found[i, f], None if math.isnan(share) else share))
    return rows


def linear_scores(df: DataFrame, subsets: Sequence[Sequence[str]], label: str, penalties: Sequence[float] = (0.0,), fold: str = "fold") -> DataFrame:
    return df.sparkSession.createDataFrame(fold_report(df, subsets, label, penalties, fold), SCORE_SCHEMA)


def linear_forward_selection(df: DataFrame, ranked: Sequence[str], label: str, alpha: float = 0.0) -> DataFrame:
    """The table of ``forward_selection`` for linear models: all prefixes and folds from two scans."""
    from terralag.operators.tuning import summarise_folds

    rows = fold_report(df, [list(ranked[:n]) for n in range(1, len(ranked) + 1)], label, (alpha,))
    out = []
    for n in range(1, len(ranked) + 1):
        scores = [{"r2": r[6], "mape_fraction": r[8]} for r in rows if r[0] == n - 1]
        s = summarise_folds(scores)
        out.append((n, list(ranked[:n]), s["r2_mean"], s["r2_std"], s["mape_fraction_mean"], s["mape_fraction_std"]))
    return df.sparkSession.createDataFrame(out, FORWARD_SCHEMA)


# ---- the lasso path


def lasso_path(m: Moments) -> list[tuple[float, np.ndarray]]:
    """Knots ``(penalty, coefficients)`` of the lasso, from nothing to least squares, by least-angle steps.

    The objective is half the mean squared error plus ``penalty * sum |b_j|`` on columns of unit spread; coefficients
    are in the columns' own units. Between knots they are linear in the penalty.
    """
    p = len(m.mean) - 1
    spread = np.sqrt(np.diag(m.cross)[:p] / m.n)
    used = spread > 1e-12 * np.maximum(np.abs(m.mean[:p]), 1e-300)
    unit = np.where(used, spread, 1.0)
    gram, along = m.cross[:p, :p] / m.n / np.outer(unit, unit), m.cross[:p, p] / m.n / unit
    along = np.where(used, along, 0.0)
    b, active, sign, knots = np.zeros(p), [], {}, []
    level = float(np.abs(along).max(initial=0.0))
    blocked = {j for j in range(p) if not used[j]}
    for _ in range(8 * p + 8):
        knots.append((level, b / unit))
        if level <= 1e-12 * max(float(np.abs(along).max(initial=0.0)), 1e-300):
            break
        left = along - gram @ b
        for j in range(p):
            if j not in active and j not in blocked and abs(left[j]) >= level * (1 - 1e-9):
                trial = [*active, j]
                if np.linalg.cond(gram[np.ix_(trial, trial)]) > 1e12:
                    blocked.add(j)  # depends on columns that are in already
                else:
                    active, sign[j] = trial, math.copysign(1.0, left[j])
        if not active:
            break
        step = np.zeros(p)
        step[active] = np.linalg.solve(gram[np.ix_(active, active)], [sign[j] for j in active])
        drift = gram @ step  # the correlations fall by this for each unit the penalty falls
        fall, gone = level, None
        for j in range(p):
            if j in active:
                if step[j] * b[j] < 0 and -b[j] / step[j] < fall * (1 - 1e-12):
                    fall, gone = -b[j] / step[j], j
            elif j not in blocked:
                for top, bottom in ((level - left[j], 1 - drift[j]), (level + left[j], 1 + drift[j])):
                    if bottom > 1e-12 and 1e-12 * level < top / bottom < fall:
                        fall, gone = top / bottom, None
        b = b + fall * step
        level = max(level - fall, 0.0)
        if gone is not None:
            b[gone] = 0.0
            active = [j for j in active if j != gone]
    return knots


def lasso_at(knots: Sequence[tuple[float, np.ndarray]], penalty: float) -> np.ndarray:
    """The coefficients at a penalty between, above or below the knots."""
    for (high, b), (low, c) in zip(knots, knots[1:]):
        if low <= penalty <= high:
            share = (high - penalty) / (high - low) if high > low else 1.0
            return b + share * (c - b)
    return knots[0][1] if penalty > knots[0][0] else knots[-1][1]


@dataclass
class LinearFit:
    intercept: float
    coefficients: np.ndarray
    note: dict


def choose_lasso(m: Moments, criterion: str = "aic") -> LinearFit:
    """The knot with the lowest information criterion; the noise is estimated from least squares on all columns."""
    p, knots = len(m.mean) - 1, lasso_path(m)
    sse = [squared_error(m, float(m.mean[p] - b @ m.mean[:p]), b) for _, b in knots]
    rank = int((np.abs(knots[-1][1]) > 0).sum())
    noise = max(sse[-1] / max(m.n - rank - 1, 1.0), 1e-300)
    price = 2.0 if criterion == "aic" else math.log(max(m.n, 1.0))
    value = [s / noise + price * int((b != 0).sum()) for s, (_, b) in zip(sse, knots)]
    best = int(np.argmin(value))
    level, b = knots[best]
    return LinearFit(float(m.mean[p] - b @ m.mean[:p]), b, {"penalty": level, "criterion": value[best]})


# ---- robust regressions

#: Smallest residual that quantile regression weighs by its own size, in spreads of the least-squares residuals.
NEAR = 1e-4


def _linear(intercept: float, coef: Sequence[float], features: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for w, c in zip(coef, features)], F.lit(float(intercept)))


def weighted_moments(rows: DataFrame, columns: Sequence[str], weight: Column, centre: np.ndarray, *extra: Column):
    """Moments under row weights, in one aggregation round a fixed ``centre``, and the values of ``extra`` aggregates."""
    p = len(columns)
    z = [F.col(c) - F.lit(float(v)) for c, v in zip(columns, centre)]
    aggs = [F.sum("_w").alias("n"), *[F.sum(F.col("_w") * z[i]).alias(f"s_{i}") for i in range(p)]]
    aggs += [F.sum(F.col("_w") * z[i] * z[j]).alias(f"c_{i}_{j}") for i in range(p) for j in range(i, p)]
    r = rows.withColumn("_w", weight).agg(*aggs, *[e.alias(f"x_{i}") for i, e in enumerate(extra)]).first()
    n = float(r["n"] or 0.0)
    if not n:
        raise ValueError("no rows to fit")
    sums = np.array([r[f"s_{i}"] for i in range(p)])
    cross = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cross[i, j] = cross[j, i] = r[f"c_{i}_{j}"] - sums[i] * sums[j] / n
    return Moments(n, centre + sums / n, cross), [r[f"x_{i}"] for i in range(len(extra))]


def solve(m: Moments) -> tuple[float, np.ndarray]:
    coef = prefix_coefficients(m)[-1] if len(m.mean) > 1 else np.zeros(0)
    return float(m.mean[-1] - coef @ m.mean[:-1]), coef


def huber(df: DataFrame, features: Sequence[str], label: str, epsilon: float = 1.35, rounds: int = 50, tol: float = 1e-7) -> LinearFit:
    """Huber regression with its scale: squares up to ``epsilon`` scales from the line, absolute values beyond.

    Each round is one aggregation: moments with the weights that the last line gives, and what the scale needs.
    """
    columns = [*features, label]
    rows = cut_lineage(complete(df, columns))  # read once a round
    start = grouped_moments(rows, columns).get(None)
    if start is None or not start.n:
        raise ValueError("no rows to fit")
    intercept, coef = solve(start)
    scale = math.sqrt(squared_error(start, intercept, coef) / start.n)
    for step in range(rounds):
        if scale <= 1e-12 * max(math.sqrt(start.cross[-1, -1] / start.n), 1e-300):
            break
        left = F.col(label) - _linear(intercept, coef, features)
        inside = F.abs(left) <= epsilon * scale
        weight = F.when(inside, F.lit(1.0)).otherwise(epsilon * scale / F.abs(left))
        sums = (F.sum(F.when(inside, left * left)), F.count_if(~inside))
        m, (squares, out) = weighted_moments(rows, columns, weight, start.mean, *sums)
        new, coef_new = solve(m)
        free = start.n - epsilon * epsilon * out
        fresh = math.sqrt((squares or 0.0) / free) if free > 0 else scale / 2
        moved = max(abs(new - intercept), *(np.abs(coef_new - coef) * np.sqrt(np.diag(start.cross)[:-1] / start.n)), abs(fresh - scale))
        intercept, coef, scale = new, coef_new, fresh
        if moved <= tol * scale:
            break
    return LinearFit(intercept, coef, {"scale": scale, "rounds": step + 1})


def quantile_regression(df: DataFrame, features: Sequence[str], label: str, quantile: float = 0.5, rounds: int = 30, tol: float = 1e-5) -> LinearFit:
    """Quantile regression by reweighted moments; the intercept is at last the exact quantile of what is left.

    Without features that quantile is the whole answer.
    """
    columns = [*features, label]
    rows = complete(df, columns)
    rows = cut_lineage(rows) if features else rows  # read once a round
    coef = np.zeros(len(features))
    if features:
        start = grouped_moments(rows, columns)[None]
        intercept, coef = solve(start)
        spread = math.sqrt(squared_error(start, intercept, coef) / start.n)
        near = spread
        for _ in range(rounds):
            if spread <= 0:
                break
            near = max(near / 3, NEAR * spread)  # residuals below this count as this large
            left = F.col(label) - _linear(intercept, coef, features)
            weight = F.when(left >= 0, quantile).otherwise(1 - quantile) / F.greatest(F.abs(left), F.lit(near))
            m, _ = weighted_moments(rows, columns, weight, start.mean)
            new, coef_new = solve(m)
            moved = max(abs(new - intercept), *(np.abs(coef_new - coef) * np.sqrt(np.diag(start.cross)[:-1] / start.n)))
            intercept, coef = new, coef_new
            if moved <= tol * spread and near <= NEAR * spread:
                break
    left = {"left": F.col(label) - _linear(0.0, coef, features)}
    found = exact_quantiles(rows, left, [quantile])["left"][0]
    if found is None:
        raise ValueError("no rows to fit")
    return LinearFit(float(found), coef, {})


def consensus(df: DataFrame, features: Sequence[str], label: str, row_id: str, trials: int = 200, width: float | None = None, seed: int = 42) -> LinearFit:
    """The line with the most rows near it among ``trials`` lines through minimal samples, refitted on those rows.

    Samples are the rows with the smallest hashes: ``trials * (features + 1)`` of them, whatever the table. One scan counts
    the rows near each line; ``width`` is by default the median absolute deviation of the label.
    """
    columns, size = [*features, label], len(features) + 1
    rows = complete(df, columns, F.col(row_id).alias("_id"))
    if width is None:
        middle = exact_quantiles(rows, [label], [0.5])[label][0]
        width = exact_quantiles(rows, {"far": F.abs(F.col(label) - F.lit(middle))}, [0.5])["far"][0] if middle is not None else 0.0
    drawn = rows.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(trials * size).select(*columns).collect()
    values = np.array([list(r) for r in drawn], dtype=float).reshape(-1, size)
    lines = []
    for part in values[: len(values) // size * size].reshape(-1, size, size):
        design = np.column_stack([np.ones(size), part[:, :-1]])
        if np.linalg.cond(design) < 1e12:
            lines.append(np.linalg.solve(design, part[:, -1]))
    if not lines:
        raise ValueError("no sample gives a line")
    stacked = np.array(lines).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, square = np.zeros(stacked.shape[1], np.int64), np.zeros(stacked.shape[1])
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            for a in range(0, len(values), 4096):
                x, y = values[a : a + 4096, :-1], values[a : a + 4096, -1:]
                left = np.abs(y - stacked[0] - x @ stacked[1:])
                near += (left <= width).sum(axis=0)
                square += np.where(left <= width, left * left, 0.0).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(len(near)), "n": near, "s": square})

    counted = rows.select(*columns).mapInPandas(run, "i int, n bigint, s double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = counted.orderBy(F.col("n").desc(), "s", "i").first()
    line = stacked[:, best["i"]]
    kept = rows.filter(F.abs(F.col(label) - _linear(line[0], line[1:], features)) <= width)
    intercept, coef = solve(grouped_moments(kept, columns)[None])
    return LinearFit(intercept, coef, {"near": int(best["n"]), "width": float(width)})


# ---- kernel regression


@dataclass
class KernelFit:
    """Random Fourier features of standardised columns, and a ridge fit on them."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    offset: float

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.cos((x - self.mean) / self.spread @ self.waves + self.phases) * math.sqrt(2 / len(self.phases))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.offset + self.features(x) @ self.weights


def spread_waves(width: int, waves: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal frequencies from a shifted additive sequence, each as a cosine and a sine.

    The sequence fills the cube evenly, so the kernel's estimate errs less than with independent draws.
    """
    half = -(-waves // 2)
    ratio = 2.0
    for _ in range(60):  # the root of x^(width + 1) = x + 1, whose powers make the sequence
        ratio = (1.0 + ratio) ** (1.0 / (width + 1))
    steps = ratio ** -np.arange(1.0, width + 1)
    points = (np.random.default_rng(seed).uniform(size=width) + np.outer(np.arange(1, half + 1), steps)) % 1.0
    quantile = NormalDist().inv_cdf
    ways = np.array([[quantile(min(max(v, 1e-12), 1 - 1e-12)) for v in row] for row in points.tolist()]).T
    return np.concatenate([ways, ways], axis=1)[:, :waves], np.r_[np.zeros(half), np.full(half, -math.pi / 2)][:waves]


def kernel_regression(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, gamma: float | None = None, waves: int = 256, seed: int = 42) -> KernelFit:
    """Kernel ridge regression with a Gaussian kernel ``exp(-gamma |x - z|^2)`` on standardised columns.

    The kernel is replaced by ``waves`` cosines and sines, whose products approach it, so one pass of second moments
    and one solve of that size do the work. ``gamma`` is by default one over the number of columns.
    """
    columns = [*features, label]
    rows = complete(df, columns)
    m = grouped_moments(rows, columns).get(None)
    if m is None or not m.n:
        raise ValueError("no rows to fit")
    spread = np.sqrt(np.diag(m.cross)[:-1] / m.n)
    spread = np.where(spread > 0, spread, 1.0)
    gamma = 1.0 / len(features) if gamma is None else gamma
    ways, phases = spread_waves(len(features), waves, seed)
    fit = KernelFit(m.mean[:-1], spread, ways * math.sqrt(2 * gamma), phases, np.zeros(waves), float(m.mean[-1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((waves, waves + 1))
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            for a in range(0, len(values), 4096):
                z = fit.features(values[a : a + 4096, :-1])
                gram[:, :waves] += z.T @ z
                gram[:, waves] += z.T @ (values[a : a + 4096, -1] - fit.offset)
        yield pd.DataFrame({"i": np.arange(waves), "line": [line.tobytes() for line in gram]})

    def total(part: pd.DataFrame) -> pd.DataFrame:
        line = np.sum([np.frombuffer(x) for x in part["line"]], axis=0)
        return pd.DataFrame({"i": part["i"].iloc[:1], "line": [line.tobytes()]})

    # a task sends one line per wave, and a wave's lines are summed together
    lines = rows.select(*columns).mapInPandas(run, "i int, line binary").groupBy("i").applyInPandas(total, "i int, line binary").collect()
    gram = np.zeros((waves, waves + 1))
    for r in lines:
        gram[r["i"]] = np.frombuffer(r["line"])
    fit.weights = np.linalg.solve(gram[:, :waves] + alpha * np.eye(waves), gram[:, waves])
    return fit


# ---- collinearity


def collinearity(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """``(column, vif, r2, group)``: variance inflation of each column by the others, and groups of collinear ones.

    ``vif`` is the diagonal of the inverse correlation matrix, ``1 / (1 - r2)`` of the regression on the others; NULL where
    that is exact or the column is constant. Columns whose correlation exceeds ``threshold`` in size are in one
    group, directly or over others; groups are numbered from 1 along ``columns``, and a column by itself has NULL.
    """
    m = grouped_moments(df, columns).get(None)
    p = len(columns)
    spread = np.sqrt(np.diag(m.cross)) if m is not None else np.zeros(p)
    live = [i for i in range(p) if spread[i] > 0]
    r = m.cross[np.ix_(live, live)] / np.outer(spread[live], spread[live]) if live else np.zeros((0, 0))
    vif: list[float | None] = [None] * p
    for place, i in enumerate(live):
        others = [j for j in range(len(live)) if j != place]
        share = float(r[place, others] @ np.linalg.lstsq(r[np.ix_(others, others)], r[others, place], rcond=1e-12)[0]) if others else 0.0
        vif[i] = 1.0 / (1.0 - share) if share < 1 - 1e-12 else None
    group = list(range(p))
    for a, i in enumerate(live):
        for b, j in enumerate(live[:a]):
            if abs(r[a, b]) > threshold and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    shared = sorted({g for g in group if group.count(g) > 1})
    rows = [(c, vif[i], None if vif[i] is None else 1 - 1 / vif[i], shared.index(group[i]) + 1 if group[i] in shared else None) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column string, vif double, r2 double, group int")
