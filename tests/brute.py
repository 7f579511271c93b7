"""Plain versions to hold results against."""

import math

import numpy as np

from vintage_jobs.jobs.fits import approximate_p


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, float(e @ e), np.linalg.pinv(x.T @ x)


def _adf_design(y: np.ndarray, lags: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(y)
    rows = np.arange(first, len(d))
    return np.column_stack([y[rows], np.ones(len(rows)), *(d[rows - j] for j in range(1, lags + 1))]), d[rows]


def unit_root_p(values: np.ndarray) -> float | None:
    """p-value of the augmented Dickey-Fuller test with a constant, lags by AIC; null where it cannot be run."""
    y = np.asarray(values, float)
    y = y[~np.isnan(y)]
    if len(y) < 25 or len(np.unique(y)) <= 2:
        return None
    y = (y - y.mean()) / y.std()  # no result depends on the unit, but the cutoff of an inverse would
    most = min(math.ceil(12 * (len(y) / 100) ** 0.25), len(y) // 2 - 2)
    best = None
    for p in range(most + 1):
        x, d = _adf_design(y, p, most)
        _, rss, _ = _least_squares(x, d)
        aic = len(d) * math.log(max(rss, 1e-300) / len(d)) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, p)
    x, d = _adf_design(y, best[1], best[1])
    b, rss, inverse = _least_squares(x, d)
    scale = rss / (len(d) - x.shape[1]) * inverse[0, 0]
    return approximate_p(b[0] / math.sqrt(scale)) if scale > 0 else None


def expected_losses(y: np.ndarray, d: int = 1, h: float = 0.2, min_train: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """At each position, the value expected from those before it by weighted least squares on explicit rows, and its deviation."""
    mu, sigma = np.full(len(y), np.nan), np.full(len(y), np.nan)
    for n in range(max(min_train, 30, d + 10), len(y)):
        rows, weights = [], []
        for t in range(d + 1, n + 1):
            u = (t / n - 1) / h
            if u > -1 + 1e-12:
                rows.append((t / n - 1, y[t - 1], [1.0, *(y[t - 1 - j] for j in range(1, d + 1))]))
                weights.append(0.75 * (1 - u * u) / h)
        if len(rows) < max(10, 3 * (d + 1)):
            continue

        def level(x, target, w):
            x = np.array(x)
            return np.linalg.solve(x.T @ (x * w[:, None]) + 1e-10 * np.eye(x.shape[1]), x.T @ (target * w))

        w, own = np.array(weights), np.array([r[1] for r in rows])
        rho = level([x + [a * v for v in x] for a, _, x in rows], own, w)[: d + 1]
        rest = own - np.array([x for *_, x in rows]) @ rho
        variance = level([[1.0, a] for a, *_ in rows], rest**2, w)[0]
        mu[n] = rho[0] + sum(rho[j] * y[n - j] for j in range(1, d + 1))
        sigma[n] = math.sqrt(variance) if variance > 0 else 1e-3
    return mu, sigma
