"""Small numeric fits for one group each. Spark builds, partitions and combines the groups (see fanout)."""

from __future__ import annotations

import math

import numpy as np


# ---- stationarity -------------------------------------------------------------------------------------------------


def unit_root_p(most: int, size: int, total: float, squares: float, a: np.ndarray, c: np.ndarray, s: np.ndarray, level: np.ndarray, head: np.ndarray, tail: np.ndarray) -> float | None:
    """p-value of the augmented Dickey-Fuller test with a constant, lags by AIC, from sums over a series' rows from ``most`` on.

    ``total`` and ``squares`` are of the level before each row; ``a``, ``c`` and ``s`` sum each lagged difference times the
    row's difference, times that level, and alone. ``level``, ``head`` are levels and differences of the first ``most`` rows,
    ``tail`` the last ``most`` differences. Products of two lags are those of the lag between them, but for both ends.
    """
    gram = np.empty((most + 3, most + 3))  # level, constant, differences of lag 1 to most, the row's difference
    place = [most + 2, *range(2, most + 2)]
    gram[:2, :2] = [[squares, total], [total, size]]
    for i in range(most + 1):
        gram[0, place[i]] = gram[place[i], 0] = c[i]
        gram[1, place[i]] = gram[place[i], 1] = s[i]
        for j in range(i, most + 1):
            k, at = j - i, most - i
            ends = head[at:] @ head[at - k : most - k] - tail[at:] @ tail[at - k : most - k]
            gram[place[i], place[j]] = gram[place[j], place[i]] = a[k] + ends
    if not np.isfinite(gram).all():
        return None

    def solved(g: np.ndarray, lags: int) -> tuple[float, float, float]:
        """Coefficient of the level, its entry in the inverse, and the squared residuals."""
        unit = np.sqrt(np.maximum(np.diag(g), 1e-300))
        x = g / np.outer(unit, unit)
        inverse = np.linalg.pinv(x[: lags + 2, : lags + 2], rcond=1e-13, hermitian=True)
        b = inverse @ x[: lags + 2, -1]
        return b[0] * unit[-1] / unit[0], inverse[0, 0] / unit[0] ** 2, max(1 - b @ x[: lags + 2, -1], 0.0) * unit[-1] ** 2

    lags = min(range(most + 1), key=lambda p: size * math.log(max(solved(gram, p)[2], 1e-300) / size) + 2 * (p + 2))
    for r in range(lags, most):
        row = np.concatenate(([level[r], 1.0], head[r - lags : r][::-1], np.zeros(most - lags), [head[r]]))
        gram += np.outer(row, row)
    slope, inverse, rss = solved(gram, lags)
    scale = rss / (size + most - lags - lags - 2) * inverse
    return approximate_p(slope / math.sqrt(scale)) if scale > 0 else None


def unit_root_p_from_running(n: int, level: np.ndarray, head: np.ndarray, tail: np.ndarray, a: np.ndarray, c: np.ndarray, s: np.ndarray, total: float, squares: float) -> float | None:
    """``unit_root_p`` of the first ``n`` values of a series, from sums over all its rows so far.

    ``level`` and ``head`` are of the first rows of the series, ``tail`` the last differences, newest first. The sums that
    ``unit_root_p`` wants leave the first ``most`` rows out.
    """
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    level, head = np.asarray(level[:most], float), np.asarray(head[:most], float)
    inner = np.array([np.asarray(x[: most + 1], float) for x in (a, c, s)])
    for r in range(most):
        for k in range(r + 1):
            inner[:, k] -= head[r] * head[r - k], level[r] * head[r - k], head[r - k]
    last = np.asarray(tail[:most], float)[::-1]
    return unit_root_p(most, n - 1 - most, total - level.sum(), squares - level @ level, *inner, level, head, last)


def approximate_p(t: float) -> float:
    """MacKinnon's response surface for the constant case. Fixed values from the published tables."""
    if t > 2.74:
        return 1.0
    if t < -18.83:
        return 0.0
    z = 2.1659 + 1.4412 * t + 0.038269 * t**2 if t <= -1.61 else 1.7339 + 0.93202 * t - 0.12745 * t**2 - 0.010368 * t**3
    return 0.5 * math.erfc(-z / math.sqrt(2))


# ---- seasonal adjustment ------------------------------------------------------------------------------------------


def _loess(y: np.ndarray, span: int, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Local linear regression on equally spaced points, tricube weights, evaluated at ``at``."""
    n = len(y)
    x = np.arange(n, dtype=float)
    gap = np.abs(at[:, None] - x[None, :])
    k = min(span, n)
    width = np.partition(gap, k - 1, axis=1)[:, k - 1] * (max(span / n, 1.0))
    width = np.maximum(width, 1.0) * (1 + 1e-9)
    w = np.clip(1 - (gap / width[:, None]) ** 3, 0, None) ** 3 * weights[None, :]
    total = w.sum(axis=1)
    flat = total <= 0
    w[flat] = 1.0 / n
    total = w.sum(axis=1)
    centre = (w @ x) / total
    mean = (w @ y) / total
    dx = x[None, :] - centre[:, None]
    spread = (w * dx * dx).sum(axis=1)
    slope = np.where(spread > 1e-12, (w * dx * y[None, :]).sum(axis=1) / np.where(spread > 1e-12, spread, 1), 0)
    return mean + slope * (at - centre)


def _moving(y: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(y, np.ones(k) / k, "valid")


def seasonal_part(y: np.ndarray, period: int = 12, seasonal: int = 13, inner: int = 2, outer: int = 15) -> np.ndarray:
    """The seasonal part of a robust decomposition by local regressions."""
    n = len(y)
    trend_span = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
    trend_span += 1 - trend_span % 2
    low_span = period + 1 - period % 2
    robust, trend, season = np.ones(n), np.zeros(n), np.zeros(n)
    for _ in range(outer + 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            free = y - trend
            for phase in range(period):
                idx = np.arange(phase, n, period)
                cycle[phase :: period][: len(idx) + 2] = _loess(free[idx], seasonal, robust[idx], np.arange(-1, len(idx) + 1, dtype=float))
            low = _loess(_moving(_moving(_moving(cycle, period), period), 3), low_span, np.ones(n), np.arange(n, dtype=float))
            season = cycle[period : period + n] - low
            trend = _loess(y - season, trend_span, robust, np.arange(n, dtype=float))
        rest = np.abs(y - season - trend)
        scale = 6 * np.median(rest)
        if scale <= 0:
            break
        robust = np.clip(1 - (rest / scale) ** 2, 0, None) ** 2
    return season


def adjusted(values: np.ndarray, least: int = 36) -> np.ndarray:
    """Values less their seasonal part, by position of the known ones; too short or failing series stay."""
    out = np.array(values, float)
    known = ~np.isnan(out)
    if known.sum() >= least:
        part = seasonal_part(out[known])
        if np.isfinite(part).all():
            out[known] -= part
    return out


# ---- forecast selection -------------------------------------------------------------------------------------------


def expected_loss(grams: np.ndarray, n: int, lags: np.ndarray, h: float) -> tuple[float, float]:
    """The loss difference expected after ``n`` of them, and its deviation, by a one-sided local linear autoregression.

    ``grams[k]`` is the sum over the kernel's span of t^k v v', t = 1..n, v = (own, 1, lags before it); ``lags`` are the last
    differences, newest first. With a = t / n - 1 the kernel is 3/4 (1 - a^2/h^2) / h, so all weighted sums follow from the
    moments of a, and the squared residuals of the second regression are a quadratic form of the same sums.
    """
    shifted = [sum(math.comb(m, k) * (-1.0) ** (m - k) * grams[k] / float(n) ** k for k in range(m + 1)) for m in range(5)]
    w = [0.75 / h * (shifted[m] - shifted[m + 2] / h**2) for m in range(3)]

    def at_end(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Level part of a local linear fit, from weighted sums of the regressors and with the target."""
        both = np.block([[left[0], left[1]], [left[1], left[2]]])
        return np.linalg.solve(both + 1e-10 * np.eye(len(both)), np.concatenate(right))[: len(left[0])]

    rho = at_end([x[1:, 1:] for x in w], [x[1:, 0] for x in w[:2]])
    residual = np.concatenate(([1.0], -rho))
    variance = at_end([x[1:2, 1:2] for x in w], [np.array([residual @ x @ residual]) for x in w[:2]])[0]
    return float(rho[0] + rho[1:] @ lags), math.sqrt(variance) if np.isfinite(variance) and variance > 0 else math.sqrt(1e-6)


# ---- boosted trees ------------------------------------------------------------------------------------------------


class Stump:
    """A regression tree of small depth; splits minimise squared error."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int, split: int, features: int | None, rng: np.random.Generator):
        self.value, self.column = float(y.mean()), None
        if depth == 0 or len(y) < max(split, 2 * leaf):
            return
        columns = np.arange(x.shape[1]) if features is None or features >= x.shape[1] else rng.choice(x.shape[1], features, replace=False)
        order = np.argsort(x[:, columns], axis=0, kind="stable")
        ordered = np.take_along_axis(x[:, columns], order, axis=0)
        left = np.cumsum(y[order], axis=0)[:-1]
        n = np.arange(1, len(y))[:, None]
        gain = left**2 / n + (y.sum() - left) ** 2 / (len(y) - n)
        gain[(ordered[1:] <= ordered[:-1]) | (n < leaf) | (len(y) - n < leaf)] = -np.inf
        if gain.size == 0 or gain.max() <= y.sum() ** 2 / len(y) + 1e-12:
            return
        row, col = np.unravel_index(int(gain.argmax()), gain.shape)
        self.column, self.cut = int(columns[col]), float((ordered[row, col] + ordered[row + 1, col]) / 2)
        low = x[:, self.column] <= self.cut
        self.low = Stump(x[low], y[low], depth - 1, leaf, split, features, rng)
        self.high = Stump(x[~low], y[~low], depth - 1, leaf, split, features, rng)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.column is None:
            return np.full(len(x), self.value)
        low = x[:, self.column] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def boosted_forecast(x: np.ndarray, y: np.ndarray, new: np.ndarray, lag_column: int | None, rounds: int = 3000, rate: float = 0.02, depth: int = 2, leaf: int = 10, split: int = 20, subsample: float = 0.6, features: str | None = "sqrt", share: float = 0.1, patience: int = 50, largest: float = 0.5, seed: int = 0) -> tuple[float, int, list[float]]:
    """Forecast for the row ``new``, trees kept, and training errors: trees fitted to the residuals of a lag regression.

    The last ``share`` of the rows is held out; without a gain of 1e-5 there for ``patience`` rounds, the trees after the
    best round are dropped. If that never happens all trees stay.
    """
    held = max(1, math.floor(len(y) * share)) if share > 0 else 0
    if held and len(y) - held < 5:
        raise ValueError("too few rows are left to train on")
    n = len(y) - held
    kept = ~np.isnan(x[:n]).all(axis=0)
    lag = int(kept[:lag_column].sum()) if lag_column is not None and kept[lag_column] else None
    x, new = x[:, kept], new[kept]
    means = np.nan_to_num(np.nanmean(x[:n], axis=0)) if x.shape[1] else np.zeros(0)
    x = np.vstack([x, new[None, :]])
    x = np.where(np.isnan(x), means, x)
    train, target = x[:n], y[:n]
    if lag is not None:
        b, *_ = np.linalg.lstsq(np.column_stack([np.ones(n), train[:, lag]]), target, rcond=None)
        fitted = b[0] + b[1] * x[:, lag]
    else:
        fitted = np.full(len(x), target.mean())
    width = max(1, int(math.sqrt(x.shape[1]))) if features == "sqrt" else None
    rng = np.random.default_rng(seed)
    best, best_at, best_new, errors = np.inf, 0, fitted[-1], [float(np.mean((target - fitted[:n]) ** 2))]
    if held:
        best = float(np.mean((y[n:] - fitted[n:-1]) ** 2))
    made = 0
    for made in range(1, rounds + 1):
        pick = np.arange(n) if subsample >= 1 else rng.choice(n, min(n, max(2 * leaf, math.floor(subsample * n))), replace=False)
        tree = Stump(train[pick], (target - fitted[:n])[pick], depth, leaf, split, width, rng)
        fitted = fitted + np.clip(rate * tree.predict(x), -largest, largest)
        errors.append(float(np.mean((target - fitted[:n]) ** 2)))
        if held:
            now = float(np.mean((y[n:] - fitted[n:-1]) ** 2))
            if now < best - 1e-5:
                best, best_at, best_new = now, made, fitted[-1]
            elif made - best_at >= patience:
                return float(best_new), best_at, errors
    return float(fitted[-1]), made, errors


# ---- dynamic factor models ----------------------------------------------------------------------------------------
#
# Batches of panels of one shape, y[item, period, series] with NaN where a cell is missing. The state holds the factors of a
# period and of the p before it, so one smoothed moment has all that the regressions of factors on their past need.


def smoothed(y: np.ndarray, mu: np.ndarray, loading: np.ndarray, noise: np.ndarray, blocks: np.ndarray, drawn: np.ndarray, spread: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and variances of the states given all data, and log-likelihoods.

    ``blocks`` [item, r, r p] move the factors by those before, ``drawn`` [item, r, r] is the variance of what is new. A
    variance filter runs forwards and the recursion of score and information backwards, which inverts no predicted variance.
    As cell noise is independent, a period's data enter as information of the factors' size; the rest of the state is only
    handed on.
    """
    (n, length, _), r, past = y.shape, loading.shape[2], blocks.shape[2]
    m = r + past
    seen = ~np.isnan(y)
    w = seen / noise[:, None, :]
    left = np.where(seen, y - mu[:, None, :], 0.0)
    info = np.einsum("btn,bnr,bns->tbrs", w, loading, loading, optimize=True)
    pull = np.einsum("btn,bnr->tbr", w * left, loading)[..., None]
    move, one = blocks.transpose(0, 2, 1), np.eye(r)
    ahead, ahead_v = np.zeros((length, n, m, 1)), np.zeros((length, n, m, m))
    solved = np.zeros((length, n, r, r + 1))
    a, v = np.zeros((n, m, 1)), np.broadcast_to(np.eye(m) * spread, (n, m, m))
    for t in range(length):
        ahead[t, :, :r], ahead[t, :, r:] = blocks @ a[:, :past], a[:, :past]
        crossed = blocks @ v[:, :past, :past]
        ahead_v[t, :, :r, :r], ahead_v[t, :, :r, r:], ahead_v[t, :, r:, :r], ahead_v[t, :, r:, r:] = crossed @ move + drawn, crossed, crossed.transpose(0, 2, 1), v[:, :past, :past]
        a, v = ahead[t], ahead_v[t]
        rest = pull[t] - info[t] @ a[:, :r]
        solved[t] = np.linalg.solve(one + info[t] @ v[:, :r, :r], np.concatenate((info[t], rest), axis=2))
        wide = v[:, :, :r]
        both = wide @ solved[t]
        a, v = a + both[..., r:], v - both[..., :r] @ wide.transpose(0, 2, 1)
        v = (v + v.transpose(0, 2, 1)) / 2
    gain, score = solved[..., :r], solved[..., r:]
    near, near_v = ahead[:, :, :r], ahead_v[:, :, :r, :r]
    rest = pull - info @ near
    line = -0.5 * (seen.sum(axis=(1, 2)) * math.log(2 * math.pi) + (seen * np.log(noise)[:, None, :]).sum(axis=(1, 2)) + (w * left**2).sum(axis=(1, 2)) + np.linalg.slogdet(one + info @ near_v)[1].sum(axis=0))
    line += (pull * near - 0.5 * near * (info @ near) + 0.5 * rest * (near_v @ score)).sum(axis=(0, 2, 3))
    s, i = np.zeros((length, n, m, 1)), np.zeros((length, n, m, m))
    for t in range(length - 1, -1, -1):
        wide = ahead_v[t, :, :r]
        if t + 1 < length:
            q, k = s[t + 1], i[t + 1]
            s[t, :, :past] = move @ q[:, :r] + q[:, r:]
            top = move @ k[:, :r, r:]
            i[t, :, :past, :past] = move @ k[:, :r, :r] @ blocks + top + top.transpose(0, 2, 1) + k[:, r:, r:]
            s[t, :, :r] -= gain[t] @ (wide @ s[t])
            x = gain[t] @ (wide @ i[t])
            i[t, :, :r] -= x
            i[t, :, :, :r] -= x.transpose(0, 2, 1)
            i[t, :, :r, :r] += x @ wide.transpose(0, 2, 1) @ gain[t]
        s[t, :, :r] += score[t]
        i[t, :, :r, :r] += gain[t]
    mean, variance = ahead + ahead_v @ s, ahead_v - ahead_v @ i @ ahead_v
    return mean[..., 0].transpose(1, 0, 2), variance.transpose(1, 0, 2, 3), line


def settled(blocks: np.ndarray, most: float = 0.995) -> np.ndarray:
    """Autoregressions drawn in where they would explode: their largest root becomes ``most``."""
    n, r, past = blocks.shape
    whole = np.zeros((n, past, past))
    whole[:, :r], whole[:, r:, : past - r] = blocks, np.eye(past - r)
    root = np.abs(np.linalg.eigvals(whole)).max(axis=1)
    return blocks * np.minimum(1.0, most / np.maximum(root, 1e-12))[:, None, None] ** np.repeat(np.arange(1, past // r + 1), r)


def factor_models(y: np.ndarray, periods: np.ndarray, r: int, p: int, most: int = 40, tol: float = 1e-4) -> dict[str, np.ndarray]:
    """Factor models with autoregressive factors by expectation-maximisation, one for each item of a batch.

    ``periods`` is how many periods of each item exist; later ones hold no data and enter no sum. Every step is made of
    sums of products over periods: each series' intercept and loadings from the expected moments of (1, factors) where it
    is seen, the autoregression from those of the state. An item stops when its log-likelihood changes by less than
    ``tol`` of its size. Returns states, loadings, intercepts, autoregressions, log-likelihoods, their first and whether it converged.
    """
    n, length, width = y.shape
    seen, z = ~np.isnan(y), np.nan_to_num(y)
    count = seen.sum(axis=1)
    pairs = np.einsum("btn,btm->bnm", seen, seen, dtype=float, optimize=True)
    cov = np.einsum("btn,btm->bnm", z, z, optimize=True) / np.maximum(pairs, 1)
    value, vector = np.linalg.eigh(cov)
    loading = vector[:, :, ::-1][:, :, :r] * np.sqrt(np.maximum(value[:, ::-1][:, None, :r], 1e-3))
    noise = np.maximum(np.einsum("bnn->bn", cov) - (loading**2).sum(axis=2), 0.1)
    mu = np.zeros((n, width))
    blocks, innovation = np.zeros((n, r, r * p)), np.tile(0.5 * np.eye(r), (n, 1, 1))
    blocks[:, :, :r] = 0.7 * np.eye(r)
    exists = (np.arange(length)[None, :] < periods[:, None]).astype(float)
    enough = count >= r + 3
    first, last, converged = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, bool)
    todo = np.arange(n)
    for _ in range(most):
        mean, variance, line = smoothed(y[todo], mu[todo], loading[todo], noise[todo], blocks[todo], innovation[todo])
        first[todo] = np.where(np.isnan(first[todo]), line, first[todo])
        size = (np.abs(line) + np.abs(last[todo])) / 2
        done = np.abs(line - last[todo]) < tol * size
        last[todo] = line
        converged[todo[done]] = True
        todo, mean, variance = todo[~done], mean[~done], variance[~done]
        if not len(todo):
            break
        moment = mean[..., :, None] * mean[..., None, :] + variance
        g = np.concatenate((np.ones((*mean.shape[:2], 1)), mean[..., :r]), axis=2)
        gg = g[..., :, None] * g[..., None, :]
        gg[..., 1:, 1:] = moment[..., :r, :r]
        squares = np.einsum("btn,btq->bnq", seen[todo].astype(float), gg.reshape(*gg.shape[:2], -1), optimize=True).reshape(len(todo), width, r + 1, r + 1)
        crossed = np.einsum("btn,btg->bng", z[todo], g, optimize=True)
        fitted = np.linalg.solve(squares + 1e-8 * np.eye(r + 1), crossed[..., None])[..., 0]
        rest = ((z[todo] ** 2).sum(axis=1) - (fitted * crossed).sum(axis=2)) / np.maximum(count[todo], 1)
        good = enough[todo]
        mu[todo] = np.where(good, fitted[..., 0], mu[todo])
        loading[todo] = np.where(good[..., None], fitted[..., 1:], loading[todo])
        noise[todo] = np.where(good, np.maximum(rest, 1e-4), noise[todo])
        total = np.einsum("bt,btij->bij", exists[todo], moment)
        now, cross, past = total[:, :r, :r], total[:, :r, r:], total[:, r:, r:]
        a = settled(np.linalg.solve(past + 1e-8 * np.eye(r * p), cross.transpose(0, 2, 1)).transpose(0, 2, 1))
        half = a @ cross.transpose(0, 2, 1)
        blocks[todo], drawn = a, (now - half - half.transpose(0, 2, 1) + a @ past @ a.transpose(0, 2, 1)) / periods[todo][:, None, None]
        innovation[todo] = (drawn + drawn.transpose(0, 2, 1)) / 2 + 1e-6 * np.eye(r)
    mean, _, line = smoothed(y, mu, loading, noise, blocks, innovation)
    return {"state": mean, "loading": loading, "mu": mu, "noise": noise, "blocks": blocks, "innovation": innovation, "loglik": line, "first": first, "converged": converged}
