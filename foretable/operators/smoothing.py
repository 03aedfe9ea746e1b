"""What one series at one origin needs inside a task: loess, seasonal-trend decomposition, exponential smoothing, theta. Numpy only;
models.per_series deals series out."""

from __future__ import annotations

import numpy as np

#: Points that loess smooths at once: bounds its memory at this many times the window.
CHUNK = 4096


def odd(x: float) -> int:
    """The least odd whole number not below x."""
    n = int(np.ceil(x))
    return n + 1 - n % 2


def loess(y: np.ndarray, window: int, weights: np.ndarray | None = None, beyond: int = 0) -> np.ndarray:
    """Local lines through evenly spaced points with tricube weights over the window nearest points, for every row of y (..., n), at
    every point and at beyond more on both sides. A window wider than the series widens the kernel by the half of what it lacks.
    weights: of the points, for robustness; where all are 0 within a window they are passed over."""
    n = y.shape[-1]
    rho = np.ones_like(y) if weights is None else weights
    reach, wider = min(window, n), max(window - n, 0) // 2
    out = []
    places = np.arange(-beyond, n + beyond)
    for at in np.array_split(places, -(-len(places) // CHUNK)):
        start = np.clip(at - reach // 2, 0, n - reach)
        near = start[:, None] + np.arange(reach)
        off = (near - at[:, None]).astype(float)
        span = np.maximum(np.abs(off).max(axis=1) + wider, 1)
        kernel = np.clip(1 - (np.abs(off) / (span[:, None] * 0.999)) ** 3, 0, None) ** 3
        kernel[np.abs(off) <= 0.001 * span[:, None]] = 1
        w = kernel * rho[..., near]
        total = w.sum(axis=-1, keepdims=True)
        w = np.where(total > 0, w / np.where(total > 0, total, 1), kernel / kernel.sum(axis=1, keepdims=True))
        values = y[..., near]
        centre = (w * off).sum(axis=-1)
        spread = (w * off * off).sum(axis=-1) - centre**2
        level = (w * values).sum(axis=-1)
        rise = (w * off * values).sum(axis=-1) - centre * level
        slope = np.where(np.sqrt(np.maximum(spread, 0)) > 0.001 * max(n - 1, 1), rise / np.where(spread > 0, spread, 1), 0.0)
        out.append(level - slope * centre)
    return np.concatenate(out, axis=-1)


def _moving(x: np.ndarray, width: int) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(x)])
    return (run[width:] - run[:-width]) / width


def stl(y: np.ndarray, season: int, window: int, robust: int = 0, inner: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(seasonal, trend) by loess: the values of each place in the season smoothed over the seasons with that window, less what of them
    is low-frequency; then the trend of the rest. robust: how often points are weighed again by their remainder (bisquare)."""
    n = len(y)
    trend, seasonal, rho = np.zeros(n), np.zeros(n), np.ones(n)
    trend_window, low_window = odd(1.5 * season / (1 - 1.5 / window)), odd(season)
    for outer in range(robust + 1):
        weighed = None if outer == 0 else rho
        for _ in range(inner):
            cycle = np.empty(n + 2 * season)
            rest = y - trend
            # places fall into two sorts by how many values they have: each sort is smoothed at once
            long = n % season
            for first, last in ((0, long), (long, season)):
                if first == last:
                    continue
                at = np.arange(first, last)[:, None] + season * np.arange(n // season + (first < long))
                cycle[np.concatenate([at[:, :1], at + season, at[:, -1:] + 2 * season], axis=1)] = loess(rest[at], window, None if weighed is None else rho[at], beyond=1)
            low = loess(_moving(_moving(_moving(cycle, season), season), 3), low_window)
            seasonal = cycle[season:-season] - low
            trend = loess(y - seasonal, trend_window, weighed)
        if outer < robust:
            left = np.abs(y - seasonal - trend)
            six = 6 * np.median(left)
            rho = np.ones(n) if six <= 0 else np.where(left <= 0.001 * six, 1.0, np.where(left < 0.999 * six, (1 - np.minimum(left / six, 1) ** 2) ** 2, 0.0))
    return seasonal, trend


def mstl(y: np.ndarray, seasons: tuple[int, ...], rounds: int = 2, robust: int = 0) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """y without its seasonal parts, and each of these. Seasons are taken from the shortest, several times over, each by stl on y
    without the others; windows are 11, 15, 19 ... seasons. Seasons of which y does not hold two are left out."""
    held = sorted(m for m in set(seasons) if len(y) >= 2 * m)
    parts = {m: np.zeros(len(y)) for m in held}
    rest = y.astype(float)
    for _ in range(rounds if len(held) > 1 else 1):
        for i, m in enumerate(held):
            rest = rest + parts[m]
            parts[m] = stl(rest, m, 11 + 4 * i, robust)[0]
            rest = rest - parts[m]
    return rest, parts


#: The forms of exponential smoothing: (multiplicative errors, trend, damped).
FORMS = ((False, False, False), (False, True, False), (False, True, True), (True, False, False), (True, True, False), (True, True, True))


def _paths(y: np.ndarray, times: np.ndarray, alpha: np.ndarray, beta: np.ndarray, phi: np.ndarray, level: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minus twice the likelihood, the last level and the last slope of many parameter sets, run side by side. times: whose errors
    are multiplicative; a forecast at or below 0 rules such a set out."""
    n, squares, logs, dead = len(y), np.zeros(len(alpha)), np.zeros(len(alpha)), np.zeros(len(alpha), bool)
    level, slope = level.copy(), slope.copy()
    for v in y:
        ahead = level + phi * slope
        dead |= times & (ahead <= 1e-8)
        ahead = np.where(dead, 1.0, ahead)
        e = v - ahead
        relative = np.where(times, e / ahead, e)
        squares += relative * relative
        logs += np.log(np.where(times, ahead, 1.0))
        level, slope = ahead + alpha * e, phi * slope + beta * e
    return np.where(dead, np.inf, n * np.log(np.maximum(squares, 1e-12)) + 2 * logs), level, slope


def ets(y: np.ndarray, horizon: int, passes: int = 5) -> np.ndarray:
    """Exponential smoothing without season: errors additive or multiplicative, no trend, a trend or a damped one, whichever has the
    least corrected information criterion (multiplicative errors only where all of y is above 0).

    Each form's likelihood is maximised over smoothing parameters and first states by a fixed cloud of points that closes in on its best
    one; all points of all forms of a pass run at once. beta lies below alpha, phi between 0.8 and 0.98. Fewer than four values: their mean."""
    n = len(y)
    if n < 4:
        return np.full(horizon, y.mean() if n else 0.0)
    head = y[: min(10, n)]
    rise, start = np.polyfit(np.arange(1, len(head) + 1), head, 1)
    scale = max(float(np.std(head)), 1e-6)
    forms = [f for f in FORMS if not f[0] or y.min() > 0]
    # one point: share of alpha, of beta below alpha, of phi, and the first level and slope, all between 0 and 1
    rng = np.random.default_rng(0)
    cube = rng.random((64, 5))
    cube[0] = (0.5, 0.1, 0.9, 0.5, 0.5)
    centre, reach, best = [cube[0]] * len(forms), 1.0, [None] * len(forms)
    for turn in range(passes):
        clouds = [cube if turn == 0 else np.vstack([centre[i][None], np.clip(centre[i] + reach * (cube - 0.5), 0, 1)]) for i in range(len(forms))]
        size = len(clouds[0])
        u = np.vstack(clouds)
        times, trend, damped = (np.repeat([f[j] for f in forms], size) for j in range(3))
        alpha = 1e-4 + 0.9998 * u[:, 0]
        beta = np.where(trend, alpha * (1e-4 + 0.9998 * u[:, 1]), 0.0)
        phi = np.where(damped, 0.8 + 0.18 * u[:, 2], trend.astype(float))
        level = np.where(trend, start, head.mean()) + 2 * scale * (u[:, 3] - 0.5)
        slope = np.where(trend, rise + scale * (u[:, 4] - 0.5), 0.0)
        likely, last, tilt = _paths(y, times, alpha, beta, phi, level, slope)
        for i in range(len(forms)):
            j = i * size + int(np.argmin(likely[i * size : (i + 1) * size]))
            if best[i] is None or likely[j] < best[i][0]:
                best[i], centre[i] = (likely[j], last[j], tilt[j], phi[j]), u[j]
        reach *= 0.45
    counts = [3 + 2 * f[1] + f[2] for f in forms]  # smoothing parameters, first states and the variance
    criterion = [b[0] + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else np.inf) for b, k in zip(best, counts, strict=True)]
    _, last, tilt, phi = best[int(np.argmin(criterion))]
    return last + tilt * np.cumsum(phi ** np.arange(1, horizon + 1))


def mstl_ets_forecast(y: np.ndarray, season: int, horizon: int, seasons: tuple[int, ...] = (24,)) -> np.ndarray:
    """Several seasons taken out by loess, the rest smoothed exponentially, the last of each season put back; not below 0. season is the
    longest of them."""
    rest, parts = mstl(y, (*seasons, season))
    ahead = np.arange(horizon)
    return np.maximum(0.0, ets(rest, horizon) + sum((part[len(y) - m + ahead % m] for m, part in parts.items()), np.zeros(horizon)))


def seasonal_means(y: np.ndarray, season: int) -> np.ndarray:
    """The mean by place in the season of y less its centred moving mean, summing to 0; zeros where y does not hold two seasons or has
    no correlation over one season at the 90 % level."""
    n = len(y)
    e = y - y.mean()
    power = e @ e
    if n < 2 * season or season < 2 or power <= 0:
        return np.zeros(season)
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(e, size)
    r = np.fft.irfft(spectrum * np.conj(spectrum), size)[1 : season + 1] / power
    if abs(r[-1]) <= 1.645 * np.sqrt((1 + 2 * (r[:-1] ** 2).sum()) / n):
        return np.zeros(season)
    weights = np.ones(season + 1 - season % 2)
    if season % 2 == 0:
        weights[[0, -1]] = 0.5
    reach = len(weights) // 2
    off = y[reach : n - reach] - np.convolve(y, weights / weights.sum(), "valid")
    place = np.arange(reach, n - reach) % season
    means = np.bincount(place, off, season) / np.maximum(np.bincount(place, minlength=season), 1)
    return means - means.mean()


def running_lines(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base and slope of the least-squares line through the first 1, 2, ... values, over the times 1, 2, ... (of one value: itself, 0)."""
    t = np.arange(1.0, len(y) + 1)
    sums, moments = np.cumsum(y), np.cumsum(t * y)
    slope = 12 * (moments - (t + 1) / 2 * sums) / np.maximum(t * (t * t - 1), 1)
    slope[0] = 0.0
    return sums / t - slope * (t + 1) / 2, slope


def dynamic_theta(y: np.ndarray, horizon: int, passes: int = 4) -> np.ndarray:
    """The dynamic optimised theta model: a smoothed level and, to the part 1 - 1 / theta, the line through the values so far.

    Given the smoothing parameter, one-step forecasts are linear in the first level and in 1 - 1 / theta; both have a closed least-squares
    solution (the latter held within 0 and 1, theta at 1 or more), so only one parameter is searched, on a lattice that closes in.
    Forecasts further ahead take earlier ones as values. Fewer than three values: the last."""
    n = len(y)
    if n < 3:
        return np.full(horizon, y[-1] if n else 0.0)
    base, slope = running_lines(y)
    low, high, best = 0.01, 0.99, None
    for _ in range(passes):
        alphas = np.linspace(low, high, 21)
        keep = 1 - alphas
        # smoothed values from a first level of 0, before each time
        state, smooth = np.zeros(len(alphas)), np.empty((n, len(alphas)))
        for i, v in enumerate(y):
            smooth[i] = state
            state = alphas * v + keep * state
        i = np.arange(n)[:, None]
        decay = keep**i
        drift = decay * np.concatenate([[0.0], base[:-1]])[:, None] + (1 - decay * keep) / alphas * np.concatenate([[0.0], slope[:-1]])[:, None]
        drift[0] = 0.0  # nothing is known yet
        goal = y[:, None] - smooth
        aa, ab, bb, ag, bg = ((p * q).sum(axis=0) for p, q in ((decay, decay), (decay, drift), (drift, drift), (decay, goal), (drift, goal)))
        free = aa * bb - ab * ab
        part = np.clip(np.where(free > 1e-9 * aa * np.maximum(bb, 1e-300), (aa * bg - ab * ag) / np.where(free > 0, free, 1), 0.0), 0.0, 1.0)
        first = (ag - part * ab) / aa
        error = ((goal - first * decay - part * drift) ** 2).sum(axis=0)
        j = int(np.argmin(error))
        if best is None or error[j] < best[0]:
            best = (error[j], alphas[j], part[j], state[j] + first[j] * keep[j] ** n)
        step = (high - low) / 20
        low, high = max(0.001, best[1] - step), min(0.999, best[1] + step)
    _, alpha, part, level = best
    out, keep = np.empty(horizon), 1 - alpha
    a, b, total, moment = base[-1], slope[-1], float(y.sum()), float((np.arange(1, n + 1) * y).sum())
    for h in range(horizon):
        t = n + h
        out[h] = level + part * (keep**t * a + (1 - keep ** (t + 1)) / alpha * b)
        level = alpha * out[h] + keep * level
        total, moment, t = total + out[h], moment + (t + 1) * out[h], t + 1.0
        b = 12 * (moment - (t + 1) / 2 * total) / (t * (t * t - 1))
        a = total / t - b * (t + 1) / 2
    return out


def theta_forecast(y: np.ndarray, season: int, horizon: int) -> np.ndarray:
    """dynamic_theta on y without its seasonal means, which are put back; not below 0."""
    means = seasonal_means(y, season)
    n = len(y)
    return np.maximum(0.0, dynamic_theta(y - means[np.arange(n) % season], horizon) + means[np.arange(n, n + horizon) % season])
