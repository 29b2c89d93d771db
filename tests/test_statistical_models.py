"""Local regression and seasonal ARIMA against plain forms."""

import numpy as np
import pytest
from ramify.operators import arima, loess, statistical


def plain_loess(y, at, span, degree, weights):
    """Local fits point by point."""
    out = []
    for x0 in at:
        distance = np.abs(np.arange(len(y)) - x0)
        width = np.sort(distance)[min(span, len(y)) - 1] + max(span - len(y), 0) // 2
        near = distance / width
        w = np.where(near < 0.999, (1 - near**3) ** 3, 0) * weights
        design = np.vander(np.arange(len(y)) - x0, degree + 1, increasing=True)
        root = np.sqrt(w)[:, None]
        out.append(np.linalg.lstsq(design * root, y * root[:, 0], rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize(("n", "span", "degree"), [(40, 11, 1), (40, 11, 0), (9, 15, 1), (60, 59, 1), (3, 11, 0)])
def test_smoothing_equals_a_loop_of_local_fits(n, span, degree):
    rng = np.random.default_rng(n)
    y = rng.normal(size=n) + np.arange(n) * 0.3
    for weights in (None, rng.random(n) + 0.1):
        got = loess.smooth(y, span, degree, weights, before=1, after=2)
        assert np.allclose(got, plain_loess(y, range(-1, n + 2), span, degree, np.ones(n) if weights is None else weights), atol=1e-8)
    both = np.column_stack([y, -2 * y])
    assert np.allclose(loess.smooth(both, span, degree)[:, 1], -2 * loess.smooth(y, span, degree))


def plain_stl(y, period, span, robust):
    """The decomposition with every smoother as a loop."""
    n, trend, weights = len(y), np.zeros(len(y)), np.ones(len(y))
    odd = lambda x: int(np.ceil(x)) + (int(np.ceil(x)) % 2 == 0)
    for _ in range(robust + 1):
        for _ in range(2):
            c = np.empty(n + 2 * period)
            for k in range(period):
                own = (y - trend)[k::period]
                c[k::period] = plain_loess(own, range(-1, len(own) + 1), span, 0, weights[k::period])
            low = c
            for length in (period, period, 3):
                low = np.convolve(low, np.ones(length) / length, mode="valid")
            seasonal = c[period : period + n] - plain_loess(low, range(n), odd(period), 1, np.ones(n))
            trend = plain_loess(y - seasonal, range(n), odd(1.5 * period / (1 - 1.5 / span)), 1, weights)
        rest = np.abs(y - seasonal - trend)
        weights = np.where(rest < 6 * np.median(rest), (1 - (rest / (6 * np.median(rest))) ** 2) ** 2, 0)
    return seasonal, trend


@pytest.mark.parametrize(("period", "span", "robust"), [(7, 11, 0), (7, 11, 2), (30, 15, 0)])
def test_decomposition_equals_the_plain_form(period, span, robust):
    rng = np.random.default_rng(3)
    t = np.arange(100)
    y = 50 + 0.1 * t + 8 * np.sin(2 * np.pi * t / period) + rng.normal(size=100)
    y[40] += 60
    got, want = loess.stl(y, period, span, robust), plain_stl(y, period, span, robust)
    assert np.allclose(got[0], want[0], atol=1e-7) and np.allclose(got[1], want[1], atol=1e-7)


def test_both_seasons_come_apart_and_are_repeated():
    rng, t = np.random.default_rng(0), np.arange(800)
    week, year = 10 * np.array([3, 1, 0, 0, -1, -2, -1]), 20 * np.sin(2 * np.pi * t / 365)
    y = 500 + week[t % 7] + year + rng.normal(0, 1, 800)
    parts, trend = loess.decompose(y, (7, 365))
    assert np.corrcoef(parts[7], week[t % 7])[0, 1] > 0.99 and np.corrcoef(parts[365], year)[0, 1] > 0.98
    assert abs((y - parts[7] - parts[365] - trend).mean()) < 0.2
    q = statistical.mstl(y[:786], 14, np.array([0.1, 0.5, 0.9]))
    assert np.abs(q[:, 1] - y[786:]).mean() < 4 and (np.diff(q, axis=1) > 0).all()
    assert loess.strength(y, 7) > 0.9 and loess.strength(rng.normal(size=300), 7) < 0.5


def dense_deviance(w, own, shocks):
    """Minus twice the Gaussian log-likelihood from the whole covariance matrix, by impulse responses."""
    n, long = len(w), 4000
    response = np.zeros(long)
    for j in range(long):
        response[j] = (1.0 if j == 0 else shocks[j - 1] if j <= len(shocks) else 0.0) + sum(own[k] * response[j - k - 1] for k in range(min(j, len(own))))
    lags = np.array([response[: long - k] @ response[k:] for k in range(n)])
    covariance = lags[np.abs(np.arange(n)[:, None] - np.arange(n))]
    variance = w @ np.linalg.solve(covariance, w) / n
    return n * (np.log(2 * np.pi * variance) + 1) + np.linalg.slogdet(covariance)[1], variance


@pytest.mark.parametrize("order", [(1, 1, 1, 1, True), (2, 0, 0, 1, False), (0, 3, 0, 0, True), (0, 0, 2, 1, True), (0, 0, 0, 0, True)])
def test_likelihood_equals_the_dense_gaussian(order):
    rng = np.random.default_rng(sum(order))
    own, shocks = arima.unfold(rng.normal(0, 0.5, sum(order[:4])), order)
    w = rng.normal(size=90)
    got, variance, _ = arima.kalman(w, own, shocks)
    want, plain = dense_deviance(w, own, shocks)
    assert got == pytest.approx(want, abs=1e-5) and variance == pytest.approx(plain, rel=1e-6)


def test_any_free_numbers_are_stationary_and_invertible():
    rng = np.random.default_rng(5)
    for _ in range(50):
        order = (*rng.integers(0, 4, 2).tolist(), *rng.integers(0, 3, 2).tolist(), True)
        own, shocks = arima.unfold(rng.normal(0, 2, sum(order[:4])), order)
        for tail in (-own, shocks):
            roots = np.roots(np.append(1.0, tail)[::-1]) if len(tail) else np.array([9.0])
            assert (np.abs(roots) > 1 - 1e-6).all()


def test_tests_choose_differences():
    rng, t = np.random.default_rng(1), np.arange(600)
    noise = rng.normal(size=600)
    assert arima.differences(noise) == () and arima.differences(np.cumsum(noise)) == (1,)
    assert arima.differences(noise + 9 * np.sin(2 * np.pi * t / 7)) == (7,)
    e = noise - noise.mean()
    lags = int(3 * np.sqrt(600) / 13)
    long = sum((1 - abs(k) / (lags + 1)) * sum(e[i] * e[i - k] for i in range(max(k, 0), 600 + min(k, 0))) for k in range(-lags, lags + 1)) / 600
    assert arima.kpss(noise) == pytest.approx((np.cumsum(e) ** 2).sum() / 600**2 / long)


def test_search_finds_a_seasonal_model_and_forecasts_it():
    rng = np.random.default_rng(4)
    e, w = rng.normal(size=1500), np.zeros(1500)
    for t in range(8, 1500):
        w[t] = 0.3 * w[t - 1] + e[t] + 0.5 * e[t - 7]
    w = w[300:] - w[300:].mean()
    order, free = arima.search(w, True)
    own, shocks = arima.unfold(free, order)
    deviance, variance, _ = arima.kalman(w, own, shocks)
    true = arima._aicc(arima.kalman(w, np.array([0.3]), np.array([0, 0, 0, 0, 0, 0, 0.5]))[0], (1, 0, 0, 1, True), 1200)
    assert arima._aicc(deviance, order, 1200) < true + 6 and variance == pytest.approx(1, abs=0.12)


def test_days_ahead_follow_the_recursion_of_the_chosen_model():
    rng = np.random.default_rng(7)
    for x in (50 + np.cumsum(rng.normal(size=300)), 50 + 5 * np.sin(2 * np.pi * np.arange(300) / 7) + rng.normal(size=300)):
        lags, order, own, shocks, mean, variance, _, _ = arima.fitted(x)
        out, deviation = arima.ahead(x, 14)
        w = [x]
        for lag in lags:
            w.append(w[-1][lag:] - w[-1][:-lag])
        e = np.zeros(len(w[-1]))
        own, shocks = np.append(own, 0), np.append(shocks, 0)
        for t in range(len(e)):
            past = sum(own[k] * (w[-1][t - k - 1] - mean) for k in range(min(t, len(own)))) + sum(shocks[k] * e[t - k - 1] for k in range(min(t, len(shocks))))
            e[t] = w[-1][t] - mean - past
        whole = np.convolve(np.append(1.0, -own), np.array([1.0]))
        for lag in lags:
            whole = np.convolve(whole, np.r_[1.0, np.zeros(lag - 1), -1.0])
        values, shock, psi = list(x), list(e), np.zeros(14)
        drift = mean * np.append(1.0, -own).sum()
        for j in range(14):
            values.append(drift - sum(whole[k] * values[-k] for k in range(1, len(whole))) + sum(shocks[k] * shock[-k - 1] for k in range(len(shocks))))
            shock.append(0.0)
            psi[j] = (1.0 if j == 0 else shocks[j - 1] if j <= len(shocks) else 0.0) - sum(whole[k] * psi[j - k] for k in range(1, min(j, len(whole) - 1) + 1))
        assert np.allclose(out, values[300:], atol=0.05) and np.allclose(deviation, np.sqrt(variance * np.cumsum(psi**2)))


def test_constant_and_short_windows_have_forecasts():
    for x in (np.full(200, 5.0), np.zeros(200), np.arange(200.0), np.tile([1.0, 2, 3, 4, 5, 6, 7], 30)):
        q = statistical.arima(x, 14, np.array([0.1, 0.5, 0.9]))
        assert q.shape == (14, 3) and np.isfinite(q).all() and (q >= 0).all()
    assert statistical.arima(np.arange(200.0), 3, np.array([0.5]))[:, 0] == pytest.approx([200, 201, 202], abs=0.5)
