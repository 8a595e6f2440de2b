"""The fit of operator 10 against a plain solver of the same objective, written with dense matrices."""

import numpy as np
import pytest

from lanewise.llm import toxicity as T


def objective(x, y, gap, times, w, b, cf):
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    z = x @ w + b
    loss = (share * (np.logaddexp(0, z) - y * z)).sum()
    swaps = cf * (times * (gap @ w) ** 2).sum() / times.sum() if len(times) else 0.0
    return loss + T.L2 / 2 * (w @ w) + T.L1 * np.abs(w).sum() + swaps


def plain_fit(x, y, gap, times, cf, steps=60_000):
    """Proximal gradient descent with a small fixed step."""
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    full = np.c_[x, np.ones(len(y))]
    curve = np.linalg.norm((full.T * (share / 4)) @ full, 2) + T.L2
    dear = 2 * cf * times / times.sum() if len(times) else times
    if len(times):
        curve += np.linalg.norm((gap.T * dear) @ gap, 2)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        r = share * (1 / (1 + np.exp(-(x @ w + b))) - y)
        g = x.T @ r + T.L2 * w + (gap.T @ (dear * (gap @ w)) if len(times) else 0.0)
        w = w - g / curve
        w, b = np.sign(w) * np.maximum(np.abs(w) - T.L1 / curve, 0), b - r.sum() / curve
    return w, b


@pytest.mark.parametrize("cf", [0.0, 1.0, 30.0])
def test_fit_is_the_plain_solvers(cf):
    rng = np.random.default_rng(9)
    n, d, m = 120, 12, 15
    x = (rng.random((n, d)) < 0.3).astype(float)
    truth = rng.standard_normal(d) * 2
    y = (x @ truth + rng.standard_normal(n) > 0.3).astype(float)
    losses, gains = (rng.random((m, d)) < 0.2).astype(float), (rng.random((m, d)) < 0.2).astype(float)
    times = rng.integers(1, 9, m).astype(float)
    places = lambda a: tuple(v.astype(np.int32) for v in np.nonzero(a))
    known = np.arange(100, 100 + d, dtype=np.int64)
    model = T._solve(y, places(x), places(gains), places(losses), times, known, cf)
    w = np.array([model.weights.get(int(k), 0.0) for k in known])
    plain, b = plain_fit(x, y, gains - losses, times, cf)
    ours, best = (objective(x, y, gains - losses, times, v, c, cf) for v, c in ((w, model.bias), (plain, b)))
    assert ours <= best + 1e-5 * max(1, best)
    assert np.abs(w - plain).max() < 0.02 * max(1, np.abs(plain).max()) and abs(model.bias - b) < 0.02 * max(1, abs(b))
    size = np.abs((gains - losses) @ w).mean()
    assert cf == 0 or size < np.abs((gains - losses) @ plain_fit(x, y, gains - losses, times, 0.0, 20_000)[0]).mean()


def test_fit_without_swaps_and_with_one_class():
    y = np.array([1.0, 0.0, 1.0])
    none = (np.zeros(0, np.int32), np.zeros(0, np.int32))
    own = (np.array([0, 2], np.int32), np.array([0, 0], np.int32))
    model = T._solve(y, own, none, none, np.zeros(0), np.array([5], np.int64), 1.0)
    plain, b = plain_fit(np.array([[1.0], [0.0], [1.0]]), y, np.zeros((0, 1)), np.zeros(0), 1.0)
    assert abs(model.weights.get(5, 0.0) - plain[0]) < 0.05 * max(1, abs(plain[0])) and abs(model.bias - b) < 0.05 * max(1, abs(b))
    assert T._solve(np.ones(4), none, none, none, np.zeros(0), np.array([5], np.int64), 1.0) == T.Model(float(np.log(4.5 / 0.5)))
