"""Loess against a fit of each row alone."""

import numpy as np
import pytest

from chartmill.operators import smoothing as S


def alone(x, y, k):
    """Fits of rows sorted by (x, y), each window found by moving it row by row."""
    out, low, k = [], 0, min(k, len(x))
    for i, q in enumerate(x):
        while low + k < len(x) and i > low and x[low + k] - q <= q - x[low]:
            low += 1
        far, seen = x[low : low + k] - q, y[low : low + k]
        reach = np.abs(far).max() or 1
        w = np.clip(1 - (np.abs(far) / reach) ** 3, 0, 1) ** 3
        mean = np.average(far, weights=w)
        spread = np.average((far - mean) ** 2, weights=w)
        slope = np.average((far - mean) * seen, weights=w) / spread if spread > 1e-9 else 0
        out.append(np.average(seen, weights=w) - slope * mean)
    return out


@pytest.mark.parametrize("k", [2, 7, 60])
def test_blocks_and_ties(spark, monkeypatch, k):
    monkeypatch.setattr(S, "BLOCK", 16)
    r = np.random.default_rng(k)
    rows = [(g, float(v), float(w)) for g, n in (("a", 300), (None, 90), ("b", 3), ("c", 1)) for v, w in zip(r.integers(0, 120, n), r.integers(0, 9, n))]
    rows += [("a", 50.0, 4.0)] * 100 + [("a", None, 1.0), ("a", 1.0, None), ("a", float("nan"), 1.0), ("b", float("inf"), 1.0)]
    got = S.loess(spark.createDataFrame(rows, "_x string, x double, y double"), "x", "y", ["_x"], k).collect()
    for g in ("a", None, "b", "c"):
        have = sorted((p[1], p[2]) for p in rows if p[0] == g and p[1] is not None and p[2] is not None and np.isfinite(p[1]))
        x, y = np.array(have).T
        want = sorted(zip(x, alone(x, y, k)))
        mine = sorted((p.x, p.loess) for p in got if p._x == g)
        assert len(mine) == len(want) and np.allclose(mine, want, atol=1e-6)


def test_none(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert S.loess(df, "x", "y", [], 5).collect() == []
    with pytest.raises(ValueError):
        S.loess(df, "x", "y", [], 1)
