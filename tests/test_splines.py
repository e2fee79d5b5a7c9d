"""Cubic and monotone interpolation against plain solves of each line."""

import frames
import numpy as np
import pytest

from gridverify.operators import grid, splines


def axis(spark, values):
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(values)], "i INT, c DOUBLE")


def cubic(x, y, t):
    """Not-a-knot spline by a dense system of the pieces' coefficients; few points: their polynomial."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    order = np.argsort(x)
    x, y, n = x[order], y[order], len(x)
    if n < 5:
        return np.array([np.polyval(np.polyfit(x - x[0], y, n - 1), v - x[0]) if x[0] <= v <= x[-1] else np.nan for v in t])
    a, b, row = np.zeros((4 * (n - 1), 4 * (n - 1))), np.zeros(4 * (n - 1)), 0
    powers = lambda h, d: [[h**3, h**2, h, 1], [3 * h**2, 2 * h, 1, 0], [6 * h, 2, 0, 0], [6, 0, 0, 0]][d]
    for k in range(n - 1):
        for h, v in ((0.0, y[k]), (x[k + 1] - x[k], y[k + 1])):
            a[row, 4 * k : 4 * k + 4], b[row], row = powers(h, 0), v, row + 1
    for k in range(n - 2):
        for d in (1, 2, *([3] if k in (0, n - 3) else [])):
            a[row, 4 * k : 4 * k + 4] = powers(x[k + 1] - x[k], d)
            a[row, 4 * k + 4 : 4 * k + 8] = -np.array(powers(0.0, d))
            row += 1
    found = np.linalg.solve(a, b).reshape(-1, 4)
    out = []
    for v in t:
        k = min(max(np.searchsorted(x, v) - 1, 0), n - 2)
        out.append(np.polyval(found[k], v - x[k]) if x[0] <= v <= x[-1] else np.nan)
    return np.array(out)


def pchip(x, y, t):
    x, y = np.asarray(x, float), np.asarray(y, float)
    order = np.argsort(x)
    x, y, n = x[order], y[order], len(x)
    h, m = np.diff(x), np.diff(y) / np.diff(x)
    d = np.zeros(n)

    def end(h0, h1, m0, m1):
        s = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        if np.sign(s) != np.sign(m0):
            return 0.0
        return 3 * m0 if np.sign(m0) != np.sign(m1) and abs(s) > 3 * abs(m0) else s

    if n == 2:
        d[:] = m[0]
    elif n > 2:
        d[0], d[-1] = end(h[0], h[1], m[0], m[1]), end(h[-1], h[-2], m[-1], m[-2])
        for k in range(1, n - 1):
            if m[k - 1] * m[k] > 0:
                w0, w1 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                d[k] = (w0 + w1) / (w0 / m[k - 1] + w1 / m[k])
    out = []
    for v in t:
        if not x[0] <= v <= x[-1]:
            out.append(np.nan)
        elif v in x:
            out.append(y[np.flatnonzero(x == v)[0]])
        else:
            k = np.searchsorted(x, v) - 1
            s = (v - x[k]) / h[k]
            basis = [(1 + 2 * s) * (1 - s) ** 2, s * (1 - s) ** 2 * h[k], s * s * (3 - 2 * s), s * s * (s - 1) * h[k]]
            out.append(np.dot(basis, [y[k], d[k], y[k + 1], d[k + 1]]))
    return np.array(out)


PLAIN = {"cubic": cubic, "pchip": pchip}


def on_grid(method, lats, lons, values, new_lats, new_lons):
    """Longitudes first, then latitudes."""
    rows = np.array([PLAIN[method](lons, v, new_lons) for v in values])
    return np.array([PLAIN[method](lats, c, new_lats) if np.isfinite(c).all() else np.full(len(new_lats), np.nan) for c in rows.T]).T


@pytest.mark.parametrize("method", ["cubic", "pchip"])
@pytest.mark.parametrize(("lats", "lons"), [(7, 12), (5, 4), (4, 3), (2, 60), (1, 100)])
def test_regrid_equals_plain(spark, method, lats, lons):
    draw = np.random.default_rng(lats * lons)
    lat, lon = 40 + np.cumsum(draw.uniform(0.2, 1, lats)), 10 + np.cumsum(draw.uniform(0.2, 1, lons))
    lat = lat[::-1]  # falling along the grid
    values = draw.normal(size=(lats, lons)).round(1)
    new_lat = np.concatenate((lat[:1], draw.uniform(lat.min() - 0.5, lat.max() + 0.5, 7), lat[-1:]))
    new_lon = np.concatenate((draw.uniform(lon.min() - 0.5, lon.max() + 0.5, 12), lon[:3]))
    found = grid.regrid(frames.field(spark, values), frames.cells(spark, lat, lon), frames.cells(spark, new_lat, new_lon), method=method)
    expected = on_grid(method, lat, lon, values, new_lat, new_lon)
    assert np.allclose(frames.array(found), expected, atol=1e-9, equal_nan=True)
    assert np.isfinite(expected).any()


@pytest.mark.parametrize("method", ["cubic", "pchip"])
def test_split_axis_equals_unsplit(spark, monkeypatch, method):
    draw = np.random.default_rng(7)
    source, target = np.cumsum(draw.uniform(0.1, 2, 400)), draw.uniform(-1, 420, 150)
    find = splines.cubic_axis if method == "cubic" else splines.pchip_axis
    names = ["target_i", "source_i", "weight", "corners"] if method == "cubic" else ["target_i", "source_i", "role", "corners", "t", "x0", "x1", "x2", "x3"]
    rows = lambda bounds: sorted(map(tuple, find(axis(spark, source), axis(spark, target), bounds).select(*names).collect()), key=lambda r: r[:2])
    whole = rows(None)
    monkeypatch.setattr(splines, "RANGE_ROWS", 50)
    split = rows([source[0], *np.quantile(source, [0.1, 0.35, 0.5, 0.8]).tolist(), source[-1]])
    assert [r[:2] for r in whole] == [r[:2] for r in split]
    assert np.allclose(np.array([r[2:] for r in whole], float), np.array([r[2:] for r in split], float), atol=1e-12, equal_nan=True)
    if method == "cubic":
        y = draw.normal(size=400)
        found = np.full(150, np.nan)
        for t, s, w, _ in whole:
            if w is not None:
                found[t] = np.nansum([found[t], w * y[s]])
        assert np.allclose(found, cubic(source, y, target), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("method", ["cubic", "pchip"])
def test_missing_values(spark, method):
    """A missing value blanks what it has weight for, and no more."""
    values = np.arange(36.0).reshape(6, 6) ** 1.5
    values[2, 4] = np.nan
    lat = lon = np.arange(6.0)
    new = np.array([0.0, 0.5, 1.0, 3.0, 4.5])
    found = frames.array(grid.regrid(frames.field(spark, values), frames.cells(spark, lat, lon), frames.cells(spark, new, new), method=method))
    blank = np.isnan(found)
    if method == "cubic":
        # Rows on a source row other than the missing one need that row alone; so do columns.
        assert not blank[[0, 2, 3]].any() and not blank[:, [0, 2, 3]].any() and blank[1, 1] and blank[4, 4]
    else:
        # Within two coordinates on either axis, but for targets on a coordinate.
        assert blank[1, 4] and not blank[0].any() and not blank[:, :3].any() and not blank[3].any()
    with pytest.raises(ValueError):
        grid.regrid(frames.field(spark, values), frames.cells(spark, lat, lon), frames.cells(spark, new, new), method="other")
