"""Tables of counts of regions and the features made of them, for many regions at once.

Steps make a table of a buffer of cells (see :mod:`.slabs`); features are sums over the
rows of a table by region, of (g, columns, counts) with regions numbered from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

from . import slabs
from .slabs import NONE, Buffer, Table, same, summed
from .spatial import half_offsets

EPS = 2.2e-16
HALF = half_offsets("corner")

FIRST = ("energy", "total_energy", "entropy", "minimum", "percentile_10", "percentile_90", "maximum", "mean", "median", "interquartile_range", "range", "mean_absolute_deviation", "robust_mean_absolute_deviation", "root_mean_squared", "standard_deviation", "skewness", "kurtosis", "variance", "uniformity")
GLCM = ("autocorrelation", "joint_average", "cluster_prominence", "cluster_shade", "cluster_tendency", "contrast", "sum_squares", "difference_average", "difference_entropy", "difference_variance", "joint_energy", "joint_entropy", "idm", "idmn", "id", "idn", "inverse_variance", "maximum_probability", "sum_average", "sum_entropy", "correlation", "imc1", "imc2")
SIZE = ("small_emphasis", "large_emphasis", "low_level_emphasis", "high_level_emphasis", "small_low_emphasis", "small_high_emphasis", "large_low_emphasis", "large_high_emphasis", "level_variance", "size_variance", "size_entropy", "level_nonuniformity", "size_nonuniformity", "level_nonuniformity_normalized", "size_nonuniformity_normalized", "percentage")
NGTDM = ("coarseness", "contrast", "busyness", "complexity", "strength")
NAMES = {"firstorder": FIRST, "glcm": (*GLCM, "mcc"), "glrlm": SIZE, "glszm": SIZE, "gldm": SIZE, "ngtdm": NGTDM}


def pair_levels(b: Buffer) -> Table:
    """(g, direction, i, j, n), both ways."""
    level, cols = b.values["level"], []
    for k, o in enumerate(HALF):
        x, y = b.pairs(o, b.own)
        cols.append((b.g[x], np.full(len(x), k), level[x], level[y]))
    g, d, i, j = (np.concatenate(c) for c in zip(*cols, strict=True))
    twice = lambda v: np.concatenate([v, v])
    return summed([twice(g), twice(d), np.concatenate([i, j]), np.concatenate([j, i])])


def dependence(alpha: int = 0) -> Callable[[Buffer], Table]:
    """(g, level, size, n): cells by how many neighbours, themselves included, differ by at most alpha."""

    def step(b: Buffer) -> Table:
        level, near = b.values["level"], np.ones(len(b.g), np.int64)
        for o in HALF:
            x, y = b.pairs(o)
            like = (np.abs(level[x] - level[y]) <= alpha) & (level[x] != NONE) & (level[y] != NONE)
            near += np.bincount(x[like], minlength=len(near)) + np.bincount(y[like], minlength=len(near))
        return summed([b.g[b.own], level[b.own], near[b.own]])

    return step


def beside(b: Buffer) -> Table:
    """(g, level, n, s): cells with neighbours, and their summed distance from the neighbours' mean."""
    level = b.values["level"]
    met, known, total = (np.zeros(len(level)) for _ in range(3))
    for o in HALF:
        x, y = b.pairs(o)
        for p, q in ((x, y), (y, x)):
            seen = level[q] != NONE
            met += np.bincount(p, minlength=len(met))
            known += np.bincount(p[seen], minlength=len(met))
            total += np.bincount(p[seen], level[q[seen]], len(met))
    rows = b.own & (met > 0)
    mean = np.divide(total, known, out=np.zeros(len(total)), where=known > 0)
    away = np.where((known > 0) & (level != NONE), np.abs(level - mean), 0.0)
    return summed([b.g[rows], level[rows]], np.ones(rows.sum(), np.int64), away[rows])


def runs(b: Buffer) -> Table:
    """(g, direction, level, size, n): runs of one level along each direction; the length so far of those that go on stays with their last cell."""
    level, cols = b.values["level"], []
    before = b.state.get("run")
    lengths = np.zeros((len(b.g), len(HALF)), np.int64)
    for k, o in enumerate(HALF):
        x, y = b.pairs(o)
        on = same(b, x, y, "level")
        x, y = x[on], y[on]
        size = np.ones(len(b.g), np.int64)
        if before is not None:
            size[b.done] = before[b.done, k]
        jump = np.full(len(b.g), -1)
        new = b.own[y]
        jump[y[new]] = x[new]
        left = np.flatnonzero(jump >= 0)
        while len(left):
            size[left] += size[jump[left]]
            jump[left] = jump[jump[left]]
            left = left[jump[left] >= 0]
        ends = b.own.copy()
        ends[x] = False
        lengths[:, k] = size
        cols.append((b.g[ends], np.full(ends.sum(), k), level[ends], size[ends]))
    b.state["run"] = lengths
    return summed([np.concatenate(c) for c in zip(*cols, strict=True)])


def zones(connectivity: str = "corner", name: str = "level") -> Callable[[Buffer], Table]:
    """(g, level, size, n): cells of one level joined through neighbours, by their number; those that may go on stay with their cells."""
    offsets = half_offsets(connectivity)

    def step(b: Buffer) -> Table:
        n = len(b.g)
        seen = b.own | b.done
        links = []
        for o in offsets:
            x, y = b.pairs(o, seen)
            on = same(b, x, y, name) & seen[y]
            links.append((x[on], y[on]))
        weight = b.own.astype(np.int64)
        if (zone := b.state.get("zone")) is not None and b.done.any():
            rows = np.flatnonzero(b.done)
            _, first, inverse = np.unique(zone[rows], return_index=True, return_inverse=True)
            links.append((rows[first][inverse], rows))
            weight[rows[first]] += b.state["joined"][rows[first]]
        a, c = (np.concatenate(v) for v in zip(*links, strict=True))
        root = slabs.unite(n, a, c)
        size = np.bincount(root, weight, n).astype(np.int64)
        goes = np.zeros(n, bool)
        goes[root[b.kept]] = True
        ends = np.flatnonzero((root == np.arange(n)) & seen & ~goes)
        b.state["zone"], b.state["joined"] = np.where(b.kept, root + 1, 0), np.where(b.kept, size[root], 0)
        return summed([b.g[ends], b.values[name][ends], size[ends]])

    return step


def levels_of(b: Buffer) -> Table:
    return summed([b.g[b.own], b.values["level"][b.own]])


def values_of(name: str) -> Callable[[Buffer], Table]:
    """(g, bits, n) of the finite values."""

    def step(b: Buffer) -> Table:
        x = b.values[name]
        rows = b.own & np.isfinite(x)
        bits = np.where(x[rows] == 0, 0.0, x[rows]).view(np.int64)
        return b.g[rows], bits, np.ones(len(bits), np.int64)

    return step


def _by(n: int, at: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda w: np.bincount(at, w, n)


def _ids(*columns: np.ndarray) -> np.ndarray:
    """One number for each distinct row, below some small multiple of the rows."""
    code = np.zeros(len(columns[0]), np.int64)
    bound = 1
    for c in columns:
        low = int(c.min()) if len(c) else 0
        size = int(c.max()) - low + 1 if len(c) else 1
        if bound * size > 8 * len(code) + (1 << 16):
            code = np.unique(code, return_inverse=True)[1]
            c, low = np.unique(c, return_inverse=True)[1], 0
            bound, size = len(code) + 1, int(c.max(initial=0)) + 1
        code, bound = code * size + (c - low), bound * size
    return np.unique(code, return_inverse=True)[1] if bound > 8 * len(code) + (1 << 16) else code


def _share(ids: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.bincount(ids, w)[ids] if len(ids) else w


def _segments(n: int, g: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's (region, direction), and the regions of those."""
    code = g * len(HALF) + d
    there = np.zeros(n * len(HALF), bool)
    there[code] = True
    number = np.cumsum(there) - 1
    return number[code], np.flatnonzero(there) // len(HALF)


def _mean(n: int, at: np.ndarray, found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    count = np.bincount(at, minlength=n)
    return {k: np.bincount(at, v, n) / np.maximum(count, 1) for k, v in found.items()}


def _level(table: Table, *columns: int) -> Table:
    keep = np.ones(len(table[0]), bool)
    for c in columns:
        keep &= table[c] != NONE
    return tuple(c[keep] for c in table)


def glcm_features(n: int, table: Table, top: np.ndarray) -> dict[str, np.ndarray]:
    g, direction, i, j, count = _level(table, 2, 3)
    s, region = _segments(n, g, direction)
    m = len(region)
    of = _by(m, s)
    q = count / of(count)[s]
    ng = top[g].astype(float)
    i, j = i.astype(float), j.astype(float)
    mu = of(i * q)
    k = np.abs(i - j)
    px, py, pd, ps = (_share(_ids(s, c.astype(np.int64)), q) for c in (i, j, k, i + j))
    mean_away = of(k * q)
    mu_r = mu[s]
    c = i + j - 2 * mu_r
    information = lambda x: of(-q * np.log2(x + EPS))
    most = np.zeros(m)
    np.maximum.at(most, s, q)
    var = of((i - mu_r) ** 2 * q)
    h, hx, hxy1 = information(q), information(px), information(px * py)
    cov = of((i - mu_r) * (j - mu_r) * q)
    found = {
        "autocorrelation": of(i * j * q), "joint_average": mu, "cluster_prominence": of(c**4 * q), "cluster_shade": of(c**3 * q), "cluster_tendency": of(c * c * q), "contrast": of(k * k * q), "sum_squares": var,
        "difference_average": mean_away, "difference_entropy": information(pd), "difference_variance": of((k - mean_away[s]) ** 2 * q), "joint_energy": of(q * q), "joint_entropy": h,
        "idm": of(q / (1 + k * k)), "idmn": of(q / (1 + k * k / (ng * ng))), "id": of(q / (1 + k)), "idn": of(q / (1 + k / ng)), "inverse_variance": of(np.divide(q, k * k, out=np.zeros(len(q)), where=k > 0)),
        "maximum_probability": most, "sum_average": of((i + j) * q), "sum_entropy": information(ps),
        "correlation": np.where(var > 0, cov / (var + EPS), 1.0), "imc1": np.divide(h - hxy1, hx, out=np.zeros(m), where=hx != 0), "imc2": np.sqrt(np.maximum(1 - np.exp(-2 * (2 * hx - h)), 0.0)),
    }
    return _mean(n, region, found)


def correlation_features(n: int, table: Table) -> dict[str, np.ndarray]:
    """The root of the second largest eigenvalue of the levels' transition products; tables of as many levels are solved together."""
    g, direction, i, j, count = _level(table, 2, 3)
    s, region = _segments(n, g, direction)
    width = int(max(i.max(initial=0), j.max(initial=0))) + 2 if len(i) else 1
    names = np.unique(np.concatenate([g * width + i, g * width + j])) if len(i) else np.zeros(0, np.int64)
    owner = names // width
    size = np.bincount(owner, minlength=n)
    base = np.cumsum(size) - size
    a, b = np.searchsorted(names, g * width + i) - base[g], np.searchsorted(names, g * width + j) - base[g]
    found = np.ones(len(region))
    order = np.argsort(s, kind="stable")
    edge = np.searchsorted(s[order], np.arange(len(region) + 1))
    for width in np.unique(size[region]):
        if width < 2:
            continue
        which = np.flatnonzero(size[region] == width)
        step = max(1, (1 << 22) // int(width) ** 2)
        for x in range(0, len(which), step):
            some = which[x : x + step]
            rows = order[_spans(edge[some], edge[some + 1])]
            slot = np.repeat(np.arange(len(some)), edge[some + 1] - edge[some])
            p = np.zeros((len(some), width, width))
            p[slot, a[rows], b[rows]] = count[rows]
            p /= p.sum((1, 2), keepdims=True)
            px, py = p.sum(2), p.sum(1)
            # sum over k of p_ik p_jk / (px_i py_k + EPS)
            q = (p / (px[:, :, None] * py[:, None, :] + EPS)) @ p.transpose(0, 2, 1)
            values = np.sort(np.linalg.eigvals(q).real, 1)
            found[some] = np.sqrt(np.maximum(values[:, -2], 0.0))
    return _mean(n, region, {"mcc": found})


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    size = high - low
    return np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def size_features(n: int, g: np.ndarray, level: np.ndarray, size: np.ndarray, count: np.ndarray, cells: np.ndarray) -> dict[str, np.ndarray]:
    of = _by(n, g)
    w = count.astype(float)
    total = np.maximum(of(w), 1e-300)
    x, s = level.astype(float), size.astype(float)
    mean = lambda v: of(v * w) / total
    p = w / total[g]
    gg, ss = x * x, s * s
    even = lambda c: of(w * _share(_ids(g, c), w)) / total
    by_level, by_size = even(level), even(size)
    return {
        "small_emphasis": mean(1 / ss), "large_emphasis": mean(ss), "low_level_emphasis": mean(1 / gg), "high_level_emphasis": mean(gg), "small_low_emphasis": mean(1 / (ss * gg)), "small_high_emphasis": mean(gg / ss), "large_low_emphasis": mean(ss / gg), "large_high_emphasis": mean(ss * gg),
        "level_variance": mean(gg) - mean(x) ** 2, "size_variance": mean(ss) - mean(s) ** 2, "size_entropy": of(-p * np.log2(p + EPS)), "level_nonuniformity": by_level, "size_nonuniformity": by_size,
        "level_nonuniformity_normalized": by_level / total, "size_nonuniformity_normalized": by_size / total, "percentage": total / np.maximum(cells, 1),
    }


def run_features(n: int, table: Table) -> dict[str, np.ndarray]:
    g, direction, level, size, count = _level(table, 2)
    s, region = _segments(n, g, direction)
    cells = np.bincount(s, size * count, len(region))
    return _mean(n, region, size_features(len(region), s, level, size, count, cells))


def beside_features(n: int, table: Table) -> dict[str, np.ndarray]:
    g, level, count, s = _level(table, 1)
    of = _by(n, g)
    order = np.argsort(g, kind="stable")
    g, level, count, s = g[order], level[order].astype(float), count[order].astype(float), s[order]
    own = np.bincount(g, minlength=n)
    base = np.cumsum(own) - own
    of = _by(n, g)
    p = count / of(count)[g]
    # each level of a region with each
    a = np.repeat(np.arange(len(g)), own[g])
    b = _spans(base[g], base[g] + own[g])
    on = _by(n, g[a])
    d = level[a] - level[b]
    c, busy, x, t = on(p[a] * p[b] * d * d), on(np.abs(level[a] * p[a] - level[b] * p[b])), on(np.abs(d) * (p[a] * s[a] + p[b] * s[b]) / (p[a] + p[b])), on((p[a] + p[b]) * d * d)
    ps, total, many, k = of(p * s), of(s), np.maximum(of(count), 1), own.astype(float)
    zero = np.zeros(n)
    return {
        "coarseness": np.minimum(np.divide(1, ps, out=np.full(n, 1e6), where=ps > 0), 1e6), "contrast": np.divide(c, k * (k - 1), out=zero.copy(), where=k > 1) * total / many,
        "busyness": np.divide(ps, busy, out=zero.copy(), where=busy != 0), "complexity": x / many, "strength": np.divide(t, total, out=zero.copy(), where=total != 0),
    }


def first_features(n: int, table: Table, bin_width: float) -> dict[str, np.ndarray]:
    g, bits, count = table
    x = bits.view(np.float64)
    order = np.lexsort((x, g))
    g, x, w = g[order], x[order], count[order].astype(float)
    of = _by(n, g)
    many = of(w)
    safe = np.maximum(many, 1)
    mean = of(x * w) / safe
    before = np.cumsum(w)
    start = np.concatenate([[0.0], before])[np.searchsorted(g, np.arange(n))]
    rank = before - start[g]  # of the last of equal values

    def percentile(share: float) -> np.ndarray:
        at = (safe - 1) * share
        low, high = np.floor(at), np.ceil(at)
        key = g + (rank - 0.5) / (safe[g] + 1)  # rises within a region
        pick = lambda r: x[np.minimum(np.searchsorted(key, np.arange(n) + (r + 0.5) / (safe + 1) - 0.25 / (safe + 1)), len(x) - 1)] if len(x) else np.zeros(n)
        a, b = pick(low), pick(high)
        return np.where(a == b, a, (high - at) * a + (at - low) * b)

    q10, q25, q50, q75, q90 = (percentile(s) for s in (0.1, 0.25, 0.5, 0.75, 0.9))
    d = x - mean[g]
    moment = lambda v: of(v * w) / safe
    m2, m3, m4, mad = moment(d * d), moment(d**3), moment(d**4), moment(np.abs(d))
    near = (x >= q10[g]) & (x <= q90[g])
    inner = np.maximum(of(w * near), 1)
    middle = of(x * w * near) / inner
    robust = of(np.abs(x - middle[g]) * w * near) / inner
    level = np.floor(x / bin_width).astype(np.int64)
    lg, _, lw = summed([g, level], w) if len(g) else (g, level, w)
    p = lw / safe[lg]
    at = _by(n, lg)
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, g, x)
    np.maximum.at(high, g, x)
    energy = of(x * x * w)
    there = m2 > 0
    return {
        "energy": energy, "total_energy": energy, "entropy": at(-p * np.log2(p + EPS)), "minimum": low, "percentile_10": q10, "percentile_90": q90, "maximum": high, "mean": mean, "median": q50, "interquartile_range": q75 - q25, "range": high - low,
        "mean_absolute_deviation": mad, "robust_mean_absolute_deviation": robust, "root_mean_squared": np.sqrt(energy / safe), "standard_deviation": np.sqrt(m2),
        "skewness": np.divide(m3, m2**1.5, out=np.zeros(n), where=there), "kurtosis": np.divide(m4, m2 * m2, out=np.zeros(n), where=there), "variance": m2, "uniformity": at(p * p),
    }


#: The tables that a family is made of.
NEEDS = {"firstorder": ("values",), "glcm": ("pairs", "levels"), "mcc": ("pairs",), "glrlm": ("runs",), "glszm": ("zones", "levels"), "gldm": ("dependence", "levels"), "ngtdm": ("beside",)}


def steps(families: Sequence[str], value: str) -> dict[str, tuple[Callable[[Buffer], Table], int]]:
    every = {"values": (values_of(value), 2), "pairs": (pair_levels, 4), "levels": (levels_of, 2), "runs": (runs, 4), "zones": (zones(), 3), "dependence": (dependence(), 3), "beside": (beside, 2)}
    wanted = {t for f in families for t in NEEDS[f]}
    return {name: step for name, step in every.items() if name in wanted}


def features(n: int, alone: np.ndarray, found: dict[str, Table], families: Sequence[str], bin_width: float, prefix: bool = True) -> dict[str, pa.Array]:
    """Columns of the families' features of n regions; null where a region has no rows of a family, or no key."""
    out = {}
    cells = top = None
    if "levels" in found:
        g, level, count = found["levels"]
        cells = np.bincount(g, count, n)
        top = np.full(n, 1, np.int64)
        np.maximum.at(top, g, level)
    for family in families:
        table = found[NEEDS[family][0]]
        if family == "firstorder":
            part = first_features(n, table, bin_width)
        elif family == "glcm":
            part = glcm_features(n, table, top) | correlation_features(n, table)
        elif family == "mcc":
            part = correlation_features(n, table)
        elif family == "glrlm":
            part = run_features(n, table)
        elif family == "ngtdm":
            part = beside_features(n, table)
        else:
            part = size_features(n, *_level(table, 1), cells)
        there = np.zeros(n, bool)
        there[table[0]] = True
        lost = ~there | alone
        out |= {f"{family}_{k}" if prefix else k: pa.array(v, mask=lost) for k, v in part.items()}
    return out
