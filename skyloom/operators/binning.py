"""Bins of a redshift column and their robust summaries.

Edges are few numbers on the driver (at most ``MAX_EDGES``); assignment is a Column expression; the summary is one
aggregation. Two conventions exist for the number of bins and for errors of small bins: ``main`` and ``report``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.quantiles import IN_MEMORY, exact_quantiles, quantile_column, quantile_list

MAX_EDGES = 1000
#: Rows with distinct redshifts up to which Bayesian blocks are computed (16 bytes a row and one core on the driver); more are refused.
MAX_BLOCK_ROWS = 5_000_000


def adaptive_bins(n: int, variant: str = "main") -> int:
    """Number of bins for ``n`` rows."""
    if variant == "main":
        return max(3, min(math.isqrt(n), n // 5, 20))
    pick = lambda steps, last: next((v for top, v in steps if n < top), last)
    per = pick(((100, 10), (300, 15), (1000, 20)), 25)
    cap = pick(((200, 12), (1000, 20), (5000, 35)), 50)
    return max(5, min(n // per, n // 8, cap))


def equal_width_edges(df: DataFrame, z: str, n: int) -> list[float]:
    lo, hi = df.agg(F.min(z), F.max(z)).first()
    return [] if lo is None else np.linspace(lo, hi, n + 1).tolist()


def quantile_edges(df: DataFrame, z: str, n: int) -> list[float]:
    """Edges of ``n`` equal-count bins, repeated ones dropped."""
    return sorted(set(quantile_list(df, z, [i / n for i in range(n + 1)])))


def choose_edges(df: DataFrame, z: str, target: int = 25, least: int = 4, most: int = 10, method: str = "quantile") -> list[float]:
    """Edges with about ``target`` rows a bin. Raises on fewer than two values, no range, a bad target or method."""
    if method.lower().strip() not in ("quantile", "linear"):
        raise ValueError("method must be 'quantile' or 'linear'")
    rows = df.filter(F.col(z).isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf")))
    n, lo, hi = rows.agg(F.count(z), F.min(z), F.max(z)).first()
    if n < 2:
        raise ValueError("at least 2 redshifts are needed")
    if lo == hi:
        raise ValueError("the redshifts have no range")
    if target <= 0:
        raise ValueError("target must be positive")
    bins = max(2, min(max(n // target, least), most))
    edges = quantile_edges(rows, z, bins) if method.lower().strip() == "quantile" else []
    return edges if len(edges) >= 3 else np.linspace(lo, hi, bins + 1).tolist()


def assign_bin(z: Column, edges: list[float]) -> Column:
    """1-based bin of right-closed intervals, the first one closed on both sides; null outside and without edges."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    inner = F.lit(1) + sum(F.when(z > e, 1).otherwise(0) for e in edges[1:-1]) if len(edges) > 2 else F.lit(1)
    return F.when((z >= edges[0]) & (z <= edges[-1]), inner).cast("int")


def summarise(df: DataFrame, keys: list[str], z: str, theta: str, variant: str = "main") -> DataFrame:
    """``(keys, z_mid, theta_med, theta_err, theta_lo, theta_hi, n)`` per bin: medians, error of the median, 16 and 84 per cent.

    Bins with a null key, without a positive middle or without an error are left out. ``variant`` decides errors of bins
    with one or two rows: ``main`` gives 10 per cent of the value and half the range, ``report`` none.
    """
    rows = df.select(*keys, F.col(z).alias("_z"), F.col(theta).alias("_t")).dropna(subset=keys)
    n, ps = rows.count(), [0.5, 0.16, 0.84]
    sums = [F.count("_z").alias("n"), F.count("_t").alias("m"), F.stddev_samp("_t").alias("s"), F.min("_t").alias("a"), F.max("_t").alias("b")]
    if n <= IN_MEMORY:
        s = rows.groupBy(*keys).agg(*sums, quantile_column("_t", ps).alias("tq"), quantile_column("_z", [0.5]).alias("zq")).dropna(subset=["tq", "zq"])
    else:
        q = exact_quantiles(rows, keys, "_t", ps, known_rows=n).withColumnRenamed("q", "tq")
        zq = exact_quantiles(rows, keys, "_z", [0.5], known_rows=n).withColumnRenamed("q", "zq")
        s = rows.groupBy(*keys).agg(*sums).join(q, keys).join(zq, keys)
    big = 1.2533 * F.col("s") / F.sqrt("m")
    err = F.when(F.col("m") >= 3, big)
    if variant == "main":
        err = F.when(F.col("m") == 1, 0.1 * F.col("tq")[0]).when(F.col("m") == 2, (F.col("b") - F.col("a")) / 2.0).otherwise(err)
    many = lambda i: F.when(F.col("m") >= 2, F.col("tq")[i])
    out = s.select(*keys, F.col("zq")[0].alias("z_mid"), F.col("tq")[0].alias("theta_med"), err.alias("theta_err"), many(1).alias("theta_lo"), many(2).alias("theta_hi"), "n")
    return out.filter("z_mid > 0 and theta_med is not null and theta_err is not null and n > 0")


def block_edges(t: np.ndarray, x: np.ndarray, sigma: float, p0: float) -> np.ndarray:
    """Edges of the optimal piecewise-constant model of point measures ``x`` at ``t`` (dynamic programming over the last change point).

    With the last change at ``j`` and a level ``m``, the score is ``best[j] - prior + s m - w m m / 2``. Later points add the same to all, so
    only the ``j`` on the upper envelope over ``m`` can win later. Its pieces are kept (few, by experience), the others dropped without loss.

    Raises on repeated ``t``, as the measures are then no function of it, and on measures or a scatter without a finite score.
    """
    o = np.argsort(t, kind="stable")
    t, x = np.asarray(t, float)[o], np.asarray(x, float)[o]
    n = len(t)
    if n and (np.diff(t) == 0).any():
        raise ValueError("repeated positions")
    if not (n and np.isfinite(x).all() and sigma > 0):
        raise ValueError("no finite measures or no scatter")
    edges = np.concatenate([t[:1], (t[1:] + t[:-1]) / 2, t[-1:]])
    prior = 4 - math.log(73.53 * p0 * n**-0.478)
    cum_w = np.concatenate([[0.0], np.cumsum(np.full(n, 1 / sigma**2))])
    cum_x = np.concatenate([[0.0], np.cumsum(x / sigma**2)])
    best, last = np.zeros(n + 1), np.zeros(n, int)
    bottom, top = x.min() - sigma, x.max() + sigma
    change, lo, hi = np.zeros(1, int), np.array([bottom]), np.array([top])  # the pieces in order of the level
    for r in range(1, n + 1):
        w, s = cum_w[r] - cum_w[change], cum_x[r] - cum_x[change]
        fit = s * s / (2 * w) - prior + best[change]
        best[r] = fit.max()
        last[r - 1] = change[fit == best[r]].min()
        room = s * s - 2 * w * (best[r] - best[change])  # a change at r is better outside the roots
        root = np.sqrt(np.maximum(room, 0.0))
        a, b = np.maximum(lo, (s - root) / w), np.minimum(hi, (s + root) / w)
        keep = (room >= 0) & (a < b)
        k = int(keep.sum())
        ends = np.empty(2 * k + 2)
        ends[0], ends[1:-1:2], ends[2:-1:2], ends[-1] = bottom, a[keep], b[keep], top
        who = np.full(2 * k + 1, r)
        who[1::2] = change[keep]
        wide = ends[:-1] < ends[1:]
        change, lo, hi = who[wide], ends[:-1][wide], ends[1:][wide]
    cuts, at = [n], n
    while at:
        at = int(last[at - 1])
        cuts.append(at)
    return edges[np.array(cuts[::-1])]


def bayesian_edges(df: DataFrame, z: str, theta: str, p0: float = 0.05, variant: str = "main") -> list[float]:
    """Edges by Bayesian blocks with a robust scatter; equal widths where any two rows share a redshift. Raises on more than ``MAX_BLOCK_ROWS`` distinct ones."""
    rows = df.select(F.col(z).alias("z"), F.col(theta).alias("t")).dropna()
    n, lo, hi = rows.agg(F.count("z"), F.min("z"), F.max("z")).first()
    if not n:
        return []
    fallback = np.linspace(lo, hi, adaptive_bins(n, variant) + 1).tolist()
    if not rows.groupBy("z").count().filter("count > 1").isEmpty():
        return fallback
    if n > MAX_BLOCK_ROWS:
        raise ValueError(f"Bayesian blocks of {n} distinct redshifts; at most {MAX_BLOCK_ROWS}")
    got = rows.toArrow()
    zs, ts = got["z"].to_numpy(), got["t"].to_numpy()
    med = np.median(ts)
    sigma = max(np.median(np.abs(ts - med)) * 1.4826, 0.01 * med)
    try:
        edges = block_edges(zs, ts, sigma, p0)
        if len(edges) < 4:
            edges = np.linspace(lo, hi, 4)
        if len(edges) > 16:
            edges = block_edges(zs, ts, sigma, 0.2)
            if len(edges) > 16:
                edges = np.linspace(lo, hi, 12)
    except (ValueError, ZeroDivisionError):
        return fallback
    return np.asarray(edges).tolist()


def bin_catalog(df: DataFrame, strategy: str, z: str = "redshift", theta: str = "r_half_arcsec", variant: str = "main", n: int | None = None) -> DataFrame:
    """Bins of one of the strategies ``equal_width``, ``percentile``, ``bayesian_blocks`` with their summaries."""
    n = n or adaptive_bins(df.filter(F.col(z).isNotNull()).count(), variant)
    if strategy == "equal_width":
        edges = equal_width_edges(df, z, n)
    elif strategy == "percentile":
        edges = quantile_edges(df, z, n)
    elif strategy == "bayesian_blocks":
        edges = bayesian_edges(df, z, theta, variant=variant)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return summarise(df.withColumn("bin", assign_bin(F.col(z), edges)), ["bin"], z, theta, variant)


def histogram(df: DataFrame, value: str, lo: float, hi: float, n: int, keys: list[str] | None = None) -> DataFrame:
    """``(keys, bin, left, right, n)`` of ``n`` equal bins, left-closed, the last one closed on both sides; empty bins have no row."""
    keys = keys or []
    w = (hi - lo) / n
    v = F.col(value)
    b = F.least(F.floor((v - lo) / w), F.lit(n - 1)).cast("int")
    rows = df.filter((v >= lo) & (v <= hi) & ~F.isnan(v)).select(*keys, b.alias("bin"))
    return rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")).select(*keys, "bin", (F.col("bin") * w + lo).alias("left"), ((F.col("bin") + 1) * w + lo).alias("right"), "n")


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75])
    return q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, extremes, mean, median and sample deviation of the finite values per group."""
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    n = v.count()
    sums = [F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")]
    if n <= IN_MEMORY:
        return v.dropna(subset=keys).groupBy(*keys).agg(*sums, quantile_column(value, [0.5])[0].alias("median"))
    s = v.groupBy(*keys).agg(*sums)
    q = exact_quantiles(v, keys, value, [0.5], known_rows=n).select(*keys, F.col("q")[0].alias("median"))
    return s.join(q, keys) if keys else s.withColumn("one", F.lit(1)).join(q.withColumn("one", F.lit(1)), "one").drop("one")


def simple_bins(df: DataFrame, z: str, theta: str, err: str, n: int = 5) -> DataFrame:
    """Equal-width bins with root-mean-square errors and quartiles, the plain form of early analyses."""
    b = df.withColumn("bin", assign_bin(F.col(z), equal_width_edges(df, z, n))).filter("bin is not null")
    s = b.groupBy("bin").agg(F.count(theta).alias("n"), F.sqrt(F.avg(F.col(err) * F.col(err))).alias("rms_err"))
    q = exact_quantiles(b, ["bin"], theta, [0.25, 0.5, 0.75])
    m = exact_quantiles(b, ["bin"], z, [0.5]).select("bin", F.col("q")[0].alias("z_mid"))
    return s.join(q.select("bin", F.col("q")[0].alias("theta_lo"), F.col("q")[1].alias("theta_med"), F.col("q")[2].alias("theta_hi")), "bin").join(m, "bin")
