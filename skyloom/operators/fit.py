"""Cosmological models fitted to binned sizes."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.constants import ARCSEC_TO_RAD, OMEGA_M
from skyloom.functions.cosmology import angular_diameter_distance, distance_np, distance_static, theta_arcsec
from skyloom.operators.quantiles import exact_quantiles

#: Rows of a sample that the two-parameter fit accepts on the driver; it is meant for bins.
MAX_FIT_ROWS = 100_000


def chi2_survival(x: float, ndf: int) -> float:
    """Probability of a larger chi square at integer degrees of freedom; NaN without any."""
    if ndf <= 0 or not math.isfinite(x):
        return math.nan
    h = max(x, 0.0) / 2
    if ndf % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, ndf // 2):
            term *= h / k
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    for k in range(1, (ndf - 1) // 2 + 1):
        total += math.exp(-h + (k - 0.5) * math.log(h) - math.lgamma(k + 0.5)) if h > 0 else 0.0
    return total


@F.pandas_udf(T.DoubleType())
def _survival(x: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([chi2_survival(a, int(b)) if a == a and b == b else math.nan for a, b in zip(x, n)])


def usable_points(df: DataFrame, z: str, theta: str, err: str) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.filter(ok(z) & ok(theta) & ok(err) & (F.col(err) > 0))


def fit_radius(df: DataFrame, keys: list[str], z: str, theta: str, err: str, model: str = "lcdm", om: float = OMEGA_M) -> DataFrame:
    """``(keys, radius_mpc, n)``: weighted mean of the physical sizes of points at z >= 0.1, the plain median of all if there are fewer than two; null with fewer than two points. One row without keys."""
    if model not in ("lcdm", "static"):
        raise ValueError("model must be 'static' or 'lcdm'")
    p = usable_points(df, z, theta, err).withColumn("_z", F.greatest(F.col(z), F.lit(1e-6)))
    d = distance_static(F.col("_z")) if model == "static" else angular_diameter_distance(F.col("_z"), om)
    p = p.select(*keys, "_z", (F.col(theta) * ARCSEC_TO_RAD * d).alias("_r"), (1.0 / (F.col(err) * F.col(err))).alias("_w"))
    far = F.col("_z") >= 0.1
    s = p.groupBy(*keys).agg(F.sum(F.when(far, F.col("_w") * F.col("_r"))).alias("a"), F.sum(F.when(far, F.col("_w"))).alias("b"), F.count(F.when(far, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    m = exact_quantiles(p, keys, "_r", [0.5]).select(*keys, F.col("q")[0].alias("med"))
    j = s.join(m, keys, "left") if keys else s.withColumn("one", F.lit(1)).join(m.withColumn("one", F.lit(1)), "one", "left")
    radius = F.when(F.col("n") < 2, None).when(F.col("k") >= 2, F.col("a") / F.col("b")).otherwise(F.col("med"))
    return j.select(*keys, radius.alias("radius_mpc"), "n")


def chi2_stats(df: DataFrame, keys: list[str], theta: str, err: str, model: Column, n_params: int, p_value: bool = True) -> DataFrame:
    """``(keys, chi2, ndf, chi2_ndf, p_value)``; ratio and probability are null without degrees of freedom."""
    r = (F.col(theta) - model) / F.col(err)
    s = df.groupBy(*keys).agg(F.sum(r * r).alias("chi2"), (F.count(r) - n_params).cast("int").alias("ndf"))
    s = s.withColumn("chi2_ndf", F.when(F.col("ndf") > 0, F.col("chi2") / F.when(F.col("ndf") > 0, F.col("ndf"))))
    if p_value:
        p = _survival(F.col("chi2"), F.col("ndf").cast("double"))
        s = s.withColumn("p_value", F.when((F.col("ndf") > 0) & ~F.isnan(p), p))
    return s


def chi2_of(df: DataFrame, theta: str, err: str, model_func: Callable[[], Column], n_params: int) -> DataFrame:
    """``chi2_stats`` of a model given as a function that returns a Column."""
    return chi2_stats(df, [], theta, err, model_func(), n_params)


@dataclass(frozen=True)
class CosmologyFit:
    R_mpc: float
    Omega_L: float
    R_err: float
    Omega_L_err: float
    chi2_reduced: float
    p_value: float
    n_points: int

    @property
    def Omega_m(self) -> float:
        return 1.0 - self.Omega_L

    @property
    def Omega_m_err(self) -> float:
        return self.Omega_L_err

    @property
    def R_kpc(self) -> float:
        return self.R_mpc * 1000.0

    @property
    def R_kpc_err(self) -> float:
        return self.R_err * 1000.0

    def row(self) -> dict[str, float]:
        return {**self.__dict__, "Omega_m": self.Omega_m, "Omega_m_err": self.Omega_m_err, "R_kpc": self.R_kpc, "R_kpc_err": self.R_kpc_err}


def fit_flat_lcdm(z, theta, err, z_err=None) -> CosmologyFit:
    """Radius and dark-energy share of a flat model by variable projection: the radius is linear, so it is solved for at every
    share, and the share is found on a grid and refined by golden section in [0, 1]. Fewer than 3 usable points give NaN."""
    z, theta, err = (np.asarray(x, float) for x in (z, theta, err))
    z_err = np.zeros_like(z) if z_err is None else np.asarray(z_err, float)
    ok = np.isfinite(z) & np.isfinite(theta) & np.isfinite(err) & np.isfinite(z_err) & (z > 0) & (err > 0)
    n = int(ok.sum())
    if n < 3:
        return CosmologyFit(*[math.nan] * 6, n)
    z, theta, err, z_err = z[ok], theta[ok], err[ok], z_err[ok]
    z = np.maximum(z, 1e-6)
    err = np.maximum(err, err.max() * 1e-6 + 1e-12)
    if (z_err > 0).any():
        err = np.sqrt(err**2 + (theta / z * z_err) ** 2)
    w = 1 / err**2

    def solve(ol: float) -> tuple[float, float, np.ndarray]:
        g = 1.0 / distance_np(z, 1.0 - ol) / ARCSEC_TO_RAD
        r = max(float((w * theta * g).sum() / (w * g * g).sum()), 1e-8)
        return float((w * (theta - r * g) ** 2).sum()), r, g

    shares = np.linspace(0, 1, 201)
    k = int(np.argmin([solve(x)[0] for x in shares]))
    lo, hi, gold = shares[max(k - 1, 0)], shares[min(k + 1, 200)], (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
        lo, hi = (lo, b) if solve(a)[0] < solve(b)[0] else (a, hi)
    ol = min([lo, (lo + hi) / 2, hi, 0.0, 1.0], key=lambda x: solve(x)[0])
    chi2, r, g = solve(ol)
    step = 1e-5
    left, right = max(ol - step, 0.0), min(ol + step, 1.0)
    slope = r * (solve(right)[2] - solve(left)[2]) / (right - left)
    info = np.array([[(w * g * g).sum(), (w * g * slope).sum()], [(w * g * slope).sum(), (w * slope * slope).sum()]])
    det = info[0, 0] * info[1, 1] - info[0, 1] ** 2
    r_err, ol_err = (math.sqrt(info[1, 1] / det), math.sqrt(info[0, 0] / det)) if det > 0 else (math.nan, math.nan)
    ndf = n - 2
    return CosmologyFit(r, float(ol), r_err, ol_err, chi2 / ndf if ndf > 0 else math.nan, chi2_survival(chi2, ndf), n)


def fit_bins(bins: DataFrame, z: str = "z_mid", theta: str = "theta_med", err: str = "theta_err", z_err: str | None = None) -> CosmologyFit:
    """The two-parameter fit of a binned relation. Raises beyond ``MAX_FIT_ROWS`` rows."""
    rows = bins.select(z, theta, err, *([z_err] if z_err else [])).limit(MAX_FIT_ROWS + 1).toPandas()
    if len(rows) > MAX_FIT_ROWS:
        raise ValueError("too many rows for a fit on the driver; bin them first, or use grid_fit")
    return fit_flat_lcdm(*[rows[c] for c in rows.columns])


def radius_and_omega(bins: DataFrame, full: bool = False):
    """``(radius_mpc, Omega_m)`` of the two-parameter fit, or the whole result."""
    f = fit_bins(bins)
    return f if full else (f.R_mpc, f.Omega_m)


def grid_fit(df: DataFrame, keys: list[str], z: str, theta: str, err: str, steps: int = 101) -> DataFrame:
    """``(keys, omega_l, radius_mpc, chi2)`` of the best of ``steps`` shares, on any number of points: per point its terms of every share, one aggregation, ``min``."""
    p = usable_points(df, z, theta, err).filter(F.col(z) > 0)
    ol = F.explode(F.array(*[F.lit(i / (steps - 1)) for i in range(steps)]))
    p = p.select(*keys, F.greatest(F.col(z), F.lit(1e-6)).alias("_z"), F.col(theta).alias("_t"), (1.0 / (F.col(err) * F.col(err))).alias("_w"), ol.alias("omega_l"))
    g = 1.0 / angular_diameter_distance(F.col("_z"), 1.0 - F.col("omega_l")) / ARCSEC_TO_RAD
    p = p.withColumn("_g", g)
    s = p.groupBy(*keys, "omega_l").agg(F.sum(F.col("_w") * F.col("_t") * F.col("_g")).alias("tg"), F.sum(F.col("_w") * F.col("_g") * F.col("_g")).alias("gg"), F.sum(F.col("_w") * F.col("_t") * F.col("_t")).alias("tt"))
    s = s.withColumns({"radius_mpc": F.col("tg") / F.col("gg"), "chi2": F.col("tt") - F.col("tg") * F.col("tg") / F.col("gg")})
    best = s.groupBy(*keys).agg(F.min(F.struct("chi2", "omega_l", "radius_mpc")).alias("m"))
    return best.select(*keys, "m.omega_l", "m.radius_mpc", "m.chi2")


def with_models(bins: DataFrame, r_static: float | Column, r_lcdm: float | Column, om: float = OMEGA_M) -> DataFrame:
    """Bins with the two model curves and their residuals."""
    b = bins.withColumns({"static": theta_arcsec(F.col("z_mid"), r_static, "static"), "lcdm": theta_arcsec(F.col("z_mid"), r_lcdm, "lcdm", om)})
    return b.withColumns({"resid_static": F.col("theta_med") - F.col("static"), "resid_lcdm": F.col("theta_med") - F.col("lcdm")})
