"""Photometric redshifts by template fitting over a broadcast model grid.

``photoz`` is the production path: Arrow batches against the grid, two matrix products per batch and band mask. The
relational form (``chi2_rows`` and what follows it) says the same with joins, ``min(struct)`` and windows, for grids small
enough to cross with the objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.constants import SIMPLE_CENTRE, SIMPLE_WIDTH, TEMPLATES
from skyloom.operators.templates import ModelGrid, load_spectrum, model_grid

SCHEMA = (
    "id long, redshift double, z_pdf_median double, z_lo double, z_hi double, chi_sq_min double, odds double, galaxy_type string, "
    "chi2_flag int, odds_flag int, bimodal_flag boolean, z_secondary double, odds_secondary double, template_ambiguity double, reduced_chi2 double, "
    "n_valid_bands int, second_best_template string, delta_chi2_templates double, best_a_v double"
)
FAIL = 1e30


@dataclass(frozen=True)
class PhotozOptions:
    systematic: float = 0.05
    template_error: float = 0.05
    secondary_separation: float = 0.3
    secondary_ratio: float = 0.1


def _window_integral(pdf: np.ndarray, z: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Trapezoid integral of each row over the grid points within 0.1 (1 + z) of a centre."""
    half = 0.1 * (1 + centre)[:, None]
    inside = (z >= centre[:, None] - half) & (z <= centre[:, None] + half)
    both = inside[:, 1:] & inside[:, :-1]
    return (np.where(both, 0.5 * (pdf[:, 1:] + pdf[:, :-1]), 0.0) * np.diff(z)).sum(1)


def _at_cdf(cdf: np.ndarray, z: np.ndarray, p: float) -> np.ndarray:
    return np.array([np.interp(p, c, z) for c in cdf])


def fit_photometry(flux: np.ndarray, err: np.ndarray, grid: ModelGrid, opt: PhotozOptions = PhotozOptions(), density: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Fits of ``(n, 4)`` fluxes and errors in the order U, B, V, I. Fewer than two usable bands give the failure row. ``density``: ``(n, redshifts, 2)``, gets the probability density and its integral."""
    n, z = len(flux), grid.z
    ok = np.isfinite(flux) & (flux > 0) & np.isfinite(err) & (err > 0)
    n_ok = ok.sum(1)
    names = np.array(grid.templates, object)
    out = {
        "redshift": np.full(n, z[0]), "z_pdf_median": np.full(n, z[0]), "z_lo": np.full(n, z[0]), "z_hi": np.full(n, 4.0), "chi_sq_min": np.full(n, FAIL), "odds": np.zeros(n),
        "galaxy_type": np.full(n, "unknown", object), "chi2_flag": np.full(n, 2), "odds_flag": np.full(n, 2), "bimodal_flag": np.zeros(n, bool),
        "z_secondary": np.full(n, np.nan), "odds_secondary": np.full(n, np.nan), "template_ambiguity": np.ones(n), "reduced_chi2": np.full(n, FAIL),
        "n_valid_bands": n_ok, "second_best_template": np.full(n, "", object), "delta_chi2_templates": np.zeros(n), "best_a_v": np.zeros(n),
    }
    nt, na, nz, _ = grid.flux.shape
    models = grid.flux.reshape(-1, 4)
    for code in np.unique(ok @ (1 << np.arange(4))):
        mask = (code >> np.arange(4) & 1).astype(bool)
        if mask.sum() < 2:
            continue
        at = np.nonzero((ok == mask).all(1))[0]
        s = models[:, mask]
        bad = s.sum(1) <= 0
        med = np.median(s, axis=1)
        s = s / np.where(med == 0, 1.0, med)[:, None]
        s2 = s * s
        for lo in range(0, len(at), 128):
            i = at[lo : lo + 128]
            f, e = flux[i][:, mask], err[i][:, mask]
            e2 = e * e + (opt.systematic * f) ** 2 + (opt.template_error * f) ** 2
            m = np.median(f, axis=1)[:, None]
            w, f = m * m / e2, f / m
            chi = np.maximum((w * f * f).sum(1)[:, None] - 2 * (w * f) @ s.T + w @ s2.T, 0.0)
            chi[:, bad] = FAIL
            k = chi.argmin(1)
            t, a, b = np.unravel_index(k, (nt, na, nz))
            exact = (w * (f - s[k]) ** 2).sum(1)  # the chosen row without the cancellation of the expansion
            best = np.where(bad[k], FAIL, exact)
            per = chi.reshape(len(i), nt, -1).min(2)
            order = np.argsort(per, axis=1, kind="stable")
            amb = np.exp(-(per[np.arange(len(i)), order[:, 1]] - chi[np.arange(len(i)), k]) / 2) if nt > 1 else np.zeros(len(i))
            log_l = -0.5 * chi.reshape(len(i), nt * na, nz)
            top = log_l.max(1)
            p = np.exp(top + np.log(np.exp(log_l - top[:, None, :]).sum(1)) - top.max(1)[:, None])
            area = (0.5 * (p[:, 1:] + p[:, :-1]) * np.diff(z)).sum(1)
            p = np.where(area[:, None] > 0, p / np.where(area > 0, area, 1)[:, None], 1.0 / nz)
            cdf = np.concatenate([np.zeros((len(i), 1)), np.cumsum(0.5 * (p[:, 1:] + p[:, :-1]) * np.diff(z), axis=1)], axis=1)
            cdf /= np.where(cdf[:, -1:] > 0, cdf[:, -1:], 1)
            zb = z[b]
            if density is not None:
                density[i, :, 0], density[i, :, 1] = p, cdf
            odds = _window_integral(p, z, zb)
            z2, o2 = secondary_peak(z, p, zb, opt)
            red = best / np.maximum(1, mask.sum() - 2)
            got = {
                "redshift": zb, "z_lo": _at_cdf(cdf, z, 0.16), "z_pdf_median": _at_cdf(cdf, z, 0.5), "z_hi": _at_cdf(cdf, z, 0.84), "chi_sq_min": best, "odds": odds, "galaxy_type": names[t],
                "chi2_flag": np.select([red < 0.1, red < 5, red < 10], [1, 0, 1], 2), "odds_flag": np.select([odds >= 0.9, odds >= 0.6], [0, 1], 2),
                "bimodal_flag": ~np.isnan(z2), "z_secondary": z2, "odds_secondary": o2, "template_ambiguity": amb, "reduced_chi2": red,
                "second_best_template": names[order[:, 1]] if nt > 1 else np.full(len(i), "", object), "delta_chi2_templates": np.where(amb < 1, best * (1 - amb), 0.0), "best_a_v": grid.av[a],
            }
            for c, v in got.items():
                out[c][i] = v
    return out


def secondary_peak(z: np.ndarray, p: np.ndarray, best: np.ndarray, opt: PhotozOptions = PhotozOptions()) -> tuple[np.ndarray, np.ndarray]:
    """Highest local maximum away from the primary one, and the probability around it; NaN where none is high enough."""
    n = len(p)
    first = p[np.arange(n), np.abs(z[None, :] - best[:, None]).argmin(1)]
    q = np.where(np.abs(z[None, :] - best[:, None]) < opt.secondary_separation * (1 + best)[:, None], 0.0, p)
    pad = np.pad(q, ((0, 0), (2, 2)), constant_values=-np.inf)
    around = np.max([pad[:, d : d + q.shape[1]] for d in range(5)], axis=0)
    peak = (around == q) & (q > opt.secondary_ratio * first[:, None])
    has = peak.any(1) & (q.max(1) >= opt.secondary_ratio * first)
    at = z[np.where(peak, q, -1.0).argmax(1)]
    return np.where(has, at, np.nan), np.where(has, _window_integral(p, z, at), np.nan)


def photoz(df: DataFrame, id_col: str, flux: list[str], err: list[str], grid: ModelGrid | None = None, opt: PhotozOptions = PhotozOptions()) -> DataFrame:
    """A fit per row (columns of ``SCHEMA``); ``flux`` and ``err`` name the columns in the order U, B, V, I. No shuffle. Missing values are missing bands."""
    shared = df.sparkSession.sparkContext.broadcast(grid or model_grid())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 2048):
                part = b.iloc[k : k + 2048]
                v = part.iloc[:, 1:].to_numpy(np.float64)
                got = fit_photometry(v[:, :4], v[:, 4:], shared.value, opt)
                yield pd.DataFrame({"id": part["id"].to_numpy(), **got})

    src = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate([*flux, *err])]).filter("id is not null")
    return src.mapInPandas(run, SCHEMA).replace(float("nan"), None, ["z_secondary", "odds_secondary"])


def photoz_pdf(df: DataFrame, id_col: str, flux: list[str], err: list[str], grid: ModelGrid | None = None, opt: PhotozOptions = PhotozOptions()) -> DataFrame:
    """``(id, zi, p, cdf)``: the density of ``photoz`` at every redshift of the grid, for rows with two usable bands or more. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(grid or model_grid())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nz = len(shared.value.z)
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k : k + 512]
                v, density = part.iloc[:, 1:].to_numpy(np.float64), np.empty((len(part), nz, 2))
                has = fit_photometry(v[:, :4], v[:, 4:], shared.value, opt, density)["n_valid_bands"] >= 2
                d = density[has].reshape(-1, 2)
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy()[has], nz), "zi": np.tile(np.arange(nz), int(has.sum())), "p": d[:, 0], "cdf": d[:, 1]})

    src = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate([*flux, *err])]).filter("id is not null")
    return src.mapInPandas(run, "id long, zi int, p double, cdf double")


def two_stage(df: DataFrame, id_col: str, flux: list[str], err: list[str], folder: str | None = None) -> DataFrame:
    """``(id, galaxy_type, redshift)`` by a coarse grid and a golden-section refinement per template within 0.5 of its best; no dust, no intergalactic absorption. Rows without all four bands get nulls."""
    wave = np.arange(2200.0, 9500.0)
    masks = [np.abs(wave - c) <= w / 2 for c, w in zip(SIMPLE_CENTRE, SIMPLE_WIDTH)]
    spectra = [load_spectrum(folder, t) for t in TEMPLATES]
    shared = df.sparkSession.sparkContext.broadcast((wave, masks, spectra))

    def synth(t: int, z: float) -> np.ndarray | None:
        wave, masks, spectra = shared.value
        w, f = spectra[t]
        g = np.interp(wave, w * (1 + z), f, left=0, right=0)
        if g.mean() == 0:
            return None
        s = np.array([g[m].mean() for m in masks]) / g.mean()
        med = np.median(s)
        return None if med == 0 else s / med

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coarse_z = np.linspace(0, 3.5, 15)
        coarse = [[synth(t, z) for t in range(len(TEMPLATES))] for z in coarse_z]
        kept: dict[tuple[int, int], np.ndarray | None] = {}
        for b in batches:
            rows = []
            for i, *v in b.itertuples(index=False):
                f, e = np.array(v[:4], float), np.array(v[4:], float)
                if not (np.isfinite(f).all() and np.isfinite(e).all() and (f > 0).all() and (e > 0).all()):
                    rows.append((i, None, None))
                    continue
                med = np.median(f)
                w, m = (med / e) ** 2, f / med
                chi = lambda s: FAIL if s is None else float(((m - s) ** 2 * w).sum())
                c = np.array([[chi(s) for s in r] for r in coarse])
                z0 = coarse_z[np.unravel_index(c.argmin(), c.shape)[0]] if c.min() < FAIL else 1.0

                def at(t: int, z: float) -> float:
                    key = (t, round(z * 1e4))
                    if key not in kept:
                        if len(kept) > 100_000:
                            kept.clear()
                        kept[key] = synth(t, key[1] / 1e4)
                    return chi(kept[key])

                best = []
                for t in range(len(TEMPLATES)):
                    lo, hi, g = max(0.0, z0 - 0.5), min(3.5, z0 + 0.5), (5**0.5 - 1) / 2
                    x, y = hi - g * (hi - lo), lo + g * (hi - lo)
                    fx, fy = at(t, x), at(t, y)
                    while hi - lo > 1e-3:
                        if fx < fy:
                            hi, y, fy = y, x, fx
                            x = hi - g * (hi - lo)
                            fx = at(t, x)
                        else:
                            lo, x, fx = x, y, fy
                            y = lo + g * (hi - lo)
                            fy = at(t, y)
                    best.append((min(fx, fy), x if fx < fy else y, t))
                _, zb, t = min(best)
                rows.append((i, TEMPLATES[t], zb))
            yield pd.DataFrame(rows, columns=["id", "galaxy_type", "redshift"])

    src = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate([*flux, *err])])
    return src.mapInPandas(run, "id long, galaxy_type string, redshift double")


# The relational form.


def median4(xs: Column) -> Column:
    s = F.sort_array(xs)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def chi2_rows(objects: DataFrame, grid: DataFrame, opt: PhotozOptions = PhotozOptions()) -> DataFrame:
    """``(id, t, a, zi, chi2)``: every object against every model. ``objects``: ``id, flux, err`` (arrays of 4); ``grid``: ``t, a, zi, m`` of a size fixed by its parameters."""
    idx = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.get("flux", i) > 0) & (F.get("err", i) > 0) & ~F.isnan(F.get("flux", i)) & ~F.isnan(F.get("err", i)))
    o = objects.withColumn("ix", idx).filter(F.size("ix") >= 2)
    o = o.withColumns({"f": F.transform("ix", lambda i: F.get("flux", i)), "e2": F.transform("ix", lambda i: F.get("err", i) * F.get("err", i) + (opt.systematic**2 + opt.template_error**2) * F.get("flux", i) * F.get("flux", i))})
    o = o.withColumn("med", median4(F.col("f"))).select("id", "ix", F.transform("f", lambda x: x / F.col("med")).alias("f"), F.transform("e2", lambda e: F.col("med") * F.col("med") / e).alias("w"))
    j = o.crossJoin(F.broadcast(grid)).withColumn("s", F.transform("ix", lambda i: F.get("m", i)))
    j = j.withColumns({"sum": F.aggregate("s", F.lit(0.0), lambda p, x: p + x), "sm": median4(F.col("s"))})
    scale = F.when(F.col("sm") == 0, 1.0).otherwise(F.col("sm"))
    term = F.zip_with(F.zip_with("f", "s", lambda x, y: (x - y / scale) * (x - y / scale)), F.col("w"), lambda d, w: d * w)
    return j.select("id", "t", "a", "zi", F.when(F.col("sum") > 0, F.aggregate(term, F.lit(0.0), lambda p, x: p + x)).otherwise(FAIL).alias("chi2"))


def best_model(chi: DataFrame) -> DataFrame:
    """``(id, t, a, zi, chi2)`` of the smallest chi square, ties in grid order."""
    return chi.groupBy("id").agg(F.min(F.struct("chi2", "t", "a", "zi")).alias("m")).select("id", "m.t", "m.a", "m.zi", "m.chi2")


def second_template(chi: DataFrame) -> DataFrame:
    """``(id, t2, ambiguity)`` from the two best templates."""
    per = chi.groupBy("id", "t").agg(F.min("chi2").alias("c")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("l"))
    return per.select("id", F.get("l", F.lit(1))["t"].alias("t2"), F.exp(-(F.get("l", F.lit(1))["c"] - F.get("l", F.lit(0))["c"]) / 2).alias("ambiguity"))


def pdf_rows(chi: DataFrame, z_min: float, step: float) -> DataFrame:
    """``(id, zi, z, p, cdf)``: marginal probability density over redshift, and its integral by trapezoids. The log-sum-exp is one aggregation by (object, redshift) and a window over an object's few grid points."""
    top = chi.groupBy("id", "zi").agg(F.min("chi2").alias("c0"), F.collect_list("chi2").alias("cs"))
    rel = top.withColumn("g", F.min("c0").over(W.partitionBy("id")))
    rel = rel.select("id", "zi", (F.lit(z_min) + F.col("zi") * step).alias("z"), F.aggregate("cs", F.lit(0.0), lambda s, x: s + F.exp(-(x - F.col("g")) / 2)).alias("u"))
    w = W.partitionBy("id").orderBy("zi")
    rel = rel.withColumn("slice", F.coalesce((F.col("u") + F.lag("u").over(w)) / 2 * step, F.lit(0.0)))
    rel = rel.withColumns({"area": F.sum("slice").over(W.partitionBy("id")), "run": F.sum("slice").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return rel.select("id", "zi", "z", (F.col("u") / F.col("area")).alias("p"), (F.col("run") / F.col("area")).alias("cdf"))


def pdf_quantile(pdf: DataFrame, p: float, name: str) -> DataFrame:
    """``(id, name)``: redshift at which the cumulative density reaches ``p``, linear between grid points."""
    w = W.partitionBy("id").orderBy("zi")
    b = pdf.withColumns({"c0": F.lag("cdf").over(w), "z0": F.lag("z").over(w)}).filter((F.col("c0") < p) & (F.col("cdf") >= p))
    return b.select("id", (F.col("z0") + (F.col("z") - F.col("z0")) * (p - F.col("c0")) / (F.col("cdf") - F.col("c0"))).alias(name))
