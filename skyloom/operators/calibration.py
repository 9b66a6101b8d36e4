"""Photometric zero points from objects with known redshifts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.constants import BANDS, SIMPLE_CENTRE, SIMPLE_WIDTH
from skyloom.functions.photometry import clean
from skyloom.operators.robust import mad_clip
from skyloom.operators.templates import load_spectrum, synthetic
from skyloom.session import cut

#: Templates that calibrators are compared with. Fixed value.
CALIBRATION_TEMPLATES = ["elliptical", "Sb", "sbt1", "sbt3", "sbt5"]
#: Redshift matches from which the pipeline calibrates, and calibrators from which offsets are derived.
GATE, MIN_CALIBRATORS = 15, 10


def band_means(z: np.ndarray, wave: np.ndarray, flux: np.ndarray) -> np.ndarray:
    """Mean of a template's samples in the four observed-frame bands at each redshift, ``(n, 4)``; 0 without any."""
    return synthetic(wave, flux, z, SIMPLE_CENTRE, SIMPLE_WIDTH, with_igm=False)


def best_residuals(z: np.ndarray, obs: np.ndarray, spectra: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of observed over scaled template flux, ``(n, 4)``, by the template of the smallest relative chi square; NaN for invalid bands, and for rows without any usable template."""
    ok = np.isfinite(obs) & (obs > 0)
    f = np.where(ok, obs, 0.0)
    least, out = np.full(len(z), np.inf), np.full(obs.shape, np.nan)
    for wave, flux in spectra:
        m = band_means(z, wave, flux)
        lit = ~(ok & (m <= 0)).any(1)
        m = np.where(ok & lit[:, None], m, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = (f * m).sum(1) / (m * m).sum(1)
            chi = np.where(ok, ((f - scale[:, None] * m) / f) ** 2, 0.0).sum(1)
            res = np.where(ok, np.log10(f / (scale[:, None] * m)), np.nan)
        better = lit & (scale > 0) & (chi < least)
        least = np.where(better, chi, least)
        out[better] = res[better]
    return out


def calibrator_residuals(catalog: DataFrame, id_col: str = "record_id", flux: list[str] | None = None, z_spec: str = "z_spec", folder: str | None = None) -> DataFrame:
    """``(id, band, resid)`` of each calibrator with three valid bands or more, in Arrow batches without a shuffle; five spectra are broadcast."""
    flux = flux or ["flux_f300", "flux_f450", "flux_f606", "flux_f814"]
    z = F.col(z_spec)
    spectra = catalog.sparkSession.sparkContext.broadcast([load_spectrum(folder, t) for t in CALIBRATION_TEMPLATES])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            r = best_residuals(b["z"].to_numpy(float), b[["f0", "f1", "f2", "f3"]].to_numpy(float), spectra.value)
            i, k = np.nonzero(np.isfinite(r))
            yield pd.DataFrame({"id": b["id"].to_numpy()[i], "band": k, "resid": r[i, k]})

    values = {f"f{i}": F.when(clean(F.col(c)) > 0, F.col(c)) for i, c in enumerate(flux)}
    cal = catalog.filter(z.isNotNull() & ~F.isnan(z) & (z > 0)).select(F.col(id_col).cast("long").alias("id"), z.alias("z"), *[v.alias(k) for k, v in values.items()])
    return cal.dropna(thresh=3, subset=list(values)).mapInPandas(run, "id long, band int, resid double")


def zeropoint_offsets(catalog: DataFrame, sign: float = 1.0, clip: float = 3.0, **source) -> DataFrame:
    """``(band, offset_mag, flux_scale, scatter, n_cal, converged)``, four rows.

    Fewer than ``MIN_CALIBRATORS`` calibrators give offsets of 0; a band with fewer than five values too, with a scatter of 0.
    ``flux_scale`` multiplies fluxes; by default it has the sign that the catalog's users know, ``sign=-1`` turns it round.
    """
    spark = catalog.sparkSession
    bands = spark.createDataFrame([(i, b) for i, b in enumerate(BANDS)], "i int, band string")
    zc = F.col(source.get("z_spec", "z_spec"))
    n = catalog.filter(zc.isNotNull() & ~F.isnan(zc) & (zc > 0)).limit(MIN_CALIBRATORS).count()
    if n < MIN_CALIBRATORS:
        return bands.select("band", F.lit(0.0).alias("offset_mag"), F.lit(1.0).alias("flux_scale"), F.lit(None).cast("double").alias("scatter"), F.lit(n).cast("long").alias("n_cal"), F.lit(False).alias("converged"))
    s = mad_clip(cut(calibrator_residuals(catalog, **source)).withColumnRenamed("band", "i"), "i", "resid", clip)
    j = bands.join(s, "i", "left")
    enough = F.coalesce(F.col("n_valid") >= 5, F.lit(False))
    mag = F.when(enough, -2.5 * F.col("median")).otherwise(0.0)
    return j.select("band", mag.alias("offset_mag"), F.pow(F.lit(10.0), -0.4 * sign * mag).alias("flux_scale"), F.when(enough, 2.5 * F.col("mad")).otherwise(0.0).alias("scatter"), F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_cal"), F.lit(True).alias("converged"))


def apply_zeropoints(catalog: DataFrame, scale: dict[str, float], flux: dict[str, str] | None = None, err: dict[str, str] | None = None) -> DataFrame:
    """Flux and error columns times their band's factor. ``scale``: by band, four numbers."""
    flux = flux or dict(zip(BANDS, ["flux_f300", "flux_f450", "flux_f606", "flux_f814"]))
    err = err or dict(zip(BANDS, ["error_f300", "error_f450", "error_f606", "error_f814"]))
    return catalog.withColumns({c: F.col(c) * F.lit(float(scale[b])) for m in (flux, err) for b, c in m.items() if c in catalog.columns and b in scale})


def iterate_zeropoints(catalog: DataFrame, classify: Callable[[DataFrame], DataFrame], rounds: int = 3, tolerance: float = 0.01) -> tuple[DataFrame, dict[str, float], list[dict[str, float]]]:
    """Derive, apply and refit until no offset reaches ``tolerance`` (mag): the corrected catalog, cumulative factors, and the offsets of each round. Every round is materialised in the checkpoint folder."""
    factors, history, now = {b: 1.0 for b in BANDS}, [], catalog
    for _ in range(rounds):
        rows = zeropoint_offsets(now).collect()
        offsets = {r["band"]: r["offset_mag"] for r in rows}
        history.append(offsets)
        factors = {r["band"]: factors[r["band"]] * r["flux_scale"] for r in rows}
        if max(map(abs, offsets.values())) < tolerance:
            break
        now = cut(classify(apply_zeropoints(now, {r["band"]: r["flux_scale"] for r in rows})))
    return now, factors, history


def calibrate_if_enough(catalog: DataFrame, gate: int = GATE) -> DataFrame:
    """The catalog with corrected fluxes if it has ``gate`` redshift matches, else as it is."""
    z = F.col("z_spec")
    if catalog.filter(z.isNotNull() & ~F.isnan(z)).limit(gate).count() < gate:
        return catalog
    return apply_zeropoints(catalog, {r["band"]: r["flux_scale"] for r in zeropoint_offsets(catalog).collect()})
