"""Template spectra, filter curves and the model grid of synthetic photometry.

The grid is built once per set of parameters, on the driver, from at most ten spectra; its size (templates x dust x
redshifts x 4) depends on the parameters alone, never on the data, so broadcasting it is safe.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import numpy as np

from skyloom.constants import AV_GRID, DUST_BLUE, DUST_RANGE, DUST_RATIO, DUST_RED, DUST_SCALE, IGM_EDGE, IGM_LINES, IGM_POWER, PIVOT, SIMPLE_CENTRE, SIMPLE_WIDTH, TEMPLATES, WIDTH

#: Power-law slope and strength of the 4000 A break of the analytic stand-ins, from red to blue.
SHAPES = {
    "elliptical": (1.6, 0.55), "S0": (1.3, 0.48), "Sa": (0.9, 0.40), "Sb": (0.5, 0.32), "sbt1": (-0.4, 0.16),
    "sbt2": (-0.7, 0.13), "sbt3": (-0.3, 0.18), "sbt4": (0.0, 0.21), "sbt5": (0.3, 0.24), "sbt6": (0.6, 0.27),
}
WAVE = np.arange(1000.0, 10000.0 + 1e-9, 10.0)


def analytic_spectrum(name: str, wave: np.ndarray = WAVE) -> np.ndarray:
    """A smooth stand-in of a template: power law, 4000 A break, Lyman limit."""
    slope, strength = SHAPES[name]
    flux = (wave / 5500.0) ** slope * (1.0 - strength / (1.0 + np.exp((wave - 4000.0) / 100.0)))
    return np.where(wave < 912.0, 0.0, flux)


def load_spectrum(folder: str | None, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Wavelength and flux of a two-column text file, or the analytic stand-in without a folder. A missing file raises."""
    if folder is None:
        return WAVE, analytic_spectrum(name)
    wave, flux = np.loadtxt(Path(folder) / f"{name}.dat", usecols=(0, 1), unpack=True)
    return wave, flux


def dust(wave: np.ndarray, av: float) -> np.ndarray:
    """Starburst attenuation on an array; the Column form is ``functions.photometry.calzetti``."""
    if av <= 0:
        return np.ones_like(wave)
    u = wave / 1e4
    blue, red = (DUST_SCALE * sum(c / u**i for i, c in enumerate(cs)) + DUST_RATIO for cs in (DUST_BLUE, DUST_RED))
    low, mid, high = DUST_RANGE
    k = np.select([(u >= low) & (u < mid), (u >= mid) & (u <= high)], [blue, red], 0.0)
    return np.clip(10 ** (-0.4 * np.maximum(k, 0) * av / DUST_RATIO), 0, 1)


def igm(wave: np.ndarray, z: float) -> np.ndarray:
    """Intergalactic transmission on an array; the Column form is ``functions.photometry.igm_transmission``."""
    if z < 0.1:
        return np.ones_like(wave)
    tau = np.zeros_like(wave)
    for line, k in IGM_LINES:
        tau += np.where(wave < line * (1 + z), k * (wave / line) ** IGM_POWER, 0.0)
    edge, k, p, q, most = IGM_EDGE
    tau += np.where(wave < edge * (1 + z), np.minimum(k * (wave / edge) ** p * (1 + z) ** q, most), 0.0)
    return np.clip(np.exp(-tau), 0, 1)


def redshift_grid(z_min: float = 0.05, z_max: float = 4.0, step: float = 0.02) -> np.ndarray:
    return np.arange(z_min, z_max + step, step)


def synthetic(wave: np.ndarray, flux: np.ndarray, zs: np.ndarray, centres=PIVOT, widths=WIDTH, with_igm: bool = True) -> np.ndarray:
    """Mean flux in each band at each redshift, ``(z, 4)``; 0 where the band lies outside the spectrum."""
    half = np.asarray(widths) / 2
    out = np.zeros((len(zs), len(centres)))
    total = np.concatenate([[0.0], np.cumsum(flux)])
    for b, (c, h) in enumerate(zip(centres, half)):
        lo = np.searchsorted(wave, (c - h) / (1 + zs), "left")
        hi = np.searchsorted(wave, (c + h) / (1 + zs), "right")
        n = hi - lo
        out[:, b] = np.where(n > 0, (total[hi] - total[lo]) / np.maximum(n, 1), 0.0)
        if with_igm:
            for i in np.nonzero((zs > 0.5) & (n > 0) & (out[:, b] != 0))[0]:
                part = slice(lo[i], hi[i])
                out[i, b] = (flux[part] * igm(wave[part] * (1 + zs[i]), zs[i])).mean()
    return out


@dataclass(frozen=True)
class ModelGrid:
    """Models in the order template, dust, redshift."""

    templates: tuple[str, ...]
    av: np.ndarray
    z: np.ndarray
    flux: np.ndarray  # (template, dust, redshift, 4)


def interpolated(names: list[str], per_pair: int, folder: str | None = None) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Templates with ``per_pair`` averages between neighbours; an average goes by the name of the nearer one."""
    out = []
    for a, b in zip(names, [*names[1:], None]):
        w, f = load_spectrum(folder, a)
        out.append((a, w, f))
        if b is not None:
            w2, f2 = load_spectrum(folder, b)
            g = np.interp(w, w2, f2)
            for i in range(1, per_pair + 1):
                t = i / (per_pair + 1)
                out.append((a if t <= 0.5 else b, w, (1 - t) * f + t * g))
    return out


def model_grid(z_step: float = 0.02, z_min: float = 0.05, z_max: float = 4.0, av=AV_GRID, templates=TEMPLATES, folder: str | None = None, with_igm: bool = True, per_pair: int = 0) -> ModelGrid:
    zs, spectra = redshift_grid(z_min, z_max, z_step), interpolated(list(templates), per_pair, folder)
    flux = np.stack([np.stack([synthetic(w, f * dust(w, a), zs, with_igm=with_igm) for a in av]) for _, w, f in spectra])
    return ModelGrid(tuple(t for t, _, _ in spectra), np.asarray(av, float), zs, flux)


def top_hats(wave: np.ndarray | None = None) -> np.ndarray:
    """0/1 curves of the four simple filters on 2200..9499 A, ``(4, wavelength)``."""
    wave = np.arange(2200, 9500) if wave is None else wave
    return np.stack([(np.abs(wave - c) <= w / 2).astype(float) for c, w in zip(SIMPLE_CENTRE, SIMPLE_WIDTH)])
