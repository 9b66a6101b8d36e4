"""Distances and angular sizes as Column expressions. Angles are radians unless a name says arcsec; distances Mpc."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.constants import ARCSEC_TO_RAD, C_KM_S, H0, OMEGA_M

#: Gauss-Legendre nodes: 16 give a relative error of 1e-10 for z <= 6.
NODES, WEIGHTS = (x.tolist() for x in np.polynomial.legendre.leggauss(16))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def at_least(x: Column, low: float) -> Column:
    """The larger of both; null stays null (Spark's ``greatest`` skips nulls)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def e_of_z(z, om=OMEGA_M, ol=1.0 - OMEGA_M) -> Column:
    """Expansion rate over its present value; 0 where the radicand is negative."""
    z, om, ol = _c(z), _c(om), _c(ol)
    return F.sqrt(at_least(om * F.pow(1.0 + z, F.lit(3.0)) + ol, 0.0))


def angular_diameter_distance(z, om=OMEGA_M, ol=None, h0=H0) -> Column:
    """Angular diameter distance of a matter + Lambda model (flat unless ``ol`` is given), integrated by fixed nodes so that it stays in code generation."""
    z, om = _c(z), _c(om)
    ol = 1.0 - om if ol is None else _c(ol)
    total = sum(F.lit(w) / F.sqrt(om * F.pow(1.0 + z * (0.5 * (x + 1.0)), F.lit(3.0)) + ol) for x, w in zip(NODES, WEIGHTS))
    return F.lit(C_KM_S) / _c(h0) / (1.0 + z) * (z * 0.5) * total


def distance_static(z) -> Column:
    """Distance of a static Euclidean model."""
    return F.lit(C_KM_S / H0) * at_least(_c(z), 1e-6)


def theta_static(z, radius_mpc) -> Column:
    return _c(radius_mpc) / distance_static(z)


def theta_lcdm(z, radius_mpc, om=OMEGA_M, ol=None) -> Column:
    return _c(radius_mpc) / angular_diameter_distance(z, om, ol)


def theta_arcsec(z, radius_mpc, model: str = "lcdm", om=OMEGA_M) -> Column:
    return (theta_static(z, radius_mpc) if model == "static" else theta_lcdm(z, radius_mpc, om)) / ARCSEC_TO_RAD


def physical_size_kpc(z, theta_arcsec_, om=OMEGA_M, h0=H0) -> Column:
    """Physical radius of an angular one."""
    return _c(theta_arcsec_) * ARCSEC_TO_RAD * angular_diameter_distance(z, om, h0=h0) * 1000.0


def angular_size_arcsec(z, radius_kpc, om=OMEGA_M, h0=H0) -> Column:
    """Angular radius of a physical one."""
    return _c(radius_kpc) / 1000.0 / angular_diameter_distance(z, om, h0=h0) / ARCSEC_TO_RAD


def distance_np(z: np.ndarray, om: float, ol: float | None = None) -> np.ndarray:
    """The same distance for a few numbers on the driver."""
    z = np.asarray(z, float)
    ol = 1.0 - om if ol is None else ol
    x, w = np.array(NODES), np.array(WEIGHTS)
    arg = om * (1.0 + z[..., None] * 0.5 * (x + 1.0)) ** 3 + ol
    return C_KM_S / H0 / (1.0 + z) * z * 0.5 * (w / np.sqrt(np.maximum(arg, 1e-30))).sum(-1)
