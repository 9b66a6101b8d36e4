"""Pixel and sky coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.constants import FIELD_CENTRE, PIXEL_SCALE

HEADER_KEYS = ("CD1_1", "CD1_2", "CD2_1", "CD2_2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")


def header_number(header: Column, key: str) -> Column:
    """A number of a ``map<string,string>`` header; null if missing or no number."""
    return F.element_at(header, F.lit(key)).try_cast("double")


def pixel_to_sky(x: Column, y: Column, header: Column, gnomonic: bool = True) -> tuple[Column, Column]:
    """``(ra, dec)`` in degrees of a 0-based pixel.

    With a full header by the tangent-plane projection (``gnomonic``) or by the CD matrix alone, without cos(dec); with
    an incomplete header linearly about the field centre.
    """
    k = {n: header_number(header, n) for n in HEADER_KEYS}
    whole = F.lit(True)
    for v in k.values():
        whole = whole & v.isNotNull()
    dx, dy = x + 1.0 - k["CRPIX1"], y + 1.0 - k["CRPIX2"]
    if not gnomonic:
        dx, dy = x - k["CRPIX1"], y - k["CRPIX2"]
    xi, eta = k["CD1_1"] * dx + k["CD1_2"] * dy, k["CD2_1"] * dx + k["CD2_2"] * dy
    if gnomonic:
        a, b, d0 = F.radians(xi), F.radians(eta), F.radians(k["CRVAL2"])
        low = F.cos(d0) - b * F.sin(d0)
        ra = F.pmod(k["CRVAL1"] + F.degrees(F.atan2(a, low)), F.lit(360.0))
        dec = F.degrees(F.atan2(F.sin(d0) + b * F.cos(d0), F.sqrt(a * a + low * low)))
    else:
        ra, dec = k["CRVAL1"] + xi, k["CRVAL2"] + eta
    ra0, dec0 = FIELD_CENTRE
    step = PIXEL_SCALE / 3600.0
    far_ra = ra0 + (x - 2048.0) * step
    return F.when(whole, ra).otherwise(far_ra), F.when(whole, dec).otherwise(dec0 + (y - 2048.0) * step)


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation by the haversine."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((d2 - d1) / 2), F.lit(2.0)) + F.cos(d1) * F.cos(d2) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), F.lit(2.0))
    return F.degrees(2.0 * F.asin(F.least(F.sqrt(h), F.lit(1.0)))) * 3600.0
