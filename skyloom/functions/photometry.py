"""Photometric and morphological expressions; all stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.constants import DUST_BLUE, DUST_RANGE, DUST_RATIO, DUST_RED, DUST_SCALE, FLUX_FACTOR, IGM_EDGE, IGM_LINES, IGM_POWER, PSF_FWHM_PIX
from skyloom.functions.cosmology import at_least


def clean(c: Column) -> Column:
    """The value, null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def igm_transmission(lam: Column, z: Column) -> Column:
    """Mean transmission of the intergalactic medium at an observed wavelength (A) for a source at z; 1 below z = 0.1."""
    tau = sum(F.when(lam < line * (1.0 + z), k * F.pow(lam / line, F.lit(IGM_POWER))).otherwise(0.0) for line, k in IGM_LINES)
    at, k, p, q, most = IGM_EDGE
    edge = F.least(k * F.pow(lam / at, F.lit(p)) * F.pow(1.0 + z, F.lit(q)), F.lit(most))
    tau = tau + F.when(lam < at * (1.0 + z), edge).otherwise(0.0)
    return F.when(lam.isNotNull() & z.isNotNull(), F.when(z < 0.1, 1.0).otherwise(F.least(F.exp(-tau), F.lit(1.0))))


def calzetti(lam_rest: Column, av: Column) -> Column:
    """Transmission of starburst dust at a rest wavelength (A); 1 without dust."""
    u = lam_rest / 1e4
    power = lambda i: F.lit(1.0) if i == 0 else u * power(i - 1)
    blue, red = (DUST_SCALE * sum(c / power(i) for i, c in enumerate(cs)) + DUST_RATIO for cs in (DUST_BLUE, DUST_RED))
    low, mid, high = DUST_RANGE
    k = F.greatest(F.when((u >= low) & (u < mid), blue).when((u >= mid) & (u <= high), red).otherwise(0.0), F.lit(0.0))
    return F.when(av <= 0, 1.0).otherwise(F.when(av.isNotNull(), F.least(F.pow(F.lit(10.0), -0.4 * k * av / DUST_RATIO), F.lit(1.0))))


def psf_corrected_radius(r: Column, fwhm: float = PSF_FWHM_PIX) -> Column:
    """Radius with the point spread taken off in quadrature, at least 0."""
    return F.sqrt(at_least(r * r - (fwhm / 2.355) ** 2, 0.0))


def _weighted(terms: list[tuple[Column, float, Column]]) -> Column:
    """Weighted mean of the valid terms; 0 if there is none."""
    top = sum(F.when(ok, w * v).otherwise(0.0) for ok, w, v in terms)
    low = sum(F.when(ok, w).otherwise(0.0) for ok, w, _ in terms)
    return F.when(low > 0, top / F.nullif(low, F.lit(0.0))).otherwise(0.0)


def stellarity(r: Column, conc: Column, ell: Column, fwhm: float = PSF_FWHM_PIX) -> Column:
    """Likeness to a point source in [0, 1] from size (double weight), concentration and roundness; missing terms drop out."""
    r, conc, ell = clean(r), clean(conc), clean(ell)
    ratio = r / (0.42 * fwhm)
    size = F.when(ratio <= 1.0, 1.0).otherwise(F.greatest(2.0 - ratio, F.lit(0.0)))
    peak = F.least(F.greatest((conc - 0.35) / 0.20, F.lit(0.0)), F.lit(1.0))
    round_ = F.greatest(1.0 - ell / 0.3, F.lit(0.0))
    return _weighted([(F.coalesce(r > 0, F.lit(False)), 2.0, size), (conc.isNotNull(), 1.0, peak), (ell.isNotNull(), 1.0, round_)])


def magnitude(flux: Column) -> Column:
    """-2.5 log10 of a positive finite flux, else null."""
    f = clean(flux)
    return F.when(f > 0, -2.5 * F.log10(F.when(f > 0, f)))


def color_stellarity(u: Column, b: Column, v: Column, i: Column) -> Column:
    """Flatness of the colors U-B, B-V, V-I in [0, 1]; 0 if none is known."""
    m = [magnitude(x) for x in (u, b, v, i)]
    colors = F.array_compact(F.array(*[p - q for p, q in zip(m, m[1:])]))
    n = F.size(colors)
    mean = F.aggregate(colors, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))
    var = F.aggregate(colors, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.nullif(n, F.lit(0))
    top = F.array_max(F.transform(colors, lambda x: F.abs(x)))
    score = F.greatest(1.0 - F.sqrt(var), F.lit(0.0)) * F.greatest(1.0 - top / 2.0, F.lit(0.0))
    return F.coalesce(F.when(n > 0, score), F.lit(0.0))


def calibrated(value: Column, band: Column) -> Column:
    """A count rate in flux units by its band; null for an unknown band."""
    factor = F.create_map(*[x for k, v in FLUX_FACTOR.items() for x in (F.lit(k), F.lit(v))])
    return value * factor[band]


def concentration_ratio(r50: Column, r90: Column) -> Column:
    return F.when(r90 > 0, r50 / F.when(r90 > 0, r90))


def concentration_index(inner: Column, outer: Column) -> Column:
    """-5 log10(1 - inner / outer + 0.01) of two aperture sums, null unless both are positive."""
    ok = (inner > 0) & (outer > 0)
    arg = 1.0 - inner / F.when(outer > 0, outer) + 0.01
    return F.when(ok & (arg > 0), -5.0 * F.log10(F.when(arg > 0, arg)))


def aperture_error(sum_inv_weight: Column | None, area: Column, rms: Column, poisson: Column | None = None) -> Column:
    """Error of an isophotal flux: correlated-noise factor times the root of pixel, photon and sky terms."""
    zero = F.lit(0.0)
    total = (sum_inv_weight if sum_inv_weight is not None else zero) + (poisson if poisson is not None else zero)
    sky = area * rms * rms
    return 1.4 * F.sqrt(total + sky + area * sky / F.greatest(10.0 * area, F.lit(1.0)))


def snr(flux: Column, err: Column) -> Column:
    return F.abs(flux) / (err + 1e-10)


def radius_error(r: Column, flux: Column, err: Column) -> Column:
    return r * err / (2.0 * F.abs(flux) + 1e-10)


def ellipticity(a: Column, b: Column) -> Column:
    return F.when(a != 0, 1.0 - b / F.when(a != 0, a))


def moment_fwhm(a: Column, b: Column) -> Column:
    return 2.0 * F.sqrt(F.lit(0.6931471805599453) * (a * a + b * b))


def sane_ellipse(a: Column, b: Column, theta: Column) -> tuple[Column, Column, Column]:
    """Semi-axes that are finite, positive (else 0.5) and in order; an angle that is not NaN."""
    fix = lambda x: F.coalesce(F.when(clean(x) > 0, x), F.lit(0.5))
    a, b = fix(a), fix(b)
    return F.greatest(a, b), F.least(a, b), F.coalesce(clean(theta), F.lit(0.0))


def redshift_half_width(lo: Column, hi: Column) -> Column:
    return (hi - lo) / 2.0


def at_boundary(z: Column, z_min: float = 0.05, z_max: float = 6.0) -> Column:
    return (z <= z_min + 0.01) | (z >= z_max - 0.01)


def flux_ratio(inner: Column, outer: Column) -> Column:
    """Outer over inner aperture sum, null without inner light; above 1.8 the source counts as extended."""
    return F.when(inner != 0, outer / F.when(inner != 0, inner))


def measurable(snr_: Column, label: Column, n_pixels: Column, size: int = 64) -> Column:
    """Whether a segment is worth a structural fit: bright, labelled, neither tiny nor filling half of its cutout."""
    return (F.coalesce(snr_, F.lit(10.0)) >= 3.0) & (label != 0) & n_pixels.between(10, size * size // 2)


def adaptive_min_pixels(height: int, base: int = 12) -> int:
    """Least pixels of a detection, scaled from a 2048-pixel image."""
    return int(base * (height / 2048.0) ** 0.5)
