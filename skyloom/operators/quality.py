"""Quality bits, selections and the fallback cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.constants import CATASTROPHIC, EDGE_MARGIN_PIX, FLAGS, LENIENT_MASK, MODERATE_MASK, PSF_FWHM_PIX, STRICT_MASK
from skyloom.functions.photometry import clean


def bit(name: str, cond: Column) -> Column:
    """The bit where the condition holds, else 0 (also on null)."""
    return F.when(F.coalesce(cond, F.lit(False)), FLAGS[name]).otherwise(0)


def with_bits(flag: Column, *bits: Column) -> Column:
    out = F.coalesce(flag, F.lit(0))
    for b in bits:
        out = out.bitwiseOR(b)
    return out


def snr_bits(snr_min: Column, snr_median: Column) -> list[Column]:
    return [bit("LOW_SNR", snr_min < 5.0), bit("VERY_LOW_SNR", snr_median < 0.5)]


def edge_bit(x: Column, y: Column, width: Column, height: Column, margin: float = EDGE_MARGIN_PIX) -> Column:
    return bit("EDGE", (x < margin) | (x > width - margin) | (y < margin) | (y > height - margin))


def star_bit(stellarity: Column, r: Column, ell: Column, conc: Column, fwhm: float = PSF_FWHM_PIX) -> Column:
    """Point-like by score, or compact, round and concentrated at once; an unknown ellipticity is not round."""
    shape = (clean(r) / (0.42 * fwhm) < 2.5) & (clean(ell) < 0.25) & (clean(conc) > 0.40)
    return bit("PSF_LIKE", (stellarity > 0.35) | F.coalesce(shape, F.lit(False)))


def mask_bits(in_mask: Column) -> list[Column]:
    return [bit("PSF_LIKE", in_mask), bit("MASKED", in_mask)]


def photoz_bits(odds: Column, boundary: Column, z: Column, z_err: Column) -> list[Column]:
    return [bit("BAD_PHOTOZ", F.coalesce(odds < 0.4, F.lit(False)) | F.coalesce(boundary, F.lit(False))), bit("UNRELIABLE_Z", (z_err > z) & (z > 0))]


def color_star_bit(color_score: Column, stellarity: Column) -> Column:
    return bit("PSF_LIKE", (color_score > 0.7) & (stellarity > 0.5))


def floored_radius(flag: Column, r: Column) -> tuple[Column, Column]:
    """Flag, then radius: what is not positive is point-like and gets 0.02 arcsec."""
    bad = F.coalesce(r <= 0, F.lit(False))
    return with_bits(flag, bit("PSF_LIKE", bad)), F.when(bad, 0.02).otherwise(r)


def catastrophic(z_phot: Column, z_spec: Column, threshold: float = CATASTROPHIC) -> Column:
    """True where both redshifts are usable and differ by more than the threshold, scaled; never null."""
    return F.coalesce((clean(z_spec) > 0) & (F.abs(clean(z_phot) - z_spec) / (1.0 + z_spec) > threshold), F.lit(False))


def catastrophic_bit(z_phot: Column, z_spec: Column) -> Column:
    return bit("CATASTROPHIC_PHOTOZ", catastrophic(z_phot, z_spec))


def fit_flags(reduced_chi2: Column, odds: Column) -> tuple[Column, Column]:
    """``(chi2_flag, odds_flag)``: 0 good, 1 fair, 2 poor; a suspiciously small chi square is fair."""
    chi = F.when(reduced_chi2 < 0.1, 1).when(reduced_chi2 < 5.0, 0).when(reduced_chi2 < 10.0, 1).otherwise(2)
    return chi, F.when(odds >= 0.9, 0).when(odds >= 0.6, 1).otherwise(2)


def unflagged(flag: Column, mask: int) -> Column:
    return F.coalesce(flag, F.lit(0)).bitwiseAND(F.lit(mask)) == 0


def high_quality(flag: Column, odds_flag: Column, chi2_flag: Column, bimodal: Column) -> Column:
    return unflagged(flag, STRICT_MASK) & (odds_flag == 0) & (chi2_flag == 0) & ~bimodal


def quality_cascade(df: DataFrame, least: int = 10) -> DataFrame:
    """The strict selection; the moderate one if that has fewer than ``least`` rows; the lenient one if that too has. Boundary redshifts always go (an unknown boundary too).

    Three conditional counts in one job choose; the answer is a plain filter that reaches the scan.
    """
    f = F.col("quality_flag")
    levels = [high_quality(f, F.col("odds_flag"), F.col("chi2_flag"), F.col("bimodal_flag")), unflagged(f, MODERATE_MASK), unflagged(f, LENIENT_MASK)]
    counts = df.agg(*[F.count(F.when(c, 1)) for c in levels[:2]]).first()
    pick = 0 if counts[0] >= least else 1 if counts[1] >= least else 2
    return df.filter(levels[pick]).filter(F.col("z_boundary_flag") == F.lit(False))


def flag_histogram(df: DataFrame, flag: str = "quality_flag") -> DataFrame:
    """``(flag, bit, n)``, a row per bit, zeros included."""
    n = df.agg(*[F.count(F.when(F.col(flag).bitwiseAND(F.lit(b)) != 0, 1)).alias(k) for k, b in FLAGS.items()])
    pair = F.array(*[F.struct(F.lit(k).alias("flag"), F.lit(b).alias("bit"), F.col(k).alias("n")) for k, b in FLAGS.items()])
    return n.select(F.inline(pair))


def is_star(in_mask: Column, flag: Column) -> Column:
    return F.coalesce(in_mask, F.lit(False)) | (F.coalesce(flag, F.lit(0)).bitwiseAND(F.lit(FLAGS["PSF_LIKE"])) != 0)
