"""Reconciling photometric with spectroscopic redshifts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.constants import CATASTROPHIC
from skyloom.operators.matching import sky_match
from skyloom.operators.quality import catastrophic, catastrophic_bit, with_bits
from skyloom.operators.robust import delta_z, redshift_metrics


def apply_spectroscopic(df: DataFrame, threshold: float = CATASTROPHIC) -> DataFrame:
    """Spectroscopic redshifts take over: the photometric one is kept as ``redshift_phot_original``, disagreement beyond the threshold is marked, the error becomes 0.001."""
    zs = F.col("z_spec")
    has = zs.isNotNull() & ~F.isnan(zs) & (zs > 0)
    return df.withColumns({
        "redshift_phot_original": F.col("redshift"), "catastrophic_outlier": catastrophic(F.col("redshift"), zs, threshold),
        "redshift": F.when(has, zs).otherwise(F.col("redshift")), "redshift_source": F.when(has, "spec").otherwise("phot"),
        "redshift_err": F.when(has, 0.001).otherwise(F.col("redshift_err")),
    })


def flag_catastrophic(df: DataFrame) -> DataFrame:
    """Sets the catastrophic bit, by the original photometric redshift if that was kept."""
    z = F.coalesce("redshift_phot_original", "redshift") if "redshift_phot_original" in df.columns else F.col("redshift")
    return df.withColumn("quality_flag", with_bits(F.col("quality_flag"), catastrophic_bit(z, F.col("z_spec"))))


def metrics_by_bands(df: DataFrame, zp: str, zs: str, least: int = 5) -> DataFrame:
    """Metrics by number of valid bands, for numbers with ``least`` comparisons, with a label."""
    m = redshift_metrics(df, zp, zs, ["n_valid_bands"]).filter(F.col("n") >= least)
    return m.withColumn("label", F.when(F.col("n_valid_bands") >= 4, "reliable").otherwise("degenerate"))


def outliers_by_redshift(df: DataFrame, zp: str, zs: str, width: float = 0.5, least: int = 5) -> DataFrame:
    """``(bin, z_lo, z_hi, outlier_frac, n)`` in left-closed bins of the spectroscopic redshift; four bins up to 1.1 times the largest where it is below ``width``."""
    d = df.select(F.col(zs).alias("z"), F.abs(delta_z(F.col(zp), F.col(zs))).alias("a")).filter("a is not null")
    top = d.agg(F.max("z")).first()[0]
    last = float("inf") if top is None else math.ceil((top + width) / width - 1) * width
    if top is not None and top <= width:
        width, last = top * 1.1 / 4, float("inf")
    d = d.filter(F.col("z") < last).withColumn("bin", F.floor(F.col("z") / width).cast("int"))
    g = d.groupBy("bin").agg(F.avg((F.col("a") > CATASTROPHIC).cast("double")).alias("outlier_frac"), F.count("a").alias("n")).filter(F.col("n") >= least)
    return g.select("bin", (F.col("bin") * width).alias("z_lo"), ((F.col("bin") + 1) * width).alias("z_hi"), "outlier_frac", "n")


def residuals(df: DataFrame, zp: str, zs: str) -> DataFrame:
    return df.withColumn("delta_z", delta_z(F.col(zp), F.col(zs))).filter("delta_z is not null")


def validate(catalog: DataFrame, entries: DataFrame, radius_arcsec: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Cross-match, metrics, take-over and flags in one go: ``(catalog, metrics)``. Earlier match columns are replaced."""
    old = [c for c in ("z_spec", "z_spec_source", "z_spec_sep_arcsec") if c in catalog.columns]
    joined = catalog.drop(*old).join(sky_match(catalog, entries, radius_arcsec), "record_id", "left")
    return flag_catastrophic(apply_spectroscopic(joined)), redshift_metrics(joined, "redshift", "z_spec")


def availability(entries: DataFrame) -> DataFrame:
    """``(list, n)``: what reference redshifts are at hand."""
    return entries.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
