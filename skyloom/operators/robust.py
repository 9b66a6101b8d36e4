"""Robust statistics: clipping by deviation and by median deviation, photometric-redshift metrics, per-source combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.operators.binning import assign_bin, quantile_edges
from skyloom.operators.quantiles import IN_MEMORY, exact_quantiles, quantile_column
from skyloom.session import cut, small

#: Groups up to which their statistics are broadcast.
GROUPS = 100_000


def _within(rounds: str, strict: bool) -> Column:
    """True where ``v`` lies within every (middle, half width) of an array."""
    off = lambda r: F.abs(F.col("v") - r["m"])
    return F.forall(rounds, (lambda r: off(r) < r["h"]) if strict else (lambda r: off(r) <= r["h"]))


def _kept(base: DataFrame, limits: DataFrame, key: str, strict: bool) -> DataFrame:
    return base.join(small(limits, GROUPS), key).filter(_within("rounds", strict)).select(key, "v")


def _limits(base: DataFrame, key: str, sigma: float, rounds: int, least: int, by_mad: bool) -> DataFrame:
    """``(key, n, rounds array<struct<m, h>>)``: what each round keeps, as intervals, so that every round filters the same
    base and carries one small table along. Each round is materialised."""
    n = base.count()
    limits = cut(base.groupBy(key).agg(F.count("v").alias("n")).withColumn("rounds", F.array().cast("array<struct<m:double,h:double>>")))
    for _ in range(rounds):
        now = _kept(base, limits, key, by_mad)
        med = cut(exact_quantiles(now, [key], "v", [0.5], known_rows=n).select(key, F.col("q")[0].alias("m")))
        if by_mad:
            off = now.join(small(med, GROUPS), key).select(key, "v", "m", F.abs(F.col("v") - F.col("m")).alias("d"))
            mad = exact_quantiles(off, [key], "d", [0.5], known_rows=n).select(key, (sigma * 1.4826 * F.col("q")[0]).alias("h"))
            s = cut(med.join(mad, key))
            left = off.join(small(s.select(key, "h"), GROUPS), key).groupBy(key).agg(F.count(F.when(F.col("d") < F.col("h"), 1)).alias("_k"))
            s = s.join(left, key).filter((F.col("h") > 0) & (F.col("_k") >= least)).select(key, "m", "h")
        else:
            s = med.join(now.groupBy(key).agg((sigma * F.stddev_pop("v")).alias("h")), key)
        step = F.when(F.col("h").isNotNull(), F.array(F.struct("m", "h"))).otherwise(F.array().cast("array<struct<m:double,h:double>>"))
        limits = cut(limits.join(s, key, "left").select(key, "n", F.concat("rounds", step).alias("rounds")))
    return limits


def sigma_clip(df: DataFrame, key: str, value: str, sigma: float = 2.5, rounds: int = 3, least: int = 5) -> DataFrame:
    """Rows of ``df`` within ``sigma`` population deviations of their group's median, repeated ``rounds`` times on what is left.

    Groups with fewer than ``least`` values at the start, rows with a null key and rows with a null value are kept as they
    are. Groups are only aggregated, never held in a task; the input is read once per round.
    """
    base = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("v")).dropna()
    limits = _limits(base, "_key", sigma, rounds, least, False).withColumnsRenamed({"_key": key, "n": "_n", "rounds": "_rounds"})
    off = lambda r: F.abs(F.col(value) - r["m"]) <= r["h"]
    inside = F.coalesce(F.forall("_rounds", off), F.lit(True)) | (F.col("_n") < least)
    return df.join(small(limits, GROUPS), key, "left").filter(F.coalesce(inside, F.lit(True))).drop("_n", "_rounds")


def sigma_clip_in_bins(df: DataFrame, z: str = "redshift", theta: str = "r_half_arcsec", sigma: float = 2.5, bins: int = 5) -> DataFrame:
    """``sigma_clip`` within equal-count redshift bins; the column set is unchanged."""
    edges = quantile_edges(df, z, bins)
    return sigma_clip(df.withColumn("_bin", assign_bin(F.col(z), edges)), "_bin", theta, sigma).drop("_bin")


def mad_clip(df: DataFrame, key: str, value: str, sigma: float = 3.0, rounds: int = 3, least: int = 5) -> DataFrame:
    """``(key, median, mad, n_valid, n_kept)`` after clipping at ``sigma`` scaled median deviations; a round that would leave fewer than ``least`` values, or with no deviation, changes nothing."""
    base = cut(df.select(key, F.col(value).cast("double").alias("v")).dropna())
    limits = _limits(base, key, sigma, rounds, least, True)
    left = cut(_kept(base, limits, key, True))
    med = cut(exact_quantiles(left, [key], "v", [0.5]).select(key, F.col("q")[0].alias("median")))
    off = left.join(small(med, GROUPS), key).select(key, F.abs(F.col("v") - F.col("median")).alias("d"))
    mad = exact_quantiles(off, [key], "d", [0.5]).select(key, (F.col("q")[0] * 1.4826).alias("mad"))
    n = left.groupBy(key).agg(F.count("v").alias("n_kept"))
    return med.join(mad, key).join(n, key).join(limits.select(key, F.col("n").alias("n_valid")), key)


def mad_scale(df: DataFrame, value: str) -> DataFrame:
    """One row ``(scale)``: scaled median deviation, at least one per cent of the median."""
    med = exact_quantiles(df, [], value, [0.5]).select(F.col("q")[0].alias("_med"))
    d = df.select(F.col(value).alias("v")).withColumn("one", F.lit(1)).join(F.broadcast(med.withColumn("one", F.lit(1))), "one")
    d = d.select("_med", F.abs(F.col("v") - F.col("_med")).alias("d"))
    m = exact_quantiles(d, ["_med"], "d", [0.5])
    return m.select(F.greatest(F.col("q")[0] * 1.4826, 0.01 * F.col("_med")).alias("scale"))


def delta_z(zp: Column, zs: Column) -> Column:
    """Scaled redshift difference; null unless both are finite and the reference is positive."""
    ok = (zs > 0) & (zs < float("inf")) & ~F.isnan(zs) & ~F.isnan(zp) & (F.abs(zp) < float("inf"))
    return F.when(ok, (zp - zs) / (1.0 + zs))


def redshift_metrics(df: DataFrame, zp: str, zs: str, keys: list[str] | None = None) -> DataFrame:
    """``(keys, nmad, bias, outlier_frac, catastrophic_frac, n)``; without keys one row, nulls and 0 when nothing compares."""
    keys = keys or []
    rows = df.select(*keys, delta_z(F.col(zp), F.col(zs)).alias("d")).filter("d is not null").withColumn("a", F.abs("d"))
    n = rows.count()
    sums = [F.avg((F.col("a") > 0.15).cast("double")).alias("outlier_frac"), F.avg((F.col("a") > 0.30).cast("double")).alias("catastrophic_frac"), F.count("d").alias("n")]
    if n <= IN_MEMORY:
        s = rows.dropna(subset=keys).groupBy(*keys).agg(*sums, quantile_column("d", [0.5])[0].alias("bias"), (1.48 * quantile_column("a", [0.5])[0]).alias("nmad"))
        return s.select(*keys, "nmad", "bias", "outlier_frac", "catastrophic_frac", "n")
    s = rows.groupBy(*keys).agg(*sums)
    b = exact_quantiles(rows, keys, "d", [0.5], known_rows=n).select(*keys, F.col("q")[0].alias("bias"))
    m = exact_quantiles(rows, keys, "a", [0.5], known_rows=n).select(*keys, (1.48 * F.col("q")[0]).alias("nmad"))
    if keys:
        return s.join(b, keys).join(m, keys).select(*keys, "nmad", "bias", "outlier_frac", "catastrophic_frac", "n")
    one = lambda x: x.withColumn("one", F.lit(1))
    return one(s).join(one(b), "one", "left").join(one(m), "one", "left").select("nmad", "bias", "outlier_frac", "catastrophic_frac", "n")


def array_median(xs: Column) -> Column:
    """Median of the non-null elements of a short array."""
    s = F.sort_array(F.filter(xs, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(s)
    mid = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, (mid(F.floor((n - 1) / 2)) + mid(F.floor(n / 2))) / 2.0)


def combined_radius_error(radii: Column, errors: Column) -> Column:
    """Measurement error over the matched bands and population scatter between them, in quadrature."""
    r = F.filter(radii, lambda x: x.isNotNull() & ~F.isnan(x))
    e = F.filter(errors, lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.nullif(F.size(r), F.lit(0))
    measured = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)) / n
    mean = F.aggregate(r, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(r, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.sqrt(measured * measured + var)


def rank_over(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))
