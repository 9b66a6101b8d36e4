"""The relations behind the analysis figures. Bins and curves are small; fits over bins run on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.constants import MIN_PER_TYPE, MIN_PER_TYPE_COMPARE, OMEGA_M, Z_CUT
from skyloom.functions.cosmology import angular_diameter_distance, distance_static, physical_size_kpc, theta_arcsec
from skyloom.functions.labels import dust_group
from skyloom.operators.binning import adaptive_bins, bayesian_edges, bin_catalog, describe, histogram, quartiles, summarise
from skyloom.operators.fit import chi2_stats, fit_bins, fit_radius, with_models
from skyloom.operators.quality import is_star
from skyloom.operators.quantiles import exact_quantiles
from skyloom.operators.robust import sigma_clip_in_bins
from skyloom.session import cut, small

#: Types whose bin edges are held on the driver.
MAX_TYPES = 10_000
STRATEGIES = ("equal_width", "percentile", "bayesian_blocks")


def physical_size_filter(df: DataFrame, z: str = "redshift", theta: str = "r_half_arcsec", lo: float = 0.3, hi: float = 15.0, om: float = OMEGA_M) -> DataFrame:
    """Rows whose physical radius ``R_phys_kpc`` is finite and within the limits, both included."""
    return df.withColumn("R_phys_kpc", physical_size_kpc(F.col(z), F.col(theta), om)).filter(F.col("R_phys_kpc").between(lo, hi))


def in_z_window(df: DataFrame, z: str = "redshift") -> DataFrame:
    return df.filter(F.col(z).between(*Z_CUT))


def frequent_types(df: DataFrame, least: int = MIN_PER_TYPE, column: str = "galaxy_type") -> DataFrame:
    """``(type, n)`` of types with ``least`` rows or more."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def of_frequent_types(df: DataFrame, least: int = MIN_PER_TYPE, column: str = "galaxy_type") -> DataFrame:
    return df.join(small(frequent_types(df, least, column).select(column), 10_000), column, "left_semi")


def box_extract(df: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Rows of a pixel box, edges included, with stars marked anew."""
    out = df.filter(F.col("xcentroid").between(x0, x1) & F.col("ycentroid").between(y0, y1))
    s = is_star(F.col("in_star_mask"), F.col("quality_flag"))
    return out.withColumns({"is_star": s, "is_galaxy": ~s})


def fitted_bins(df: DataFrame, strategy: str, variant: str = "report") -> tuple[DataFrame, dict]:
    """Bins of a strategy with model curves and residuals, and a row of radii and goodness of both models."""
    bins = cut(bin_catalog(df, strategy, variant=variant))
    radius = {m: fit_radius(bins, [], "z_mid", "theta_med", "theta_err", m).first()["radius_mpc"] for m in ("static", "lcdm")}
    if radius["lcdm"] is None:
        return with_models(bins, float("nan"), float("nan")), {"strategy": strategy, "n_bins": 0}
    out = {"strategy": strategy, "n_bins": bins.count()}
    for m, r in radius.items():
        c = chi2_stats(bins, [], "theta_med", "theta_err", theta_arcsec(F.col("z_mid"), r, m), 1).first()
        out |= {f"R_{m}": r, f"chi2_{m}": c["chi2"], f"ndf_{m}": c["ndf"], f"p_{m}": c["p_value"]}
    return with_models(bins, radius["static"], radius["lcdm"]), out


def binning_comparison(df: DataFrame, variant: str = "report", least: int = 10) -> DataFrame | None:
    """Bins, models and residuals of all strategies, ``strategy`` in front; none below ``least`` rows."""
    if df.limit(least).count() < least:
        return None
    out = None
    for s in STRATEGIES:
        b = fitted_bins(df, s, variant)[0].select(F.lit(s).alias("strategy"), "*")
        out = b if out is None else out.unionByName(b)
    return out


def fit_comparison(spark: SparkSession, df: DataFrame, variant: str = "report") -> DataFrame:
    """``fitted_bins``' second part for every strategy."""
    rows = [fitted_bins(df, s, variant)[1] for s in STRATEGIES]
    cols = ["strategy", "n_bins", *[f"{k}_{m}" for m in ("static", "lcdm") for k in ("R", "chi2", "ndf", "p")]]
    kinds = {"strategy": "string", "n_bins": "int", "ndf_static": "int", "ndf_lcdm": "int"}
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"{c} {kinds.get(c, 'double')}" for c in cols))


def two_parameter_fit(df: DataFrame, strategy: str = "percentile", variant: str = "main") -> dict:
    """Radius and matter share fitted to the bins of a strategy."""
    return fit_bins(cut(bin_catalog(df, strategy, variant=variant))).row()


def curve(spark: SparkSession, r_static: float, r_lcdm: float, z_lo: float, z_hi: float, n: int = 300) -> DataFrame:
    """``(z, theta_static, theta_lcdm)`` at ``n`` points."""
    z = F.lit(float(z_lo)) + F.col("id") * ((z_hi - z_lo) / (n - 1))
    t = spark.range(n).select(z.alias("z"))
    return t.select("z", theta_arcsec(F.col("z"), r_static, "static").alias("theta_static"), theta_arcsec(F.col("z"), r_lcdm, "lcdm").alias("theta_lcdm"))


def distance_curves(spark: SparkSession, z_hi: float = 4.0, n: int = 200) -> DataFrame:
    """``(z, da_static, da_lcdm)`` in Mpc."""
    t = spark.range(1, n + 1).select((F.col("id") * (z_hi / n)).alias("z"))
    return t.select("z", distance_static(F.col("z")).alias("da_static"), angular_diameter_distance(F.col("z")).alias("da_lcdm"))


def type_summary(df: DataFrame, least: int = MIN_PER_TYPE_COMPARE, column: str = "galaxy_type") -> DataFrame:
    """``(type, n, median, std, radius_mpc)`` of the sizes of frequent types: all groups in one pass each."""
    d = of_frequent_types(df, least, column).filter(F.col("r_half_arcsec").isNotNull())
    s = describe(d, [column], "r_half_arcsec").select(column, "n", "median", "std")
    return s.join(fit_radius(d, [column], "redshift", "r_half_arcsec", "r_half_arcsec_error").select(column, "radius_mpc"), column, "left")


def per_type_bins(df: DataFrame, n: int = 5, least: int = MIN_PER_TYPE, column: str = "galaxy_type", variant: str = "report") -> DataFrame:
    """Equal-count bins within each type and their summaries, all types at once: edges are per-type quantiles."""
    d = of_frequent_types(df, least, column)
    q = exact_quantiles(d, [column], "redshift", [i / n for i in range(1, n)])
    j = d.join(small(q, 10_000), column).withColumn("bin", F.size(F.filter("q", lambda e: e < F.col("redshift"))) + 1)
    return summarise(j, [column, "bin"], "redshift", "r_half_arcsec", variant)


def _fits(b: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n_bins, R_static, R_lcdm, chi2_static, chi2_lcdm, ndf)`` of bins, by aggregates over the keys."""
    r = fit_radius(b, keys, "z_mid", "theta_med", "theta_err", "static").select(*keys, F.col("radius_mpc").alias("R_static"))
    r = r.join(fit_radius(b, keys, "z_mid", "theta_med", "theta_err", "lcdm").select(*keys, F.col("radius_mpc").alias("R_lcdm"), F.col("n").alias("n_bins")), keys)
    j = b.join(r, keys)
    out = r
    for m in ("static", "lcdm"):
        c = chi2_stats(j, keys, "theta_med", "theta_err", theta_arcsec(F.col("z_mid"), F.col(f"R_{m}"), m), 1, p_value=False)
        out = out.join(c.select(*keys, F.col("chi2").alias(f"chi2_{m}"), *(["ndf"] if m == "lcdm" else [])), keys)
    return out.select(*keys, "n_bins", "R_static", "R_lcdm", "chi2_static", "chi2_lcdm", "ndf")


def per_type_fits(df: DataFrame, **options) -> DataFrame:
    """``(type, n_bins, R_static, R_lcdm, chi2_static, chi2_lcdm, ndf)`` of ``per_type_bins``."""
    return _fits(cut(per_type_bins(df, **options)), [options.get("column", "galaxy_type")])


def per_type_strategies(df: DataFrame, least: int = MIN_PER_TYPE_COMPARE, column: str = "galaxy_type", variant: str = "report") -> DataFrame:
    """``(type, strategy, bin, ...)``: the bins of every strategy within each frequent type, their number by the type's own size. All types and strategies in one aggregation.

    Edges are few numbers per type and reach the driver (at most ``MAX_TYPES`` types, refused beyond). Bayesian blocks stand only in types without repeated redshifts; elsewhere equal widths do, as in ``bayesian_edges``.
    """
    d = cut(of_frequent_types(df, least, column).filter(F.col("redshift").isNotNull()))
    found = d.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("redshift").alias("lo"), F.max("redshift").alias("hi")).limit(MAX_TYPES + 1).collect()
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types")
    counts = {r[column]: adaptive_bins(r["n"], variant) for r in found}
    ps = sorted({i / n for n in set(counts.values()) for i in range(n + 1)})
    q = {r[column]: dict(zip(ps, r["q"])) for r in exact_quantiles(d, [column], "redshift", ps).collect()} if found else {}
    tied = {r[column] for r in d.groupBy(column, "redshift").count().filter("count > 1").select(column).distinct().collect()}
    rows = []
    for r in found:
        t, n = r[column], counts[r[column]]
        equal = np.linspace(r["lo"], r["hi"], n + 1).tolist()
        rows.append((t, "equal_width", equal))
        rows.append((t, "percentile", sorted({q[t][i / n] for i in range(n + 1)})))
        rows.append((t, "bayesian_blocks", equal if t in tied else bayesian_edges(d.filter(F.col(column) == t), "redshift", "r_half_arcsec", variant=variant)))
    edges = df.sparkSession.createDataFrame(rows, f"`{column}` {dict(df.dtypes)[column]}, strategy string, _e array<double>")
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    j = d.join(F.broadcast(edges), column).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("redshift"))) + 1)
    return summarise(j, [column, "strategy", "bin"], "redshift", "r_half_arcsec", variant)


def per_type_strategy_fits(df: DataFrame, least_bins: int = 3, **options) -> DataFrame:
    """``(type, strategy, n_bins, R_static, R_lcdm, chi2_static, chi2_lcdm, ndf)`` of ``per_type_strategies``, of types with ``least_bins`` bins or more by any strategy."""
    column = options.get("column", "galaxy_type")
    f = cut(_fits(cut(per_type_strategies(df, **options)), [column, "strategy"]))
    enough = f.filter(F.col("n_bins") >= least_bins).select(column).distinct()
    return f.join(enough, column, "left_semi")


def combined_types_fit(df: DataFrame, types: list[str], least: int = MIN_PER_TYPE, clip_from: int = 20) -> dict | None:
    """Redshift window, types, size limits, clipping, then the fit of the percentile bins; nothing where fewer than ``least`` rows are left."""
    d = in_z_window(df).filter(F.col("galaxy_type").isin(*types))
    before = d.count()
    if before < least:
        return None
    d = physical_size_filter(d)
    if d.limit(clip_from).count() >= clip_from:
        d = sigma_clip_in_bins(d)
    d = cut(d)
    n = d.count()
    return fitted_bins(d, "percentile")[1] | {"n": n, "n_before": before} if n >= least else None


def with_dust_groups(df: DataFrame) -> DataFrame:
    return df.withColumn("combined_type", dust_group(F.col("galaxy_type")))


def redshift_histogram(df: DataFrame, z: str = "redshift") -> DataFrame:
    """Counts in as many equal bins as the sample size asks for (15 to 50)."""
    n, lo, hi = df.filter(F.col(z).isNotNull() & ~F.isnan(z)).agg(F.count(z), F.min(z), F.max(z)).first()
    bins = min(50, max(15, n // 10))
    return histogram(df, z, lo, hi, bins) if n and hi > lo else histogram(df, z, 0.0, 1.0, bins).limit(0)


def type_histogram(df: DataFrame, column: str = "galaxy_type") -> DataFrame:
    """``(type, n, share)``, the most frequent first by ``n``."""
    g = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).select(column, "n", (100.0 * F.col("n") / F.col("total")).alias("share"))


def size_distribution(df: DataFrame, column: str = "galaxy_type") -> DataFrame:
    return quartiles(df, [column], "r_half_arcsec")


def sources_summary(df: DataFrame) -> DataFrame:
    """One row: rows, types, the most frequent type, redshift and size ranges."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("galaxy_type").alias("n_types"), F.mode("galaxy_type", True).alias("top_type"), F.min("redshift").alias("z_min"), F.max("redshift").alias("z_max"), F.min("r_half_arcsec").alias("theta_min"), F.max("r_half_arcsec").alias("theta_max"))


def all_relations(spark: SparkSession, df: DataFrame) -> dict[str, DataFrame]:
    """Every relation behind the figures of one catalog by name; those that need more rows than there are, are absent."""
    out = {
        "fit_comparison": fit_comparison(spark, df), "per_type_bins": per_type_bins(in_z_window(df)), "per_type_fits": per_type_fits(in_z_window(df)), "per_type_strategies": per_type_strategies(df),
        "per_type_strategy_fits": per_type_strategy_fits(df), "type_summary": type_summary(df), "type_histogram": type_histogram(df), "size_distribution": size_distribution(df), "redshift_histogram": redshift_histogram(df),
        "distance_curves": distance_curves(spark), "sources_summary": sources_summary(df),
    }
    bins = binning_comparison(df)
    return out | ({"binning_comparison": bins} if bins is not None else {})
