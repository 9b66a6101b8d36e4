"""Queries over the galaxy catalog: expressions, bins, robust statistics, fits, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.constants import ARCSEC_TO_RAD, FLAGS, SED_GROUP, SIMPLE_CENTRE, SIMPLE_WIDTH
from skyloom.functions import cosmology as cos
from skyloom.functions import labels, photometry
from skyloom.functions import sky as sky_functions
from skyloom.functions.angles import sexagesimal_dec, sexagesimal_ra
from skyloom.operators import binning, fit, quality, reports, robust, validation
from skyloom.operators.matching import sky_match
from skyloom.plans.common import MEAS, Registry, gauss_sql, measured, rounded
from skyloom.sources.catalogs import catalog_with_fits, read_catalog, redshift_entries
from skyloom.session import table
from skyloom.streaming.binned import windowed_bins

query = Registry()
ASEC = repr(ARCSEC_TO_RAD) + "::double"


@query("q_scan_filter_catalog", MEAS + " SELECT record_id, redshift, r_half_arcsec, galaxy_type FROM meas WHERE redshift BETWEEN 0.3 AND 2.0")
def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    m = read_catalog(measured(spark, d), ["redshift", "r_half_arcsec", "r_half_arcsec_error"])
    return reports.in_z_window(m).select("record_id", "redshift", "r_half_arcsec", "galaxy_type")


# Bins.

_N = {
    "main": "greatest(3, least(floor(sqrt(count(*)))::bigint, count(*) // 5, 20))",
    "report": "greatest(5, least(count(*) // (CASE WHEN count(*) < 100 THEN 10 WHEN count(*) < 300 THEN 15 WHEN count(*) < 1000 THEN 20 ELSE 25 END), count(*) // 8, "
    "CASE WHEN count(*) < 200 THEN 12 WHEN count(*) < 1000 THEN 20 WHEN count(*) < 5000 THEN 35 ELSE 50 END))",
}
_ERR = {
    "main": "CASE WHEN count(r_half_arcsec) = 1 THEN 0.1 * median(r_half_arcsec) WHEN count(r_half_arcsec) = 2 THEN (max(r_half_arcsec) - min(r_half_arcsec)) / 2 ELSE 1.2533 * stddev_samp(r_half_arcsec) / sqrt(count(*)) END",
    "report": "CASE WHEN count(r_half_arcsec) >= 3 THEN 1.2533 * stddev_samp(r_half_arcsec) / sqrt(count(*)) END",
}


def _summary_sql(keys: str, source: str, variant: str) -> str:
    return f"""SELECT * FROM (SELECT {keys}, round(median(redshift), 9) AS z_mid, round(median(r_half_arcsec), 9) AS theta_med, round({_ERR[variant]}, 9) AS theta_err,
        CASE WHEN count(*) >= 2 THEN round(quantile_cont(r_half_arcsec, 0.16), 9) END AS theta_lo, CASE WHEN count(*) >= 2 THEN round(quantile_cont(r_half_arcsec, 0.84), 9) END AS theta_hi,
        count(redshift) AS n FROM {source} GROUP BY {keys}) WHERE theta_err IS NOT NULL"""


def _bin_sql(strategy: str, variant: str) -> str:
    edges = {
        "equal_width": "SELECT list_transform(range(0, n + 1), lambda i: CASE WHEN i = n THEN hi ELSE i * ((hi - lo) / n) + lo END) AS e FROM c",
        "percentile": "SELECT list_sort(list_distinct(list(q))) AS e FROM (SELECT i, CASE WHEN i = n THEN hi ELSE (SELECT quantile_cont(redshift, x.p) FROM meas) END AS q FROM (SELECT 0 AS i, 0 AS n, 0.0 AS hi, 0.0 AS p) x)",
    }[strategy]
    if strategy == "percentile":  # order statistics by hand, as the number of edges depends on the rows
        edges = """SELECT list_sort(list_distinct(list(a.redshift + (b.redshift - a.redshift) * (p - floor(p))))) AS e
            FROM (SELECT (cnt - 1) * (i::double / n) AS p FROM c, range(0, 51) t(i) WHERE i <= n) q
            JOIN r a ON a.k = floor(q.p)::bigint JOIN r b ON b.k = ceil(q.p)::bigint"""
    ranked = ", r AS (SELECT redshift, row_number() OVER (ORDER BY redshift) - 1 AS k FROM meas)" if strategy == "percentile" else ""
    return f"""{MEAS}, c AS (SELECT {_N[variant]} AS n, count(*) AS cnt, min(redshift) AS lo, max(redshift) AS hi FROM meas){ranked}, ed AS ({edges}),
        b AS (SELECT meas.*, greatest(len(list_filter(ed.e, lambda x: x < redshift)), 1)::int AS bin FROM meas, ed) """ + _summary_sql("bin", "b", variant)


def _rounded_bins(b: DataFrame) -> DataFrame:
    return b.select("bin", *[rounded(c).alias(c) for c in ("z_mid", "theta_med", "theta_err", "theta_lo", "theta_hi")], "n")


def _register_bins() -> None:
    for s in ("equal_width", "percentile"):
        for v in ("main", "report"):
            def run(spark, d, s=s, v=v):
                return _rounded_bins(binning.bin_catalog(measured(spark, d), s, variant=v))

            query(f"q_bin_{s}_{v}", _bin_sql(s, v))(run)


_register_bins()


@query("q_bin_bayesian_blocks", _bin_sql("equal_width", "main"))  # redshifts on a grid repeat, so equal widths stand in
def bayesian(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_bins(binning.bin_catalog(measured(spark, d), "bayesian_blocks"))


def _blocks_sql(points: str) -> str:
    """CTE ``pick(grp, e)``: the edges of Bayesian blocks of every group of ``points`` (``grp, z, t``, no ``z`` twice in a group)."""
    return f"""p AS ({points}),
    ps AS (SELECT grp, count(*) AS n, median(t) AS med, min(z) AS lo, max(z) AS hi FROM p GROUP BY 1), pg AS (SELECT grp, greatest(1.4826::double * median(abs(t - med)), 0.01::double * max(med)) AS sigma FROM p JOIN ps USING (grp) GROUP BY 1),
    pc AS (SELECT grp, list(z ORDER BY z) AS zs, list(c ORDER BY z) AS cx FROM (SELECT grp, z, sum(t) OVER (PARTITION BY grp ORDER BY z) / (sigma * sigma) AS c FROM p JOIN pg USING (grp)) GROUP BY 1),
    pa AS (SELECT grp, n, lo, hi, 1 / (sigma * sigma) AS w, zs, cx FROM ps JOIN pg USING (grp) JOIN pc USING (grp)),
    dp AS (SELECT grp, p0, 0 AS r, [0.0::double] AS best, []::bigint[] AS last FROM pa, (VALUES (0.05::double), (0.2::double)) v(p0)
      UNION ALL SELECT grp, p0, r + 1, list_append(best, list_max(f)), list_append(last, list_position(f, list_max(f)) - 1)
      FROM (SELECT dp.*, list_transform(range(0, r + 1), lambda j: pow(cx[r + 1] - (CASE WHEN j = 0 THEN 0 ELSE cx[j] END), 2) / (2 * w * (r + 1 - j)) - (4 - ln(73.53::double * p0 * pow(n, -0.478::double))) + best[j + 1]) AS f FROM dp JOIN pa USING (grp) WHERE r < n)),
    back AS (SELECT grp, p0, last, n AS cut FROM dp JOIN pa USING (grp) WHERE r = n UNION ALL SELECT grp, p0, last, last[cut] FROM back WHERE cut > 0),
    pe AS (SELECT grp, p0, list(CASE WHEN cut = 0 THEN zs[1] WHEN cut = n THEN zs[n] ELSE (zs[cut] + zs[cut + 1]) / 2 END ORDER BY cut) AS e FROM back JOIN pa USING (grp) GROUP BY 1, 2),
    po AS (SELECT grp, max(CASE WHEN p0 < 0.1 THEN e END) AS x, max(CASE WHEN p0 > 0.1 THEN e END) AS y FROM pe GROUP BY 1),
    pick AS (SELECT grp, CASE WHEN len(x) < 4 THEN list_transform(range(0, 4), lambda i: lo + i * ((hi - lo) / 3)) WHEN len(x) <= 16 THEN x WHEN len(y) <= 16 THEN y ELSE list_transform(range(0, 12), lambda i: lo + i * ((hi - lo) / 11)) END AS e FROM po JOIN pa USING (grp))"""


_RECURSIVE = MEAS.replace("WITH f", "WITH RECURSIVE f")
_BLOCKS = _blocks_sql("SELECT 1 AS grp, floor(redshift / 0.05::double) * 0.05::double AS z, median(r_half_arcsec) AS t FROM meas GROUP BY 2")


@query("q_bayesian_block_edges", _RECURSIVE + f", {_BLOCKS} SELECT generate_subscripts(e, 1)::int AS i, round(unnest(e), 9) AS edge FROM pick")
def block_edges(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the median sizes in steps of 0.05, over all rows: no redshift repeats, so the blocks themselves are computed."""
    steps = measured(spark, d).groupBy((F.floor(F.col("redshift") / 0.05) * 0.05).alias("z")).agg(F.median("r_half_arcsec").alias("t"))
    e = binning.bayesian_edges(steps, "z", "t")
    return spark.createDataFrame([(i + 1, round(x, 9)) for i, x in enumerate(e)], "i int, edge double")


@query(
    "q_bin_edges_choice",
    MEAS + """, c AS (SELECT greatest(2, least(greatest(count(*) // 25, 4), 10)) AS n, count(*) AS cnt FROM meas), r AS (SELECT redshift, row_number() OVER (ORDER BY redshift) - 1 AS k FROM meas),
      e AS (SELECT DISTINCT a.redshift + (b.redshift - a.redshift) * (p - floor(p)) AS e FROM (SELECT (cnt - 1) * (i::double / n) AS p FROM c, range(0, 11) t(i) WHERE i <= n) q
            JOIN r a ON a.k = floor(q.p)::bigint JOIN r b ON b.k = ceil(q.p)::bigint)
      SELECT (row_number() OVER (ORDER BY e))::int AS i, round(e, 9) AS edge FROM e""",
)
def edges_choice(spark: SparkSession, d: str) -> DataFrame:
    e = binning.choose_edges(measured(spark, d), "redshift")
    return spark.createDataFrame([(i + 1, round(x, 9)) for i, x in enumerate(e)], "i int, edge double")


@query("q_se_median_variants", MEAS + f" SELECT strftime(run_day, '%Y-%m-%d') AS run_day, count(*) AS n, round({_ERR['main']}, 9) AS err_main, round({_ERR['report']}, 9) AS err_report FROM meas GROUP BY 1")
def se_variants(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d).withColumn("run_day", F.date_format("run_day", "yyyy-MM-dd"))
    a = binning.summarise(m, ["run_day"], "redshift", "r_half_arcsec", "main").select("run_day", "n", rounded("theta_err").alias("err_main"))
    return a.join(binning.summarise(m, ["run_day"], "redshift", "r_half_arcsec", "report").select("run_day", rounded("theta_err").alias("err_report")), "run_day", "left")


# Cosmology and other expressions.


@query("q_angular_diameter_distance", f"{MEAS} SELECT record_id, round({gauss_sql('redshift')}, 4) AS da, round(299792.458::double / 70.0 * greatest(redshift, 1e-6), 4) AS da_static, round(sqrt(greatest(0.3::double * pow(1 + redshift, 3) + 0.7, 0)), 9) AS e FROM meas")
def da(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("redshift")
    return measured(spark, d).select("record_id", rounded(cos.angular_diameter_distance(z), 4).alias("da"), rounded(cos.distance_static(z), 4).alias("da_static"), rounded(cos.e_of_z(z)).alias("e"))


@query("q_theta_models", f"{MEAS} SELECT record_id, round(0.005::double / (299792.458::double / 70.0 * greatest(redshift, 1e-6)) / {ASEC}, 9) AS theta_static, round(0.005::double / {gauss_sql('redshift')} / {ASEC}, 9) AS theta_lcdm FROM meas")
def theta_models(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("redshift")
    return measured(spark, d).select("record_id", rounded(cos.theta_arcsec(z, 0.005, "static")).alias("theta_static"), rounded(cos.theta_arcsec(z, 0.005)).alias("theta_lcdm"))


@query("q_physical_size_filter", f"{MEAS}, s AS (SELECT record_id, r_half_arcsec * {ASEC} * {gauss_sql('redshift')} * 1000 AS k FROM meas) SELECT record_id, round(k, 9) AS r_kpc FROM s WHERE k BETWEEN 0.3 AND 15")
def physical_size(spark: SparkSession, d: str) -> DataFrame:
    return reports.physical_size_filter(measured(spark, d)).select("record_id", rounded("R_phys_kpc").alias("r_kpc"))


@query("q_size_conversions", f"{MEAS} SELECT record_id, round(r_half_arcsec * {ASEC} * {gauss_sql('redshift')} * 1000, 9) AS kpc, round(5.0::double / 1000 / {gauss_sql('redshift')} / {ASEC}, 9) AS arcsec_of_5kpc FROM meas")
def conversions(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("redshift")
    return measured(spark, d).select("record_id", rounded(cos.physical_size_kpc(z, F.col("r_half_arcsec"))).alias("kpc"), rounded(cos.angular_size_arcsec(z, 5.0)).alias("arcsec_of_5kpc"))


_LAMBDAS = [950.0, 1100.0, 2500.0, 4556.0, 8002.0]


@query(
    "q_igm_transmission",
    MEAS + ", l AS (SELECT record_id, redshift AS z, unnest([950.0, 1100.0, 2500.0, 4556.0, 8002.0])::double AS lam FROM meas), "
    "t AS (SELECT *, " + " + ".join(f"(CASE WHEN lam < {w} * (1 + z) THEN {k} * pow(lam / {w}, 3.46) ELSE 0 END)" for w, k in ((1216.0, 0.0036), (1026.0, 0.0017), (972.5, 0.0012)))
    + " + (CASE WHEN lam < 912.0 * (1 + z) THEN least(0.25 * pow(lam / 912.0, 3) * pow(1 + z, 0.46), 30.0) ELSE 0 END) AS tau FROM l) "
    "SELECT record_id, lam, round(CASE WHEN z < 0.1 THEN 1.0 ELSE least(greatest(exp(-tau), 0), 1) END, 9) AS transmission FROM t",
)
def igm(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d).select("record_id", "redshift", F.explode(F.array(*map(F.lit, _LAMBDAS))).alias("lam"))
    return m.select("record_id", "lam", rounded(photometry.igm_transmission(F.col("lam"), F.col("redshift"))).alias("transmission"))


@query(
    "q_calzetti",
    "WITH l AS (SELECT id, best_a_v AS av, unnest([1500.0, 3000.0, 6500.0, 12000.0, 30000.0])::double / 10000 AS u FROM (SELECT DISTINCT id, best_a_v FROM photoz_result)), "
    "k AS (SELECT *, greatest(CASE WHEN u >= 0.12 AND u < 0.63 THEN 2.659 * (-2.156 + 1.509 / u - 0.198 / (u * u) + 0.011 / (u * u * u)) + 4.05 WHEN u >= 0.63 AND u <= 2.2 THEN 2.659 * (-1.857 + 1.040 / u) + 4.05 ELSE 0 END, 0) AS k FROM l) "
    "SELECT id, round(u * 10000, 1) AS lam, round(CASE WHEN av <= 0 THEN 1.0 ELSE least(greatest(pow(10, -0.4 * k * av / 4.05), 0), 1) END, 9) AS transmission FROM k",
)
def calzetti(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "photoz_result").select("id", "best_a_v").distinct().withColumn("lam", F.explode(F.array(*map(F.lit, [1500.0, 3000.0, 6500.0, 12000.0, 30000.0]))))
    return p.select("id", F.round("lam", 1).alias("lam"), rounded(photometry.calzetti(F.col("lam"), F.col("best_a_v"))).alias("transmission"))


_STELL = """CASE WHEN w > 0 THEN t / w ELSE 0 END"""
_STAR_SQL = """s AS (SELECT source_id, r_half_pix AS r, concentration AS c, ellipticity AS e, isfinite(r_half_pix) AND r_half_pix > 0 AS vr, isfinite(concentration) AS vc, isfinite(ellipticity) AS ve FROM b),
    w AS (SELECT *, CASE WHEN vr THEN 2.0 * (CASE WHEN r / 0.945 <= 1 THEN 1 ELSE greatest(2 - r / 0.945, 0) END) ELSE 0 END + CASE WHEN vc THEN least(greatest((c - 0.35) / 0.20, 0), 1) ELSE 0 END
      + CASE WHEN ve THEN greatest(1 - e / 0.3, 0) ELSE 0 END AS t, CASE WHEN vr THEN 2.0 ELSE 0 END + CASE WHEN vc THEN 1.0 ELSE 0 END + CASE WHEN ve THEN 1.0 ELSE 0 END AS w FROM s)"""


@query(
    "q_stellarity",
    "WITH b AS (SELECT DISTINCT source_id, r_half_pix, concentration, ellipticity FROM band_catalog), " + _STAR_SQL
    + f" SELECT source_id, round({_STELL}, 9) AS stellarity, CASE WHEN isfinite(r) THEN round(sqrt(greatest(r * r - pow(2.25 / 2.355, 2), 0)), 9) END AS r_corrected FROM w",
)
def stellarity(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "band_catalog").select("source_id", "r_half_pix", "concentration", "ellipticity").distinct()
    s = photometry.stellarity(F.col("r_half_pix"), F.col("concentration"), F.col("ellipticity"))
    return b.select("source_id", rounded(s).alias("stellarity"), rounded(photometry.psf_corrected_radius(photometry.clean(F.col("r_half_pix")))).alias("r_corrected"))


@query(
    "q_stellar_colors",
    "WITH m AS (SELECT record_id, " + ", ".join(f"CASE WHEN isfinite(flux_{b}) AND flux_{b} > 0 THEN -2.5 * log10(flux_{b}) END AS m{i}" for i, b in enumerate(("f300", "f450", "f606", "f814"))) + " FROM galaxy_catalog), "
    "c AS (SELECT record_id, list_filter([m0 - m1, m1 - m2, m2 - m3], lambda x: x IS NOT NULL) AS c FROM m) "
    "SELECT record_id, round(CASE WHEN len(c) = 0 THEN 0 ELSE greatest(1 - list_stddev_pop(c), 0) * greatest(1 - list_max(list_transform(c, lambda x: abs(x))) / 2, 0) END, 9) AS color_stellarity FROM c",
)
def colors(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "galaxy_catalog")
    return g.select("record_id", rounded(photometry.color_stellarity(*[F.col(f"flux_{b}") for b in ("f300", "f450", "f606", "f814")])).alias("color_stellarity"))


@query(
    "q_source_expressions",
    "SELECT source_id, band, round(abs(source_sky) / (source_error + 1e-10), 4) AS snr2, round(r_half_pix * source_error / (2 * abs(source_sky) + 1e-10), 4) AS r_err2, CASE WHEN r_90_pix > 0 THEN round(r_half_pix / r_90_pix, 9) END AS conc2, "
    "round(source_sky * (CASE band WHEN 'f300' THEN 59.9 WHEN 'f450' THEN 8.8 WHEN 'f606' THEN 1.89 WHEN 'f814' THEN 2.45 END), 9) AS flux_e18 FROM "
    "(SELECT DISTINCT source_id, band, source_sky, source_error, r_half_pix, r_90_pix FROM band_catalog WHERE isfinite(source_sky) AND isfinite(source_error) AND isfinite(r_half_pix) AND isfinite(r_90_pix))",
)
def source_expressions(spark: SparkSession, d: str) -> DataFrame:
    cols = ["source_sky", "source_error", "r_half_pix", "r_90_pix"]
    b = table(spark, d, "band_catalog").select("source_id", "band", *[photometry.clean(F.col(c)).alias(c) for c in cols]).dropna(subset=cols).distinct()
    f, e, r = F.col("source_sky"), F.col("source_error"), F.col("r_half_pix")
    return b.select("source_id", "band", rounded(photometry.snr(f, e), 4).alias("snr2"), rounded(photometry.radius_error(r, f, e), 4).alias("r_err2"), rounded(photometry.concentration_ratio(r, F.col("r_90_pix"))).alias("conc2"), rounded(photometry.calibrated(f, F.col("band")) * 1e18, 9).alias("flux_e18"))


@query(
    "q_sexagesimal",
    "WITH p AS (SELECT specz_id, string_split_regex(trim(raj2000), '\\s+') AS a, string_split_regex(trim(dej2000), '\\s+') AS d, trim(dej2000) AS t FROM specz_catalog WHERE raj2000 IS NOT NULL) "
    "SELECT specz_id, round((a[1]::double + a[2]::double / 60 + a[3]::double / 3600) * 15, 7) AS ra, round((CASE WHEN starts_with(t, '-') THEN -1 ELSE 1 END) * (abs(d[1]::double) + d[2]::double / 60 + d[3]::double / 3600), 7) AS dec FROM p",
)
def sexagesimal(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "specz_catalog").filter("raj2000 is not null")
    return s.select("specz_id", rounded(sexagesimal_ra(F.col("raj2000")), 7).alias("ra"), rounded(sexagesimal_dec(F.col("dej2000")), 7).alias("dec"))


# Quality.


@query(
    "q_quality_flags",
    MEAS + " SELECT record_id, ((CASE WHEN snr_min < 5 THEN 8 ELSE 0 END) | (CASE WHEN snr_median < 0.5 THEN 512 ELSE 0 END) | (CASE WHEN stellarity > 0.35 OR (isfinite(ellipticity) AND ellipticity < 0.25 AND isfinite(concentration) AND concentration > 0.40 AND r_half_arcsec / 0.04 / 0.945 < 2.5) THEN 64 ELSE 0 END)"
    " | (CASE WHEN in_star_mask THEN 192 ELSE 0 END) | (CASE WHEN odds < 0.4 OR redshift <= 0.060000000000000005::double OR redshift >= 5.99 THEN 32 ELSE 0 END) | (CASE WHEN isfinite(redshift_err) AND redshift_err > redshift THEN 256 ELSE 0 END))::int AS flag FROM meas",
)
def flags(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d)
    bits = quality.snr_bits(F.col("snr_min"), F.col("snr_median")) + [quality.star_bit(F.col("stellarity"), F.col("r_half_arcsec") / 0.04, F.col("ellipticity"), F.col("concentration")), *quality.mask_bits(F.col("in_star_mask"))]
    bits += quality.photoz_bits(F.col("odds"), photometry.at_boundary(F.col("redshift")), F.col("redshift"), photometry.clean(F.col("redshift_err")))
    return m.select("record_id", quality.with_bits(F.lit(0), *bits).alias("flag"))


@query("q_flag_histogram", " UNION ALL ".join(f"SELECT '{k}' AS flag, {b} AS bit, count(*) FILTER (WHERE quality_flag & {b} != 0) AS n FROM galaxy_catalog" for k, b in FLAGS.items()))
def flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_histogram(table(spark, d, "galaxy_catalog"))


@query(
    "q_quality_cascade",
    MEAS + ", b AS (SELECT *, redshift <= 0.060000000000000005::double OR redshift >= 5.99 AS edge FROM meas), l AS (SELECT *, quality_flag & 4095 = 0 AND odds_flag = 0 AND chi2_flag = 0 AND NOT bimodal_flag AS a, quality_flag & 224 = 0 AS m, quality_flag & 192 = 0 AS u FROM b),"
    " n AS (SELECT count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE m) AS nm FROM l) SELECT record_id, quality_flag FROM l, n WHERE NOT edge AND CASE WHEN na >= 10 THEN a WHEN nm >= 10 THEN m ELSE u END",
)
def cascade(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d).withColumn("z_boundary_flag", photometry.at_boundary(F.col("redshift")))
    return quality.quality_cascade(m).select("record_id", "quality_flag")


@query("q_star_classification", "SELECT record_id, coalesce(in_star_mask, false) OR quality_flag & 64 != 0 AS is_star, coalesce(isfinite(flux_f300) AND flux_f300 > 0, false) AS has_uband FROM galaxy_catalog")
def stars(spark: SparkSession, d: str) -> DataFrame:
    u = F.coalesce(photometry.clean(F.col("flux_f300")) > 0, F.lit(False))
    return table(spark, d, "galaxy_catalog").select("record_id", quality.is_star(F.col("in_star_mask"), F.col("quality_flag")).alias("is_star"), u.alias("has_uband"))


@query("q_box_extract", "SELECT record_id, coalesce(in_star_mask, false) OR quality_flag & 64 != 0 AS is_star FROM galaxy_catalog WHERE xcentroid BETWEEN 489000 AND 491048 AND ycentroid BETWEEN 489000 AND 491048")
def box(spark: SparkSession, d: str) -> DataFrame:
    return reports.box_extract(table(spark, d, "galaxy_catalog"), 489000.0, 491048.0, 489000.0, 491048.0).select("record_id", "is_star")


# Redshift validation.

_SPEC = "isfinite(z_spec) AND z_spec > 0 AND z_spec <= 8 AND isfinite(z_phot) AND z_phot > 0 AND z_phot <= 8"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    ok = lambda c: (F.col(c) > 0) & (F.col(c) <= 8.0)
    return catalog_with_fits(spark, d).filter(ok("z_spec") & ok("z_phot"))


_METRICS = "round(1.48 * median(abs(d)), 9) AS nmad, round(median(d), 9) AS bias, round(avg((abs(d) > 0.15)::int), 9) AS outlier_frac, round(avg((abs(d) > 0.30)::int), 9) AS catastrophic_frac, count(*) AS n"
_PAIRS = MEAS + f", p AS (SELECT *, (z_phot - z_spec) / (1 + z_spec) AS d FROM cat WHERE {_SPEC})"


def _rounded_metrics(m: DataFrame, *keys: str) -> DataFrame:
    return m.select(*keys, *[rounded(c).alias(c) for c in ("nmad", "bias", "outlier_frac", "catastrophic_frac")], "n")


@query("q_photoz_metrics", f"{_PAIRS} SELECT {_METRICS} FROM p")
def metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_metrics(robust.redshift_metrics(_pairs(spark, d), "z_phot", "z_spec"))


@query("q_metrics_by_bands", f"{_PAIRS} SELECT n_valid_bands, {_METRICS}, CASE WHEN n_valid_bands >= 4 THEN 'reliable' ELSE 'degenerate' END AS label FROM p GROUP BY n_valid_bands HAVING count(*) >= 5")
def metrics_by_bands(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_metrics(validation.metrics_by_bands(_pairs(spark, d), "z_phot", "z_spec"), "n_valid_bands", "label")


@query("q_outliers_by_redshift", f"{_PAIRS} SELECT floor(z_spec / 0.5)::int AS bin, floor(z_spec / 0.5) * 0.5 AS z_lo, (floor(z_spec / 0.5) + 1) * 0.5 AS z_hi, round(avg((abs(d) > 0.15)::int), 9) AS outlier_frac, count(*) AS n FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def outliers(spark: SparkSession, d: str) -> DataFrame:
    return validation.outliers_by_redshift(_pairs(spark, d), "z_phot", "z_spec").withColumn("outlier_frac", rounded("outlier_frac"))


@query(
    "q_apply_specz",
    f"{MEAS} SELECT record_id, round(z_phot, 9) AS redshift_phot_original, round(CASE WHEN isfinite(z_spec) AND z_spec > 0 AND z_spec <= 8 THEN z_spec ELSE z_phot END, 9) AS redshift, CASE WHEN isfinite(z_spec) AND z_spec > 0 AND z_spec <= 8 THEN 'spec' ELSE 'phot' END AS redshift_source,"
    f" coalesce({_SPEC} AND abs(z_phot - z_spec) / (1 + z_spec) > 0.15, false) AS catastrophic_outlier, (quality_flag | CASE WHEN {_SPEC} AND abs(z_phot - z_spec) / (1 + z_spec) > 0.15 THEN 2048 ELSE 0 END)::int AS quality_flag FROM cat WHERE isfinite(z_phot) AND z_phot > 0 AND z_phot <= 8",
)
def apply_specz(spark: SparkSession, d: str) -> DataFrame:
    c = catalog_with_fits(spark, d).withColumn("redshift", F.col("z_phot")).filter((photometry.clean(F.col("z_phot")) > 0) & (F.col("z_phot") <= 8.0))
    c = c.withColumn("z_spec", F.when((photometry.clean(F.col("z_spec")) > 0) & (F.col("z_spec") <= 8.0), F.col("z_spec")))
    out = validation.flag_catastrophic(validation.apply_spectroscopic(c))
    return out.select("record_id", rounded("redshift_phot_original").alias("redshift_phot_original"), rounded("redshift").alias("redshift"), "redshift_source", "catastrophic_outlier", "quality_flag")


_ENTRIES = """e AS (SELECT specz_id, lower(trim(catalog_name)) AS list, coalesce(t.trust_rank, 1073741824) AS o, z_spec,
      coalesce(CASE WHEN isnan(ra) THEN NULL ELSE ra END, (string_split_regex(trim(raj2000), '\\s+')[1]::double + string_split_regex(trim(raj2000), '\\s+')[2]::double / 60 + string_split_regex(trim(raj2000), '\\s+')[3]::double / 3600) * 15) AS ra,
      coalesce(CASE WHEN isnan(dec) THEN NULL ELSE dec END, (CASE WHEN starts_with(trim(dej2000), '-') THEN -1 ELSE 1 END) * (abs(string_split_regex(trim(dej2000), '\\s+')[1]::double) + string_split_regex(trim(dej2000), '\\s+')[2]::double / 60 + string_split_regex(trim(dej2000), '\\s+')[3]::double / 3600)) AS dec
    FROM specz_catalog s LEFT JOIN specz_source t ON lower(trim(s.catalog_name)) = lower(trim(t.source_name)) WHERE z_spec > 0 AND NOT isnan(z_spec))"""


@query(
    "q_sky_match_priority",
    f"""WITH {_ENTRIES}, g AS (SELECT record_id, radians(ra) AS a, radians(dec) AS b, dec AS dd FROM galaxy_catalog WHERE isfinite(ra) AND isfinite(dec) AND abs(dec) <= 90),
      j AS (SELECT g.record_id, e.*, degrees(2 * asin(least(1, sqrt(pow(sin((radians(e.dec) - b) / 2), 2) + cos(b) * cos(radians(e.dec)) * pow(sin((radians(e.ra) - a) / 2), 2))))) * 3600 AS sep
            FROM g JOIN e ON e.dec BETWEEN g.dd - 0.001 AND g.dd + 0.001),
      r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(sep, 9), o, specz_id) AS k FROM j WHERE sep <= 1.5)
      SELECT record_id, z_spec, list AS z_spec_source, round(sep, 4) AS sep FROM r WHERE k = 1""",
)
def sky(spark: SparkSession, d: str) -> DataFrame:
    e = redshift_entries(table(spark, d, "specz_catalog"), table(spark, d, "specz_source"))
    m = sky_match(table(spark, d, "galaxy_catalog"), e)
    return m.select("record_id", "z_spec", "z_spec_source", rounded("z_spec_sep_arcsec", 4).alias("sep"))


# Robust statistics and reports.


@query(
    "q_sigma_clip",
    MEAS + ", q AS (SELECT quantile_cont(redshift, [0.2, 0.4, 0.6, 0.8]) AS e FROM meas), r0 AS (SELECT record_id, r_half_arcsec AS v, len(list_filter(e, lambda x: x < redshift)) + 1 AS b FROM meas, q)"
    + "".join(f", s{i} AS (SELECT *, median(v) OVER (PARTITION BY b) AS m, stddev_pop(v) OVER (PARTITION BY b) AS s FROM r{i}), r{i + 1} AS (SELECT record_id, v, b FROM s{i} WHERE abs(v - m) <= 2.5 * s)" for i in range(3))
    + " SELECT record_id, b::int AS bin FROM r3",
)
def sigma_clip(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d)
    e = binning.quantile_edges(m, "redshift", 5)
    kept = robust.sigma_clip(m.withColumn("bin", binning.assign_bin(F.col("redshift"), e)), "bin", "r_half_arcsec")
    return kept.select("record_id", "bin")


@query("q_mad_scale", MEAS + ", m AS (SELECT median(r_half_arcsec) AS m FROM meas) SELECT round(greatest(1.4826 * median(abs(r_half_arcsec - m)), 0.01 * max(m)), 9) AS scale FROM meas, m")
def mad(spark: SparkSession, d: str) -> DataFrame:
    return robust.mad_scale(measured(spark, d), "r_half_arcsec").select(rounded("scale").alias("scale"))


@query("q_type_filter", MEAS + " SELECT galaxy_type, count(*) AS n FROM meas WHERE galaxy_type IS NOT NULL GROUP BY galaxy_type HAVING count(*) >= 30")
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    return reports.frequent_types(measured(spark, d))


@query("q_combined_types", MEAS + " SELECT coalesce(CASE WHEN galaxy_type IN ('sbt1','sbt2') THEN 'low_dust' WHEN galaxy_type IN ('sbt3','sbt4','sbt5','sbt6') THEN 'high_dust' ELSE galaxy_type END, 'none') AS combined_type, count(*) AS n FROM meas GROUP BY 1")
def combined_types(spark: SparkSession, d: str) -> DataFrame:
    return reports.with_dust_groups(measured(spark, d)).groupBy(F.coalesce("combined_type", F.lit("none")).alias("combined_type")).agg(F.count(F.lit(1)).alias("n"))


@query("q_sed_morphology", MEAS + " SELECT record_id, CASE galaxy_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SED_GROUP.items()) + " ELSE 'unknown' END AS sed_morphology FROM meas")
def sed_morphology(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).select("record_id", labels.sed_group(F.col("galaxy_type")).alias("sed_morphology"))


_RADIUS = f"r_half_arcsec * {ASEC} * {gauss_sql('greatest(redshift, 1e-6)')}"


@query(
    "q_type_summary",
    f"{MEAS}, t AS (SELECT *, {_RADIUS} AS r, 1 / (r_half_arcsec_error * r_half_arcsec_error) AS w FROM meas WHERE galaxy_type IS NOT NULL) SELECT galaxy_type, count(*) AS n, round(median(r_half_arcsec), 9) AS median, round(stddev_samp(r_half_arcsec), 9) AS std, "
    "round(CASE WHEN count(*) < 2 THEN NULL WHEN count(*) FILTER (WHERE redshift >= 0.1) >= 2 THEN sum(w * r) FILTER (WHERE redshift >= 0.1) / sum(w) FILTER (WHERE redshift >= 0.1) ELSE median(r) END, 9) AS radius_mpc FROM t GROUP BY galaxy_type HAVING count(*) >= 9",
)
def type_summary(spark: SparkSession, d: str) -> DataFrame:
    s = reports.type_summary(measured(spark, d))
    return s.select("galaxy_type", "n", rounded("median").alias("median"), rounded("std").alias("std"), rounded("radius_mpc", 9).alias("radius_mpc"))


@query("q_histogram", MEAS + " SELECT least(floor((redshift - 0) / 0.4), 19)::int AS bin, count(*) AS n FROM meas WHERE redshift BETWEEN 0 AND 8 GROUP BY 1")
def hist(spark: SparkSession, d: str) -> DataFrame:
    return binning.histogram(measured(spark, d), "redshift", 0.0, 8.0, 20).select("bin", "n")


@query("q_boxplot", MEAS + " SELECT galaxy_type, round(quantile_cont(r_half_arcsec, 0.25), 9) AS q1, round(median(r_half_arcsec), 9) AS median, round(quantile_cont(r_half_arcsec, 0.75), 9) AS q3 FROM meas WHERE galaxy_type IS NOT NULL GROUP BY galaxy_type")
def boxplot(spark: SparkSession, d: str) -> DataFrame:
    q = reports.size_distribution(measured(spark, d).filter("galaxy_type is not null"))
    return q.select("galaxy_type", rounded("q1").alias("q1"), rounded("median").alias("median"), rounded("q3").alias("q3"))


@query("q_describe", MEAS + " SELECT field_id, count(*) AS n, min(redshift) AS min, max(redshift) AS max, round(avg(redshift), 9) AS mean, round(median(redshift), 9) AS median, round(stddev_samp(redshift), 9) AS std FROM meas GROUP BY field_id")
def describe(spark: SparkSession, d: str) -> DataFrame:
    s = binning.describe(measured(spark, d), ["field_id"], "redshift")
    return s.select("field_id", "n", "min", "max", rounded("mean").alias("mean"), rounded("median").alias("median"), rounded("std").alias("std"))


@query("q_type_histogram", MEAS + " SELECT galaxy_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS share FROM meas WHERE galaxy_type IS NOT NULL GROUP BY galaxy_type")
def type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.type_histogram(measured(spark, d)).withColumn("share", rounded("share"))


@query("q_redshift_histogram", MEAS + ", c AS (SELECT least(50, greatest(15, count(*) // 10)) AS n, min(redshift) AS lo, max(redshift) AS hi FROM meas) SELECT least(floor((redshift - lo) / ((hi - lo) / n)), n - 1)::int AS bin, count(*) AS n FROM meas, c GROUP BY 1")
def redshift_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.redshift_histogram(measured(spark, d)).select("bin", "n")


@query("q_sources_summary", MEAS + ", t AS (SELECT galaxy_type, count(*) AS k FROM meas WHERE galaxy_type IS NOT NULL GROUP BY 1) SELECT count(*) AS n, count(DISTINCT galaxy_type) AS n_types, (SELECT galaxy_type FROM t ORDER BY k DESC, galaxy_type LIMIT 1) AS top_type, min(redshift) AS z_min, max(redshift) AS z_max, min(r_half_arcsec) AS theta_min, max(r_half_arcsec) AS theta_max FROM meas")
def sources_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.sources_summary(measured(spark, d))


_PER_TYPE = MEAS + """, big AS (SELECT galaxy_type, quantile_cont(redshift, [0.2, 0.4, 0.6, 0.8]) AS e FROM meas WHERE galaxy_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
    b AS (SELECT meas.*, (len(list_filter(e, lambda x: x < redshift)) + 1)::int AS bin FROM meas JOIN big USING (galaxy_type)) """


@query("q_per_type_bins", _PER_TYPE + _summary_sql("galaxy_type, bin", "b", "report"))
def per_type_bins(spark: SparkSession, d: str) -> DataFrame:
    b = reports.per_type_bins(measured(spark, d))
    return b.select("galaxy_type", "bin", *[rounded(c).alias(c) for c in ("z_mid", "theta_med", "theta_err", "theta_lo", "theta_hi")], "n")


_DS, _DL = "299792.458::double / 70.0 * greatest(z_mid, 1e-6)", gauss_sql("greatest(z_mid, 1e-6)")


def _type_radius(d: str) -> str:
    r = f"theta_med * {ASEC} * {d}"
    return f"CASE WHEN count(*) < 2 THEN NULL WHEN count(*) FILTER (WHERE z_mid >= 0.1) >= 2 THEN sum({r} / (theta_err * theta_err)) FILTER (WHERE z_mid >= 0.1) / sum(1 / (theta_err * theta_err)) FILTER (WHERE z_mid >= 0.1) ELSE median({r}) END"


@query(
    "q_per_type_fits",
    _PER_TYPE.rstrip() + f""", s AS (SELECT galaxy_type, bin, median(redshift) AS z_mid, median(r_half_arcsec) AS theta_med, {_ERR['report']} AS theta_err FROM b GROUP BY 1, 2), k AS (SELECT * FROM s WHERE theta_err > 0),
      r AS (SELECT galaxy_type, count(*) AS n_bins, {_type_radius(_DS)} AS rs, {_type_radius(_DL)} AS rl FROM k GROUP BY 1)
      SELECT galaxy_type, max(n_bins) AS n_bins, round(max(rs), 9) AS "R_static", round(max(rl), 9) AS "R_lcdm", round(sum(pow((theta_med - rs / ({_DS}) / {ASEC}) / theta_err, 2)), 5) AS chi2_static,
        round(sum(pow((theta_med - rl / {_DL} / {ASEC}) / theta_err, 2)), 5) AS chi2_lcdm, (count(*) - 1)::int AS ndf FROM k JOIN r USING (galaxy_type) GROUP BY galaxy_type""",
)
def per_type_fits(spark: SparkSession, d: str) -> DataFrame:
    f = reports.per_type_fits(measured(spark, d))
    return f.select("galaxy_type", "n_bins", rounded("R_static").alias("R_static"), rounded("R_lcdm").alias("R_lcdm"), rounded("chi2_static", 5).alias("chi2_static"), rounded("chi2_lcdm", 5).alias("chi2_lcdm"), "ndf")


_BY_STRATEGY = _RECURSIVE + f""", t AS (SELECT * FROM meas WHERE galaxy_type IN (SELECT galaxy_type FROM meas GROUP BY 1 HAVING count(*) >= 9)),
      c AS (SELECT galaxy_type, {_N['report']} AS n, count(*) AS cnt, min(redshift) AS lo, max(redshift) AS hi FROM t GROUP BY 1), r AS (SELECT galaxy_type, redshift, row_number() OVER (PARTITION BY galaxy_type ORDER BY redshift) - 1 AS k FROM t),
      w AS (SELECT galaxy_type, list_transform(range(0, n + 1), lambda i: CASE WHEN i = n THEN hi ELSE i * ((hi - lo) / n) + lo END) AS e FROM c),
      {_blocks_sql("SELECT galaxy_type AS grp, redshift AS z, r_half_arcsec AS t FROM t WHERE galaxy_type NOT IN (SELECT galaxy_type FROM t GROUP BY galaxy_type, redshift HAVING count(*) > 1)")},
      e AS (SELECT galaxy_type, 'equal_width' AS strategy, e FROM w UNION ALL SELECT galaxy_type, 'bayesian_blocks', coalesce(pick.e, w.e) FROM w LEFT JOIN pick ON grp = galaxy_type UNION ALL SELECT q.galaxy_type, 'percentile', list_sort(list_distinct(list(a.redshift + (b.redshift - a.redshift) * (p - floor(p)))))
        FROM (SELECT galaxy_type, (cnt - 1) * (i::double / n) AS p FROM c, range(0, 51) x(i) WHERE i <= n) q JOIN r a ON a.galaxy_type = q.galaxy_type AND a.k = floor(p)::bigint JOIN r b ON b.galaxy_type = q.galaxy_type AND b.k = ceil(p)::bigint GROUP BY 1),
      b AS (SELECT t.*, strategy, greatest(len(list_filter(e.e, lambda x: x < redshift)), 1)::int AS bin FROM t JOIN e USING (galaxy_type)) """


@query("q_per_type_strategies", _BY_STRATEGY + _summary_sql("galaxy_type, strategy, bin", "b", "report"))
def per_type_strategies(spark: SparkSession, d: str) -> DataFrame:
    b = reports.per_type_strategies(measured(spark, d))
    return b.select("galaxy_type", "strategy", "bin", *[rounded(c).alias(c) for c in ("z_mid", "theta_med", "theta_err", "theta_lo", "theta_hi")], "n")


@query(
    "q_per_type_strategy_fits",
    _BY_STRATEGY.rstrip() + f""", s AS (SELECT galaxy_type, strategy, bin, median(redshift) AS z_mid, median(r_half_arcsec) AS theta_med, {_ERR['report']} AS theta_err FROM b GROUP BY 1, 2, 3), k AS (SELECT * FROM s WHERE theta_err > 0),
      rr AS (SELECT galaxy_type, strategy, count(*) AS n_bins, {_type_radius(_DS)} AS rs, {_type_radius(_DL)} AS rl FROM k GROUP BY 1, 2)
      SELECT galaxy_type, strategy, max(n_bins) AS n_bins, round(max(rs), 9) AS "R_static", round(max(rl), 9) AS "R_lcdm", round(sum(pow((theta_med - rs / ({_DS}) / {ASEC}) / theta_err, 2)), 5) AS chi2_static,
        round(sum(pow((theta_med - rl / {_DL} / {ASEC}) / theta_err, 2)), 5) AS chi2_lcdm, (count((theta_med - rl / {_DL} / {ASEC}) / theta_err) - 1)::int AS ndf FROM k JOIN rr USING (galaxy_type, strategy)
      WHERE galaxy_type IN (SELECT galaxy_type FROM rr WHERE n_bins >= 3) GROUP BY galaxy_type, strategy""",
)
def per_type_strategy_fits(spark: SparkSession, d: str) -> DataFrame:
    f = reports.per_type_strategy_fits(measured(spark, d))
    return f.select("galaxy_type", "strategy", "n_bins", rounded("R_static").alias("R_static"), rounded("R_lcdm").alias("R_lcdm"), rounded("chi2_static", 5).alias("chi2_static"), rounded("chi2_lcdm", 5).alias("chi2_lcdm"), "ndf")


@query(
    "q_radius_fits",
    f"{MEAS}, t AS (SELECT field_id, redshift AS z, r_half_arcsec * {ASEC} * 299792.458::double / 70.0 * greatest(redshift, 1e-6) AS rs, {_RADIUS} AS rl, 1 / (r_half_arcsec_error * r_half_arcsec_error) AS w FROM meas) SELECT field_id, "
    + ", ".join(f"round(CASE WHEN count(*) < 2 THEN NULL WHEN count(*) FILTER (WHERE z >= 0.1) >= 2 THEN sum(w * {c}) FILTER (WHERE z >= 0.1) / sum(w) FILTER (WHERE z >= 0.1) ELSE median({c}) END, 8) AS {n}" for c, n in (("rs", "r_static"), ("rl", "r_lcdm")))
    + " FROM t GROUP BY field_id",
)
def radius_fits(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d)
    a, b = (fit.fit_radius(m, ["field_id"], "redshift", "r_half_arcsec", "r_half_arcsec_error", x) for x in ("static", "lcdm"))
    return a.select("field_id", rounded("radius_mpc", 8).alias("r_static")).join(b.select("field_id", rounded("radius_mpc", 8).alias("r_lcdm")), "field_id")


@query("q_chi2_stats", f"{MEAS} SELECT field_id, round(sum(pow((r_half_arcsec - 0.003::double / {gauss_sql('redshift')} / {ASEC}) / r_half_arcsec_error, 2)), 3) AS chi2, (count(*) - 1)::int AS ndf FROM meas GROUP BY field_id")
def chi2(spark: SparkSession, d: str) -> DataFrame:
    c = fit.chi2_stats(measured(spark, d), ["field_id"], "r_half_arcsec", "r_half_arcsec_error", cos.theta_arcsec(F.col("redshift"), 0.003), 1, p_value=False)
    return c.select("field_id", rounded("chi2", 3).alias("chi2"), "ndf")


@query(
    "q_lcdm_grid_fit",
    f"{MEAS}, g AS (SELECT galaxy_type, r_half_arcsec AS t, 1 / (r_half_arcsec_error * r_half_arcsec_error) AS w, o.i / 20.0::double AS ol, 1 / {gauss_sql('redshift', '(1.0 - o.i / 20.0::double)', '(1.0::double - (1.0 - o.i / 20.0::double))')} / {ASEC} AS g FROM meas, range(0, 21) o(i) WHERE galaxy_type IS NOT NULL),"
    " s AS (SELECT galaxy_type, ol, sum(w * t * g) AS tg, sum(w * g * g) AS gg, sum(w * t * t) AS tt FROM g GROUP BY 1, 2), r AS (SELECT *, tt - tg * tg / gg AS chi2, row_number() OVER (PARTITION BY galaxy_type ORDER BY tt - tg * tg / gg, ol) AS k FROM s)"
    " SELECT galaxy_type, ol AS omega_l, round(tg / gg, 8) AS radius_mpc, round(chi2, 2) AS chi2 FROM r WHERE k = 1",
)
def grid_fit(spark: SparkSession, d: str) -> DataFrame:
    g = fit.grid_fit(measured(spark, d).filter("galaxy_type is not null"), ["galaxy_type"], "redshift", "r_half_arcsec", "r_half_arcsec_error", 21)
    return g.select("galaxy_type", "omega_l", rounded("radius_mpc", 8).alias("radius_mpc"), rounded("chi2", 2).alias("chi2"))


@query("q_lcdm_grid_fit_full")
def full_grid_fit(spark: SparkSession, d: str) -> DataFrame:
    """All shares of the operator, in steps of 0.01."""
    g = fit.grid_fit(measured(spark, d).filter("galaxy_type is not null"), ["galaxy_type"], "redshift", "r_half_arcsec", "r_half_arcsec_error")
    return g.select("galaxy_type", "omega_l", rounded("radius_mpc", 8).alias("radius_mpc"), rounded("chi2", 2).alias("chi2"))


@query("q_lcdm_fit")
def lcdm_fit(spark: SparkSession, d: str) -> DataFrame:
    f = reports.two_parameter_fit(measured(spark, d))
    return spark.createDataFrame([tuple(f.values())], ", ".join(f"{k} {'int' if k == 'n_points' else 'double'}" for k in f))


#: All strategies over the whole catalog: bins ``b``, their summaries ``s`` (those kept: ``k``) and radii ``rr``.
_WHOLE = _BY_STRATEGY.replace("SELECT * FROM meas WHERE galaxy_type IN (SELECT galaxy_type FROM meas GROUP BY 1 HAVING count(*) >= 9)", "SELECT * REPLACE ('all' AS galaxy_type) FROM meas").rstrip() + f""",
      s AS ({_summary_sql('strategy, bin', 'b', 'report')}), k0 AS (SELECT strategy, bin, median(redshift) AS z_mid, median(r_half_arcsec) AS theta_med, {_ERR['report']} AS theta_err FROM b GROUP BY 1, 2), k AS (SELECT * FROM k0 WHERE theta_err IS NOT NULL),
      rr AS (SELECT strategy, {_type_radius(_DS)} AS rs, {_type_radius(_DL)} AS rl FROM k WHERE theta_err > 0 GROUP BY 1)"""
_STATIC, _LCDM = f"(rs / ({_DS}) / {ASEC})", f"(rl / {_DL} / {ASEC})"


@query(
    "q_binning_comparison",
    _WHOLE + f""" SELECT s.*, round({_STATIC}, 6) AS static, round({_LCDM}, 6) AS lcdm, round(k.theta_med - {_STATIC}, 6) AS resid_static, round(k.theta_med - {_LCDM}, 6) AS resid_lcdm FROM k JOIN rr USING (strategy) JOIN s ON s.strategy = k.strategy AND s.bin = k.bin""".replace("z_mid", "k.z_mid"),
)
def comparison(spark: SparkSession, d: str) -> DataFrame:
    b = reports.binning_comparison(measured(spark, d))
    return b.select("strategy", "bin", *[rounded(c).alias(c) for c in ("z_mid", "theta_med", "theta_err", "theta_lo", "theta_hi")], "n", *[rounded(c, 6).alias(c) for c in ("static", "lcdm", "resid_static", "resid_lcdm")])


@query(
    "q_fit_comparison",
    _WHOLE + f""" SELECT strategy, count(*)::int AS n_bins, round(max(rs), 9) AS "R_static", round(max(rl), 9) AS "R_lcdm", round(sum(pow((theta_med - {_STATIC}) / theta_err, 2)), 4) AS chi2_static, round(sum(pow((theta_med - {_LCDM}) / theta_err, 2)), 4) AS chi2_lcdm,
      (count(*) - 1)::int AS ndf_static, (count(*) - 1)::int AS ndf_lcdm FROM k JOIN rr USING (strategy) GROUP BY strategy""",
)
def fit_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Without the probabilities, which SQL has no function for (tests hold them against known values)."""
    f = reports.fit_comparison(spark, measured(spark, d))
    return f.select("strategy", "n_bins", rounded("R_static").alias("R_static"), rounded("R_lcdm").alias("R_lcdm"), rounded("chi2_static", 4).alias("chi2_static"), rounded("chi2_lcdm", 4).alias("chi2_lcdm"), "ndf_static", "ndf_lcdm")


_COMBINED = (
    MEAS + f""", d0 AS (SELECT *, CASE WHEN galaxy_type IN ('sbt1', 'sbt2') THEN 'low_dust' WHEN galaxy_type IN ('sbt3', 'sbt4', 'sbt5', 'sbt6') THEN 'high_dust' END AS name FROM meas WHERE redshift BETWEEN 0.3 AND 2.0),
      nb AS (SELECT name, count(*) AS n_before FROM d0 WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
      d1 AS (SELECT d0.* FROM d0 JOIN nb USING (name) WHERE r_half_arcsec * {ASEC} * {gauss_sql('redshift')} * 1000 BETWEEN 0.3 AND 15),
      q AS (SELECT name, quantile_cont(redshift, [0.2, 0.4, 0.6, 0.8]) AS e FROM d1 GROUP BY 1), r0 AS (SELECT d1.*, r_half_arcsec AS v, len(list_filter(e, lambda x: x < redshift)) + 1 AS cb FROM d1 JOIN q USING (name))"""
    + "".join(f", s{i} AS (SELECT *, median(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM r{i} WINDOW w AS (PARTITION BY name, cb)), r{i + 1} AS (SELECT * EXCLUDE (m, sd) FROM s{i} WHERE abs(v - m) <= 2.5 * sd)" for i in range(3))
    + f""", t AS (SELECT * FROM r3 WHERE name IN (SELECT name FROM r3 GROUP BY 1 HAVING count(*) >= 30)), c AS (SELECT name, {_N['report']} AS n, count(*) AS cnt FROM t GROUP BY 1), rk AS (SELECT name, redshift, row_number() OVER (PARTITION BY name ORDER BY redshift) - 1 AS k FROM t),
      e AS (SELECT q.name, list_sort(list_distinct(list(a.redshift + (b.redshift - a.redshift) * (p - floor(p))))) AS e FROM (SELECT name, (cnt - 1) * (i::double / n) AS p FROM c, range(0, 51) x(i) WHERE i <= n) q
        JOIN rk a ON a.name = q.name AND a.k = floor(p)::bigint JOIN rk b ON b.name = q.name AND b.k = ceil(p)::bigint GROUP BY 1),
      b AS (SELECT t.*, greatest(len(list_filter(e.e, lambda x: x < redshift)), 1)::int AS bin FROM t JOIN e USING (name)),
      k AS (SELECT * FROM (SELECT name, bin, median(redshift) AS z_mid, median(r_half_arcsec) AS theta_med, {_ERR['report']} AS theta_err FROM b GROUP BY 1, 2) WHERE theta_err > 0)
      SELECT name, max(cnt) AS n, max(n_before) AS n_before, round({_type_radius(_DS)}, 9) AS "R_static", round({_type_radius(_DL)}, 9) AS "R_lcdm" FROM k JOIN c USING (name) JOIN nb USING (name) GROUP BY name"""
)


@query("q_distance_curves", f"SELECT z, round(299792.458::double / 70.0 * z, 4) AS da_static, round({gauss_sql('z')}, 4) AS da_lcdm FROM (SELECT i * (4.0::double / 200) AS z FROM range(1, 201) t(i))")
def distance_curves(spark: SparkSession, d: str) -> DataFrame:
    return reports.distance_curves(spark).select("z", rounded("da_static", 4).alias("da_static"), rounded("da_lcdm", 4).alias("da_lcdm"))


@query("q_combined_types_fit", _COMBINED)
def combined_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = [(name, f["n"], f["n_before"], f.get("R_static"), f.get("R_lcdm")) for name, ts in (("low_dust", ["sbt1", "sbt2"]), ("high_dust", ["sbt3", "sbt4", "sbt5", "sbt6"])) if (f := reports.combined_types_fit(measured(spark, d), ts))]
    out = spark.createDataFrame(rows, "name string, n long, n_before long, R_static double, R_lcdm double")
    return out.withColumns({c: rounded(c) for c in ("R_static", "R_lcdm")})


@query("q_windowed_bins", MEAS + ", w AS (SELECT date_trunc('day', ingested_at) AS start, CASE WHEN redshift BETWEEN 0 AND 8 THEN greatest(len(list_filter([0.0, 0.5, 1.0, 2.0, 8.0], lambda e: e < redshift)), 1)::int END AS bin, r_half_arcsec AS v FROM meas) SELECT strftime(start, '%Y-%m-%d') AS day, bin, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std FROM w GROUP BY 1, 2")
def windowed(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_bins(measured(spark, d), "ingested_at", "redshift", "r_half_arcsec", [0.0, 0.5, 1.0, 2.0, 8.0])
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "bin", "n", rounded("mean").alias("mean"), rounded("std").alias("std"))


HEADER = {"CD1_1": "-1.1e-5", "CD1_2": "2e-7", "CD2_1": "2e-7", "CD2_2": "1.1e-5", "CRVAL1": "189.25", "CRVAL2": "62.2", "CRPIX1": "490000", "CRPIX2": "490000"}


@query(
    "q_pixel_to_sky",
    "WITH p AS (SELECT record_id, radians(-1.1e-5::double * (xcentroid + 1 - 490000) + 2e-7::double * (ycentroid + 1 - 490000)) AS a, radians(2e-7::double * (xcentroid + 1 - 490000) + 1.1e-5::double * (ycentroid + 1 - 490000)) AS b, radians(62.2::double) AS d,"
    " 189.25::double + -1.1e-5::double * (xcentroid - 490000) + 2e-7::double * (ycentroid - 490000) AS ra_cd FROM galaxy_catalog) SELECT record_id, round((189.25::double + degrees(atan2(a, cos(d) - b * sin(d))) + 360) % 360, 8) AS ra,"
    " round(degrees(atan2(sin(d) + b * cos(d), sqrt(a * a + (cos(d) - b * sin(d)) * (cos(d) - b * sin(d))))), 8) AS dec, round(ra_cd, 8) AS ra_cd FROM p",
)
def pixel_to_sky(spark: SparkSession, d: str) -> DataFrame:
    head = F.create_map(*[F.lit(x) for kv in HEADER.items() for x in kv])
    x, y = F.col("xcentroid"), F.col("ycentroid")
    (ra, dec), (cd, _) = sky_functions.pixel_to_sky(x, y, head), sky_functions.pixel_to_sky(x, y, head, gnomonic=False)
    return table(spark, d, "galaxy_catalog").select("record_id", rounded(ra, 8).alias("ra"), rounded(dec, 8).alias("dec"), rounded(cd, 8).alias("ra_cd"))


@query("q_ellipse", "WITH e AS (SELECT vec_id, embedding[1]::double * 10 AS a, embedding[2]::double * 10 AS b FROM embeddings), s AS (SELECT vec_id, CASE WHEN a > 0 THEN a ELSE 0.5 END AS a, CASE WHEN b > 0 THEN b ELSE 0.5 END AS b FROM e) SELECT vec_id, round(greatest(a, b), 9) AS a, round(least(a, b), 9) AS b, round(1 - least(a, b) / greatest(a, b), 9) AS ellipticity, round(2 * sqrt(ln(2) * (a * a + b * b)), 9) AS fwhm FROM s")
def ellipse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 10).alias("a"), (F.col("embedding")[1].cast("double") * 10).alias("b"))
    a, b, _ = photometry.sane_ellipse(F.col("a"), F.col("b"), F.lit(0.0))
    return e.select("vec_id", rounded(a).alias("a"), rounded(b).alias("b"), rounded(photometry.ellipticity(a, b)).alias("ellipticity"), rounded(photometry.moment_fwhm(a, b)).alias("fwhm"))


@query(
    "q_aperture_error",
    "SELECT source_id, round(1.4 * sqrt(v + n * s * s + n * n * s * s / greatest(10 * n, 1)), 9) AS err FROM (SELECT DISTINCT source_id, source_error * source_error AS v, pi() * r_half_pix * r_half_pix AS n, source_error / 10 AS s FROM band_catalog WHERE isfinite(source_error) AND isfinite(r_half_pix))",
)
def aperture_error(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "band_catalog").select("source_id", photometry.clean(F.col("source_error")).alias("e"), photometry.clean(F.col("r_half_pix")).alias("r")).dropna().distinct()
    err = photometry.aperture_error(F.col("e") * F.col("e"), F.pi() * F.col("r") * F.col("r"), F.col("e") / 10)
    return b.select("source_id", rounded(err).alias("err"))


@query("q_safe_names", "SELECT DISTINCT z_spec_source, regexp_replace(z_spec_source, '[/\\\\\\s:+]+', '_', 'g') AS safe FROM galaxy_catalog WHERE z_spec_source IS NOT NULL")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "galaxy_catalog").filter("z_spec_source is not null").select("z_spec_source", labels.safe_name(F.col("z_spec_source")).alias("safe")).distinct()


@query(
    "q_simple_bins",
    MEAS + ", c AS (SELECT min(redshift) AS lo, max(redshift) AS hi FROM meas), b AS (SELECT meas.*, greatest(len(list_filter(list_transform(range(0, 6), lambda i: CASE WHEN i = 5 THEN hi ELSE i * ((hi - lo) / 5) + lo END), lambda x: x < redshift)), 1)::int AS bin FROM meas, c)"
    " SELECT bin, count(*) AS n, round(sqrt(avg(r_half_arcsec_error * r_half_arcsec_error)), 9) AS rms_err, round(quantile_cont(r_half_arcsec, 0.25), 9) AS theta_lo, round(median(r_half_arcsec), 9) AS theta_med, round(quantile_cont(r_half_arcsec, 0.75), 9) AS theta_hi, round(median(redshift), 9) AS z_mid FROM b GROUP BY bin",
)
def simple_bins(spark: SparkSession, d: str) -> DataFrame:
    b = binning.simple_bins(measured(spark, d), "redshift", "r_half_arcsec", "r_half_arcsec_error")
    return b.select("bin", "n", *[rounded(c).alias(c) for c in ("rms_err", "theta_lo", "theta_med", "theta_hi", "z_mid")])


@query("q_flux_ratio", "SELECT DISTINCT source_id, CASE WHEN r_half_pix != 0 THEN round(r_90_pix / r_half_pix, 9) END AS ratio FROM band_catalog WHERE isfinite(r_half_pix) AND isfinite(r_90_pix)")
def flux_ratio(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "band_catalog").select("source_id", photometry.clean(F.col("r_half_pix")).alias("a"), photometry.clean(F.col("r_90_pix")).alias("b")).dropna()
    return b.select("source_id", rounded(photometry.flux_ratio(F.col("a"), F.col("b"))).alias("ratio")).distinct()


@query("q_odds_filter", MEAS + " SELECT record_id FROM meas WHERE odds >= 0.7")
def odds_filter(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).filter("odds >= 0.7").select("record_id")


@query("q_top_hats", "SELECT b.i AS band, w.w::int AS wave FROM (VALUES (0, 3000, 1521), (1, 4500, 1501), (2, 6060, 951), (3, 8140, 766)) b(i, c, s), range(2200, 9500) w(w) WHERE abs(w.w - b.c) <= b.s / 2.0")
def top_hats(spark: SparkSession, d: str) -> DataFrame:
    b = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(zip(SIMPLE_CENTRE, SIMPLE_WIDTH))], "band int, c double, s double")
    w = b.select("band", "c", "s", F.explode(F.sequence(F.lit(2200), F.lit(9499))).alias("wave"))
    return w.filter(F.abs(F.col("wave") - F.col("c")) <= F.col("s") / 2).select("band", "wave")


@query("q_redshift_availability", "SELECT lower(trim(catalog_name)) AS list, count(*) AS n FROM specz_catalog WHERE z_spec > 0 AND NOT isnan(z_spec) GROUP BY 1")
def available(spark: SparkSession, d: str) -> DataFrame:
    return validation.availability(redshift_entries(table(spark, d, "specz_catalog"), table(spark, d, "specz_source")))


@query(
    "q_calibrated_validation",
    MEAS + f""", {_ENTRIES}, g AS (SELECT record_id, radians(ra) AS a, radians(dec) AS b, dec AS dd, z_phot FROM cat WHERE isfinite(ra) AND isfinite(dec) AND abs(dec) <= 90),
      j AS (SELECT g.record_id, z_phot, e.z_spec, o, specz_id, degrees(2 * asin(least(1, sqrt(pow(sin((radians(e.dec) - b) / 2), 2) + cos(b) * cos(radians(e.dec)) * pow(sin((radians(e.ra) - a) / 2), 2))))) * 3600 AS sep FROM g JOIN e ON e.dec BETWEEN g.dd - 0.001 AND g.dd + 0.001),
      r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY round(sep, 9), o, specz_id) AS k FROM j WHERE sep <= 1.0), p AS (SELECT (z_phot - z_spec) / (1 + z_spec) AS d FROM r WHERE k = 1 AND isfinite(z_phot) AND isfinite(z_spec) AND z_spec > 0)
      SELECT {_METRICS} FROM p""",
)
def calibrated_validation(spark: SparkSession, d: str) -> DataFrame:
    """Cross-match, metrics and take-over in one go: the metrics."""
    c = catalog_with_fits(spark, d).withColumn("redshift", F.col("z_phot"))
    return _rounded_metrics(validation.validate(c, redshift_entries(table(spark, d, "specz_catalog"), table(spark, d, "specz_source")))[1])


QUERIES, SQL = query.queries, query.sql
