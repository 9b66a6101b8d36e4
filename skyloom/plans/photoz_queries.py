"""Queries of template fitting, zero points and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.constants import BANDS, PIVOT, SIMPLE_CENTRE, SIMPLE_WIDTH, WIDTH
from skyloom.operators import calibration, ml, photoz
from skyloom.operators.quality import fit_flags
from skyloom.operators.templates import SHAPES, model_grid, redshift_grid
from skyloom.plans.common import Registry, rounded
from skyloom.session import cut, table
from skyloom.sources.catalogs import catalog_with_fits

query = Registry()
FLUX = [f"flux_{b}" for b in ("f300", "f450", "f606", "f814")]
ERR = [f"error_{b}" for b in ("f300", "f450", "f606", "f814")]
#: The small grid that the relational form and its SQL share.
SMALL = dict(z_step=0.4, z_min=0.1, z_max=3.6, av=[0.0, 0.6], templates=["elliptical", "Sb", "sbt1", "sbt4"])


def _grid_rows(**size) -> list[tuple]:
    g = model_grid(**size)
    return [(t, a, z, [float(x) for x in g.flux[t, a, z]]) for t in range(len(g.templates)) for a in range(len(g.av)) for z in range(len(g.z))]


def _grid_sql() -> str:
    """CTE ``grid(t, a, zi, m)``: spectra, dust and intergalactic absorption evaluated and averaged over the bands in SQL."""
    names = ", ".join(f"({i}, {SHAPES[t][0]}::double, {SHAPES[t][1]}::double)" for i, t in enumerate(SMALL["templates"]))
    bands = ", ".join(f"({i}, {c}::double, {w / 2}::double)" for i, (c, w) in enumerate(zip(PIVOT, WIDTH)))
    avs = ", ".join(f"({i}, {v}::double)" for i, v in enumerate(SMALL["av"]))
    n = len(redshift_grid(SMALL["z_min"], SMALL["z_max"], SMALL["z_step"]))
    tau = " + ".join(f"(CASE WHEN w * (1 + z) < {line}::double * (1 + z) THEN {k}::double * pow(w * (1 + z) / {line}::double, 3.46::double) ELSE 0 END)" for line, k in ((1216.0, 0.0036), (1026.0, 0.0017), (972.5, 0.0012)))
    tau += " + (CASE WHEN w * (1 + z) < 912::double * (1 + z) THEN least(0.25::double * pow(w * (1 + z) / 912.0::double, 3) * pow(1 + z, 0.46::double), 30) ELSE 0 END)"
    k = "greatest(CASE WHEN w >= 1200 AND w < 6300 THEN 2.659::double * (-2.156::double + 1.509::double / (w / 1e4) - 0.198::double / pow(w / 1e4, 2) + 0.011::double / pow(w / 1e4, 3)) + 4.05 WHEN w >= 6300 AND w <= 22000 THEN 2.659::double * (-1.857::double + 1.040::double / (w / 1e4)) + 4.05 ELSE 0 END, 0)"
    return f"""tm(t, slope, strength) AS (VALUES {names}), bd(i, c, h) AS (VALUES {bands}), ax(a, av) AS (VALUES {avs}), zz AS (SELECT zi::int AS zi, {SMALL['z_min']}::double + zi * {SMALL['z_step']}::double AS z FROM range(0, {n}) r(zi)),
      sp AS (SELECT t, a, w::double AS w, pow(w / 5500.0::double, slope) * (1 - strength / (1 + exp((w - 4000) / 100.0::double))) * (CASE WHEN av <= 0 THEN 1 ELSE least(pow(10, -0.4::double * {k} * av / 4.05::double), 1) END) AS f FROM tm, ax, range(1000, 10001, 10) r(w)),
      me AS (SELECT t, a, zi, i, avg(f * (CASE WHEN z > 0.5 THEN least(exp(-({tau})), 1) ELSE 1 END)) AS m FROM sp JOIN zz ON true JOIN bd ON w >= (c - h) / (1 + z) AND w <= (c + h) / (1 + z) GROUP BY ALL),
      grid AS (SELECT t, a, zi, list(coalesce(m, 0) ORDER BY i) AS m FROM tm JOIN ax ON true JOIN zz ON true JOIN bd ON true LEFT JOIN me USING (t, a, zi, i) GROUP BY ALL)"""


_OBJ = "o AS (SELECT record_id AS id, [" + ", ".join(FLUX) + "] AS f, [" + ", ".join(ERR) + "] AS e FROM galaxy_catalog), ix AS (SELECT *, list_filter([1, 2, 3, 4], lambda i: isfinite(f[i]) AND f[i] > 0 AND isfinite(e[i]) AND e[i] > 0) AS ix FROM o)"
CHI = f"""WITH {_grid_sql()}, {_OBJ},
  n AS (SELECT id, ix, list_transform(ix, lambda i: f[i]) AS f, list_transform(ix, lambda i: e[i] * e[i] + 0.005::double * f[i] * f[i]) AS e2 FROM ix WHERE len(ix) >= 2),
  k AS (SELECT id, ix, list_transform(f, lambda x: x / list_median(f)) AS f, list_transform(e2, lambda x: list_median(f) * list_median(f) / x) AS w FROM n),
  j AS (SELECT id, t, a, zi, f, w, list_transform(ix, lambda i: m[i]) AS s FROM k, grid),
  l AS (SELECT id, t, a, zi, f, w, s, list_sum(s) AS sm, CASE WHEN list_median(s) = 0 THEN 1 ELSE list_median(s) END AS sc FROM j),
  chi AS (SELECT id, t, a, zi, CASE WHEN sm > 0 THEN list_sum(list_transform(range(1, len(f) + 1), lambda i: pow(f[i] - s[i] / sc, 2) * w[i])) ELSE 1e30 END AS chi2 FROM l)"""


def _chi(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.createDataFrame(_grid_rows(**SMALL), "t int, a int, zi int, m array<double>")
    o = table(spark, d, "galaxy_catalog").select(F.col("record_id").alias("id"), F.array(*FLUX).alias("flux"), F.array(*ERR).alias("err"))
    return photoz.chi2_rows(o, grid)


@query("q_model_grid", f"WITH {_grid_sql()} SELECT t, a, zi, round(m[1], 9) AS u, round(m[2], 9) AS b, round(m[3], 9) AS v, round(m[4], 9) AS i FROM grid")
def grid(spark: SparkSession, d: str) -> DataFrame:
    return _bands_of(spark, _grid_rows(**SMALL))


def _bands_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    g = spark.createDataFrame(rows, "t int, a int, zi int, m array<double>")
    return g.select("t", "a", "zi", *[rounded(F.col("m")[i]).alias(c) for i, c in enumerate("ubvi")])


@query("q_photoz_argmin", CHI + ", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(chi2, 9), t, a, zi) AS k FROM chi) SELECT id, t, a, zi, round(chi2, 5) AS chi2 FROM r WHERE k = 1")
def argmin(spark: SparkSession, d: str) -> DataFrame:
    return photoz.best_model(_chi(spark, d)).withColumn("chi2", rounded("chi2", 5))


@query("q_photoz_second_best", CHI + ", p AS (SELECT id, t, min(chi2) AS c FROM chi GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 9), t) AS k, min(c) OVER (PARTITION BY id) AS g FROM p) SELECT id, t AS t2, round(exp(-(c - g) / 2), 6) AS ambiguity FROM r WHERE k = 2")
def second(spark: SparkSession, d: str) -> DataFrame:
    return photoz.second_template(_chi(spark, d)).withColumn("ambiguity", rounded("ambiguity", 6))


_PDF = CHI + """, g AS (SELECT id, min(chi2) AS g FROM chi GROUP BY 1), u AS (SELECT chi.id, zi, 0.1::double + zi * 0.4::double AS z, sum(exp(-(chi2 - g) / 2)) AS u FROM chi JOIN g ON g.id = chi.id GROUP BY 1, 2),
  sl AS (SELECT *, coalesce((u + lag(u) OVER (PARTITION BY id ORDER BY zi)) / 2 * 0.4::double, 0) AS sl FROM u),
  pdf AS (SELECT id, zi, z, u / sum(sl) OVER (PARTITION BY id) AS p, sum(sl) OVER (PARTITION BY id ORDER BY zi) / sum(sl) OVER (PARTITION BY id) AS cdf FROM sl)"""


@query("q_photoz_pdf", _PDF + " SELECT id, zi, round(p, 6) AS p, round(cdf, 6) AS cdf FROM pdf")
def pdf(spark: SparkSession, d: str) -> DataFrame:
    p = photoz.pdf_rows(_chi(spark, d), 0.1, 0.4)
    return p.select("id", "zi", rounded("p", 6).alias("p"), rounded("cdf", 6).alias("cdf"))


@query("q_photoz_quantiles", _PDF + ", b AS (SELECT *, lag(cdf) OVER (PARTITION BY id ORDER BY zi) AS c0, lag(z) OVER (PARTITION BY id ORDER BY zi) AS z0 FROM pdf) SELECT id, round(max(z0 + (z - z0) * (0.5 - c0) / (cdf - c0)), 5) AS z_median FROM b WHERE c0 < 0.5 AND cdf >= 0.5 GROUP BY id")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return photoz.pdf_quantile(photoz.pdf_rows(_chi(spark, d), 0.1, 0.4), 0.5, "z_median").withColumn("z_median", rounded("z_median", 5))


@query("q_photoz_flags", "SELECT DISTINCT id, CASE WHEN reduced_chi2 < 0.1 THEN 1 WHEN reduced_chi2 < 5 THEN 0 WHEN reduced_chi2 < 10 THEN 1 ELSE 2 END AS chi2_flag2, CASE WHEN odds >= 0.9 THEN 0 WHEN odds >= 0.6 THEN 1 ELSE 2 END AS odds_flag2 FROM photoz_result")
def flags(spark: SparkSession, d: str) -> DataFrame:
    c, o = fit_flags(F.col("reduced_chi2"), F.col("odds"))
    return table(spark, d, "photoz_result").select("id", c.alias("chi2_flag2"), o.alias("odds_flag2")).distinct()


@query("q_photoz_arrow")
def production(spark: SparkSession, d: str) -> DataFrame:
    """The full grid: ten templates, nine dust columns, steps of 0.02."""
    return photoz.photoz(table(spark, d, "galaxy_catalog"), "record_id", FLUX, ERR)


# The same questions over the full grid; the relational form and its SQL would make 17 910 rows of every object.


@query("q_model_grid_full")
def full_grid(spark: SparkSession, d: str) -> DataFrame:
    return _bands_of(spark, _grid_rows())


def _fits(spark: SparkSession, d: str) -> DataFrame:
    return photoz.photoz(table(spark, d, "galaxy_catalog"), "record_id", FLUX, ERR).filter("n_valid_bands >= 2")


@query("q_photoz_argmin_full")
def full_argmin(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d).select("id", "galaxy_type", "best_a_v", "redshift", rounded("chi_sq_min", 5).alias("chi2"))


@query("q_photoz_second_best_full")
def full_second(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d).select("id", "second_best_template", rounded("template_ambiguity", 6).alias("ambiguity"))


@query("q_photoz_pdf_full")
def full_pdf(spark: SparkSession, d: str) -> DataFrame:
    p = photoz.photoz_pdf(table(spark, d, "galaxy_catalog"), "record_id", FLUX, ERR)
    return p.select("id", "zi", rounded("p", 6).alias("p"), rounded("cdf", 6).alias("cdf"))


@query("q_photoz_quantiles_full")
def full_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _fits(spark, d).select("id", rounded("z_pdf_median", 5).alias("z_median"))


@query("q_photoz_two_stage")
def two_stage(spark: SparkSession, d: str) -> DataFrame:
    return photoz.two_stage(table(spark, d, "galaxy_catalog"), "record_id", FLUX, ERR)


def _calibrators(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "galaxy_catalog")
    return g.withColumn("z_spec", F.when((F.col("z_spec") > 0) & (F.col("z_spec") <= 8) & ~F.isnan("z_spec"), F.col("z_spec")))


def _zeropoint_sql() -> str:
    names = ", ".join(f"({i}, {SHAPES[t][0]}::double, {SHAPES[t][1]}::double)" for i, t in enumerate(calibration.CALIBRATION_TEMPLATES))
    bands = ", ".join(f"({i}, '{b}', {c}::double, {w / 2}::double)" for i, (b, c, w) in enumerate(zip(BANDS, SIMPLE_CENTRE, SIMPLE_WIDTH)))
    sql = f"""WITH tm(t, slope, strength) AS (VALUES {names}), bd(i, band, c, h) AS (VALUES {bands}),
      sp AS (SELECT t, w::double AS w, pow(w / 5500.0::double, slope) * (1 - strength / (1 + exp((w - 4000) / 100.0::double))) AS f FROM tm, range(1000, 10001, 10) r(w)),
      cal AS (SELECT record_id AS id, z_spec AS z, [{', '.join(FLUX)}] AS f FROM galaxy_catalog WHERE isfinite(z_spec) AND z_spec > 0 AND z_spec <= 8),
      o AS (SELECT id, z, i, c, h, f[i + 1] AS f, count(*) OVER (PARTITION BY id) AS n FROM cal, bd WHERE isfinite(f[i + 1]) AND f[i + 1] > 0),
      zs AS (SELECT DISTINCT z FROM cal), mt AS (SELECT z, t, i, avg(f) AS m FROM zs, bd, sp WHERE w >= (c - h) / (1 + z) AND w <= (c + h) / (1 + z) GROUP BY 1, 2, 3),
      j AS (SELECT o.id, o.i, o.f, tm.t, coalesce(m, 0) AS m FROM o CROSS JOIN tm LEFT JOIN mt ON mt.z = o.z AND mt.t = tm.t AND mt.i = o.i WHERE n >= 3),
      a AS (SELECT id, t, sum(f * m) / sum(m * m) AS a FROM j GROUP BY 1, 2 HAVING min(m) > 0),
      x AS (SELECT j.*, a.a, sum(pow((f - a.a * m) / f, 2)) OVER (PARTITION BY j.id, j.t) AS chi FROM j JOIN a ON a.id = j.id AND a.t = j.t),
      b AS (SELECT id, arg_min(t, chi) AS t FROM x GROUP BY 1), r0 AS (SELECT x.i, log10(f / (a * m)) AS v FROM x JOIN b ON b.id = x.id AND b.t = x.t)"""
    for k in range(3):
        sql += f""", m{k} AS (SELECT *, median(v) OVER (PARTITION BY i) AS med FROM r{k}), d{k} AS (SELECT *, abs(v - med) AS d, 1.4826 * median(abs(v - med)) OVER (PARTITION BY i) AS mad FROM m{k}),
          k{k} AS (SELECT *, count(*) FILTER (WHERE d < 3 * mad) OVER (PARTITION BY i) AS c FROM d{k}), r{k + 1} AS (SELECT i, v FROM k{k} WHERE d < 3 * mad OR c < 5 OR mad = 0)"""
    return sql + """, f AS (SELECT i, median(v) AS med FROM r3 GROUP BY 1), s AS (SELECT i, med, 1.4826 * median(abs(v - med)) AS mad FROM r3 JOIN f USING (i) GROUP BY 1, 2), n AS (SELECT i, count(*) AS n FROM r0 GROUP BY 1)
      SELECT band, round(CASE WHEN n >= 5 THEN -2.5 * med ELSE 0 END, 6) AS offset_mag, round(pow(10, -0.4 * CASE WHEN n >= 5 THEN -2.5 * med ELSE 0 END), 6) AS flux_scale, round(CASE WHEN n >= 5 THEN 2.5 * mad ELSE 0 END, 6) AS scatter, coalesce(n, 0) AS n_cal, true AS converged
      FROM bd LEFT JOIN s USING (i) LEFT JOIN n USING (i)"""


@query("q_zeropoint_offsets", _zeropoint_sql())
def offsets(spark: SparkSession, d: str) -> DataFrame:
    z = calibration.zeropoint_offsets(_calibrators(spark, d))
    return z.select("band", *[rounded(c, 6).alias(c) for c in ("offset_mag", "flux_scale", "scatter")], "n_cal", "converged")


@query("q_zeropoint_apply", "SELECT record_id, " + ", ".join(f"round({c} * {k} * 1e18, 6) AS {c}" for c, k in zip(FLUX, (1.1, 0.9, 1.02, 0.98))) + " FROM (SELECT record_id, " + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in FLUX) + " FROM galaxy_catalog)")
def apply(spark: SparkSession, d: str) -> DataFrame:
    from skyloom.functions.photometry import clean

    a = calibration.apply_zeropoints(table(spark, d, "galaxy_catalog"), {"U": 1.1, "B": 0.9, "V": 1.02, "I": 0.98})
    return a.select("record_id", *[rounded(clean(F.col(c)) * 1e18, 6).alias(c) for c in FLUX])


@query("q_star_forest")
def star_forest(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "galaxy_catalog").select("record_id", "concentration", "gini", "sersic_n", (F.col("r_half_arcsec") / 0.04).alias("half_light_radius"), (F.col("quality_flag").bitwiseAND(F.lit(64)) != 0).cast("int").alias("star"))
    return ml.classify_stars(cut(g), "star", "record_id").select("record_id", "star_prob_ml")


@query("q_morphology_mlp")
def mlp(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "galaxy_catalog").groupBy("object_id").agg(F.max("sed_morphology").alias("label"))
    e = cut(table(spark, d, "zoobot_embedding").join(g, "object_id", "left").select("emb_id", "embeddings", "label"))
    return ml.MorphologyClassifier().fit(e, "label").classify(e).drop("embeddings")


@query("q_embedding_columns", "SELECT emb_id, " + ", ".join(f"embeddings[{i + 1}] AS zoobot_emb_{i}" for i in range(2)) + " FROM zoobot_embedding WHERE len(embeddings) >= 2 AND isfinite(embeddings[1]) AND isfinite(embeddings[2])")
def embedding_columns(spark: SparkSession, d: str) -> DataFrame:
    e = ml.with_embedding_columns(table(spark, d, "zoobot_embedding").filter("size(embeddings) >= 2"), "embeddings", 2)
    ok = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return e.filter(ok("zoobot_emb_0") & ok("zoobot_emb_1")).select("emb_id", "zoobot_emb_0", "zoobot_emb_1")


@query("q_embedding_columns_full", "SELECT emb_id, " + ", ".join(f"embeddings[{i + 1}] AS zoobot_emb_{i}" for i in range(8)) + " FROM zoobot_embedding WHERE len(embeddings) >= 8 AND " + " AND ".join(f"isfinite(embeddings[{i + 1}])" for i in range(8)))
def all_embedding_columns(spark: SparkSession, d: str) -> DataFrame:
    """All eight components of the vectors that have them."""
    e = ml.with_embedding_columns(table(spark, d, "zoobot_embedding").filter("size(embeddings) >= 8"), "embeddings")
    names = [f"zoobot_emb_{i}" for i in range(8)]
    return e.filter(" and ".join(f"abs({c}) < double('infinity')" for c in names)).select("emb_id", *names)


@query("q_uband_share", "SELECT n_valid_bands, count(*) AS n FROM (SELECT DISTINCT id, n_valid_bands FROM photoz_result) GROUP BY 1")
def uband(spark: SparkSession, d: str) -> DataFrame:
    return catalog_with_fits(spark, d).filter("n_valid_bands is not null").groupBy("n_valid_bands").agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = query.queries, query.sql
