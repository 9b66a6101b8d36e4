"""Raster operators over the 8 x 8 arrays of ``embeddings``, read as small images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.photometry import concentration_index
from skyloom.operators import detection, raster
from skyloom.plans.common import Registry, rounded
from skyloom.session import table

query = Registry()
PX = "WITH px AS (SELECT vec_id AS image, (i % 8)::int AS x, (i // 8)::int AS y, v FROM (SELECT vec_id, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"
#: Sub-sampled share of a pixel within a circle about (3.5, 3.5).
COV = "(" + " + ".join(f"(CASE WHEN pow(x - 3.5 + {a}, 2) + pow(y - 3.5 + {b}, 2) <= r * r THEN 1 ELSE 0 END)" for a in (-0.4, -0.2, 0, 0.2, 0.4) for b in (-0.4, -0.2, 0, 0.2, 0.4)) + ") / 25.0::double"
APER = PX + f", ap AS (SELECT image, r, sum(v * c) AS flux, sum(c) AS area FROM (SELECT image, v, r, {COV} AS c FROM px, (SELECT unnest([0.9, 1.4, 2.3, 3.1])::double AS r)) WHERE c > 0 GROUP BY 1, 2)"
RADII = [0.9, 1.4, 2.3, 3.1]


def _px(spark: SparkSession, d: str) -> DataFrame:
    return raster.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


def _abs(spark: SparkSession, d: str) -> DataFrame:
    return _px(spark, d).withColumn("v", F.abs("v"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.col("vec_id").alias("id"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"))


@query("q_aperture_sum", APER + " SELECT image, r, round(flux, 6) AS flux, round(area, 6) AS area FROM ap")
def apertures(spark: SparkSession, d: str) -> DataFrame:
    a = raster.aperture_sums(_sources(spark, d), _px(spark, d), RADII)
    return a.select("image", "r", rounded("flux", 6).alias("flux"), rounded("area", 6).alias("area"))


@query("q_annulus_background", PX + ", b AS (SELECT image, median(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM px WHERE pow(x - 3.5, 2) + pow(y - 3.5, 2) BETWEEN 4 AND 12.25 GROUP BY 1) SELECT image, round(m, 6) AS bkg_median, round(s, 6) AS bkg_std, n AS n_bkg FROM b")
def annulus(spark: SparkSession, d: str) -> DataFrame:
    b = raster.local_background(_sources(spark, d), _px(spark, d), 2.0, 3.5)
    return b.select("image", rounded("bkg_median", 6).alias("bkg_median"), rounded("bkg_std", 6).alias("bkg_std"), "n_bkg")


APER_ABS = APER.replace("unnest(embedding)::double AS v", "abs(unnest(embedding)::double) AS v")


@query(
    "q_growth_radius",
    APER_ABS + ", t AS (SELECT image, sum(v) AS total FROM px GROUP BY 1), g AS (SELECT ap.*, total, 0.3::double * total AS goal, lag(r) OVER w AS r0, lag(flux) OVER w AS f0 FROM ap JOIN t USING (image) WINDOW w AS (PARTITION BY image ORDER BY r)),"
    " h AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY r) AS k FROM g WHERE flux >= goal) SELECT t.image, round(CASE WHEN h.image IS NULL THEN 3.1 WHEN r0 IS NULL THEN r WHEN flux > f0 THEN r0 + (r - r0) * (goal - f0) / (flux - f0) ELSE r0 END, 6) AS radius FROM t LEFT JOIN h ON h.image = t.image AND k = 1",
)
def growth(spark: SparkSession, d: str) -> DataFrame:
    px = _abs(spark, d)
    totals = px.groupBy("image").agg(F.sum("v").alias("total")).withColumn("id", F.col("image"))
    g = raster.growth_radius(raster.aperture_sums(_sources(spark, d), px, RADII), totals, 0.3)
    return g.select("image", rounded("radius", 6).alias("radius"))


@query("q_concentration", APER_ABS + ", c AS (SELECT image, max(flux) FILTER (WHERE r = 1.4) AS a, max(flux) FILTER (WHERE r = 3.1) AS b FROM ap GROUP BY 1) SELECT image, CASE WHEN a > 0 AND b > 0 AND 1 - a / b + 0.01 > 0 THEN round(-5 * log10(1 - a / b + 0.01), 6) END AS c FROM c")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    w = raster.wide_apertures(raster.aperture_sums(_sources(spark, d), _abs(spark, d), RADII), RADII)
    return w.select("image", rounded(concentration_index(F.col("flux_aper_1p4"), F.col("flux_aper_3p1")), 6).alias("c"))


@query("q_gini", PX + ", r AS (SELECT image, abs(v) AS a, row_number() OVER (PARTITION BY image ORDER BY abs(v), y, x) AS i FROM px) SELECT image, round((2 * sum(i * a) - (count(*) + 1) * sum(a)) / (sum(a) * (count(*) - 1)), 6) AS gini FROM r GROUP BY 1")
def gini(spark: SparkSession, d: str) -> DataFrame:
    return raster.gini(_px(spark, d)).withColumn("gini", rounded("gini", 6))


@query(
    "q_m20",
    PX.replace("unnest(embedding)::double AS v", "abs(unnest(embedding)::double) AS v") + ", c AS (SELECT image, sum(v * x) / sum(v) AS cx, sum(v * y) / sum(v) AS cy, sum(v) AS total FROM px GROUP BY 1), m AS (SELECT px.image, v * (pow(x - cx, 2) + pow(y - cy, 2)) AS m, total, sum(v) OVER (PARTITION BY px.image ORDER BY v DESC, y, x ROWS UNBOUNDED PRECEDING) AS run FROM px JOIN c USING (image)) SELECT image, round(log10(sum(m) FILTER (WHERE run <= 0.2 * total) / sum(m)), 6) AS m20 FROM m GROUP BY 1",
)
def m20(spark: SparkSession, d: str) -> DataFrame:
    return raster.m20(_abs(spark, d)).withColumn("m20", rounded("m20", 6))


@query("q_convolve", PX + ", k(dx, dy, w) AS (VALUES (-1,-1,1),(0,-1,2),(1,-1,1),(-1,0,2),(0,0,4),(1,0,2),(-1,1,1),(0,1,2),(1,1,1)) SELECT image, (x + dx)::int AS x, (y + dy)::int AS y, round(sum(v * w / 16.0::double), 6) AS v FROM px, k WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7 GROUP BY 1, 2, 3")
def convolve(spark: SparkSession, d: str) -> DataFrame:
    return raster.convolve(_px(spark, d)).withColumn("v", rounded("v", 6))


@query("q_asymmetry", PX + " SELECT a.image, round(sum(abs(a.v - b.v)) / (2 * sum(abs(a.v))), 6) AS asymmetry FROM px a JOIN px b ON a.image = b.image AND b.x = 7 - a.x AND b.y = 7 - a.y GROUP BY 1")
def asymmetry(spark: SparkSession, d: str) -> DataFrame:
    return raster.asymmetry(_px(spark, d), 8, 8).withColumn("asymmetry", rounded("asymmetry", 6))


@query("q_cutout_normalise", "SELECT vec_id, list_sum(list_transform(e, lambda v: floor((v - list_min(e)) / (list_max(e) - list_min(e) + 1e-10) * 255)))::bigint AS total FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings)")
def normalise(spark: SparkSession, d: str) -> DataFrame:
    n = raster.normalised(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("q_stretch", PX + " SELECT image, round(quantile_cont(v, 0.20), 6) AS lo, round(quantile_cont(v, 0.99), 6) AS hi FROM px GROUP BY 1")
def stretch(spark: SparkSession, d: str) -> DataFrame:
    return raster.stretch(_px(spark, d)).select("image", rounded("lo", 6).alias("lo"), rounded("hi", 6).alias("hi"))


@query(
    "q_label_components",
    PX.replace("WITH px", "WITH RECURSIVE px") + """, hot AS (SELECT image, x, y, v FROM px WHERE v > 0.1),
      reach AS (SELECT image, x, y, x::bigint * 2147483648 + y AS code FROM hot UNION SELECT h.image, h.x, h.y, r.code FROM reach r JOIN hot h ON h.image = r.image AND abs(h.x - r.x) <= 1 AND abs(h.y - r.y) <= 1),
      lab AS (SELECT image, x, y, min(code) AS label FROM reach GROUP BY 1, 2, 3)
      SELECT image, label, count(*) AS npix, round(sum(v), 6) AS flux FROM lab JOIN hot USING (image, x, y) GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def components(spark: SparkSession, d: str) -> DataFrame:
    lab = raster.label_components(_px(spark, d).filter("v > 0.1"), 2)
    return lab.groupBy("image", "label").agg(F.count(F.lit(1)).alias("npix"), rounded(F.sum("v"), 6).alias("flux"))


@query("q_moments", PX + ", g AS (SELECT image, count(*) AS npix, sum(v) AS f, sum(v * x) / sum(v) AS cx, sum(v * y) / sum(v) AS cy, sum(v * x * x) AS xx, sum(v * y * y) AS yy, sum(v * x * y) AS xy FROM px WHERE v > 0 GROUP BY 1) SELECT image, npix, round(f, 6) AS flux, round(cx, 6) AS x, round(cy, 6) AS y, round(greatest(xx / f - cx * cx, 0), 6) AS x2, round(greatest(yy / f - cy * cy, 0), 6) AS y2, round(xy / f - cx * cy, 6) AS xy FROM g")
def moments(spark: SparkSession, d: str) -> DataFrame:
    m = raster.moments(_px(spark, d).filter("v > 0").withColumn("label", F.lit(1)))
    return m.select("image", "npix", *[rounded(c, 6).alias(c) for c in ("flux", "x", "y", "x2", "y2", "xy")])


@query("q_uncovered", PX + ", p AS (SELECT x, y, CASE WHEN (7 * x + 3 * y) % 5 = 0 THEN 0 ELSE v END AS v FROM px) SELECT x, y FROM p GROUP BY 1, 2 HAVING bool_and(v = 0)")
def uncovered(spark: SparkSession, d: str) -> DataFrame:
    """A lattice of pixels is set to zero in every array, as the arrays themselves have none."""
    return raster.uncovered(_px(spark, d).withColumn("v", F.when((7 * F.col("x") + 3 * F.col("y")) % 5 == 0, 0.0).otherwise(F.col("v"))))


@query("q_cutout_morphology")
def morphology(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("pix"))
    return raster.cutout_morphology(c, 8)


@query("q_deblend")
def deblend(spark: SparkSession, d: str) -> DataFrame:
    lab = raster.label_components(_px(spark, d).filter("v > 0.05"))
    return raster.deblend(lab).groupBy("image", "label").agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("npix"))


def _mosaic(spark: SparkSession, d: str) -> DataFrame:
    """All arrays side by side as one mosaic per label."""
    e = table(spark, d, "embeddings").withColumn("row", F.floor(F.col("vec_id") / 16)).withColumn("col", F.col("vec_id") % 16)
    p = e.select("label", "row", "col", F.posexplode("embedding").alias("i", "v"))
    return p.select(F.col("label").alias("image"), (F.col("col") * 8 + F.col("i") % 8).cast("int").alias("x"), (F.col("row") * 8 + F.floor(F.col("i") / 8)).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


def _detect_sql() -> str:
    rounds = "".join(
        f", s{i} AS (SELECT *, median(v) OVER (PARTITION BY image, gx, gy) AS m, stddev_pop(v) OVER (PARTITION BY image, gx, gy) AS s FROM c{i}), c{i + 1} AS (SELECT image, gx, gy, v FROM s{i} WHERE abs(v - m) <= 3 * s)" for i in range(3)
    )
    steps = (-0.4, -0.2, 0, 0.2, 0.4)
    cover = " + ".join(f"(CASE WHEN pow(p.x - cx + {i}, 2) + pow(p.y - cy + {j}, 2) <= 4 THEN 1 ELSE 0 END)" for i in steps for j in steps)
    return f"""WITH RECURSIVE px AS (SELECT label AS image, ((vec_id % 16) * 8 + i % 8)::int AS x, ((vec_id // 16) * 8 + i // 8)::int AS y, v
        FROM (SELECT vec_id, label, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
      c0 AS (SELECT image, x // 16 AS gx, y // 16 AS gy, v FROM px){rounds},
      mesh AS (SELECT image, gx, gy, median(v) AS back, stddev_pop(v) AS rms FROM c3 GROUP BY 1, 2, 3),
      f AS (SELECT a.image, a.gx, a.gy, median(b.back) AS back, median(b.rms) AS rms FROM mesh a JOIN mesh b ON a.image = b.image AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 GROUP BY 1, 2, 3),
      ends AS (SELECT image, min(gx) AS x0, max(gx) AS x1, min(gy) AS y0, max(gy) AS y1 FROM f GROUP BY 1),
      corner AS (SELECT image, x, y, v, greatest(least(floor(u)::int + i, x1), x0) AS gx, greatest(least(floor(t)::int + j, y1), y0) AS gy,
          (CASE i WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE j WHEN 1 THEN t - floor(t) ELSE 1 - (t - floor(t)) END) AS w
        FROM (SELECT *, (x + 0.5::double) / 16 - 0.5 AS u, (y + 0.5::double) / 16 - 0.5 AS t FROM px) JOIN ends USING (image), (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
      sub AS (SELECT image, x, y, any_value(v) - sum(w * back) / sum(w) AS v, sum(w * rms) / sum(w) AS rms FROM corner JOIN f USING (image, gx, gy) GROUP BY 1, 2, 3),
      p AS (SELECT image, x, y, v, rms * rms + greatest(v, 0) / 50.0::double AS var FROM sub),
      k(dx, dy, w) AS (VALUES (-1,-1,1),(0,-1,2),(1,-1,1),(-1,0,2),(0,0,4),(1,0,2),(-1,1,1),(0,1,2),(1,1,1)),
      snr AS (SELECT image, x + dx AS x, y + dy AS y, sum(v / var * w / 16.0::double) / sqrt(sum(pow(w / 16.0::double, 2) / var)) AS s FROM p, k WHERE var > 0 GROUP BY 1, 2, 3),
      hot AS (SELECT p.* FROM p JOIN snr USING (image, x, y) WHERE s > 1.5),
      reach AS (SELECT image, x, y, x::bigint * 2147483648 + y AS code FROM hot UNION SELECT h.image, h.x, h.y, r.code FROM reach r JOIN hot h ON h.image = r.image AND abs(h.x - r.x) <= 1 AND abs(h.y - r.y) <= 1),
      lab AS (SELECT image, x, y, min(code) AS id FROM reach GROUP BY 1, 2, 3),
      g AS (SELECT image, id, count(*) AS npix, sum(v) AS flux, sum(v * x) / nullif(sum(v), 0) AS cx, sum(v * y) / nullif(sum(v), 0) AS cy, sum(v * x * x) / nullif(sum(v), 0) AS xx, sum(v * y * y) / nullif(sum(v), 0) AS yy, sum(v * x * y) / nullif(sum(v), 0) AS xy FROM lab JOIN hot USING (image, x, y) GROUP BY 1, 2 HAVING count(*) >= 3),
      mo AS (SELECT *, greatest(xx - cx * cx, 0) AS x2, greatest(yy - cy * cy, 0) AS y2, xy - cx * cy AS c FROM g WHERE cx IS NOT NULL),
      el AS (SELECT *, sqrt((x2 + y2) / 2 + sqrt(pow((x2 - y2) / 2, 2) + c * c)) AS a, sqrt(greatest((x2 + y2) / 2 - sqrt(pow((x2 - y2) / 2, 2) + c * c), 0)) AS b, atan2(2 * c, x2 - y2) / 2 AS theta FROM mo),
      src AS (SELECT image, id, cx, cy, greatest(coalesce(CASE WHEN a > 1e-6 THEN a END, 0.5), coalesce(CASE WHEN b > 1e-6 THEN b END, 0.5)) AS a, least(coalesce(CASE WHEN a > 1e-6 THEN a END, 0.5), coalesce(CASE WHEN b > 1e-6 THEN b END, 0.5)) AS b, theta FROM el),
      er AS (SELECT src.*, p.v, p.var, sqrt(pow(((p.x - cx) * cos(theta) + (p.y - cy) * sin(theta)) / a, 2) + pow(((p.y - cy) * cos(theta) - (p.x - cx) * sin(theta)) / b, 2)) AS er FROM src JOIN p USING (image)),
      kr AS (SELECT image, id, greatest(coalesce(CASE WHEN sum(v) > 0 THEN sum(er * v) / sum(v) END, 0), 1.75) AS kron FROM er WHERE er <= 6 + 1e-9 GROUP BY 1, 2),
      fl AS (SELECT image, id, any_value(kron) AS kron, sum(v) AS flux_auto, sqrt(sum(var)) AS flux_auto_err FROM er JOIN kr USING (image, id) WHERE er <= kron * 2.5 + 1e-9 GROUP BY 1, 2),
      ap AS (SELECT image, id, sum(v * c) AS f2, sqrt(sum(var * c)) AS e2 FROM (SELECT image, id, v, var, ({cover}) / 25.0::double AS c FROM src JOIN p USING (image) WHERE abs(p.x - cx) <= 3 AND abs(p.y - cy) <= 3) WHERE c > 0 GROUP BY 1, 2)
      SELECT el.image, el.id, npix, round(flux, 6) AS flux, round(cx, 6) AS xcentroid, round(cy, 6) AS ycentroid, round(el.a, 5) AS a, round(el.b, 5) AS b, round(kron, 5) AS kron_radius, round(flux_auto, 5) AS flux_auto, round(flux_auto_err, 5) AS flux_auto_err, round(f2, 5) AS flux_aper_2p0, round(e2, 5) AS flux_aper_2p0_err
      FROM el LEFT JOIN fl USING (image, id) LEFT JOIN ap USING (image, id)"""


@query("q_detect_measure", _detect_sql())
def detect_measure(spark: SparkSession, d: str) -> DataFrame:
    """Background, error map with photon noise, matched filter, segments (not deblended, for the SQL's sake), moments (about the image's origin, as the SQL has them), Kron and circular apertures."""
    cat, _, _ = detection.detect_and_measure(_mosaic(spark, d), 1.5, min_pixels=3, box=16, gain=50.0, levels=0, radii=[2.0], half_light=False, local=False)
    five = ("a", "b", "kron_radius", "flux_auto", "flux_auto_err", "flux_aper_2p0", "flux_aper_2p0_err")
    return cat.select("image", "id", "npix", *[rounded(c, 6).alias(c) for c in ("flux", "xcentroid", "ycentroid")], *[rounded(c, 5).alias(c) for c in five])


@query("q_band_images")
def band_images(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from images, one per band, to the rows of a band catalog: four of the mosaics are the bands, the rest further images."""
    bands = F.create_map(*[x for i, b in enumerate(("f300", "f450", "f606", "f814")) for x in (F.lit(i), F.lit(b))])
    px = _mosaic(spark, d).withColumn("image", F.coalesce(bands[F.col("image")], F.col("image").cast("string")))
    return detection.band_catalog(px, 128, 128, gain=50.0, base_pixels=16, box=32, cutout=16)


@query("q_detect")
def detect(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed pixels above the scatter of the background, in segments of two pixels or more."""
    return detection.detect(_mosaic(spark, d), 1.0, min_pixels=2, box=16, levels=0, matched=False)


QUERIES, SQL = query.queries, query.sql
