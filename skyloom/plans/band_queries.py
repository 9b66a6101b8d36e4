"""Queries over per-band sources: cross-matching, assembly, masks, the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.constants import REFERENCE_BAND
from skyloom.functions.photometry import clean
from skyloom.operators import matching
from skyloom.operators.spatial import usable_position
from skyloom.plans import pipeline
from skyloom.plans.common import Registry, rounded
from skyloom.session import table
from skyloom.sources.catalogs import redshift_entries

query = Registry()

#: Each source once, with a usable position: CTE ``s``.
SOURCES = """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY loaded_at DESC, detected_at DESC) AS k FROM band_catalog) WHERE k = 1 AND isfinite(xcentroid) AND isfinite(ycentroid))"""
NEAR = SOURCES + """, m AS (SELECT a.source_id AS id, b.band AS part, b.source_id AS near_id, sqrt((a.xcentroid - b.xcentroid) * (a.xcentroid - b.xcentroid) + (a.ycentroid - b.ycentroid) * (a.ycentroid - b.ycentroid)) AS dist
      FROM s a JOIN s b ON a.field_id = b.field_id AND a.band = 'f450' AND b.band IN ('f814', 'f300', 'f606') AND b.xcentroid BETWEEN a.xcentroid - 3 AND a.xcentroid + 3 AND b.ycentroid BETWEEN a.ycentroid - 3 AND a.ycentroid + 3),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY dist, near_id) AS k FROM m WHERE dist < 3) WHERE k = 1)"""


def _sources(spark: SparkSession, d: str, cols: list[str] | None = None) -> DataFrame:
    return matching.once(table(spark, d, "band_catalog"), cols)


@query("q_band_crossmatch", NEAR + " SELECT id, part, near_id, round(dist, 9) AS dist FROM n")
def crossmatch(spark: SparkSession, d: str) -> DataFrame:
    return matching.cross_band(_sources(spark, d, ["band", "field_id"])).withColumn("dist", rounded("dist"))


_C = ("source_sky", "r_half_pix", "concentration", "ellipticity", "snr")


@query(
    "q_bands_assembled",
    NEAR + ", v AS (SELECT source_id, " + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in _C) + " FROM s), a AS (SELECT id, part, v.* FROM n JOIN v ON v.source_id = n.near_id UNION ALL SELECT v.source_id, 'f450', v.* FROM v JOIN s ON s.source_id = v.source_id WHERE s.band = 'f450') "
    "SELECT id AS source_id, count(*)::int AS n_bands, concat_ws(',', 'f450', max(part) FILTER (WHERE part = 'f814'), max(part) FILTER (WHERE part = 'f300'), max(part) FILTER (WHERE part = 'f606')) AS bands_matched, "
    "round(max(source_sky) FILTER (WHERE part = 'f814'), 9) AS sky_f814, round(median(r_half_pix), 9) AS r_half_pix, round(median(concentration), 9) AS concentration, round(median(ellipticity), 9) AS ellipticity, round(median(snr), 9) AS snr_median, round(min(snr), 9) AS snr_min FROM a GROUP BY id HAVING count(*) >= 3",
)
def assembled(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    a = matching.assemble(s, matching.cross_band(s))
    return a.select("source_id", F.col("n_bands").cast("int").alias("n_bands"), "bands_matched", rounded("source_sky_f814").alias("sky_f814"), *[rounded(c).alias(c) for c in ("r_half_pix", "concentration", "ellipticity", "snr_median", "snr_min")])


@query("q_all_four_bands", NEAR + " SELECT id AS source_id FROM n GROUP BY id HAVING count(*) = 3")
def all_bands(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    return matching.assemble(s, matching.cross_band(s), 4).select("source_id")


def _centres(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "galaxy_catalog").filter("in_star_mask").select(F.col("field_id").alias("grp"), F.col("xcentroid").alias("x"), F.col("ycentroid").alias("y"))


@query("q_star_mask_theta", SOURCES + ", c AS (SELECT field_id, xcentroid AS x, ycentroid AS y FROM galaxy_catalog WHERE in_star_mask) SELECT source_id FROM s WHERE EXISTS (SELECT 1 FROM c WHERE c.field_id = s.field_id AND pow(c.x - s.xcentroid, 2) + pow(c.y - s.ycentroid, 2) < 900)")
def star_theta(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d, ["field_id"]).select("source_id", F.col("field_id").alias("grp"), F.col("xcentroid").alias("x"), F.col("ycentroid").alias("y"))
    return matching.near_centres(s, _centres(spark, d))


@query("q_star_mask_lookup", SOURCES + ", c AS (SELECT DISTINCT field_id, round_even(xcentroid, 0)::bigint AS x, round_even(ycentroid, 0)::bigint AS y FROM galaxy_catalog WHERE in_star_mask) SELECT source_id, c.x IS NOT NULL AS in_mask FROM s LEFT JOIN c ON c.field_id = s.field_id AND c.x = round_even(s.xcentroid, 0)::bigint AND c.y = round_even(s.ycentroid, 0)::bigint")
def star_lookup(spark: SparkSession, d: str) -> DataFrame:
    mask = _centres(spark, d).select(F.col("grp").alias("field_id"), F.bround("x").cast("long").alias("mx"), F.bround("y").cast("long").alias("my"))
    return matching.mask_lookup(_sources(spark, d, ["field_id"]), mask).select("source_id", "in_mask")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Sky positions of reference-band sources: of the nearest catalog version within the match radius in the same field that has a usable one."""
    own = lambda k: (F.col(k), F.col("field_id").alias("grp"), F.col("xcentroid").alias("x"), F.col("ycentroid").alias("y"))
    g = table(spark, d, "galaxy_catalog").filter(usable_position(F.col("ra"), F.col("dec")) & clean(F.col("xcentroid")).isNotNull() & clean(F.col("ycentroid")).isNotNull())
    s = _sources(spark, d, ["band", "field_id"]).filter(F.col("band") == REFERENCE_BAND)
    near = matching.nearest_pixel(s.select(*own("source_id")).withColumnRenamed("source_id", "id"), g.select(*own("record_id"), F.lit("sky").alias("part")).withColumnRenamed("record_id", "id"))
    return near.join(g.select(F.col("record_id").alias("near_id"), "ra", "dec"), "near_id").select(F.col("id").alias("source_id"), "ra", "dec")


def _run(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All stages with the default profile. The tables have no image sizes, so there is no edge bit."""
    entries = redshift_entries(table(spark, d, "specz_catalog"), table(spark, d, "specz_source"))
    return pipeline.run(spark, table(spark, d, "band_catalog"), entries=entries, positions=_positions(spark, d), centres=_centres(spark, d))


@query("q_pipeline")
def full_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Sources to catalog with redshifts and flags."""
    return _run(spark, d)["full"].select("source_id", "n_bands", "redshift", "redshift_source", "galaxy_type", "odds", "r_half_arcsec", "in_star_mask", "catastrophic_outlier", "quality_flag", "photoz_reliable")


@query("q_pipeline_fits")
def pipeline_fits(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)["fits"]


QUERIES, SQL = query.queries, query.sql
