"""Queries of the point-and-region operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.spatial import near_pairs, points_in_regions
from skyloom.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of different objects at most 3 arcsec apart, and the rows within each region."""
    g = table(spark, d, "galaxy_catalog")
    near = near_pairs(g, 3.0, id_col="record_id", group_col="object_id")
    inside = points_in_regions(g, table(spark, d, "sky_region"), id_col="record_id")
    return near.select(F.lit("near").alias("case_kind"), F.col("id_a").alias("key_1"), F.col("id_b").alias("key_2")).unionByName(
        inside.select(F.lit("inside").alias("case_kind"), F.col("region_id").alias("key_1"), F.col("id").alias("key_2"))
    )


QUERIES = {"p4_found": p4_found}
_U = "[cos(radians({d})) * cos(radians({a})), cos(radians({d})) * sin(radians({a})), sin(radians({d}))]"
SQL = {
    "p4_found": f"""
      WITH g AS (SELECT record_id, object_id, dec, {_U.format(a="ra", d="dec")} AS u FROM galaxy_catalog WHERE isfinite(ra) AND isfinite(dec) AND abs(dec) <= 90),
      near AS (SELECT a.record_id AS key_1, b.record_id AS key_2 FROM g a JOIN g b ON b.dec BETWEEN a.dec - 0.00084 AND a.dec + 0.00084 AND a.record_id < b.record_id AND a.object_id != b.object_id
               WHERE pow(a.u[1] - b.u[1], 2) + pow(a.u[2] - b.u[2], 2) + pow(a.u[3] - b.u[3], 2) <= pow(2 * sin(radians(3.0::double / 3600) / 2), 2)),
      c AS (SELECT region_id, {_U.format(a="ra", d="dec")} AS u, radius_arcsec AS r FROM sky_region WHERE lower(trim(shape)) = 'circle' AND isfinite(ra) AND isfinite(dec) AND abs(dec) <= 90 AND isfinite(radius_arcsec) AND radius_arcsec >= 0),
      circles AS (SELECT DISTINCT region_id AS key_1, record_id AS key_2 FROM c, g WHERE 2 * asin(least(1, sqrt(pow(c.u[1] - g.u[1], 2) + pow(c.u[2] - g.u[2], 2) + pow(c.u[3] - g.u[3], 2)) / 2)) <= radians(r / 3600) + 1e-15),
      v AS (SELECT region_id, len(vertex_ra) AS n, list_transform(range(1, len(vertex_ra) + 1), lambda i: {_U.format(a="vertex_ra[i]", d="vertex_dec[i]")}) AS v FROM sky_region WHERE lower(trim(shape)) = 'polygon' AND len(vertex_ra) >= 3 AND len(vertex_ra) = len(vertex_dec)),
      e AS (SELECT region_id, list_transform(range(1, n + 1), lambda i: [v[i][2] * v[i % n + 1][3] - v[i][3] * v[i % n + 1][2], v[i][3] * v[i % n + 1][1] - v[i][1] * v[i % n + 1][3], v[i][1] * v[i % n + 1][2] - v[i][2] * v[i % n + 1][1]]) AS e,
             [list_sum(list_transform(v, lambda p: p[1])), list_sum(list_transform(v, lambda p: p[2])), list_sum(list_transform(v, lambda p: p[3]))] AS m FROM v),
      s AS (SELECT *, CASE WHEN list_sum(list_transform(e, lambda k: k[1] * m[1] + k[2] * m[2] + k[3] * m[3])) >= 0 THEN 1 ELSE -1 END AS sense FROM e),
      polygons AS (SELECT DISTINCT region_id AS key_1, record_id AS key_2 FROM s, g WHERE m[1] * u[1] + m[2] * u[2] + m[3] * u[3] > 0 AND list_min(list_transform(e, lambda k: sense * (k[1] * u[1] + k[2] * u[2] + k[3] * u[3]))) >= -1e-15)
      SELECT 'near' AS case_kind, key_1, key_2 FROM near UNION ALL SELECT DISTINCT 'inside', key_1, key_2 FROM (SELECT * FROM circles UNION ALL SELECT * FROM polygons)
    """,
}
