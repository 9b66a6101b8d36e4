"""Registration of queries and the shared views of catalog tables, in both languages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.constants import TEMPLATES
from skyloom.functions.labels import template_name
from skyloom.sources.catalogs import catalog_with_fits

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of a module and their SQL."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


def rounded(c: Column | str, n: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Catalog versions with a usable redshift, size and error, and the fit's columns."""
    g = catalog_with_fits(spark, d).withColumn("galaxy_type", template_name(F.col("galaxy_type")))
    ok = lambda c, top: (F.col(c) > 0) & (F.col(c) <= top)  # noqa: E731  # NaN is above any bound; both reach the scan
    return g.filter(ok("redshift", 8.0) & ok("r_half_arcsec", 100.0) & ok("r_half_arcsec_error", 100.0))


_TYPE = "CASE lower(trim(f.galaxy_type)) " + " ".join(f"WHEN '{t.lower()}' THEN '{t}'" for t in TEMPLATES) + " ELSE lower(trim(f.galaxy_type)) END"
#: The same view as a CTE ``meas``; starts a WITH clause.
MEAS = f"""WITH f AS (SELECT DISTINCT * FROM photoz_result),
cat AS (SELECT g.*, f.redshift AS z_phot, f.z_lo, f.z_hi, f.chi_sq_min, f.odds, f.chi2_flag, f.odds_flag, f.bimodal_flag, f.reduced_chi2, f.n_valid_bands, {_TYPE} AS galaxy_type
        FROM galaxy_catalog g LEFT JOIN f ON f.id = g.record_id),
meas AS (SELECT * FROM cat WHERE isfinite(redshift) AND redshift > 0 AND redshift <= 8 AND isfinite(r_half_arcsec) AND r_half_arcsec > 0 AND r_half_arcsec <= 100
         AND isfinite(r_half_arcsec_error) AND r_half_arcsec_error > 0 AND r_half_arcsec_error <= 100)"""


def gauss_sql(z: str, om: str = "0.3", ol: str | None = None) -> str:
    """The fixed-node distance (Mpc) as SQL."""
    from skyloom.functions.cosmology import NODES, WEIGHTS

    ol = ol or f"(1.0::double - {om})"
    terms = " + ".join(f"{w!r}::double / sqrt({om}::double * pow(1 + ({z}) * {0.5 * (x + 1.0)!r}::double, 3) + {ol})" for x, w in zip(NODES, WEIGHTS))
    return f"(299792.458::double / 70.0 / (1 + ({z})) * (({z}) * 0.5::double) * ({terms}))"
