"""Text and table sources of the catalog pipeline, and its sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.angles import sexagesimal_dec, sexagesimal_ra
from skyloom.session import table


def read_catalog(df: DataFrame, required: list[str], exclude_boundary: bool = True) -> DataFrame:
    """Rows with all required values (NaN counts as missing), without boundary redshifts where that column exists (unknown ones go too)."""
    out = df.dropna(subset=required)
    if exclude_boundary and "z_boundary_flag" in df.columns:
        out = out.filter(F.col("z_boundary_flag") == F.lit(False))
    return out


def read_csv_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV catalog by an explicit schema; values that do not parse become null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", nanValue="NaN")


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """``(file, wave, flux)`` of two-column text spectra; comment and blank lines are skipped."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("t")).filter("t != '' and not startswith(t, '#')")
    p = F.split("t", r"\s+")
    return t.select(F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1).alias("file"), F.get(p, F.lit(0)).try_cast("double").alias("wave"), F.get(p, F.lit(1)).try_cast("double").alias("flux"))


@dataclass(frozen=True)
class RedshiftList:
    """How one external list is read; columns that are not named are found by the file's header."""

    name: str
    path: str
    z: str | None = None
    ra: str | None = None
    dec: str | None = None


#: Header names (without case) of redshifts, and of positions in degrees or in sexagesimal notation.
Z_NAMES, DEGREES, SEXAGESIMAL = ("z_spec", "zsp"), ("ra", "dec"), ("raj2000", "dej2000")


def usable_redshift(z: Column) -> Column:
    return z.isNotNull() & ~F.isnan(z) & (z > 0)


def lists_of(spark: SparkSession, folder: str) -> list[RedshiftList]:
    """The CSV files of a folder, in the order of their names; none if there is no such folder."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = fs.Path(f"{folder}/*.csv")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    paths = sorted(str(f.getPath()) for f in found)
    return [RedshiftList(p.rsplit("/", 1)[-1].removesuffix(".csv"), p) for p in paths]


def read_redshift_lists(spark: SparkSession, folder: str, lists: list[RedshiftList] | None = None) -> DataFrame:
    """``(list, list_order, ra, dec, z_spec)`` of external lists, rows with a positive redshift; the order is that of ``lists`` (all CSV files of the folder unless given). A file without the needed columns gives no rows."""
    out = spark.createDataFrame([], "list string, list_order int, ra double, dec double, z_spec double")
    for i, x in enumerate(lists if lists is not None else lists_of(spark, folder)):
        t = spark.read.csv(x.path, header=True)
        by = {c.lower(): c for c in t.columns}
        z = x.z or next((by[n] for n in Z_NAMES if n in by), None)
        pair = next(((by[a], by[d]) for a, d in (DEGREES, SEXAGESIMAL) if a in by and d in by), None)
        ra, dec = (x.ra, x.dec) if x.ra and x.dec else pair or (None, None)
        if not z or not ra:
            continue
        p = F.coalesce(F.col(ra).try_cast("double"), sexagesimal_ra(F.col(ra))), F.coalesce(F.col(dec).try_cast("double"), sexagesimal_dec(F.col(dec)))
        t = t.select(F.lit(x.name).alias("list"), F.lit(i).alias("list_order"), p[0].alias("ra"), p[1].alias("dec"), F.col(z).try_cast("double").alias("z_spec"))
        out = out.unionByName(t.filter(usable_redshift(F.col("z_spec"))))
    return out


def redshift_entries(specz: DataFrame, trust: DataFrame) -> DataFrame:
    """``(entry_id, list, list_order, ra, dec, z_spec)`` of a ``specz_catalog`` table: positive redshifts, positions of either notation; the order is the source's trust."""
    has = F.col("ra").isNotNull() & F.col("dec").isNotNull() & ~F.isnan("ra") & ~F.isnan("dec")
    e = specz.filter(usable_redshift(F.col("z_spec"))).select(
        F.col("specz_id").alias("entry_id"), F.lower(F.trim("catalog_name")).alias("list"),
        F.when(has, F.col("ra")).otherwise(sexagesimal_ra(F.col("raj2000"))).alias("ra"), F.when(has, F.col("dec")).otherwise(sexagesimal_dec(F.col("dej2000"))).alias("dec"), "z_spec",
    )
    t = trust.select(F.lower(F.trim("source_name")).alias("list"), F.col("trust_rank").cast("int").alias("list_order"))
    return e.join(t, "list", "left").withColumn("list_order", F.coalesce("list_order", F.lit(2**30)))


def band_files(spark: SparkSession, mode: str = "full", root: str = "data") -> DataFrame:
    """``(band, kind, path)`` of the science and weight images of a mode, ``full`` or ``chip3``."""
    if mode not in ("full", "chip3"):
        raise ValueError("mode must be 'full' or 'chip3'")
    # Naming of the image files.
    name = (lambda b, s: f"mosaics/{b}{s}_mosaic_v2.fits") if mode == "full" else (lambda b, s: f"chips/{b}_3{s}_v2.fits")
    rows = [(b, k, f"{root}/{name(b, s)}") for b in ("f300", "f450", "f606", "f814") for k, s in (("science", ""), ("weight", "c"))]
    return spark.createDataFrame(rows, "band string, kind string, path string")


def padded_mask(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Set pixels ``(x, y)`` of a mask laid at the origin; what lies outside the image goes, what it does not reach is unset."""
    return mask.filter((F.col("x") < width) & (F.col("y") < height) & (F.col("v") != 0)).select("x", "y").distinct()


ZERO_LINE = r"^\s*(\S+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*$"


def read_zeropoints(spark: SparkSession, path: str) -> DataFrame:
    """``(band, offset_mag, flux_scale, scatter, n_cal, converged)`` of a zero-point text file; comment lines give only the number of calibrators."""
    t = spark.read.text(path)
    n = t.select(F.max(F.regexp_extract("value", r"#\s*N_calibrators:\s*(\d+)", 1).try_cast("long")).alias("n_cal"))
    rows = t.filter(~F.startswith(F.trim("value"), F.lit("#")) & F.regexp_like("value", F.lit(ZERO_LINE)))
    g = lambda i: F.regexp_extract("value", ZERO_LINE, i)
    out = rows.select(g(1).alias("band"), g(2).try_cast("double").alias("offset_mag"), g(3).try_cast("double").alias("flux_scale"), g(4).try_cast("double").alias("scatter"))
    return out.crossJoin(F.broadcast(n)).withColumn("converged", F.lit(True))


def write_zeropoints(offsets: DataFrame, path: str) -> None:
    """Four lines and a comment with the number of calibrators, as one text file."""
    head = offsets.select(F.concat(F.lit("# N_calibrators: "), F.max("n_cal").cast("string")).alias("value"), F.lit(0).alias("o"))
    body = offsets.select(F.format_string("%s %+.4f %.4f %.4f", "band", "offset_mag", "flux_scale", F.coalesce("scatter", F.lit(0.0))).alias("value"), F.lit(1).alias("o"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def write_catalog(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, and on request a single CSV beside it (for catalogs that a person reads)."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        df.coalesce(1).write.mode("overwrite").csv(f"{path}_csv", header=True)


def write_summary(metrics: DataFrame, path: str) -> None:
    """Every number of a metrics table as a ``name: value`` line."""
    pairs = F.explode(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in metrics.columns]))
    metrics.select(pairs.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of image files for inference."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def photoz_once(fits: DataFrame) -> DataFrame:
    """One fit per catalog row: a fit delivered twice counts once."""
    return fits.dropDuplicates(["id"])


def catalog_with_fits(spark: SparkSession, d: str) -> DataFrame:
    """``galaxy_catalog`` with the columns of its photometric fit (null without one); the fit's redshift is ``z_phot``."""
    p = photoz_once(table(spark, d, "photoz_result")).withColumnsRenamed({"id": "record_id", "redshift": "z_phot"})
    return table(spark, d, "galaxy_catalog").join(p, "record_id", "left")
