"""From images or per-band sources to fitted models."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.constants import CHIP_BOX, FLUX_FACTOR, PIXEL_SCALE
from skyloom.functions.labels import sed_group, with_reliability
from skyloom.functions.photometry import at_boundary, clean, color_stellarity, redshift_half_width
from skyloom.operators import quality as q
from skyloom.operators.calibration import calibrate_if_enough
from skyloom.operators.detection import band_catalog
from skyloom.operators.matching import assemble, cross_band, near_centres, once, sky_match
from skyloom.operators.photoz import photoz
from skyloom.operators.raster import tile_pixels, trimmed_chip
from skyloom.operators.reports import all_relations, box_extract, fit_comparison
from skyloom.operators.templates import model_grid
from skyloom.operators.validation import apply_spectroscopic, flag_catastrophic
from skyloom.plans.profile import Profile, choose, resources, summary
from skyloom.session import cut
from skyloom.sources.catalogs import band_files
from skyloom.sources.fits import read_tiles

FLUX = [f"flux_{b}" for b in ("f300", "f450", "f606", "f814")]
ERR = [c.replace("flux", "error") for c in FLUX]


def matched_catalog(bands: DataFrame, centres: DataFrame | None = None, width: float | None = None, height: float | None = None) -> DataFrame:
    """Per-band sources cross-matched, assembled and flagged; ``centres`` (``grp, x, y``) are star-mask centres."""
    s = once(bands)
    m = assemble(s, cross_band(s))
    bits = q.snr_bits(F.col("snr_min"), F.col("snr_median")) + [q.star_bit(F.col("stellarity"), F.col("r_half_pix"), F.col("ellipticity"), F.col("concentration"))]
    if width and height:
        bits.append(q.edge_bit(F.col("xcentroid"), F.col("ycentroid"), F.lit(width), F.lit(height)))
    if centres is not None:
        near = near_centres(m.select("source_id", F.col("field_id").alias("grp"), F.col("xcentroid").alias("x"), F.col("ycentroid").alias("y")), centres).withColumn("in_star_mask", F.lit(True))
        m = m.join(near, "source_id", "left").withColumn("in_star_mask", F.coalesce("in_star_mask", F.lit(False)))
    else:
        m = m.withColumn("in_star_mask", F.lit(False))
    m = m.withColumn("quality_flag", q.with_bits(F.lit(0), *bits, *q.mask_bits(F.col("in_star_mask"))))
    flux = {f"flux_{b}": F.col(f"source_sky_{b}") * k for b, k in FLUX_FACTOR.items()}
    err = {f"error_{b}": F.col(f"source_error_{b}") * k for b, k in FLUX_FACTOR.items()}
    return m.withColumns(flux | err).withColumn("half_light_radius", F.col("r_half_pix"))


def with_redshifts(catalog: DataFrame, profile: Profile, id_col: str = "source_id") -> DataFrame:
    """Photometric redshifts, sizes in arcsec and the flags that depend on them (set on the photometric value)."""
    z = photoz(catalog, id_col, FLUX, ERR, model_grid(profile.z_step)).withColumnRenamed("id", id_col)
    c = catalog.drop(*[x for x in z.columns if x in catalog.columns and x != id_col]).join(z, id_col)
    c = c.withColumns({"redshift_err": redshift_half_width(F.col("z_lo"), F.col("z_hi")), "z_boundary_flag": at_boundary(F.col("redshift")), "color_stellarity": color_stellarity(*[F.col(x) for x in FLUX])})
    c = c.withColumns({"r_half_arcsec": F.col("r_half_pix") * PIXEL_SCALE, "r_half_arcsec_error": F.col("r_half_pix_error") * PIXEL_SCALE, "sed_morphology": sed_group(F.col("galaxy_type"))})
    flag = q.with_bits(F.col("quality_flag"), *q.photoz_bits(F.col("odds"), F.col("z_boundary_flag"), F.col("redshift"), F.col("redshift_err")), q.color_star_bit(F.col("color_stellarity"), F.col("stellarity")))
    flag, radius = q.floored_radius(flag, F.col("r_half_arcsec"))
    return with_reliability(c.withColumns({"quality_flag": flag, "r_half_arcsec": radius}))


def run(spark: SparkSession, bands: DataFrame, profile: Profile | None = None, entries: DataFrame | None = None, positions: DataFrame | None = None, centres: DataFrame | None = None, width: float | None = None, height: float | None = None) -> dict[str, DataFrame]:
    """``full`` (all rows), ``filtered`` (the quality selection) and ``fits``.

    ``positions`` gives ``source_id, ra, dec``; with them and ``entries`` fluxes are calibrated and spectroscopic redshifts take
    over after the photometric flags were set. ``width`` and ``height`` of the image set the edge bit, ``centres`` the star mask.
    """
    if (entries is None) != (positions is None) or (width is None) != (height is None):
        raise ValueError("entries and positions, width and height go together")
    profile = profile or choose()
    cat = matched_catalog(bands, centres, width, height)
    sky = None
    if entries is not None:
        cat = cut(cat.join(positions, "source_id", "left"))
        sky = cut(sky_match(cat, entries, id_col="source_id"))
        cat = calibrate_if_enough(cat.join(sky, "source_id", "left").withColumnRenamed("source_id", "record_id")).withColumnRenamed("record_id", "source_id").drop("z_spec", "z_spec_source", "z_spec_sep_arcsec")
    full = with_redshifts(cat, profile)
    if sky is not None:
        full = flag_catastrophic(apply_spectroscopic(full.join(sky, "source_id", "left")))
    full = cut(full)
    ok = clean(F.col("redshift")).isNotNull() & clean(F.col("r_half_arcsec")).isNotNull() & clean(F.col("r_half_arcsec_error")).isNotNull()
    filtered = q.quality_cascade(full.filter(ok))
    return {"full": full, "filtered": filtered, "fits": fit_comparison(spark, filtered)}


def bands_from_images(spark: SparkSession, root: str, mode: str = "full", profile: Profile | None = None, mask: DataFrame | None = None, gain: float | None = None, matched: bool = True) -> DataFrame:
    """``band_catalog`` rows of the images of a mode under ``root``; the profile sets the detection threshold. ``mask``: set pixels ``x, y``, the same in every band. An image that cannot be read raises."""
    files = band_files(spark, mode, root).filter("kind = 'science'").collect()
    band = F.create_map(*[x for f in files for x in (F.lit(f["path"].rsplit("/", 1)[-1]), F.lit(f["band"]))])
    px = tile_pixels(read_tiles(spark, [f["path"] for f in files])).withColumn("image", band[F.col("image")])
    if mode == "chip3":
        px = trimmed_chip(px)
    px = cut(px)
    last = px.agg(F.max("x"), F.max("y")).first()
    if last[0] is None:
        raise ValueError(f"no pixels under {root}")
    masked = mask.select("x", "y", F.explode(F.array(*[F.lit(f["band"]) for f in files])).alias("image")) if mask is not None else None
    return band_catalog(px, last[0] + 1, last[1] + 1, detection_sigma=(profile or choose()).detection_sigma, gain=gain, mask=masked, matched=matched)


def main(argv: list[str] | None = None) -> None:
    """Command line: images, or a Parquet table of per-band sources, in; catalogs, fits and the relations behind the figures out."""
    p = argparse.ArgumentParser(prog="skyloom")
    p.add_argument("source", help="Parquet table of per-band sources; with --images the folder of the images")
    p.add_argument("out")
    p.add_argument("--images", action="store_true", help="detect the sources in images first")
    p.add_argument("--mask", help="Parquet table of masked pixels: x, y; with --images")
    p.add_argument("--backend", choices=["matched", "smoothed"], default="matched", help="signal to noise of a matched filter, or smoothed pixels, against the threshold")
    p.add_argument("--mode", choices=["full", "chip3", "both"], default="full")
    p.add_argument("--subdir", help="of the output folder")
    p.add_argument("--relations", action="store_true", help="write every relation behind the figures, too")
    p.add_argument("--resource-profile", choices=["low", "medium", "high"])
    p.add_argument("--centres", help="Parquet table of star-mask centres: grp, x, y")
    p.add_argument("--entries", help="Parquet table of redshift entries: entry_id, list, list_order, ra, dec, z_spec; with --positions")
    p.add_argument("--positions", help="Parquet table of sky positions: source_id, ra, dec; with --entries")
    p.add_argument("--width", type=float, help="of the image, in pixels; with --height")
    p.add_argument("--height", type=float)
    a = p.parse_args(argv)
    if (a.entries is None) != (a.positions is None) or (a.width is None) != (a.height is None):
        p.error("--entries and --positions, --width and --height go together")
    spark = SparkSession.builder.getOrCreate()
    memory, cores = resources(spark)
    profile = choose(a.resource_profile, memory, cores)
    print(summary(spark))
    more = {k: spark.read.parquet(v) for k in ("centres", "entries", "positions") if (v := getattr(a, k))}
    mask = spark.read.parquet(a.mask) if a.mask else None
    out = f"{a.out}/{a.subdir}" if a.subdir else a.out
    for mode in ["full", "chip3"] if a.mode == "both" else [a.mode]:
        if a.images:
            part = bands_from_images(spark, a.source, mode, profile, mask, matched=a.backend == "matched")
            part.write.mode("overwrite").parquet(f"{out}/{mode}/bands")
            part = spark.read.parquet(f"{out}/{mode}/bands").withColumns({c: F.current_timestamp() for c in ("detected_at", "loaded_at")})
        else:
            src = spark.read.parquet(a.source)
            part = src if mode == "full" else box_extract(src.withColumns({"in_star_mask": F.lit(False), "quality_flag": F.lit(0)}), *CHIP_BOX).drop("in_star_mask", "quality_flag", "is_star", "is_galaxy")
        found = run(spark, part, profile, **more, width=a.width, height=a.height)
        for name, df in found.items():
            df.write.mode("overwrite").parquet(f"{out}/{mode}/{name}")
        if a.relations:
            for name, df in all_relations(spark, found["filtered"]).items():
                df.write.mode("overwrite").parquet(f"{out}/{mode}/relations/{name}")


if __name__ == "__main__":
    main()
