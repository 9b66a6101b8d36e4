"""Nearest-neighbour joins in pixel and sky coordinates, and the assembly of per-band sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.constants import MATCH_RADIUS_ARCSEC, MATCH_RADIUS_PIX, MIN_BANDS, OTHER_BANDS, REFERENCE_BAND, STAR_RADIUS_PIX
from skyloom.functions.labels import bands_matched
from skyloom.functions.photometry import clean, psf_corrected_radius, stellarity
from skyloom.operators.robust import array_median, combined_radius_error
from skyloom.operators.spatial import near_pairs

MEASURES = ["source_sky", "source_error", "r_half_pix", "r_half_pix_error", "concentration", "ellipticity", "snr"]


def _cells(df: DataFrame, r: float, spread: bool) -> DataFrame:
    """Grid cells of size ``r``; with ``spread`` also the eight around, so that a plain equi-join finds all within ``r``."""
    cx, cy = F.floor(F.col("x") / r), F.floor(F.col("y") / r)
    if not spread:
        return df.withColumns({"cx": cx, "cy": cy})
    near = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_c", F.explode(near)).select("*", "_c.cx", "_c.cy").drop("_c")


def once(sources: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Each ``source_id`` once (the row loaded last), with a usable position; only what matching and assembly use, or ``cols``."""
    cols = list(dict.fromkeys(["xcentroid", "ycentroid", *(cols if cols is not None else ["band", "field_id", *MEASURES])]))
    s = sources.groupBy("source_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", "detected_at")).alias("s")).select("source_id", "s.*")
    return s.filter(clean(F.col("xcentroid")).isNotNull() & clean(F.col("ycentroid")).isNotNull())


def nearest_pixel(left: DataFrame, right: DataFrame, radius: float = MATCH_RADIUS_PIX) -> DataFrame:
    """``(id, part, near_id, dist)``: for each left row and each ``part`` of the right the nearest right row closer than ``radius``, ties to the smallest id.

    Both sides have ``id, grp, x, y``, the right also ``part``. Only rows of equal ``grp`` meet. The equi-join is on grid
    cells of the radius and the minimum has a map-side step; skewed cells are left to adaptive execution.
    """
    a = _cells(left.select("id", "grp", "x", "y"), radius, True)
    b = _cells(right.select(F.col("id").alias("near_id"), "grp", "part", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("x"), F.col("y")), radius, False).drop("x", "y")
    d = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
    j = a.join(b, ["grp", "cx", "cy"]).withColumn("d", d).filter(F.col("d") < radius)
    return j.groupBy("id", "part").agg(F.min(F.struct("d", "near_id")).alias("m")).select("id", "part", F.col("m.near_id").alias("near_id"), F.col("m.d").alias("dist"))


def cross_band(sources: DataFrame, radius: float = MATCH_RADIUS_PIX) -> DataFrame:
    """Matches of every reference-band source in the other bands of its field; a target may serve several sources."""
    s = sources.select(F.col("source_id").alias("id"), F.col("field_id").alias("grp"), F.col("band").alias("part"), F.col("xcentroid").alias("x"), F.col("ycentroid").alias("y"))
    return nearest_pixel(s.filter(F.col("part") == REFERENCE_BAND), s.filter(F.col("part").isin(*OTHER_BANDS)), radius)


def assemble(sources: DataFrame, matches: DataFrame, min_bands: int = MIN_BANDS) -> DataFrame:
    """One row per reference source seen in ``min_bands`` bands or more: fluxes and errors by band, medians over the bands, derived sizes and scores."""
    keep = F.struct(*[clean(F.col(c)).alias(c) for c in MEASURES])
    values = sources.select(F.col("source_id").alias("near_id"), keep.alias("m"))
    joined = matches.join(values, "near_id")
    wide = joined.groupBy("id").agg(*[F.max(F.when(F.col("part") == b, F.col("m"))).alias(b) for b in OTHER_BANDS])
    ref = sources.filter(F.col("band") == REFERENCE_BAND).select(F.col("source_id").alias("id"), "field_id", "xcentroid", "ycentroid", keep.alias(REFERENCE_BAND))
    w = ref.join(wide, "id", "left")
    bands = [REFERENCE_BAND, *OTHER_BANDS]
    n = F.lit(1) + sum(F.col(b).isNotNull().cast("int") for b in OTHER_BANDS)
    w = w.withColumn("n_bands", n).filter(F.col("n_bands") >= min_bands)
    over = lambda c: F.array(*[F.col(b)[c] for b in bands])
    out = w.select(
        F.col("id").alias("source_id"), "field_id", "xcentroid", "ycentroid", "n_bands", bands_matched({b: F.col(b).isNotNull() for b in OTHER_BANDS}).alias("bands_matched"),
        *[F.col(b)["source_sky"].alias(f"source_sky_{b}") for b in bands], *[F.col(b)["source_error"].alias(f"source_error_{b}") for b in bands],
        array_median(over("r_half_pix")).alias("r_half_pix"), combined_radius_error(over("r_half_pix"), over("r_half_pix_error")).alias("r_half_pix_error"),
        array_median(over("concentration")).alias("concentration"), array_median(over("ellipticity")).alias("ellipticity"), array_median(over("snr")).alias("snr_median"), F.array_min(over("snr")).alias("snr_min"),
    )
    return out.withColumns({"r_half_pix_corrected": psf_corrected_radius(F.col("r_half_pix")), "stellarity": stellarity(F.col("r_half_pix"), F.col("concentration"), F.col("ellipticity"))})


def sky_match(catalog: DataFrame, entries: DataFrame, radius_arcsec: float = MATCH_RADIUS_ARCSEC, id_col: str = "record_id") -> DataFrame:
    """``(id, z_spec, z_spec_source, z_spec_sep_arcsec)`` of the nearest entry within the radius over all lists.

    ``entries``: ``entry_id, list, list_order, ra, dec, z_spec``. At equal separation the earlier list wins, then the smaller id.
    """
    near = near_pairs(catalog, radius_arcsec, entries, id_col=id_col, right_id="entry_id")
    e = entries.select(F.col("entry_id").alias("id_b"), "list", "list_order", "z_spec")
    best = F.min(F.struct("sep_arcsec", "list_order", "id_b", "list", "z_spec"))
    return near.join(e, "id_b").groupBy(F.col("id_a").alias(id_col)).agg(best.alias("b")).select(id_col, F.col("b.z_spec").alias("z_spec"), F.col("b.list").alias("z_spec_source"), F.col("b.sep_arcsec").alias("z_spec_sep_arcsec"))


def mask_lookup(sources: DataFrame, mask: DataFrame, x: str = "xcentroid", y: str = "ycentroid", group: str = "field_id") -> DataFrame:
    """``sources`` with ``in_mask``: whether the pixel that a position rounds to (half to even) is set. ``mask``: ``group, mx, my``; repeated pixels count once."""
    m = mask.select(group, "mx", "my").distinct().withColumn("in_mask", F.lit(True))
    s = sources.withColumns({"mx": F.bround(x).cast("long"), "my": F.bround(y).cast("long")})
    return s.join(m, [group, "mx", "my"], "left").withColumn("in_mask", F.coalesce("in_mask", F.lit(False))).drop("mx", "my")


def near_centres(sources: DataFrame, centres: DataFrame, radius: float = STAR_RADIUS_PIX, id_col: str = "source_id") -> DataFrame:
    """Ids of sources closer than ``radius`` pixels to any centre of their group. Both sides: ``grp, x, y``; a semi join on grid cells of the radius."""
    a = _cells(sources.select(F.col(id_col).alias("id"), "grp", "x", "y"), radius, True)
    b = _cells(centres.select("grp", "x", "y"), radius, False).select(F.col("grp").alias("g2"), F.col("cx").alias("cx2"), F.col("cy").alias("cy2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    close = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) < radius * radius
    return a.join(b, (F.col("grp") == F.col("g2")) & (F.col("cx") == F.col("cx2")) & (F.col("cy") == F.col("cy2")) & close, "left_semi").select(F.col("id").alias(id_col)).distinct()
