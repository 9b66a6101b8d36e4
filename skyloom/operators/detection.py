"""From pixels to band catalogs: detection against an error map, photometry and shapes, composed of the raster operators.

Pixels are rows ``(image, x, y, v)``; one run measures all images (bands) at once. Tables that a step reads more than once are materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.constants import PIXEL_SCALE, PSF_FWHM_PIX, REFERENCE_BAND
from skyloom.functions.photometry import adaptive_min_pixels, concentration_ratio, ellipticity, moment_fwhm, radius_error, sane_ellipse, snr
from skyloom.operators import raster
from skyloom.session import cut

#: Distance (pixels) within which curves of growth take sub-samples of a pixel; farther out its middle decides.
FINE = 6.0
#: Axes up to this are those of a line, whose width is rounding.
THIN = 1e-6


def measured_pixels(px: DataFrame, *, box: int = 64, filter_size: int = 3, gain: float | None = None, weights: DataFrame | None = None, mask: DataFrame | None = None, exclude_percentile: float | None = None) -> DataFrame:
    """``(image, x, y, v, back, rms, err, bad)``: pixels less their background, with their error.

    The variance is that of the background, or the inverse of ``weights`` (``image, x, y, v``) where given, and with ``gain`` the photon noise of what is above the background.
    Pixels of ``mask`` (``image, x, y``), without a positive weight, or without a value are ``bad``: they take no part in the background.
    """
    p = px.select("image", "x", "y", "v").withColumn("bad", F.col("v").isNull() | F.isnan("v"))
    if mask is not None:
        m = mask.select("image", "x", "y").distinct().withColumn("_m", F.lit(True))
        p = p.join(m, ["image", "x", "y"], "left").withColumn("bad", F.col("bad") | F.coalesce("_m", F.lit(False))).drop("_m")
    if weights is not None:
        w = weights.select("image", "x", "y", F.col("v").alias("w"))
        p = p.join(w, ["image", "x", "y"], "left").withColumn("bad", F.col("bad") | ~F.coalesce(F.col("w") > 0, F.lit(False)))
    p = cut(p)
    sub = raster.subtract_background(p, raster.background_mesh(p.filter("not bad"), box, filter_size=filter_size, exclude_percentile=exclude_percentile), box)
    var = F.when(F.col("w") > 0, 1.0 / F.when(F.col("w") > 0, F.col("w"))) if weights is not None else F.col("rms") * F.col("rms")
    if gain and gain > 0:
        var = var + F.greatest(F.col("v"), F.lit(0.0)) / gain
    return sub.select("image", "x", "y", "v", "back", "rms", F.sqrt(var).alias("err"), "bad")


def matched_snr(p: DataFrame, kernel: list[list[float]] | None = None) -> DataFrame:
    """``(image, x, y, s)``: signal to noise of the matched filter at every good pixel, from the good pixels around it."""
    kernel = kernel or raster.KERNEL
    total, half = sum(map(sum, kernel)), len(kernel) // 2
    to = F.array(*[F.struct(F.lit(j - half).alias("dx"), F.lit(i - half).alias("dy"), F.lit(k / total).alias("k")) for i, r in enumerate(kernel) for j, k in enumerate(r)])
    good = p.filter(~F.col("bad") & (F.col("err") > 0))
    s = good.select("image", "x", "y", (F.col("v") / (F.col("err") * F.col("err"))).alias("a"), (1.0 / (F.col("err") * F.col("err"))).alias("b"), F.inline(to))
    g = s.groupBy("image", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).agg(F.sum(F.col("a") * F.col("k")).alias("a"), F.sum(F.col("b") * F.col("k") * F.col("k")).alias("b"))
    return g.join(good.select("image", "x", "y"), ["image", "x", "y"], "left_semi").select("image", "x", "y", (F.col("a") / F.sqrt("b")).alias("s"))


def segments(p: DataFrame, threshold: float = 1.5, min_pixels: int = 5, kernel: list[list[float]] | None = None, levels: int = 32, contrast: float = 0.005, matched: bool = True) -> DataFrame:
    """``(image, x, y, v, label)`` of the pixels above the threshold, in 8-connected segments of ``min_pixels`` or more, deblended unless ``levels`` is 0; ``label`` is the segment's smallest pixel code, or a hash of it and the part.

    ``matched`` compares the filter's signal to noise with the threshold; else smoothed pixels are compared with so many deviations of the background.
    """
    if matched:
        hot = p.join(matched_snr(p, kernel).filter(F.col("s") > threshold), ["image", "x", "y"])
    else:
        smooth = raster.convolve(p.filter("not bad").select("image", "x", "y", "v"), kernel)
        hot = p.join(smooth.select("image", "x", "y", F.col("v").alias("s")), ["image", "x", "y"]).filter(F.col("s") > threshold * F.col("rms"))
    lab = raster.label_components(hot.select("image", "x", "y", "v"), min_pixels)
    if not levels:
        return lab
    parts = raster.deblend(lab, levels, contrast, min_pixels)
    split = F.max("part").over(W.partitionBy("image", "label")) > 0
    return parts.withColumn("_split", split).select("image", "x", "y", "v", F.when(F.col("_split"), F.xxhash64("label", "part")).otherwise(F.col("label")).alias("label"))


def detect(px: DataFrame, threshold: float = 1.5, *, min_pixels: int = 5, box: int = 64, filter_size: int = 3, gain: float | None = None, weights: DataFrame | None = None, mask: DataFrame | None = None,
           kernel: list[list[float]] | None = None, levels: int = 32, contrast: float = 0.005, matched: bool = True) -> DataFrame:
    """Isophotal measures (``raster.moments``) of the sources of every image; no sources give no rows."""
    p = cut(measured_pixels(px, box=box, filter_size=filter_size, gain=gain, weights=weights, mask=mask))
    return raster.moments(segments(p, threshold, min_pixels, kernel, levels, contrast, matched))


def light_radii(sources: DataFrame, p: DataFrame, fractions: list[float], max_radius: float = 50.0, n: int = 50) -> DataFrame:
    """``(image, id, r_<percent>)``: radii of the curve of growth (``n`` circles up to ``max_radius``) that enclose fractions of ``total``. ``sources``: ``image, id, cx, cy, total``.

    Every pixel adds to the first circle that holds it; within ``FINE`` pixels of the centre its sub-samples do, each on its own. One aggregation by source and circle.
    """
    step = max_radius / n
    j = raster.pixels_within(sources.select("image", "id", "cx", "cy").withColumn("reach", F.lit(max_radius + 1.0)), p.filter("not bad").select("image", "x", "y", "v"))
    k = raster.SUBPIX
    subs = [((i + 0.5) / k - 0.5, (m + 0.5) / k - 0.5) for i in range(k) for m in range(k)]
    d = lambda a, b: F.sqrt((F.col("x") + a - F.col("cx")) * (F.col("x") + a - F.col("cx")) + (F.col("y") + b - F.col("cy")) * (F.col("y") + b - F.col("cy")))
    one = lambda a, b, w: F.struct(F.greatest(F.ceil(d(a, b) / step), F.lit(1)).cast("int").alias("ring"), F.lit(w).alias("w"))
    spread = F.when(d(0.0, 0.0) <= FINE, F.array(*[one(a, b, 1.0 / len(subs)) for a, b in subs])).otherwise(F.array(one(0.0, 0.0, 1.0)))
    rings = j.select("image", "id", "v", F.inline(spread)).filter(F.col("ring") <= n).groupBy("image", "id", "ring").agg(F.sum(F.col("v") * F.col("w")).alias("f"))
    upto = W.partitionBy("image", "id").orderBy("ring").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = rings.select("image", "id", (F.col("ring") * step).alias("r"), F.sum("f").over(upto).alias("flux"))
    out = sources.select("image", "id")
    for f in fractions:
        out = out.join(raster.growth_radius(sums, sources.select("image", "id", "total"), f).withColumnRenamed("radius", f"r_{round(100 * f)}"), ["image", "id"], "left")
    return out


def detect_and_measure(px: DataFrame, threshold: float = 1.5, *, min_pixels: int = 5, box: int = 64, filter_size: int = 3, gain: float | None = 7.0, weights: DataFrame | None = None, mask: DataFrame | None = None, kernel: list[list[float]] | None = None,
                       levels: int = 32, contrast: float = 0.005, radii: list[float] | None = None, kron: bool = True, half_light: bool = True, pixel_scale: float = PIXEL_SCALE, drop_masked: bool = False, matched: bool = True, local: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalog, the measured pixels and the labelled pixels of all images.

    Catalog: isophotal measures, apertures (``radii``), with ``kron`` Kron radius, flux, error and flags, with ``half_light`` also the radii of half and nine tenths of that flux, shape columns, and
    sizes in arcsec. ``id`` is the segment's label. ``drop_masked`` leaves out segments that touch a masked pixel. ``local`` is that of ``raster.moments``.
    """
    p = cut(measured_pixels(px, box=box, filter_size=filter_size, gain=gain, weights=weights, mask=mask))
    lab = segments(p, threshold, min_pixels, kernel, levels, contrast, matched)
    if drop_masked and mask is not None:
        lab = raster.without_masked(lab, mask)
    lab = cut(lab)
    m = raster.moments(lab, local)
    axis = lambda c: F.when(F.col(c) > THIN, F.col(c)).otherwise(0.0)
    a, b, theta = sane_ellipse(axis("a"), axis("b"), F.col("theta"))
    cat = cut(m.withColumnsRenamed({"label": "id", "x": "xcentroid", "y": "ycentroid"}).filter("xcentroid is not null and ycentroid is not null"))
    src = cat.select("image", "id", F.col("xcentroid").alias("cx"), F.col("ycentroid").alias("cy"), a.alias("a"), b.alias("b"), theta.alias("theta"))
    on = ["image", "id"]
    out = cat
    if kron:
        k = cut(raster.kron_photometry(src, p))
        out = out.join(k, on, "left")
        if half_light:
            out = out.join(light_radii(src.join(k.select(*on, F.col("flux_auto").alias("total")), on), p, [0.5, 0.9]), on, "left").withColumnsRenamed({"r_50": "r_half", "r_90": "r_90"})
    out = out.join(raster.wide_apertures(raster.aperture_sums(src, p, radii), radii), on, "left")
    out = out.withColumns({"ellipticity": ellipticity(F.col("a"), F.col("b")), "fwhm": moment_fwhm(F.col("a"), F.col("b"))})
    arcsec = {"a": "a_arcsec", "b": "b_arcsec", "fwhm": "fwhm_arcsec"} | ({"r_half": "r_half_arcsec"} if kron and half_light else {})
    return out.withColumns({n: F.col(c) * pixel_scale for c, n in arcsec.items()}), p, lab


def segment_shapes(lab: DataFrame, size: int = 129) -> DataFrame:
    """``(image, id, gini, m20, asymmetry, smoothness, rhalf_ellip, shape_flag)`` of segments: their own pixels, in coordinates about the centre of light.

    ``rhalf_ellip`` is the semi-major axis of the segment's ellipse that holds half of its light. ``shape_flag`` is 1 where a measure is missing (no light, or a line of pixels), else 0.
    """
    key = F.struct("image", "label")
    m = raster.moments(lab)
    a, b, theta = sane_ellipse(F.when(F.col("a") > THIN, F.col("a")), F.when(F.col("b") > THIN, F.col("b")), F.col("theta"))
    c = m.select("image", "label", F.col("x").alias("cx"), F.col("y").alias("cy"), a.alias("a"), b.alias("b"), theta.alias("theta"), F.col("flux").alias("total"))
    h = size // 2
    j = cut(lab.join(c, ["image", "label"]).withColumn("key", key))
    px = j.select(F.col("key").alias("image"), (F.col("x") - F.round("cx") + h).cast("int").alias("x"), (F.col("y") - F.round("cy") + h).cast("int").alias("y"), "v")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    u, v = dx * F.cos("theta") + dy * F.sin("theta"), (dy * F.cos("theta") - dx * F.sin("theta")) * F.col("a") / F.col("b")
    upto = W.partitionBy("key").orderBy("er", "y", "x").rowsBetween(W.unboundedPreceding, W.currentRow)
    grown = j.withColumn("er", F.sqrt(u * u + v * v)).withColumn("run", F.sum("v").over(upto))
    half = grown.filter((F.col("total") > 0) & (F.col("run") >= 0.5 * F.col("total"))).groupBy(F.col("key").alias("image")).agg(F.min("er").alias("rhalf_ellip"))
    out = px.select("image").distinct()
    for t in (raster.gini(px), raster.m20(px), raster.asymmetry(px, size, size), raster.smoothness(px), half):
        out = out.join(t, "image", "left")
    missing = F.col("gini").isNull() | F.col("m20").isNull() | F.col("rhalf_ellip").isNull()
    return out.select("image.image", F.col("image.label").alias("id"), "gini", "m20", "asymmetry", "smoothness", "rhalf_ellip", F.when(missing, 1).otherwise(0).alias("shape_flag"))


def source_id(image: Column, label: Column) -> Column:
    """A key of sources over all images."""
    return F.xxhash64(image, label)


def band_catalog(px: DataFrame, width: int, height: int, *, detection_sigma: float = 1.5, gain: float | None = None, weights: DataFrame | None = None, mask: DataFrame | None = None, field: Column | None = None, base_pixels: int = 12, levels: int = 32, contrast: float = 0.01,
                 reference: str = REFERENCE_BAND, cutout: int = 64, box: int | None = None, matched: bool = True) -> DataFrame:
    """The rows of ``band_catalog`` from the images of all bands; ``image`` is the band.

    The least number of pixels follows from the height, the box of the background too unless given; the kernel is a Gaussian of the point-spread function's width. Segments that touch the mask are left out. The reference band also has
    structural measures: ``statmorph_flag`` is 1 where no profile could be fitted (a cutout over the edge, too little light), else 0.
    """
    kernel = raster.gaussian_kernel(max(PSF_FWHM_PIX, 2.0), 5)
    m, p, lab = detect_and_measure(px, detection_sigma, min_pixels=max(1, adaptive_min_pixels(height, base_pixels)), box=box or raster.box_size(height), filter_size=5, gain=gain, weights=weights, mask=mask, kernel=kernel, levels=levels, contrast=contrast, drop_masked=mask is not None, matched=matched)
    one = F.col("image") == reference
    shape = segment_shapes(lab.filter(one))
    centres = m.filter(one).select("image", "id", F.col("xcentroid").alias("cx"), F.col("ycentroid").alias("cy"))
    fit = raster.cutout_morphology(raster.cutouts(centres, p.filter("not bad").filter(one).select("image", "x", "y", "v"), width, height, cutout), cutout).select("image", "id", "sersic_n")
    m = m.join(shape, ["image", "id"], "left").join(fit, ["image", "id"], "left")
    flux, err, r = F.col("flux_auto"), F.col("flux_auto_err"), F.col("r_half")
    return m.select(
        source_id(F.col("image"), F.col("id")).alias("source_id"), F.col("image").alias("band"), (field if field is not None else F.lit("image")).alias("field_id"), "xcentroid", "ycentroid", flux.alias("source_sky"), err.alias("source_error"),
        r.alias("r_half_pix"), radius_error(r, flux, err).alias("r_half_pix_error"), F.col("r_90").alias("r_90_pix"), concentration_ratio(r, F.col("r_90")).alias("concentration"), snr(flux, err).alias("snr"), "ellipticity",
        "gini", "m20", "sersic_n", "asymmetry", "smoothness", F.when(one, F.when(F.col("sersic_n").isNull(), 1).otherwise(0)).cast("int").alias("statmorph_flag"),
    )
