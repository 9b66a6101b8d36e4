"""Template fits and raster operators against plain NumPy, and the image reader."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import calibration, detection, matching, photoz, raster
from skyloom.operators.templates import ModelGrid, model_grid, synthetic
from skyloom.sources import catalogs, fits


@pytest.fixture(scope="module")
def grid():
    return model_grid(0.2, av=[0.0, 0.6])


def slow_fit(flux, err, g):
    """One object, straight from the definition."""
    ok = np.isfinite(flux) & (flux > 0) & np.isfinite(err) & (err > 0)
    f, e = flux[ok], err[ok]
    e2 = e**2 + 2 * (0.05 * f) ** 2
    med = np.median(f)
    m = g.flux[..., ok]
    s = m / np.where(np.median(m, axis=-1) == 0, 1, np.median(m, axis=-1))[..., None]
    chi = np.where(m.sum(-1) > 0, ((f / med - s) ** 2 * med**2 / e2).sum(-1), 1e30)
    p = np.exp(-(chi - chi.min()) / 2).sum((0, 1))
    p /= np.trapezoid(p, g.z)
    return np.unravel_index(chi.argmin(), chi.shape), chi, p


def test_fits_match_the_definition(grid):
    rng = np.random.default_rng(0)
    flux = rng.lognormal(0, 0.5, (40, 4))
    flux[::5, 0] = np.nan
    err = 0.1 * np.abs(flux)
    got = photoz.fit_photometry(flux, err, grid)
    for i in range(40):
        (t, a, z), chi, p = slow_fit(flux[i], err[i], grid)
        assert got["galaxy_type"][i] == grid.templates[t] and got["redshift"][i] == grid.z[z] and got["best_a_v"][i] == grid.av[a]
        assert got["chi_sq_min"][i] == pytest.approx(chi.min(), rel=1e-6)
        inside = np.abs(grid.z - grid.z[z]) <= 0.1 * (1 + grid.z[z])
        inside = (grid.z >= grid.z[z] - 0.1 * (1 + grid.z[z])) & (grid.z <= grid.z[z] + 0.1 * (1 + grid.z[z]))
        assert got["odds"][i] == pytest.approx(np.trapezoid(p[inside], grid.z[inside]), rel=1e-6)
    assert (got["z_lo"] <= got["z_pdf_median"]).all() and (got["z_pdf_median"] <= got["z_hi"]).all()


def test_failure_row(grid):
    got = photoz.fit_photometry(np.array([[1.0, np.nan, -1.0, 0.0]]), np.full((1, 4), 0.1), grid)
    assert got["galaxy_type"][0] == "unknown" and got["chi_sq_min"][0] == 1e30 and got["odds"][0] == 0 and got["n_valid_bands"][0] == 1


def test_relational_form_agrees(spark, grid):
    rng = np.random.default_rng(1)
    flux = rng.lognormal(0, 0.5, (10, 4))
    rows = spark.createDataFrame([(i, f.tolist(), (0.1 * f).tolist()) for i, f in enumerate(flux)], "id long, flux array<double>, err array<double>")
    g = spark.createDataFrame([(t, a, z, grid.flux[t, a, z].tolist()) for t in range(10) for a in range(2) for z in range(len(grid.z))], "t int, a int, zi int, m array<double>")
    best = photoz.best_model(photoz.chi2_rows(rows, g)).orderBy("id").toPandas()
    want = photoz.fit_photometry(flux, 0.1 * flux, grid)
    assert [grid.templates[t] for t in best.t] == list(want["galaxy_type"]) and np.allclose(grid.z[best.zi], want["redshift"]) and np.allclose(best.chi2, want["chi_sq_min"])


def test_embedding_query_keeps_all_components(spark, tmp_path):
    from skyloom.plans import registry

    good, nan = [float(i) for i in range(8)], float("nan")
    rows = [(1, good), (2, good[:7]), (3, good[:7] + [nan]), (4, None), (5, good + [9.0]), (6, [float("-inf")] + good[1:]), (7, good[:7] + [None])]
    spark.createDataFrame(rows, "emb_id long, embeddings array<float>").write.parquet(f"{tmp_path}/zoobot_embedding.parquet")
    got = registry.queries()["q_embedding_columns_full"](spark, str(tmp_path)).orderBy("emb_id").collect()
    assert [tuple(r) for r in got] == [(1, *good), (5, *good)]


def test_full_grid_queries_agree_with_the_relational_form(spark, tmp_path):
    from skyloom.plans import registry

    q, g = registry.queries(), model_grid()
    rng = np.random.default_rng(4)
    flux = rng.lognormal(0, 0.5, (6, 4))
    flux[4, 0], flux[5, 1:] = np.nan, np.nan  # three bands; one band only, in no result
    pdf = pd.DataFrame(np.hstack([flux, 0.1 * flux]), columns=[f"{k}_{b}" for k in ("flux", "error") for b in ("f300", "f450", "f606", "f814")]).assign(record_id=range(6))
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/galaxy_catalog.parquet")
    get = lambda n, *k: q[n](spark, str(tmp_path)).orderBy(*k).toPandas()
    models = get("q_model_grid_full", "t", "a", "zi")
    assert len(models) == 10 * 9 * 199 == g.flux.size // 4 and np.allclose(models[list("ubvi")], g.flux.reshape(-1, 4), atol=1e-9)
    rows = [(i, f.tolist(), (0.1 * f).tolist()) for i, f in enumerate(flux)]
    grid_rows = [(t, a, z, g.flux[t, a, z].tolist()) for t in range(10) for a in range(9) for z in range(199)]
    chi = photoz.chi2_rows(spark.createDataFrame(rows, "id long, flux array<double>, err array<double>"), spark.createDataFrame(grid_rows, "t int, a int, zi int, m array<double>")).cache()
    best, got = photoz.best_model(chi).orderBy("id").toPandas(), get("q_photoz_argmin_full", "id")
    assert list(got.id) == [0, 1, 2, 3, 4] and [g.templates[t] for t in best.t] == list(got.galaxy_type)
    assert np.allclose(g.av[best.a], got.best_a_v) and np.allclose(g.z[best.zi], got.redshift) and np.allclose(best.chi2, got.chi2, atol=1e-5)
    second, got = photoz.second_template(chi).orderBy("id").toPandas(), get("q_photoz_second_best_full", "id")
    assert [g.templates[t] for t in second.t2] == list(got.second_best_template) and np.allclose(second.ambiguity, got.ambiguity, atol=1e-5)
    rel = photoz.pdf_rows(chi, 0.05, g.z[1] - g.z[0])
    want, got = rel.orderBy("id", "zi").toPandas(), get("q_photoz_pdf_full", "id", "zi")
    assert len(got) == 5 * 199 and (got[["id", "zi"]].values == want[["id", "zi"]].values).all() and np.allclose(got[["p", "cdf"]], want[["p", "cdf"]], atol=2e-6)
    want, got = photoz.pdf_quantile(rel, 0.5, "m").orderBy("id").toPandas(), get("q_photoz_quantiles_full", "id")
    assert np.allclose(want.m, got.z_median, atol=2e-5)
    chi.unpersist()


def test_band_means_match_sums():
    w = np.arange(1000.0, 10000.0, 10.0)
    f = np.sin(w / 500) + 2
    got = synthetic(w, f, np.array([0.3]), with_igm=False)[0, 1]
    inside = (w >= (4556 - 789 / 2) / 1.3) & (w <= (4556 + 789 / 2) / 1.3)
    assert got == pytest.approx(f[inside].mean())


def test_two_peaks():
    z = np.arange(0.05, 4.0, 0.02)
    p = np.exp(-((z - 0.5) ** 2) / 0.002) + 0.4 * np.exp(-((z - 2.5) ** 2) / 0.002)
    z2, odds = photoz.secondary_peak(z, p[None] / np.trapezoid(p, z), np.array([0.5]))
    assert z2[0] == pytest.approx(2.5, abs=0.02) and odds[0] == pytest.approx(0.4 / 1.4, abs=0.02)
    z2, _ = photoz.secondary_peak(z, np.exp(-((z - 0.5) ** 2) / 0.002)[None], np.array([0.5]))
    assert np.isnan(z2[0])


def test_zeropoints_recover_a_planted_offset(spark):
    from skyloom.operators.templates import load_spectrum

    rng = np.random.default_rng(0)
    w, f = load_spectrum(None, "Sb")
    zs = rng.uniform(0.1, 1.0, 60)
    m = calibration.band_means(zs, w, f) * rng.lognormal(0, 0.5, (60, 1))
    pdf = pd.DataFrame(m, columns=["flux_f300", "flux_f450", "flux_f606", "flux_f814"]).assign(record_id=range(60), z_spec=zs)
    got = {r["band"]: r for r in calibration.zeropoint_offsets(spark.createDataFrame(pdf)).collect()}
    assert all(abs(r["offset_mag"]) < 1e-6 and r["n_cal"] == 60 and r["converged"] for r in got.values())
    few = {r["band"]: r for r in calibration.zeropoint_offsets(spark.createDataFrame(pdf.head(3))).collect()}
    assert not few["U"]["converged"] and few["U"]["flux_scale"] == 1.0


def image(spark, a, name=1):
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"image": name, "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), "v": a.ravel().astype(float)}))


def test_labels_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(raster, "TILE", 7)
    rng = np.random.default_rng(5)
    a = rng.uniform(size=(40, 40))
    on = a > 0.62
    got = raster.label_components(image(spark, a).filter("v > 0.62")).toPandas()
    y, x = np.nonzero(on)
    want = raster._components(x, y)
    lab = {(r.x, r.y): r.label for r in got.itertuples()}
    assert len(got) == on.sum()
    mine = pd.Series([lab[p] for p in zip(x, y)])
    assert mine.nunique() == len(np.unique(want)) and pd.Series(want).groupby(mine).nunique().max() == 1


def test_moments_of_a_gaussian(spark):
    y, x = np.mgrid[:41, :41]
    a = np.exp(-((x - 20) ** 2 / 18 + (y - 20) ** 2 / 8))
    m = raster.moments(image(spark, a).withColumn("label", F.lit(1))).first()
    assert (m["x"], m["y"]) == (pytest.approx(20), pytest.approx(20)) and m["a"] == pytest.approx(3, rel=0.01) and m["b"] == pytest.approx(2, rel=0.01) and (m["xpeak"], m["ypeak"]) == (20, 20)


def test_aperture_of_a_flat_image(spark):
    src = spark.createDataFrame([(1, 1, 20.0, 20.0)], "image int, id int, cx double, cy double")
    got = {r["r"]: r["flux"] for r in raster.aperture_sums(src, image(spark, np.ones((41, 41))), [3.0, 10.0]).collect()}
    assert got[3.0] == pytest.approx(np.pi * 9, rel=0.02) and got[10.0] == pytest.approx(np.pi * 100, rel=0.01)
    bkg = raster.local_photometry(src, image(spark, np.ones((41, 41))), 5.0, 8.0, 12.0).first()
    assert bkg["flux"] == pytest.approx(0, abs=1e-9)


def test_background_and_detection(spark):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:64, :64]
    a = 10 + rng.normal(0, 0.1, (64, 64)) + 5 * np.exp(-((x - 20) ** 2 + (y - 40) ** 2) / 8)
    got = detection.detect(image(spark, a), 3.0, min_pixels=5, box=32).toPandas().sort_values("flux")
    assert abs(got.iloc[-1].x - 20) < 0.3 and abs(got.iloc[-1].y - 40) < 0.3


def sky_image(shape=(96, 96), seed=3):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: shape[0], : shape[1]]
    star = lambda cx, cy, f, s: f * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s))
    return 10 + rng.normal(0, 0.1, shape) + star(30, 60, 8, 2.5) + star(60, 30, 6, 2.5) + star(72, 30, 5, 2.5) + star(93, 93, 8, 3.0)


def test_images_to_band_catalog(spark):
    a = sky_image()
    px = image(spark, a).withColumn("image", F.lit("f450"))
    px = px.unionByName(px.withColumns({"image": F.lit("f814"), "v": F.col("v") * 2}))
    mask = spark.createDataFrame([(b, x, y) for b in ("f450", "f814") for x in range(80, 96) for y in range(80, 96)], "image string, x int, y int")
    got = detection.band_catalog(px, 96, 96, detection_sigma=5.0, gain=1e6, mask=mask, base_pixels=60, box=32, cutout=32).toPandas().sort_values(["band", "xcentroid"])
    for b, k in (("f450", 1), ("f814", 2)):
        s = got[got.band == b]
        assert len(s) == 3  # the blend is split, the masked star is left out
        assert np.allclose(s.xcentroid, [30, 60, 72], atol=0.7) and np.allclose(s.ycentroid, [60, 30, 30], atol=0.7)
        assert s.source_sky.iloc[0] == pytest.approx(k * 8 * 2 * np.pi * 2.5**2, rel=0.1)
        assert s.r_half_pix.iloc[0] == pytest.approx(2.5 * 1.1774, rel=0.1) and s.r_90_pix.iloc[0] > s.r_half_pix.iloc[0] and (s.snr > 20).all()
    assert got[got.band == "f814"][["gini", "m20", "sersic_n", "statmorph_flag"]].isna().all().all() and got.source_id.is_unique
    ref = got[got.band == "f450"]
    assert ref.gini.between(0.2, 0.9).all() and ref.statmorph_flag.iloc[0] == 0
    assert detection.band_catalog(px.filter("v < 0"), 96, 96).count() == 0


def test_weights_gain_and_flags(spark):
    a = sky_image()
    px, w = image(spark, a), np.full(a.shape, 100.0)
    w[45:76, 15:46] = 0.0001  # the first star is hardly known
    w[15:46, 45:88] = 0.0  # the second has no weight
    got = detection.detect(px, 5.0, box=32, min_pixels=10, weights=image(spark, w), levels=0).toPandas()
    assert len(got) == 1 and got.x.min() > 85
    cat, p, _ = detection.detect_and_measure(px, 5.0, box=32, min_pixels=10, gain=2.0, levels=0)
    c = cat.toPandas().sort_values("xcentroid")
    assert {16, 0} == set(c.flag_auto) and c.flag_auto.iloc[-1] == 16 and c.flag_aper_10p0.iloc[-1] == 16
    e = p.filter("x = 30 and y = 60").first()
    assert e["err"] == pytest.approx(np.sqrt(e["rms"] ** 2 + e["v"] / 2.0))
    bad = spark.createDataFrame([(0, 31, 60)], "image int, x int, y int").withColumn("image", F.lit(px.first()["image"]))
    c = detection.detect_and_measure(px, 5.0, box=32, min_pixels=10, levels=0, mask=bad)[0].toPandas().sort_values("xcentroid")
    assert c.flag_auto.iloc[0] == 32 and c.flag_aper_2p0.iloc[0] == 32


def test_shapes_of_a_segment(spark):
    y, x = np.mgrid[:61, :61]
    a = np.exp(-((x - 30) ** 2 / 72 + (y - 30) ** 2 / 18))  # a Gaussian of 6 by 3
    got = detection.segment_shapes(image(spark, a).filter("v > 1e-4").withColumn("label", F.lit(5).cast("long"))).first()
    assert got["rhalf_ellip"] == pytest.approx(6 * 1.1774, rel=0.05) and got["asymmetry"] == pytest.approx(0, abs=1e-9) and got["shape_flag"] == 0


def test_lines_far_from_the_origin_have_no_width(spark):
    """Rows, columns and diagonals of pixels: what rounding leaves of squared positions must not be taken for a width."""
    steps = {1: (1, 0), 2: (0, 1), 3: (1, 1), 4: (1, -1)}
    light = [0.0137, 0.0311, 0.0523, 0.0191, 0.0079]
    rows = [(i, 9001 + 37 * i + k * dx, 8011 + 53 * i + k * dy, v * (1 + 0.17 * i), d) for d, (dx, dy) in steps.items() for i in range(20) for k, v in enumerate(light)]
    got = raster.moments(spark.createDataFrame(rows, "image int, x int, y int, v double, label long")).toPandas()
    assert len(got) == 80 and (got.b < 1e-12).all()
    k = np.average(range(5), weights=light)
    s = np.sqrt(np.average((np.arange(5) - k) ** 2, weights=light))
    for d, (dx, dy) in steps.items():
        g = got[got.label == d]
        assert np.allclose(g.a, s * np.hypot(dx, dy), rtol=1e-12) and np.allclose(g.x, 9001 + 37 * g.image + k * dx, rtol=1e-14) and np.allclose(g.y, 8011 + 53 * g.image + k * dy, rtol=1e-14)


def test_background_plan_does_not_grow_with_rounds(spark):
    a = np.random.default_rng(3).normal(10, 2, (32, 48))
    a[5:9, 5:9] = 500.0
    mesh = {n: raster.background_mesh(image(spark, a), 16, rounds=n, filter_size=1) for n in (1, 4)}
    joins = {n: m._jdf.queryExecution().optimizedPlan().toString().count("Join") for n, m in mesh.items()}
    assert joins[1] == joins[4] <= 1
    for r in mesh[4].collect():
        v = a[16 * r["by"] : 16 * r["by"] + 16, 16 * r["bx"] : 16 * r["bx"] + 16].ravel()
        for _ in range(4):
            v = v[np.abs(v - np.median(v)) <= 3 * v.std()]
        assert r["back"] == pytest.approx(np.median(v), abs=1e-12) and r["rms"] == pytest.approx(v.std(), abs=1e-9)
    assert mesh[4].count() == 6


def test_large_sources_lose_no_light(spark):
    """The reach follows the source: half of an ellipse of 60 pixels lies beyond any fixed cell."""
    y, x = np.mgrid[:400, :400]
    a = ((x - 200) ** 2 + (y - 200) ** 2 <= 150**2).astype(float)
    src = spark.createDataFrame([(1, 1, 200.0, 200.0, 60.0, 60.0, 0.0)], "image int, id int, cx double, cy double, a double, b double, theta double")
    k = raster.kron_photometry(src, image(spark, a).withColumn("image", F.lit(1))).first()
    assert k["flux_auto"] == pytest.approx(np.pi * 150**2, rel=0.01) and k["flag_auto"] == 16


def test_deblend_two_stars(spark):
    y, x = np.mgrid[:40, :40]
    a = np.exp(-((x - 14) ** 2 + (y - 20) ** 2) / 10) + 0.8 * np.exp(-((x - 25) ** 2 + (y - 20) ** 2) / 10)
    got = raster.deblend(raster.label_components(image(spark, a).filter("v > 0.001"))).toPandas()
    assert got.label.nunique() == 1 and got.part.nunique() == 2


def test_half_light_and_sersic(spark):
    y, x = np.mgrid[:64, :64]
    a = np.exp(-np.hypot(x - 32, y - 32) / 4)
    r = raster.cutout_morphology(spark.createDataFrame([(1, 1, a.ravel().tolist())], "image int, id int, pix array<double>"), 64).first()
    assert r["sersic_n"] == pytest.approx(1.0, abs=0.15) and r["half_light_radius"] == pytest.approx(1.678 * 4, rel=0.1)


def test_asymmetry_of_a_symmetric_image(spark):
    y, x = np.mgrid[:9, :9]
    a = np.exp(-((x - 4) ** 2 + (y - 4) ** 2) / 4)
    assert raster.asymmetry(image(spark, a), 9, 9).first()["asymmetry"] == pytest.approx(0, abs=1e-12)


def encode(img, **head):
    cards = {"SIMPLE": "T", "BITPIX": "-32", "NAXIS": "2", "NAXIS1": str(img.shape[1]), "NAXIS2": str(img.shape[0]), **head}
    text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards.items()) + "END".ljust(80)
    data = img.astype(">f4").tobytes()
    return text.encode().ljust(-(-len(text) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


def test_image_files(spark, tmp_path):
    img = np.arange(30 * 50, dtype=float).reshape(30, 50)
    (tmp_path / "a.fits").write_bytes(encode(img, CRVAL1="189.25 / degrees", OBJECT="'NORTH'"))
    (tmp_path / "b.fits").write_bytes(b"version https://example/spec/v1\nsize 3\n")
    with pytest.raises(Exception, match="b.fits: no readable image"):
        fits.read_tiles(spark, str(tmp_path), tile=16).count()
    px = raster.tile_pixels(fits.read_tiles(spark, str(tmp_path), tile=16, on_error="skip")).toPandas()
    assert len(px) == 1500 and (px.v == px.y * 50 + px.x).all()
    head = fits.read_headers(spark, str(tmp_path)).collect()
    assert len(head) == 1 and head[0]["header"]["CRVAL1"] == "189.25" and head[0]["header"]["OBJECT"] == "NORTH"


def test_zeropoint_file_round_trip(spark, tmp_path):
    z = spark.createDataFrame([("U", 0.1, 0.912, 0.02, 40), ("B", -0.05, 1.0471, 0.03, 40)], "band string, offset_mag double, flux_scale double, scatter double, n_cal long")
    catalogs.write_zeropoints(z, str(tmp_path / "z"))
    got = catalogs.read_zeropoints(spark, str(tmp_path / "z")).orderBy("band").collect()
    assert [(r["band"], r["offset_mag"], r["n_cal"]) for r in got] == [("B", -0.05, 40), ("U", 0.1, 40)]


def test_redshift_lists(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ra,dec,z_spec,source_name\n189.1,62.2,0.5,a\n189.2,62.3,-1,b\nx,62.3,0.7,c\n")
    (tmp_path / "a.csv").write_text("RAJ2000,DEJ2000,zsp\n12 36 00.0,-62 12 00.0,1.5\n")
    (tmp_path / "c.csv").write_text("name\nx\n")
    got = catalogs.read_redshift_lists(spark, str(tmp_path)).collect()
    assert sorted((r["list"], r["list_order"], r["z_spec"]) for r in got) == [("a", 0, 1.5), ("b", 1, 0.5), ("b", 1, 0.7)]
    r = next(r for r in got if r["list"] == "a")
    assert r["ra"] == pytest.approx(189.0) and r["dec"] == pytest.approx(-62.2)
    assert catalogs.read_redshift_lists(spark, str(tmp_path / "none")).count() == 0


def test_spectrum_file(spark, tmp_path):
    (tmp_path / "Sa.dat").write_text("# wave flux\n1000.0 0.5\n\n1010.0  0.75\n")
    assert [(r["file"], r["wave"], r["flux"]) for r in catalogs.read_spectrum(spark, str(tmp_path / "Sa.dat")).collect()] == [("Sa", 1000.0, 0.5), ("Sa", 1010.0, 0.75)]


def test_nearest_pixel_ties(spark):
    left = spark.createDataFrame([(1, "f", 0.0, 0.0), (2, "f", 100.0, 0.0)], "id long, grp string, x double, y double")
    right = spark.createDataFrame([(9, "f", "a", 1.0, 0.0), (8, "f", "a", -1.0, 0.0), (7, "g", "a", 0.0, 0.0), (6, "f", "b", 3.0, 0.0)], "id long, grp string, part string, x double, y double")
    assert [(r["id"], r["part"], r["near_id"]) for r in matching.nearest_pixel(left, right).collect()] == [(1, "a", 8)]


def test_grid_is_frozen():
    assert isinstance(model_grid(1.0, av=[0.0], templates=["Sb"]), ModelGrid)
    assert [len(model_grid(s, av=[0.0], templates=["Sb"]).z) for s in (0.01, 0.02, 0.05)] == [396, 199, 80]


def test_png_of_a_cutout(spark):
    cut = spark.createDataFrame([(1, 1, [0.0, 1.0, 2.0, 3.0]), (1, 2, [1.0])], "image int, id int, pix array<double>")
    got = raster.png_cutouts(cut, 2).collect()
    assert len(got) == 1 and bytes(got[0]["png"]).startswith(b"\x89PNG") and b"IEND" in bytes(got[0]["png"])


def test_interpolated_templates():
    g = model_grid(1.0, av=[0.0], templates=["Sa", "Sb"], per_pair=1)
    assert g.templates == ("Sa", "Sa", "Sb") and np.allclose(g.flux[1], (g.flux[0] + g.flux[2]) / 2)


def test_cutouts_inside_the_image(spark):
    a = np.arange(400.0).reshape(20, 20)
    src = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 1.0, 10.0)], "image int, id int, cx double, cy double")
    got = raster.cutouts(src, image(spark, a), 20, 20, 4).collect()
    assert len(got) == 1 and got[0]["pix"] == a[8:12, 8:12].ravel().tolist()


def test_segments_on_a_mask_go(spark):
    lab = spark.createDataFrame([(1, 0, 0, 1.0, 5), (1, 1, 0, 1.0, 5), (1, 9, 9, 1.0, 6)], "image int, x int, y int, v double, label long")
    mask = spark.createDataFrame([(1, 1, 0)], "image int, x int, y int")
    assert [r["label"] for r in raster.without_masked(lab, mask).collect()] == [6]
