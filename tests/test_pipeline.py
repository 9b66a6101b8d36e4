"""The pipeline with positions and reference redshifts, profiles, and the iterative calibration."""

import pytest
from pyspark.sql import functions as F

from skyloom.operators import calibration, reports, validation
from skyloom.plans import band_queries, pipeline, profile
from skyloom.session import table


def test_with_reference_redshifts(spark, sf):
    bands = table(spark, sf, "band_catalog")
    pos = bands.groupBy("source_id").agg(F.max("xcentroid").alias("x"), F.max("ycentroid").alias("y")).filter("not isnan(x) and not isnan(y)")
    pos = pos.select("source_id", (F.col("x") * 1e-5).alias("ra"), (F.col("y") * 1e-5).alias("dec"))
    entries = pos.select((F.col("source_id") + 10**12).alias("entry_id"), F.lit("made").alias("list"), F.lit(0).alias("list_order"), "ra", "dec", (F.col("source_id") % 20 * 0.1 + 0.1).alias("z_spec"))
    out = pipeline.run(spark, bands, profile.PROFILES["low"], entries, pos)
    full = out["full"]
    assert full.count() > 0 and full.filter("redshift_source != 'spec' or redshift_err != 0.001 or redshift != z_spec").count() == 0
    assert full.filter("catastrophic_outlier != ((quality_flag & 2048) != 0)").count() == 0
    assert {"photoz_reliable", "has_uband", "color_stellarity", "sed_morphology", "z_boundary_flag"} <= set(full.columns)
    assert out["filtered"].filter("z_boundary_flag").count() == 0 and out["fits"].count() == 3


def test_registered_pipeline_runs_all_stages(spark, sf, monkeypatch):
    monkeypatch.delenv(profile.VARIABLE, raising=False)
    used, redshifts = [], pipeline.with_redshifts
    monkeypatch.setattr(pipeline, "with_redshifts", lambda c, p, *a: used.append(p.z_step) or redshifts(c, profile.PROFILES["low"], *a))
    kept, cascade = [], pipeline.q.quality_cascade
    monkeypatch.setattr(pipeline.q, "quality_cascade", lambda df: kept.append(df) or cascade(df))
    assert band_queries.pipeline_fits(spark, sf).count() == 3 and used == [0.02]
    full = kept[0]
    assert full.filter("redshift_source = 'spec' and redshift = z_spec").count() > 0 and full.filter("in_star_mask and (quality_flag & 128) != 0").count() > 0
    assert cascade(full).filter("in_star_mask").count() == 0


def test_positions_are_those_of_the_nearest_version(spark, sf):
    got = band_queries._positions(spark, sf)
    assert got.count() == got.select("source_id").distinct().count() > 100
    s = {r["source_id"]: r for r in band_queries._sources(spark, sf).filter("band = 'f450'").collect()}
    g = table(spark, sf, "galaxy_catalog").filter("ra is not null and dec is not null and abs(dec) <= 90 and not isnan(ra)").collect()
    for r in got.orderBy("source_id").limit(40).collect():
        a = s[r["source_id"]]
        near = sorted(((a["xcentroid"] - b["xcentroid"]) ** 2 + (a["ycentroid"] - b["ycentroid"]) ** 2, b["record_id"], b["ra"], b["dec"]) for b in g if b["field_id"] == a["field_id"] and b["xcentroid"] is not None and b["ycentroid"] is not None)
        assert near[0][0] < 9 and (r["ra"], r["dec"]) == near[0][2:]


def test_edges_and_arguments(spark, sf, tmp_path, monkeypatch):
    bands = table(spark, sf, "band_catalog")
    got = pipeline.matched_catalog(bands, None, 490_000.0, 1e6).select("xcentroid", F.expr("(quality_flag & 2) != 0").alias("edge"))
    assert got.filter("edge != (xcentroid > 489950)").count() == 0 and got.select("edge").distinct().count() == 2
    with pytest.raises(ValueError):
        pipeline.run(spark, bands, positions=bands)
    for name in ("bands", "centres", "entries", "positions"):
        spark.createDataFrame([(name,)], "name string").write.parquet(f"{tmp_path}/{name}")
    seen = {}
    monkeypatch.setattr(pipeline, "run", lambda spark, bands, profile, **more: seen.update(more) or {})
    pipeline.main([f"{tmp_path}/bands", "out", *[x for k in ("centres", "entries", "positions") for x in (f"--{k}", f"{tmp_path}/{k}")], "--width", "100", "--height", "200"])
    assert [seen[k].first()["name"] for k in ("centres", "entries", "positions")] == ["centres", "entries", "positions"] and (seen["width"], seen["height"]) == (100, 200)
    with pytest.raises(SystemExit):
        pipeline.main(["bands", "out", "--width", "100"])


def test_from_images(spark, tmp_path, monkeypatch):
    """Four mosaics in, the rows of a band catalog out, the profile's threshold in use; the command line writes them and every relation."""
    from test_photoz_raster import encode, sky_image

    (tmp_path / "mosaics").mkdir()
    for i, b in enumerate(("f300", "f450", "f606", "f814")):
        (tmp_path / "mosaics" / f"{b}_mosaic_v2.fits").write_bytes(encode(sky_image(seed=i)))
    seen = {}
    detect = pipeline.band_catalog
    monkeypatch.setattr(pipeline, "band_catalog", lambda *a, **k: seen.update(k) or detect(*a, **k | {"box": 32, "detection_sigma": 6.0, "base_pixels": 60, "cutout": 32}))
    monkeypatch.setattr(pipeline, "run", lambda spark, bands, *a, **k: {"filtered": bands})
    monkeypatch.setattr(pipeline, "all_relations", lambda spark, df: {"count": df.groupBy("band").count()})
    pipeline.main([str(tmp_path), f"{tmp_path}/out", "--images", "--subdir", "one", "--relations", "--resource-profile", "low"])
    got = spark.read.parquet(f"{tmp_path}/out/one/full/filtered")
    assert seen["detection_sigma"] == 2.0 and {"source_id", "source_sky", "r_90_pix", "detected_at", "loaded_at"} <= set(got.columns)
    n = {r["band"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out/one/full/relations/count").collect()}
    assert set(n) == {"f300", "f450", "f606", "f814"} and all(4 <= k <= 6 for k in n.values())


def test_all_relations(spark, sf):
    from skyloom.plans.common import measured

    got = reports.all_relations(spark, measured(spark, sf))
    assert {"binning_comparison", "fit_comparison", "per_type_strategies", "type_summary", "distance_curves"} <= set(got) and all(df.count() > 0 for k, df in got.items() if not k.startswith("per_type"))


def test_resources(spark, monkeypatch):
    monkeypatch.delenv(profile.VARIABLE, raising=False)
    memory, cores = profile.resources(spark)
    assert memory > 1 and cores == 4 and "profile: " in profile.summary(spark)


def test_iterative_calibration_stops(spark):
    from skyloom.operators.templates import load_spectrum
    import numpy as np
    import pandas as pd

    zs = np.random.default_rng(0).uniform(0.1, 1.0, 40)
    m = calibration.band_means(zs, *load_spectrum(None, "Sb"))
    df = spark.createDataFrame(pd.DataFrame(m, columns=["flux_f300", "flux_f450", "flux_f606", "flux_f814"]).assign(record_id=range(40), z_spec=zs))
    _, factors, history = calibration.iterate_zeropoints(df, lambda d: d)
    assert len(history) == 1 and all(abs(f - 1) < 1e-6 for f in factors.values())
    assert calibration.calibrate_if_enough(df.limit(5)).columns == df.columns


def test_profiles(monkeypatch):
    monkeypatch.delenv(profile.VARIABLE, raising=False)
    assert [profile.choose(None, m, c).name for m, c in ((2, 8), (16, 2), (6, 8), (16, 4), (16, 8))] == ["low", "low", "medium", "medium", "high"]
    monkeypatch.setenv(profile.VARIABLE, "LOW")
    assert profile.choose(None, 64, 64).z_step == 0.05
    with pytest.raises(KeyError):
        profile.choose("other")


def test_low_redshift_outliers(spark):
    df = spark.createDataFrame([(0.1 + 0.01 * i, 0.1 + 0.01 * i) for i in range(30)], "zp double, zs double")
    got = validation.outliers_by_redshift(df, "zp", "zs").orderBy("bin").collect()
    assert len(got) >= 3 and got[-1]["z_hi"] == pytest.approx(0.39 * 1.1)


def test_curves(spark):
    c = reports.curve(spark, 0.003, 0.005, 0.1, 2.0, 50).toPandas()
    assert len(c) == 50 and c.theta_static.is_monotonic_decreasing and c.theta_lcdm.iloc[-1] > c.theta_lcdm.min() * 0.99
