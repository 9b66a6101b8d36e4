"""Expressions, bins, fits and robust statistics against formulas, pandas and hand-computed constants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions import angles, cosmology, photometry, sky
from skyloom.operators import binning, fit, quality, quantiles, robust
from skyloom.operators.templates import dust, igm


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("z, want", [(0.5, 1259.0836), (1.0, 1651.9144), (2.0, 1726.6207)])
def test_distance(spark, z, want):
    assert one(spark, cosmology.angular_diameter_distance(F.lit(z))) == pytest.approx(want, rel=1e-7)
    assert cosmology.distance_np(np.array([z]), 0.3)[0] == pytest.approx(want, rel=1e-7)


def test_size_conversion_round_trip(spark):
    kpc = cosmology.physical_size_kpc(F.lit(1.2), F.lit(0.4))
    assert one(spark, cosmology.angular_size_arcsec(F.lit(1.2), kpc)) == pytest.approx(0.4)


@pytest.mark.parametrize("n, want", [(1, 0.0213254), (2, 0.0706512), (3, 0.1511024), (4, 0.2578769), (7, 0.6234040), (10, 0.8702581)])
def test_chi2_survival(n, want):
    assert fit.chi2_survival(5.3, n) == pytest.approx(want, abs=1e-7)


def test_chi2_survival_without_freedom():
    assert math.isnan(fit.chi2_survival(1.0, 0))


def test_dust_and_igm_agree_with_arrays(spark):
    lam = np.array([950.0, 1190.0, 1250.0, 3000.0, 6500.0, 15000.0, 30000.0])
    df = spark.createDataFrame([(float(x),) for x in lam], "lam double")
    got = df.select(photometry.calzetti(F.col("lam"), F.lit(0.6)).alias("d"), photometry.igm_transmission(F.col("lam") * 3, F.lit(2.0)).alias("i")).toPandas()
    assert np.allclose(got["d"], dust(lam, 0.6))
    assert np.allclose(got["i"], igm(lam * 3, 2.0))


def test_null_stays_null(spark):
    n = F.lit(None).cast("double")
    for e in (photometry.psf_corrected_radius(n), cosmology.distance_static(n), cosmology.e_of_z(n), photometry.calzetti(F.lit(3000.0), n), photometry.igm_transmission(n, F.lit(1.0))):
        assert one(spark, e) is None


def test_stellarity_terms_drop_out(spark):
    nan = F.lit(float("nan"))
    assert one(spark, photometry.stellarity(nan, nan, nan)) == 0.0
    assert one(spark, photometry.stellarity(F.lit(0.9), nan, nan)) == 1.0
    assert one(spark, photometry.stellarity(F.lit(0.9), F.lit(0.45), F.lit(0.3))) == pytest.approx((2 + 0.5 + 0) / 4)


def test_sexagesimal_sign(spark):
    assert one(spark, angles.sexagesimal_dec(F.lit("-00 30 00"))) == -0.5
    assert one(spark, angles.sexagesimal_ra(F.lit("12 30 00.0"))) == 187.5
    assert one(spark, angles.sexagesimal_ra(F.lit("12 xx 00"))) is None
    assert one(spark, angles.sexagesimal_ra(F.lit(None).cast("string"))) is None


def test_pixel_to_sky_at_reference(spark):
    head = F.create_map(*[F.lit(x) for kv in {"CD1_1": "-1e-5", "CD1_2": "0", "CD2_1": "0", "CD2_2": "1e-5", "CRVAL1": "189.2", "CRVAL2": "62.2", "CRPIX1": "100", "CRPIX2": "100"}.items() for x in kv])
    ra, dec = sky.pixel_to_sky(F.lit(99.0), F.lit(99.0), head)
    assert one(spark, ra) == pytest.approx(189.2) and one(spark, dec) == pytest.approx(62.2)
    ra, dec = sky.pixel_to_sky(F.lit(2048.0), F.lit(2048.0), F.create_map().cast("map<string,string>"))
    assert one(spark, dec) == pytest.approx(62.212572)


def sample(n=400, seed=1):
    rng = np.random.default_rng(seed)
    z = np.round(rng.uniform(0.1, 3, n), 2)
    return pd.DataFrame({"redshift": z, "r_half_arcsec": rng.lognormal(-1, 0.4, n), "r_half_arcsec_error": np.full(n, 0.02)})


@pytest.mark.parametrize("strategy", ["equal_width", "percentile"])
def test_bins_match_pandas(spark, strategy):
    pdf = sample()
    n = binning.adaptive_bins(len(pdf))
    cut = pd.cut(pdf.redshift, np.linspace(pdf.redshift.min(), pdf.redshift.max(), n + 1), include_lowest=True) if strategy == "equal_width" else pd.qcut(pdf.redshift, n, duplicates="drop")
    want = pdf.groupby(cut, observed=True).agg(z=("redshift", "median"), t=("r_half_arcsec", "median"), n=("redshift", "count")).reset_index(drop=True)
    got = binning.bin_catalog(spark.createDataFrame(pdf), strategy).orderBy("bin").toPandas()
    assert got["n"].tolist() == want["n"].tolist()
    assert np.allclose(got["z_mid"], want["z"]) and np.allclose(got["theta_med"], want["t"])


def test_small_bin_errors(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (2, 1.0, 3.0), (3, 1.0, 1.0), (3, 1.0, 2.0), (3, 1.0, 3.0)], "bin int, z double, t double")
    main = {r["bin"]: r["theta_err"] for r in binning.summarise(df, ["bin"], "z", "t").collect()}
    assert main == {1: pytest.approx(0.2), 2: 0.5, 3: pytest.approx(1.2533 / math.sqrt(3))}
    assert [r["bin"] for r in binning.summarise(df, ["bin"], "z", "t", "report").collect()] == [3]


def test_adaptive_bins():
    assert [binning.adaptive_bins(n) for n in (4, 50, 400, 10**6)] == [3, 7, 20, 20]
    assert [binning.adaptive_bins(n, "report") for n in (10, 150, 500, 2000, 10**5)] == [5, 10, 20, 35, 50]


def test_block_edges_find_a_step():
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, 1, 300))
    x = np.where(t < 0.4, 1.0, 2.0) + rng.normal(0, 0.1, 300)
    e = binning.block_edges(t, x, 0.1, 0.05)
    assert len(e) == 3 and e[1] == pytest.approx(0.4, abs=0.02)
    with pytest.raises(ValueError):
        binning.block_edges(np.array([0.1, 0.1, 0.2]), np.ones(3), 0.1, 0.05)


def test_block_edges_equal_the_full_recursion():
    def full(t, x, sigma, p0):
        n, best, last = len(t), [0.0], []
        prior = 4 - math.log(73.53 * p0 * n**-0.478)
        for r in range(1, n + 1):
            fit = [best[j] + x[j:r].sum() ** 2 / (2 * (r - j) * sigma**2) - prior for j in range(r)]
            last.append(int(np.argmax(fit)))
            best.append(max(fit))
        cuts = [n]
        while cuts[-1]:
            cuts.append(last[cuts[-1] - 1])
        e = np.concatenate([t[:1], (t[1:] + t[:-1]) / 2, t[-1:]])
        return e[cuts[::-1]].tolist()

    rng = np.random.default_rng(5)
    for k in range(24):
        n = int(rng.integers(1, 260))
        t = np.sort(rng.uniform(0, 3, n))
        x = [np.ones(n), rng.lognormal(-1, 0.5, n), np.floor(3 * t) + rng.normal(0, 0.4, n), 2 / (0.3 + t) + rng.normal(0, 0.2, n)][k % 4]
        assert binning.block_edges(t, x, 0.3, 0.05).tolist() == full(t, x, 0.3, 0.05)


def test_blocks_of_many_distinct_redshifts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    z = (np.arange(20_001) + rng.uniform(0, 0.9, 20_001)) / 10_000
    t = np.select([z < 0.37, z < 1.3], [2.0, 1.0], 1.5) + rng.normal(0, 0.1, len(z))
    df = spark.createDataFrame(pd.DataFrame({"z": z, "t": t}))
    e = binning.bayesian_edges(df, "z", "t")
    assert len(e) == 4 and e[1:3] == pytest.approx([0.37, 1.3], abs=1e-3)
    repeated = binning.bayesian_edges(df.union(df.limit(1)), "z", "t")
    assert np.allclose(np.diff(repeated), (z.max() - z.min()) / 20) and len(repeated) == 21
    monkeypatch.setattr(binning, "MAX_BLOCK_ROWS", 20_000)
    with pytest.raises(ValueError, match="20001"):
        binning.bayesian_edges(df, "z", "t")


def test_grid_fit_query_asks_all_shares(spark, sf):
    from skyloom.plans import registry

    q = registry.queries()
    coarse, full = ({r["galaxy_type"]: r for r in q[n](spark, sf).collect()} for n in ("q_lcdm_grid_fit", "q_lcdm_grid_fit_full"))
    assert full.keys() == coarse.keys() and all(full[t]["chi2"] <= coarse[t]["chi2"] for t in full)
    assert any(round(r["omega_l"] * 100) % 5 for r in full.values())


def test_choose_edges_errors(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "z double")
    with pytest.raises(ValueError):
        binning.choose_edges(df, "z")
    with pytest.raises(ValueError):
        binning.choose_edges(df, "z", method="other")


def test_quantiles_by_splitting(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 3000), "v": np.where(rng.uniform(size=3000) < 0.3, 5.0, rng.lognormal(size=3000))})
    ps = [0.0, 0.16, 0.5, 0.99, 1.0]
    got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", ps, in_memory=10).collect()}
    for k, g in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(g.v, ps))
    whole = quantiles.exact_quantiles(spark.createDataFrame(pdf), [], "v", [0.5], in_memory=10).first()["q"]
    assert whole[0] == pytest.approx(np.median(pdf.v))


def test_quantiles_by_splitting_with_infinities(spark):
    v = [float("-inf"), 1.0, 2.0, 3.0, float("inf"), float("inf"), None, float("nan")]
    df = spark.createDataFrame([("a", x) for x in v] + [(None, 5.0)], "v string, x double")
    for cap in (2, 100):
        got = quantiles.exact_quantiles(df, ["v"], "x", [0.0, 0.4, 1.0], in_memory=cap).collect()
        assert [(r["v"], r["q"]) for r in got] == [("a", [float("-inf"), 2.0, float("inf")])]


def test_quantiles_empty(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "k int, v double")
    assert quantiles.exact_quantiles(df, ["k"], "v", [0.5]).count() == 0
    assert quantiles.quantile_list(df, "v", [0.5]) == []


def numpy_clip(v, sigma=2.5):
    keep = np.ones(len(v), bool)
    for _ in range(3):
        keep &= np.abs(v - np.median(v[keep])) <= sigma * v[keep].std()
    return keep


def test_sigma_clip(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": ["a"] * 200 + ["b"] * 3, "v": np.concatenate([rng.standard_t(2, 200), [0.0, 1.0, 99.0]])})
    got = robust.sigma_clip(spark.createDataFrame(pdf), "k", "v").toPandas()
    assert (got.k == "a").sum() == numpy_clip(pdf.v[:200].to_numpy()).sum()
    assert (got.k == "b").sum() == 3


def test_mad_clip(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=100), [50.0, -40.0]])
    want = v
    for _ in range(3):
        m = np.median(want)
        d = 1.4826 * np.median(np.abs(want - m))
        want = want[np.abs(want - m) < 3 * d]
    got = robust.mad_clip(spark.createDataFrame(pd.DataFrame({"k": 1, "v": v})), "k", "v").first()
    assert got["n_kept"] == len(want) and got["median"] == pytest.approx(np.median(want)) and got["n_valid"] == 102


def test_redshift_metrics_of_nothing(spark):
    r = robust.redshift_metrics(spark.createDataFrame([(None, 1.0)], "zp double, zs double"), "zp", "zs").collect()
    assert len(r) == 1 and r[0]["n"] == 0 and r[0]["nmad"] is None


def test_fit_recovers_planted_values():
    z = np.linspace(0.2, 2.5, 15)
    theta = 0.006 / cosmology.distance_np(z, 0.35) * (180 * 3600 / math.pi)
    f = fit.fit_flat_lcdm(z, theta, np.full(15, 0.01))
    assert f.R_mpc == pytest.approx(0.006, rel=1e-5) and f.Omega_m == pytest.approx(0.35, abs=1e-4)
    assert f.R_err > 0 and f.Omega_L_err > 0 and f.n_points == 15
    assert math.isnan(fit.fit_flat_lcdm([1.0], [1.0], [1.0]).R_mpc)


def test_fit_radius_recovers(spark):
    z = np.linspace(0.2, 2.5, 15)
    theta = 0.006 / cosmology.distance_np(z, 0.3) * (180 * 3600 / math.pi)
    df = spark.createDataFrame(pd.DataFrame({"z": z, "t": theta, "e": 0.01}))
    assert fit.fit_radius(df, [], "z", "t", "e").first()["radius_mpc"] == pytest.approx(0.006, rel=1e-6)
    assert fit.fit_radius(df.limit(1), [], "z", "t", "e").first()["radius_mpc"] is None
    best = fit.grid_fit(df, [], "z", "t", "e").first()
    assert best["omega_l"] == pytest.approx(0.7) and best["radius_mpc"] == pytest.approx(0.006, rel=1e-3)


def test_cascade_levels(spark):
    rows = [(i, 0 if i < 12 else 8, 1, 0, False, i == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, quality_flag int, odds_flag int, chi2_flag int, bimodal_flag boolean, z_boundary_flag boolean")
    assert quality.quality_cascade(df).count() == 19  # nothing is strict, all are moderate, one is at the boundary
    assert quality.quality_cascade(df.withColumn("odds_flag", F.lit(0))).count() == 11


def test_flag_order(spark):
    f, r = quality.floored_radius(F.lit(0), F.lit(-1.0))
    assert one(spark, f) == 64 and one(spark, r) == 0.02
