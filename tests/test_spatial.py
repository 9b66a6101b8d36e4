"""Points near points and in regions, against brute force."""

import numpy as np
import pandas as pd
import pytest

from skyloom.operators.spatial import near_pairs, points_in_regions


def unit(ra, dec):
    a, d = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], -1)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = [(0.0, 10.0), (120.0, 89.9995), (200.0, -89.9998), (359.999, -30.0), (40.0, 0.0)]
    k = rng.integers(0, len(centres), n)
    ra0, dec0 = np.array(centres)[k].T
    dec = np.clip(dec0 + rng.normal(0, 0.002, n), -90, 90)
    ra = ra0 + rng.normal(0, 0.002, n) / np.maximum(np.cos(np.radians(dec)), 1e-5)
    return pd.DataFrame({"id": np.arange(n), "grp": rng.integers(0, n // 2, n), "ra": ra, "dec": dec})


def brute(p, r):
    x = unit(p.ra.to_numpy(), p.dec.to_numpy())
    sep = np.degrees(2 * np.arcsin(np.minimum(1, np.linalg.norm(x[:, None] - x[None], axis=-1) / 2))) * 3600
    i, j = np.nonzero((sep <= r) & (p.grp.to_numpy()[:, None] != p.grp.to_numpy()[None]))
    return {(a, b) for a, b in zip(p.id.to_numpy()[i], p.id.to_numpy()[j]) if a < b}


@pytest.mark.parametrize("cap", [20_000, 15])
def test_pairs(spark, cap):
    p = clustered(900, 4)
    want = brute(p, 3.0)
    got = near_pairs(spark.createDataFrame(p), 3.0, id_col="id", group_col="grp", tile_cap=cap).toPandas()
    assert len(got) == len(want) and set(zip(got.id_a, got.id_b)) == want and len(want) > 100


def test_two_tables(spark):
    p, q = clustered(400, 5), clustered(300, 6)
    x, y = unit(p.ra.to_numpy(), p.dec.to_numpy()), unit(q.ra.to_numpy(), q.dec.to_numpy())
    sep = np.degrees(2 * np.arcsin(np.linalg.norm(x[:, None] - y[None], axis=-1) / 2)) * 3600
    want = set(zip(*(v.tolist() for v in np.nonzero(sep <= 5.0))))
    got = near_pairs(spark.createDataFrame(p), 5.0, spark.createDataFrame(q.rename(columns={"id": "other"})), id_col="id", right_id="other").toPandas()
    assert set(zip(got.id_a, got.id_b)) == want


def test_unusable_positions_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, 10.0, 5.0, "a"), (2, 2, 370.0, 5.0, "b"), (3, 3, None, 5.0, "c"), (4, 4, nan, 5.0, "d"), (5, 5, 10.0, 99.0, "e"), (6, 6, inf, 5.0, "f"), (None, 7, 10.0, 5.0, "g"), (8, None, 10.0, 5.0, "h"), (2, 2, 370.0, 5.0, "b")]
    df = spark.createDataFrame(rows, "id long, grp long, ra double, dec double, home string")
    df = df.withColumnsRenamed({"home": "sep_arcsec"}).selectExpr("*", "1 as z", "2 as block", "3 as nb")
    got = near_pairs(df, 3.0, id_col="id", group_col="grp").collect()
    assert [(r["id_a"], r["id_b"]) for r in got] == [(1, 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "id long, ra double, dec double")
    reg = spark.createDataFrame([], "region_id long, shape string, ra double, dec double, radius_arcsec double, vertex_ra array<double>, vertex_dec array<double>")
    assert near_pairs(df, 3.0, id_col="id").count() == 0
    assert points_in_regions(df, reg, id_col="id").count() == 0


def test_regions(spark):
    nan = float("nan")
    reg = [
        (1, "circle", 0.0, 89.999, 10.0, None, None), (2, "circle", 10.0, 5.0, None, None, None), (3, "circle", nan, 5.0, 9.0, None, None),
        (4, "polygon", None, None, None, [359.99, 0.01, 0.01, 359.99], [-0.01, -0.01, 0.01, 0.01]), (5, "polygon", None, None, None, [359.99, 0.01, 0.01, 359.99], [0.01, 0.01, -0.01, -0.01]),
        (6, "polygon", None, None, None, [0.0, 1.0], [0.0, 1.0]), (7, "circle", 100.0, 0.0, 7200.0, None, None), (7, "circle", 100.0, 0.0, 7200.0, None, None), (8, "circle", 0.0, 0.0, -1.0, None, None), (9, None, 0.0, 0.0, 5.0, None, None),
    ]
    df = spark.createDataFrame(reg, "region_id long, shape string, ra double, dec double, radius_arcsec double, vertex_ra array<double>, vertex_dec array<double>")
    pts = spark.createDataFrame([(1, 180.0, 89.9991), (2, 0.0, 0.0), (3, 360.005, 0.005), (4, 0.02, 0.0), (5, 101.9, 0.1), (6, 102.1, 0.0)], "id long, ra double, dec double")
    got = {(r["region_id"], r["id"]) for r in points_in_regions(pts, df, id_col="id").collect()}
    assert got == {(1, 1), (4, 2), (4, 3), (5, 2), (5, 3), (7, 5)}


@pytest.mark.parametrize("cap", [20_000, 60])
def test_hot_group(spark, cap):
    p = clustered(900, 7)
    p.loc[p.index % 3 > 0, "grp"] = -1
    want = brute(p, 3.0)
    got = near_pairs(spark.createDataFrame(p), 3.0, id_col="id", group_col="grp", tile_cap=cap).toPandas()
    assert len(got) == len(want) and set(zip(got.id_a, got.id_b)) == want and len(want) > 100
