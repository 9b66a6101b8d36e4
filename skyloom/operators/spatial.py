"""Points near points, and points in regions, on the sphere.

``near_pairs`` range-partitions latitude into strips that overlap by the search radius, cuts each strip into
longitude slices, sorts every tile locally and sweeps an active set in longitude order. A pair is verified by its
chord and belongs to one owner: the home tile of the row with the smaller key. All tile arithmetic is Column
expressions; only the sweep itself runs in Arrow batches.

Skew: a tile with more than ``tile_cap`` rows is cut into blocks by a hash of the key, and the block pairs are separate
tasks, so that no task holds an unbounded tile and no pair is lost. Where few groups hold most rows of a tile, rows of a
group that share a cell are swept as one entry, so that a hot group is not compared with itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.runs import borders, complete_runs
from skyloom.session import shuffle_width

#: Latitude strip and least longitude slice, degrees on the sky. Independent of the data.
STRIP_DEG, SLICE_DEG = 0.01, 0.05
#: Strips and slices for regions too large for the fine grid.
COARSE_DEG = 2.0
#: Rows of a tile above which it is cut into blocks.
TILE_CAP = 20_000
#: Hot tiles, and region tiles, up to which the table of them is broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000

ARCSEC = 3600.0
#: What one task of the sweep is: a tile, or two blocks of a hot one.
KEYS = ("z", "s", "bi", "bj")


def usable_position(ra: Column, dec: Column) -> Column:
    """True where both angles are finite and dec is in [-90, 90]; never null."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return finite(ra) & finite(dec) & F.coalesce(F.abs(dec) <= 90.0, F.lit(False))


def wrap_ra(ra: Column) -> Column:
    """Right ascension modulo 360, in [0, 360)."""
    r = F.pmod(ra, F.lit(360.0))
    return F.when(r >= 360.0, 0.0).otherwise(r)


def unit(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a direction in degrees."""
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def _strip(dec: Column, h: float) -> Column:
    top = math.ceil(180.0 / h) - 1
    return F.least(F.greatest(F.floor((dec + 90.0) / h), F.lit(0)), F.lit(top)).cast("int")


def _slices(strip: Column, h: float, w: float) -> Column:
    """Slices of a strip: as many of width ``w`` as its shorter edge holds, at least one."""
    lo, hi = strip * h - 90.0, (strip + 1) * h - 90.0
    edge = F.least(F.greatest(F.abs(lo), F.abs(hi)), F.lit(90.0))
    return F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / w), F.lit(1)).cast("int")


def _slice_of(ra: Column, n: Column) -> Column:
    return F.floor(ra / 360.0 * n).cast("int")


def _reach(dec: Column, r: Column) -> Column:
    """Largest difference in longitude of anything within ``r`` degrees; 180 where the circle holds a pole."""
    ratio = F.sin(F.radians(r)) / F.cos(F.radians(dec))
    return F.when(F.abs(dec) + r >= 90.0, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))


def covering_tiles(ra: Column, dec: Column, r: Column, h: float, w: float) -> Column:
    """Array of ``struct(z, s, n)``: every tile that a circle of ``r`` degrees may touch."""
    slack = 1e-9
    reach = _reach(dec, r) + slack

    def row(z: Column) -> Column:
        n = _slices(z, h, w)
        a, b = F.floor((ra - reach) / 360.0 * n), F.floor((ra + reach) / 360.0 * n)
        whole = (b - a + 1) >= n
        s = F.sequence(F.when(whole, F.lit(0)).otherwise(a), F.when(whole, n - 1).otherwise(b))
        return F.transform(s, lambda i: F.struct(z.alias("z"), F.pmod(i, n).cast("int").alias("s"), n.alias("n")))

    return F.flatten(F.transform(F.sequence(_strip(dec - r - slack, h), _strip(dec + r + slack, h)), row))


def home_tile(ra: Column, dec: Column, h: float, w: float) -> Column:
    z = _strip(dec, h)
    n = _slices(z, h, w)
    return F.struct(z.alias("z"), F.least(_slice_of(ra, n), n - 1).alias("s"), n.alias("n"))


def _windows(tile: np.ndarray, lon: np.ndarray, dec: np.ndarray, n: np.ndarray, radius_deg: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the active sets: within each tile, in longitude order, every row with the rows up to its reach ahead of it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.degrees(np.arcsin(np.minimum(1.0, math.sin(math.radians(radius_deg)) / np.cos(np.radians(dec)))))
    reach = np.where(np.abs(dec) + radius_deg >= 90.0, 180.0, reach) + 1e-7
    ring = np.nonzero(n == 1)[0]  # a tile of the whole circle wraps: its rows come once more, a turn later
    at, ahead = np.concatenate([np.arange(len(lon)), ring]), np.concatenate([lon, lon[ring] + 360.0])
    key = tile[at] * 1000.0 + ahead
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    begin = np.nonzero(ahead[order] < 360.0)[0]
    size = np.searchsorted(key, key[begin] + reach[at[begin]], "right") - begin - 1
    for lo, hi in _chunks(size):
        m = size[lo:hi]
        i = np.repeat(begin[lo:hi], m)
        j = i + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        i, j = at[i], at[j]
        ok = np.abs(dec[i] - dec[j]) <= radius_deg + 1e-9
        yield i[ok], j[ok]


def _across(tile: np.ndarray, lon: np.ndarray, dec: np.ndarray, n: np.ndarray, side: np.ndarray, radius_deg: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of left and right rows: for every left row the right rows within its reach on both sides. Rows of one side never meet."""
    left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    if not len(left) or not len(right):
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.degrees(np.arcsin(np.minimum(1.0, math.sin(math.radians(radius_deg)) / np.cos(np.radians(dec[left])))))
    reach = np.where(np.abs(dec[left]) + radius_deg >= 90.0, 180.0, reach) + 1e-7
    ring = right[n[right] == 1]
    at = np.concatenate([right, ring, ring])
    key = tile[at] * 2000.0 + np.concatenate([lon[right], lon[ring] + 360.0, lon[ring] - 360.0])
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    own = tile[left] * 2000.0 + lon[left]
    lo = np.searchsorted(key, own - reach, "left")
    size = np.searchsorted(key, own + reach, "right") - lo
    for a, b in _chunks(size):
        m = size[a:b]
        i = np.repeat(left[a:b], m)
        j = at[np.repeat(lo[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        ok = np.abs(dec[i] - dec[j]) <= radius_deg + 1e-9
        yield i[ok], j[ok]


def _chunks(size: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``most``."""
    cuts = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(size), np.arange(most, size.sum() + most, most), "left") + 1, [len(size)]]))
    for lo, hi in zip(cuts[:-1], np.minimum(cuts[1:], len(size))):
        if size[lo:hi].sum():
            yield int(lo), int(hi)


def _group_pairs(tile: np.ndarray, grp: np.ndarray, xyz: np.ndarray, lon: np.ndarray, dec: np.ndarray, n: np.ndarray, radius_deg: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for crowded groups: rows of one group in one cell are one entry, entries of different groups are swept, and only their rows are paired. A hot group costs its neighbours, not its square."""
    cell = np.floor(xyz / math.radians(radius_deg)).astype(np.int64)
    whole, entry, size = np.unique(np.stack([tile, grp, *cell], 1), axis=0, return_inverse=True, return_counts=True)
    order = np.argsort(entry.ravel(), kind="stable")
    start = np.cumsum(size) - size
    rep = order[start]
    far = radius_deg * (1 + 2 * math.sqrt(3)) * 1.001  # a representative is at most a cell's diagonal from its rows
    for a, b in _windows(whole[:, 0], lon[rep], dec[rep], n[rep], far):
        ok = whole[a, 1] != whole[b, 1]
        a, b = a[ok], b[ok]
        many = size[a] * size[b]
        for lo, hi in _chunks(many):
            m, x, y = many[lo:hi], a[lo:hi], b[lo:hi]
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            w = np.repeat(size[y], m)
            yield order[np.repeat(start[x], m) + k // w], order[np.repeat(start[y], m) + k % w]


def _sweep(radius_deg: float, two_sided: bool):
    """mapInArrow function: complete tiles in, verified pairs out."""
    limit = (2.0 * math.sin(math.radians(radius_deg) / 2.0)) ** 2
    schema = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64()), ("sep_arcsec", pa.float64())])

    def tiles(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {k: t.column(k).to_numpy() for k in t.column_names}
        tile = np.cumsum(borders(t, KEYS))
        # longitude from the tile's middle, so that only a tile of the whole circle can wrap
        lon = np.where(c["n"] > 1, (c["ra"] - (c["s"] + 0.5) * 360.0 / c["n"] + 540.0) % 360.0, c["ra"])
        a, d = np.radians(c["ra"]), np.radians(c["dec"])
        xyz = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)])
        crowded = not two_sided and len(np.unique(tile * 1_000_003 + c["grp"] % 1_000_003)) * 2 < len(tile)
        if two_sided:
            pairs = _across(tile, lon, c["dec"], c["n"], c["side"], radius_deg)
        elif crowded:
            pairs = _group_pairs(tile, c["grp"], xyz, lon, c["dec"], c["n"], radius_deg)
        else:
            pairs = _windows(tile, lon, c["dec"], c["n"], radius_deg)
        for i, j in pairs:
            turn = np.zeros(len(i), bool) if two_sided else c["id"][i] > c["id"][j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            ok = c["home"][i] & ((c["bi"][i] == c["bj"][i]) | (c["block"][i] != c["block"][j]))
            if not two_sided:
                ok &= (c["id"][i] != c["id"][j]) & (c["grp"][i] != c["grp"][j])
            i, j = i[ok], j[ok]
            chord = ((xyz[:, i] - xyz[:, j]) ** 2).sum(0)
            ok = chord <= limit
            i, j, chord = i[ok], j[ok], chord[ok]
            if len(i):
                sep = np.degrees(2.0 * np.arcsin(np.sqrt(chord) / 2.0)) * ARCSEC
                yield pa.record_batch([pa.array(c["id"][i]), pa.array(c["id"][j]), pa.array(sep)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in complete_runs(batches, KEYS):
            yield from tiles(whole)

    return run


def near_pairs(
    left: DataFrame,
    radius_arcsec: float,
    right: DataFrame | None = None,
    *,
    id_col: str,
    right_id: str | None = None,
    group_col: str | None = None,
    ra: str = "ra",
    dec: str = "dec",
    tile_cap: int = TILE_CAP,
) -> DataFrame:
    """Pairs ``(id_a, id_b, sep_arcsec)`` at most ``radius_arcsec`` apart on the sphere.

    Without ``right``: pairs of rows of ``left``, ``id_a < id_b``; with ``group_col`` only pairs of different, non-null
    groups. With ``right``: ``id_a`` is from ``left``, ``id_b`` from ``right``.

    ``ra`` counts modulo 360. Rows without a usable position, or with a null key, are in no pair. Rows that repeat a
    key are taken once per position. Other columns are not read, so their names cannot clash. Empty input gives no rows.
    """
    if not 0 < radius_arcsec <= 3600.0:
        raise ValueError("radius_arcsec must be in (0, 3600]")
    r = radius_arcsec / ARCSEC
    h, w = max(STRIP_DEG, 4 * r), max(SLICE_DEG, 20 * r)
    spark = left.sparkSession

    def side(df: DataFrame, key: str, which: int, spread: bool) -> DataFrame:
        group = F.col(group_col).cast("long") if group_col else F.col(key).cast("long")
        df = df.select(F.col(key).cast("long").alias("id"), group.alias("grp"), F.col(ra).cast("double").alias("ra"), F.col(dec).cast("double").alias("dec"))
        df = df.filter(usable_position(F.col("ra"), F.col("dec")) & F.col("id").isNotNull() & F.col("grp").isNotNull())
        df = df.withColumn("ra", wrap_ra(F.col("ra"))).withColumn("own", home_tile(F.col("ra"), F.col("dec"), h, w))
        tiles = covering_tiles(F.col("ra"), F.col("dec"), F.lit(r), h, w) if spread else F.array("own")
        df = df.withColumn("t", F.explode(tiles))
        return df.select("t.z", "t.s", "t.n", F.lit(which).cast("tinyint").alias("side"), ((F.col("t.z") == F.col("own.z")) & (F.col("t.s") == F.col("own.s"))).alias("home"), "id", "grp", "ra", "dec")

    two = right is not None
    rows = side(left, id_col, 0, not two)
    if two:
        rows = rows.unionByName(side(right, right_id or id_col, 1, True))
    hot = rows.groupBy("z", "s").count().filter(F.col("count") > tile_cap).select("z", "s", F.ceil(F.col("count") / tile_cap).cast("int").alias("nb"))
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, ["z", "s"], "left")
        nb = F.coalesce("nb", F.lit(1))
    else:
        nb = F.lit(1)
    rows = rows.withColumn("nb", nb).withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("bi", F.least("block", "o")).withColumn("bj", F.greatest("block", "o")).drop("o", "nb")
    rows = rows.repartitionByRange(shuffle_width(spark), *KEYS).sortWithinPartitions(*KEYS)
    return rows.mapInArrow(_sweep(r, two), "id_a long, id_b long, sep_arcsec double").distinct()


def regions(df: DataFrame) -> DataFrame:
    """Usable regions of a ``sky_region`` table: ``region_id``, a bounding circle and the test of containment.

    A circle needs a finite centre and a finite radius >= 0. A polygon needs three or more vertices, all of them usable;
    its vertices may run either way. Any other row contains nothing. Repeated rows are taken once.
    """
    rid, shape = F.col("region_id").cast("long"), F.lower(F.trim("shape"))
    radius = F.col("radius_arcsec").cast("double")
    circle = (
        df.filter((shape == "circle") & usable_position(F.col("ra"), F.col("dec")) & (radius >= 0) & ~F.isnan(radius) & (radius <= 180 * ARCSEC))
        .select(rid.alias("region_id"), wrap_ra(F.col("ra")).alias("c_ra"), F.col("dec").alias("c_dec"), (radius / ARCSEC).alias("c_r"), F.lit(None).cast("array<struct<x:double,y:double,z:double>>").alias("inward"))
        .filter(F.col("region_id").isNotNull())
    )
    v = F.arrays_zip(F.col("vertex_ra").alias("a"), F.col("vertex_dec").alias("d"))
    xyz = lambda p: F.struct(*[e.alias(k) for e, k in zip(unit(p["a"], p["d"]), "xyz")])
    poly = df.filter((shape == "polygon") & (F.size("vertex_ra") >= 3) & (F.size("vertex_ra") == F.size("vertex_dec"))).select(rid.alias("region_id"), v.alias("v"))
    poly = poly.filter(F.col("region_id").isNotNull() & F.forall("v", lambda p: usable_position(p["a"], p["d"])))
    poly = poly.select("region_id", F.transform("v", xyz).alias("v"))
    dot = lambda p, q: p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    add = lambda p, q: F.struct((p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y"), (p["z"] + q["z"]).alias("z"))
    scale = lambda p, k: F.struct((p["x"] * k).alias("x"), (p["y"] * k).alias("y"), (p["z"] * k).alias("z"))
    cross = lambda p, q: F.struct((p["y"] * q["z"] - p["z"] * q["y"]).alias("x"), (p["z"] * q["x"] - p["x"] * q["z"]).alias("y"), (p["x"] * q["y"] - p["y"] * q["x"]).alias("z"))
    poly = poly.withColumn("m", F.aggregate("v", zero, add))
    poly = poly.withColumn("m", scale(F.col("m"), 1.0 / F.sqrt(F.greatest(dot(F.col("m"), F.col("m")), F.lit(1e-300)))))
    nxt = F.concat(F.slice("v", 2, F.size("v")), F.slice("v", 1, 1))
    poly = poly.withColumn("edge", F.zip_with("v", nxt, cross))
    turn = F.aggregate("edge", F.lit(0.0), lambda s, e: s + dot(e, F.col("m")))
    poly = poly.withColumn("sense", F.when(turn >= 0, 1.0).otherwise(-1.0))
    far = F.array_max(F.transform("v", lambda p: F.acos(F.least(F.greatest(dot(p, F.col("m")), F.lit(-1.0)), F.lit(1.0)))))
    poly = poly.select(
        "region_id",
        wrap_ra(F.degrees(F.atan2(F.col("m.y"), F.col("m.x")))).alias("c_ra"),
        F.degrees(F.asin(F.least(F.greatest(F.col("m.z"), F.lit(-1.0)), F.lit(1.0)))).alias("c_dec"),
        (F.degrees(far) + 1e-7).alias("c_r"),
        F.transform("edge", lambda e: scale(e, F.col("sense"))).alias("inward"),
    )
    return circle.unionByName(poly)


def points_in_regions(points: DataFrame, region_df: DataFrame, *, id_col: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """``(region_id, id)`` for every usable point within every usable region, edges included.

    Regions are posted to the tiles of the same strip grid that their bounding circle touches (large ones to a coarse
    grid), points look up their home tiles, and the exact test follows in the join. The region side is broadcast only if
    its tile list is at most ``BROADCAST_ROWS`` long.
    """
    reg = regions(region_df)
    big = F.col("c_r") > 0.5
    at = lambda h, w: covering_tiles(F.col("c_ra"), F.col("c_dec"), F.least("c_r", F.lit(180.0)), h, w)
    level = lambda i, t: F.transform(t, lambda x: F.struct(F.lit(i).alias("l"), x["z"].alias("z"), x["s"].alias("s")))
    tiles = F.when(big, level(1, at(COARSE_DEG, COARSE_DEG))).otherwise(level(0, at(STRIP_DEG, SLICE_DEG)))
    reg = reg.withColumn("t", F.explode(tiles)).select("region_id", "c_ra", "c_dec", "c_r", "inward", "t.*")
    small = reg.count() <= BROADCAST_ROWS
    p = points.select(F.col(id_col).cast("long").alias("id"), F.col(ra).cast("double").alias("ra"), F.col(dec).cast("double").alias("dec"))
    p = p.filter(usable_position(F.col("ra"), F.col("dec")) & F.col("id").isNotNull()).withColumn("ra", wrap_ra(F.col("ra")))
    x, y, z = unit(F.col("ra"), F.col("dec"))
    p = p.withColumns({"x": x, "y": y, "zz": z, "t": F.explode(F.array(*[F.struct(F.lit(i).alias("l"), *[home_tile(F.col("ra"), F.col("dec"), h, w)[k].alias(k) for k in "zs"]) for i, (h, w) in enumerate(((STRIP_DEG, SLICE_DEG), (COARSE_DEG, COARSE_DEG)))]))})
    p = p.select("id", "x", "y", "zz", F.col("dec").alias("p_dec"), "t.*")
    got = p.join(F.broadcast(reg) if small else reg, ["l", "z", "s"])
    cx, cy, cz = unit(F.col("c_ra"), F.col("c_dec"))
    chord = (F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2 + (F.col("zz") - cz) ** 2
    in_circle = F.asin(F.least(F.sqrt(chord) / 2.0, F.lit(1.0))) * 2.0 <= F.radians("c_r") + 1e-15
    in_poly = F.forall("inward", lambda e: e["x"] * F.col("x") + e["y"] * F.col("y") + e["z"] * F.col("zz") >= -1e-15)
    return got.filter(in_circle & (F.col("inward").isNull() | in_poly)).select("region_id", "id").distinct()
