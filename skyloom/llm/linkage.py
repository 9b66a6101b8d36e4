"""Matching entities across sources without keys: soft logic, solved by alternating directions.

Every candidate pair (an object and a list entry that are close on the sky) gets a truth value in [0, 1]. Weighted rules, each
a hinge (its loss is linear in the degree to which the rule is violated):

* *similarity*: separation and redshifts that speak for a pair make it a match, those that speak against it make it none: two
  hinges that meet at the pair's evidence, as heavy as its log-odds, so that what is hardly known is moved first;
* *transitivity*: two entries that are the same galaxy, to the degree that their positions and redshifts agree, match an object
  to the same degree. The rule is posted for the entries of an object that follow each other in order of redshift, in both
  directions, so their number grows as the pairs do;
* *exclusivity*: the values of the pairs of one entry sum to at most 1 (hard).

The sum is convex. Consensus ADMM solves it: every rule has its own copies of its pairs' values and a closed form for them
(shrinkage to the evidence; moving two values towards each other; projection on the capped simplex), and the consensus is their
mean. A step is two window aggregations, one by entry and one by object, so all pairs advance at once on the cluster and no
component is gathered anywhere. It ends when copies and consensus agree within ``TOLERANCE``. The values are the confidences.

Pairs that no rule but similarity concerns have their evidence as value; only the others enter the solver. A pair with evidence
below ``LEAST`` keeps it, too: its log-odds outweigh the two transitivity rules that it can be in at most, so no solution lifts it
(its rules still act on the others). Of the 1 that an entry's values may sum to, such pairs take theirs first.

Evidence has no labels to learn from: the lists' positional accuracies and the weights of agreeing, conflicting and missing
redshifts are estimated by expectation maximisation from counts of *all* candidate pairs by list, separation and redshift
class; random neighbours, whose number grows with the area, tell what a coincidence looks like.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.functions.angles import sexagesimal_dec, sexagesimal_ra
from skyloom.llm.survivor import label, usable_z
from skyloom.operators.spatial import near_pairs, usable_position
from skyloom.session import cut, small

#: Candidate radius, width of a separation bin (arcsec), and most lists (the counts below are bounded by it).
RADIUS, BIN, MAX_LISTS = 10.0, 0.05, 5_000
#: Width of the rings of the clustering profile, and separation from which a neighbourhood's density is counted (arcsec).
RING, INNER = 0.5, 3.0
#: Relative redshift differences that agree, nearly agree, and (photometric) agree.
SPEC_SAME, SPEC_NEAR, PHOT_SAME = 0.005, 0.02, 0.12
#: Redshift classes.
CLASSES = ["spec_same", "spec_near", "spec_far_phot_same", "spec_far", "phot_same", "phot_far", "none"]
#: Weight of a transitivity rule, least agreement of two entries for which it is posted, redshift scatter of one galaxy between lists (relative to 1 + z).
TRANSITIVITY, SAME, SCATTER = 2.5, 0.5, 0.002
#: Pairs whose evidence is below this cannot be lifted: its log-odds are more than 2 * TRANSITIVITY.
LEAST = 0.005
#: Step size, most steps, steps between two checkpoints (each tests the residuals), residual at which values stand.
RHO, STEPS, CUT_EVERY, TOLERANCE = 10.0, 60, 6, 0.02
#: Divided objects up to which their table is broadcast.
GROUPS = 100_000
#: Entries of an object above which it is divided into blocks, within which entries follow each other.
BLOCK = 10_000


def entries(specz: DataFrame) -> DataFrame:
    """``(specz_id, list, ra, dec, z)``; positions in either notation, ``z`` null unless usable."""
    dec_deg = usable_position(F.col("ra"), F.col("dec"))
    return specz.filter(F.col("specz_id").isNotNull()).select(
        F.col("specz_id").cast("long").alias("specz_id"), F.coalesce(label(F.col("catalog_name")), F.lit("")).alias("list"),
        F.when(dec_deg, F.col("ra")).otherwise(sexagesimal_ra(F.col("raj2000"))).alias("ra"),
        F.when(dec_deg, F.col("dec")).otherwise(sexagesimal_dec(F.col("dej2000"))).alias("dec"),
        F.when(usable_z(F.col("z_spec")), F.col("z_spec")).alias("z"),
    )


def object_redshifts(catalog: DataFrame) -> DataFrame:
    """``(object_id, zs, zp)``: medians over an object's versions of usable spectroscopic and photometric redshifts."""
    zs = F.when(usable_z(F.col("z_spec")), F.col("z_spec"))
    zp = F.when(usable_z(F.col("redshift")) & ~F.coalesce(F.col("redshift") == F.col("z_spec"), F.lit(False)), F.col("redshift"))
    return catalog.groupBy("object_id").agg(F.percentile_approx(zs, 0.5, 1000).alias("zs"), F.percentile_approx(zp, 0.5, 1000).alias("zp"))


def redshift_class(z: Column, zs: Column, zp: Column) -> Column:
    ds, dp = F.abs(z - zs) / (1.0 + z), F.abs(z - zp) / (1.0 + z)
    return (
        F.when(ds <= SPEC_SAME, "spec_same").when(ds <= SPEC_NEAR, "spec_near").when(ds.isNotNull() & (dp <= PHOT_SAME), "spec_far_phot_same").when(ds.isNotNull(), "spec_far")
        .when(dp <= PHOT_SAME, "phot_same").when(dp.isNotNull(), "phot_far").otherwise("none")
    )


def candidates(catalog: DataFrame, ent: DataFrame) -> DataFrame:
    """``(object_id, specz_id, list, z, e_ra, e_dec, sep, cls)``: every pair within ``RADIUS``, with the median separation over the object's versions."""
    near = near_pairs(catalog, RADIUS, ent, id_col="object_id", right_id="specz_id")
    near = near.groupBy(F.col("id_a").alias("object_id"), F.col("id_b").alias("specz_id")).agg(F.percentile_approx("sep_arcsec", 0.5, 1000).alias("sep"))
    one = ent.groupBy("specz_id").agg(F.min(F.struct("list", "z", F.col("ra").alias("e_ra"), F.col("dec").alias("e_dec"))).alias("e")).select("specz_id", "e.*")
    pairs = near.join(one, "specz_id").join(object_redshifts(catalog), "object_id")
    return pairs.select("object_id", "specz_id", "list", "z", "e_ra", "e_dec", "sep", redshift_class(F.col("z"), F.col("zs"), F.col("zp")).alias("cls"))


def fit_evidence(pairs: DataFrame) -> tuple[dict[str, tuple[float, float]], dict[str, float], float, list[float]]:
    """Positional sigma and expected matches of each list, weight ratio of each redshift class, number of background pairs, and their density in rings of ``RING`` relative to that beyond ``INNER`` (galaxies cluster, so coincidences do).

    At most ``MAX_LISTS`` lists times bins times classes reach the driver, whatever the number of pairs.
    """
    if pairs.select("list").distinct().count() > MAX_LISTS:
        raise ValueError(f"more than {MAX_LISTS} lists")
    rows = pairs.groupBy("list", F.floor(F.col("sep") / BIN).cast("int").alias("b"), "cls").count().collect()
    lists = sorted({r["list"] for r in rows})
    nb = int(RADIUS / BIN) + 1
    n = np.zeros((len(lists), nb, len(CLASSES)))
    for r in rows:
        n[lists.index(r["list"]), min(r["b"], nb - 1), CLASSES.index(r["cls"])] += r["count"]
    edge = np.arange(nb + 1) * BIN
    mid = (edge[1:] + edge[:-1]) / 2
    area = np.diff(edge**2)
    ring = np.minimum(mid / RING, RADIUS / RING - 1).astype(int)
    ring_area = np.bincount(ring, area)
    g = area / area.sum()
    sigma = np.full(len(lists), 0.6)
    total = n.sum((1, 2))
    match, back = 0.4 * total, 0.6 * total
    m = u = np.full(len(CLASSES), 1 / len(CLASSES))
    for _ in range(200):
        f = -np.diff(np.exp(-(edge[None, :] ** 2) / (2 * sigma[:, None] ** 2)), axis=1) + 1e-12
        a = match[:, None, None] * f[:, :, None] * m
        c = back[:, None, None] * g[None, :, None] * u
        w = n * a / (a + c + 1e-300)
        match, back = w.sum((1, 2)) + 1e-3, (n - w).sum((1, 2)) + 1e-3
        m, u = w.sum((0, 1)) + 0.5, (n - w).sum((0, 1)) + 0.5
        m, u = m / m.sum(), u / u.sum()
        profile = (np.bincount(ring, (n - w).sum((0, 2))) + 0.5) / ring_area
        g = profile[ring] * area
        g = g / g.sum()
        sigma = np.sqrt(np.maximum((w * mid[None, :, None] ** 2).sum((1, 2)) / (2 * match), BIN**2 / 4))
    by_list = {x: (float(s), float(k)) for x, s, k in zip(lists, sigma, match)}
    far = np.arange(len(profile)) >= INNER / RING
    profile = profile / (profile * ring_area)[far].sum() * ring_area[far].sum()
    return by_list, {c: float(p / q) for c, p, q in zip(CLASSES, m, u)}, float(back.sum()), profile.tolist()


def evidence(pairs: DataFrame, ent: DataFrame) -> DataFrame:
    """Pairs with ``e``: the probability that the pair is a match, were it the entry's only candidate (exclusivity is a rule of the solver), and ``sigma``, the accuracy of the entry's list."""
    spark = pairs.sparkSession
    by_list, ratio, back, profile = fit_evidence(pairs)
    if not by_list:
        return pairs.withColumns({"e": F.lit(0.0), "sigma": F.lit(1.0)})
    found = ent.filter(usable_position(F.col("ra"), F.col("dec")) & F.col("list").isin(list(by_list)))
    located = {r["list"]: r["count"] for r in found.groupBy("list").count().collect()}
    rows = [(x, s, min(0.98, max(0.02, k / max(located.get(x, 1), 1)))) for x, (s, k) in by_list.items()]
    lists = spark.createDataFrame(rows, "list string, sigma double, prior double")
    areas = [2 * i + 1 for i in range(len(profile))]
    dense = back / max(sum(located.values()), 1) / (math.pi * RADIUS**2) / (sum(p * a for p, a in zip(profile, areas)) / sum(areas))
    weight = F.create_map(*[x for c, v in ratio.items() for x in (F.lit(c), F.lit(v))])
    ring = math.pi * (RADIUS**2 - INNER**2)
    clustered = F.get(F.array(*map(F.lit, profile)), F.least(F.floor(F.col("sep") / RING), F.lit(len(profile) - 1)).cast("int"))
    around = F.sum(F.when(F.col("sep") > INNER, 1.0).otherwise(0.0)).over(W.partitionBy("specz_id"))
    pairs = pairs.join(F.broadcast(lists), "list").withColumn("dens", (around + dense * ring) / (2 * ring) * clustered + 1e-9)
    like = F.exp(-F.col("sep") ** 2 / (2 * F.col("sigma") ** 2)) / (2 * math.pi * F.col("sigma") ** 2)
    pairs = pairs.withColumn("l", F.col("prior") * like / F.col("dens") * weight[F.col("cls")])
    return pairs.withColumn("e", F.col("l") / (1.0 - F.col("prior") + F.col("l"))).drop("l", "dens", "prior")


def posted(v: DataFrame) -> DataFrame:
    """Pairs with the rules that concern them: ``s_l`` and ``s_r``, the agreement with the object's entry before and after in order of redshift (null: no rule), ``ex``, whether exclusivity can bind, ``block``, and ``left``, what an entry's pairs without evidence leave for this one."""
    big = v.groupBy("object_id").count().filter(F.col("count") > BLOCK).select("object_id", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
    v = v.join(small(big, GROUPS), "object_id", "left").withColumn("block", F.when(F.col("nb").isNotNull(), F.pmod(F.xxhash64("specz_id"), F.col("nb"))).otherwise(0).cast("int")).drop("nb")
    by = W.partitionBy("object_id", "block").orderBy("z", "specz_id")
    it = F.struct("z", "e_ra", "e_dec", "sigma", "e")
    v = v.withColumns({"_l": F.lag(it).over(by), "_r": F.lead(it).over(by)})

    def agreement(o: Column) -> Column:
        turn = F.abs(o["e_ra"] - F.col("e_ra"))
        dx = F.least(turn, 360.0 - turn) * F.cos(F.radians((o["e_dec"] + F.col("e_dec")) / 2.0)) * 3600.0
        dy = (o["e_dec"] - F.col("e_dec")) * 3600.0
        dz = (o["z"] - F.col("z")) / (1.0 + (o["z"] + F.col("z")) / 2.0) / SCATTER
        var = F.col("sigma") * F.col("sigma") + o["sigma"] * o["sigma"]
        s = F.exp(-0.5 * (dz * dz / 2.0 + (dx * dx + dy * dy) / var))
        return F.when((s >= SAME) & (F.greatest(F.col("e"), o["e"]) >= LEAST), s)

    v = v.withColumns({"s_l": agreement(F.col("_l")), "s_r": agreement(F.col("_r"))}).drop("_l", "_r", "z", "e_ra", "e_dec", "sigma")
    live, ruled = F.col("e") >= LEAST, F.col("s_l").isNotNull() | F.col("s_r").isNotNull()
    of = W.partitionBy("specz_id")
    bind = (F.count(F.when(live, 1)).over(of) > 1) & ((F.sum(F.when(live, F.col("e"))).over(of) > 1.0) | F.max(live & ruled).over(of))
    left = F.greatest(1.0 - F.coalesce(F.sum(F.when(~live, F.col("e"))).over(of), F.lit(0.0)), F.lit(0.0))
    return v.withColumns({"ex": live & bind, "left": F.when(live, left).otherwise(1.0)})


def _towards(own: Column, other: Column, s: Column) -> Column:
    """One end of a transitivity rule: values further apart than ``1 - s`` move towards each other, by no more than the rule's weight allows."""
    d = own - other
    return own - F.signum(d) * F.least(F.lit(TRANSITIVITY / RHO), F.greatest((F.abs(d) - (1.0 - s)) / 2.0, F.lit(0.0)))


def _step(v: DataFrame) -> DataFrame:
    """One round. ``y``: the consensus; ``u0``, ``uq``, ``ul``, ``ur``: scaled duals of the copies of similarity, exclusivity and both transitivity rules; ``q``: the copy of exclusivity; ``r``: the residual."""
    c = F.col
    by = W.partitionBy("object_id", "block").orderBy("n")
    v = v.withColumns({"_a": F.lag(c("y") - c("ur")).over(by), "_b": F.lead(c("y") - c("ul")).over(by)})
    left = F.when(c("s_l").isNotNull(), _towards(c("y") - c("ul"), c("_a"), c("s_l")))
    right = F.when(c("s_r").isNotNull(), _towards(c("y") - c("ur"), c("_b"), c("s_r")))
    off = c("y") - c("u0") - c("e")
    v = v.withColumns({"xl": left, "xr": right, "x0": c("e") + F.signum(off) * F.greatest(F.abs(off) - c("w") / RHO, F.lit(0.0)), "_q": c("y") - c("uq")})
    of = W.partitionBy("specz_id", "ex")
    ranked = of.orderBy(c("_q").desc(), "object_id")
    run = ranked.rowsBetween(W.unboundedPreceding, W.currentRow)
    v = v.withColumn("_k", (F.sum("_q").over(run) - 1.0) / F.row_number().over(ranked))
    v = v.withColumn("q", F.when(c("ex"), F.greatest(c("_q") - F.greatest(F.max("_k").over(of), F.lit(0.0)), F.lit(0.0))))
    copies = [("x0", "u0"), ("q", "uq"), ("xl", "ul"), ("xr", "ur")]
    total = sum(F.coalesce(c(x) + c(u), F.lit(0.0)) for x, u in copies)
    mean = total / sum(F.when(c(x).isNotNull(), 1).otherwise(0) for x, _ in copies)
    new = F.when(c("e") < LEAST, c("e")).otherwise(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)))
    v = v.withColumn("_y", new)
    apart = [F.abs(c("_y") - c("y")), *[F.coalesce(F.abs(c(x) - c("_y")), F.lit(0.0)) for x, _ in copies]]
    v = v.withColumns({"r": F.when(c("e") < LEAST, F.lit(0.0)).otherwise(F.greatest(*apart)), **{u: F.coalesce(c(u) + c(x) - c("_y"), F.lit(0.0)) for x, u in copies}})
    return v.withColumn("y", c("_y")).drop("_a", "_b", "_q", "_k", "_y", "x0", "xl", "xr")


def solved(v: DataFrame) -> DataFrame:
    """``(object_id, specz_id, confidence)`` of the pairs that several rules concern."""
    odds = F.abs(F.log(F.greatest("e", F.lit(1e-9)) / F.greatest(1.0 - F.col("e"), F.lit(1e-9))))
    v = v.withColumns({"n": F.row_number().over(W.partitionBy("object_id", "block").orderBy("place")), "w": F.least(F.greatest(odds, F.lit(0.1)), F.lit(8.0)), "y": F.col("e"), **{u: F.lit(0.0) for u in ("u0", "uq", "ul", "ur")}})
    v = cut(v.select("object_id", "specz_id", "block", "n", "e", "w", "s_l", "s_r", "ex", "y", "u0", "uq", "ul", "ur", F.lit(None).cast("double").alias("q"), F.lit(1.0).alias("r")))
    for i in range(STEPS):
        v = _step(v)
        if (i + 1) % CUT_EVERY == 0:
            v = cut(v)
            if (v.agg(F.max("r")).first()[0] or 0.0) < TOLERANCE:
                break
    return v.select("object_id", "specz_id", F.coalesce("q", "y").alias("solved"))


def link(catalog: DataFrame, specz: DataFrame) -> DataFrame:
    """``(object_id, specz_id, confidence, sep_arcsec, evidence)`` of every candidate pair.

    Rows without a key or a usable position, and objects without any, are in no pair; a missing or unusable redshift leaves
    the position alone to speak. Repeated entries are entries of their own; a repeated ``specz_id`` keeps all its
    positions and one redshift. Empty tables give no rows.
    """
    ent = cut(entries(specz))
    pairs = cut(candidates(catalog.filter(F.col("object_id").isNotNull()), ent))
    v = cut(posted(evidence(pairs, ent).select("object_id", "specz_id", "sep", "e", "z", "e_ra", "e_dec", "sigma", F.struct("z", "specz_id").alias("place"))))
    ruled = v.filter(F.col("ex") | F.col("s_l").isNotNull() | F.col("s_r").isNotNull())
    if ruled.isEmpty():
        return v.select("object_id", "specz_id", (F.col("e") * F.col("left")).alias("confidence"), F.col("sep").alias("sep_arcsec"), F.col("e").alias("evidence"))
    v = v.join(solved(ruled), ["object_id", "specz_id"], "left")
    return v.select("object_id", "specz_id", (F.coalesce("solved", "e") * F.col("left")).alias("confidence"), F.col("sep").alias("sep_arcsec"), F.col("e").alias("evidence"))


def matches(links: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The most confident object of each entry, if its confidence reaches the threshold (then larger evidence, smaller id)."""
    best = F.max(F.struct("confidence", "evidence", (-F.col("object_id")).alias("o"), "sep_arcsec"))
    return links.groupBy("specz_id").agg(best.alias("b")).filter(F.col("b.confidence") >= threshold).select((-F.col("b.o")).alias("object_id"), "specz_id", F.col("b.confidence").alias("confidence"), F.col("b.sep_arcsec").alias("sep_arcsec"))
