"""Queries of this package, ``name -> (session, folder) -> DataFrame``, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.llm import mix, sketch
from skyloom.llm.encode import encode_corpus
from skyloom.llm.linkage import RADIUS, link, matches
from skyloom.llm.lookalike import canonical_text, lookalike_pairs
from skyloom.llm.neighbours import nearest_vectors
from skyloom.llm.survivor import FIELDS, MEASURES, best_rows, fused_objects
from skyloom.session import cut, table

PERCENTILES = [0.001, 0.01, 0.05, 0.16, 0.25, 0.5, 0.75, 0.84, 0.95, 0.99, 0.999]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    won = best_rows(table(spark, d, "galaxy_catalog"), table(spark, d, "specz_source"), [])
    return won.filter("n_rows > 1").select("object_id", "record_id", F.when(F.col("usable"), "spec").otherwise("phot").alias("redshift_source"))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return fused_objects(table(spark, d, "galaxy_catalog"), table(spark, d, "specz_source"))


def _p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Measured values by type, column and day. A fit delivered twice counts once; versions without a fit have no type and take no part; null labels are a group."""
    fits = table(spark, d, "photoz_result").select(F.col("id").alias("record_id"), F.lower(F.trim("galaxy_type")).alias("t")).filter("record_id is not null").groupBy("record_id").agg(F.max("t").alias("galaxy_type"))
    g = table(spark, d, "galaxy_catalog").select(
        "record_id", "run_day",
        sketch.measurement(F.col("r_half_arcsec"), [99.0, 999.0, 9999.0], 0.0, 3600.0).alias("r"),
        sketch.measurement(F.col("redshift"), [], 0.0, 8.0).alias("z"),
    )
    rows = g.join(fits, "record_id")
    pair = F.array(F.struct(F.lit("r_half_arcsec").alias("metric"), F.col("r").alias("value")), F.struct(F.lit("redshift").alias("metric"), F.col("z").alias("value")))
    return rows.select("galaxy_type", "run_day", F.inline(pair))


def p2_day_sketches(spark: SparkSession, d: str) -> DataFrame:
    return sketch.build_sketches(_p2_values(spark, d), ["galaxy_type", "metric", "run_day"])


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Over all days, from the sketches of single days."""
    keys = ["galaxy_type", "metric"]
    return sketch.percentiles(sketch.merge_sketches(p2_day_sketches(spark, d), keys), keys, PERCENTILES)


def p2_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Of every calendar month, from the sketches of its days."""
    keys = ["galaxy_type", "metric", "month"]
    days = p2_day_sketches(spark, d).withColumn("month", F.trunc("run_day", "month"))
    return sketch.percentiles(sketch.merge_sketches(days, keys), keys, PERCENTILES)


def p2_audit(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles of ``p2_percentiles`` beside the exact ones, and whether these lie between the stated bounds."""
    keys = ["galaxy_type", "metric"]
    disc = F.map_from_arrays(F.array(*map(F.lit, PERCENTILES)), F.array(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)") for p in PERCENTILES]))
    exact = _p2_values(spark, d).filter("value is not null").groupBy(*keys).agg(F.count("value").alias("rows"), disc.alias("m")).select(*keys, "rows", F.explode("m").alias("p", "exact"))
    got = p2_percentiles(spark, d).alias("g")
    j = got.join(exact.alias("e"), [F.col(f"g.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys] + [F.col("g.p") == F.col("e.p")])
    within = F.col("exact").between(F.col("value_lo"), F.col("value_hi")) & (F.col("n") == F.col("rows"))
    return j.select("g.galaxy_type", "g.metric", "g.p", "n", F.col("exact").alias("value"), within.alias("within"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest_vectors(table(spark, d, "zoobot_embedding"), 6, size=8)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the lists of six that are all but identical."""
    near = p3_neighbours(spark, d).filter("cos >= 0.9999")
    return near.select(F.least("id", "near_id").alias("emb_id_1"), F.greatest("id", "near_id").alias("emb_id_2")).distinct()


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return matches(link(table(spark, d, "galaxy_catalog"), table(spark, d, "specz_catalog")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_links(spark, d).select("object_id", "specz_id")


def p5_audit(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: entries matched twice, confidences outside [0, 1] or summing to more than 1 for an entry, matches without confidence of a half."""
    links = cut(link(table(spark, d, "galaxy_catalog"), table(spark, d, "specz_catalog")))
    found = matches(links)
    twice = found.groupBy("specz_id").count().agg(F.count_if(F.col("count") > 1).alias("entries_twice"), F.max(F.lit(1)).alias("one"))
    sums = links.groupBy("specz_id").agg(F.sum("confidence").alias("s")).agg(F.count_if(F.col("s") > 1.0001).alias("sums_above_one"), F.max(F.lit(1)).alias("one"))
    rest = links.agg(F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("out_of_range"), F.count_if(F.col("sep_arcsec") > RADIUS).alias("too_far"), F.max(F.lit(1)).alias("one"))
    low = found.agg(F.count_if(F.col("confidence") < 0.5).alias("unsure"), F.max(F.lit(1)).alias("one"))
    return twice.join(sums, "one").join(rest, "one").join(low, "one").drop("one")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.draw(mix.token_sizes(table(spark, d, "documents")), table(spark, d, "mix_target"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(p7_mix(spark, d), table(spark, d, "mix_target"))


def _weighted_sizes(spark: SparkSession, d: str) -> DataFrame:
    return mix.token_sizes(table(spark, d, "documents"), F.when(F.lower(F.trim("lang")) == "en", 2.0).otherwise(1.0))


def p7_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The same mixes with unequal inclusion probabilities: English documents count twice."""
    return mix.draw(_weighted_sizes(spark, d), table(spark, d, "mix_target"))


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """Of every target: whether the weighted draw keeps the cap on repeats, and reaches the share (among the mix's sources that have documents) to the nearest document: each source ends within half of its longest one."""
    t, sizes = table(spark, d, "mix_target"), _weighted_sizes(spark, d)
    s = mix.shares(mix.draw(sizes, t), t)
    caps = t.select("mix_name", mix.source_label(F.col("source")).alias("source"), "max_repeats").groupBy("mix_name", "source").agg(F.max("max_repeats").alias("cap"))
    s = s.join(caps, ["mix_name", "source"]).join(sizes.groupBy("source").agg((F.max("n_tokens") / 2.0).alias("half")), "source", "left").fillna(0.0, ["half"])
    of = W.partitionBy("mix_name")
    live = F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)
    s = s.withColumns({"wanted": live / F.sum(live).over(of), "total": F.sum("tokens").over(of), "slack": F.sum("half").over(of)})
    near = F.abs(F.col("tokens") - F.col("wanted") * F.col("total")) <= F.col("half") + F.col("wanted") * F.col("slack") + 1.0
    return s.select("mix_name", "source", F.round("target_share", 9).alias("target_share"), (F.col("most_copies") <= F.col("cap")).alias("capped"), near.alias("on_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "documents"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical_text(table(spark, d, "documents"))


_NEWEST = {f: f"isfinite({f})" for f in FIELDS} | {"r_half_arcsec": "isfinite(r_half_arcsec) AND r_half_arcsec > 0 AND r_half_arcsec < 9999", "field_id": "field_id IS NOT NULL"}
_PLACE = "isfinite(ra) AND isfinite(dec) AND abs(dec) <= 90"
_Z = "isfinite({0}) AND {0} > 0 AND {0} <= 8"


#: The same reasoning over the learned edges; an order of more steps than one is not closed transitively here.
_SURVIVORS = """
        WITH t AS (SELECT regexp_replace(lower(source_name), '[\\s_-]+', '', 'g') AS src, min(trust_rank) AS trust FROM specz_source GROUP BY 1),
        l AS (SELECT c.*, coalesce(epoch_us(updated_at), -4e18::bigint) AS u, regexp_replace(lower(z_spec_source), '[\\s_-]+', '', 'g') AS src,
            nullif(regexp_replace(lower(c.sed_morphology), '[\\s_-]+', '', 'g'), '') AS sed, n_bands::varchar AS nb,
            CASE WHEN regexp_replace(lower(c.redshift_source), '[\\s_-]+', '', 'g') IN ('s', 'spec', 'specz', 'spectroscopic') THEN 'spec' WHEN regexp_replace(lower(c.redshift_source), '[\\s_-]+', '', 'g') IN ('p', 'phot', 'photoz', 'photometric') THEN 'phot' END AS org
          FROM galaxy_catalog c WHERE object_id IS NOT NULL),
        p AS (SELECT * FROM (SELECT object_id, record_id, updated_at, u, unnest(['sed', 'nb', 'org']) AS a, unnest([sed, nb, org]) AS v FROM l) WHERE v IS NOT NULL),
        s AS (SELECT object_id, a, v, min(updated_at) AS f FROM p WHERE updated_at IS NOT NULL GROUP BY ALL),
        x AS (SELECT a, v AS x, lead(v) OVER w AS y, f, lead(f) OVER w AS g FROM s WINDOW w AS (PARTITION BY object_id, a ORDER BY f, v)),
        n AS (SELECT a, x, y, count(*) AS k FROM x WHERE g > f GROUP BY ALL),
        e AS (SELECT n.a, n.x, n.y FROM n LEFT JOIN n m ON m.a = n.a AND m.x = n.y AND m.y = n.x WHERE n.k + coalesce(m.k, 0) >= 10 AND n.k - coalesce(m.k, 0) >= 3 * sqrt(n.k + coalesce(m.k, 0))),
        per AS (SELECT object_id, a, v, max(CASE WHEN updated_at IS NOT NULL THEN row(u, -record_id) END) AS last, count(*) FILTER (updated_at IS NULL) AS c FROM p GROUP BY ALL),
        d AS (SELECT object_id, a, arg_max(v, last) FILTER (last IS NOT NULL) AS dated FROM per GROUP BY ALL),
        fr AS (SELECT per.object_id, per.a, per.v, c FROM per JOIN d USING (object_id, a) WHERE c > 0 AND (dated IS NULL OR EXISTS (SELECT 1 FROM e WHERE e.a = per.a AND e.x = dated AND e.y = per.v))),
        b AS (SELECT object_id, a, arg_min(v, row(-c, v)) AS v FROM fr WHERE NOT EXISTS (SELECT 1 FROM fr g JOIN e ON e.a = g.a AND e.y = g.v WHERE g.object_id = fr.object_id AND g.a = fr.a AND e.x = fr.v) GROUP BY ALL),
        lat AS (SELECT object_id, a, dated, coalesce(b.v, dated) AS v, CASE WHEN dated IS NULL THEN 'undated' WHEN b.v IS NOT NULL THEN 'inferred' ELSE 'dated' END AS how FROM d LEFT JOIN b USING (object_id, a)),
        late AS (SELECT p.record_id FROM p JOIN lat USING (object_id, a) LEFT JOIN e f ON f.a = p.a AND f.x = dated AND f.y = p.v LEFT JOIN e h ON h.a = p.a AND h.x = p.v AND h.y = dated
          WHERE p.updated_at IS NULL GROUP BY 1 HAVING count(f.a) > 0 AND count(h.a) = 0),
        lv AS (SELECT *, row(level, u, -record_id) AS o FROM (SELECT l.*, CASE WHEN updated_at IS NOT NULL THEN 1 WHEN record_id IN (SELECT record_id FROM late) THEN 2 ELSE 0 END AS level FROM l)),
        w AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ok DESC, CASE WHEN ok THEN trust ELSE -n END, level DESC, u DESC, record_id) AS i, count(*) OVER (PARTITION BY object_id) AS n_rows
          FROM (SELECT lv.*, coalesce(t.trust, 2147483648) AS trust, coalesce(""" + _Z.format("z_spec") + """, false) AS ok,
            """ + " + ".join(f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN 1 ELSE 0 END" for c in MEASURES) + """ AS n FROM lv LEFT JOIN t USING (src))),
        best AS (SELECT object_id, record_id, CASE WHEN ok THEN z_spec END AS z_spec, CASE WHEN ok THEN nullif(src, '') END AS z_spec_source, CASE WHEN ok THEN 'spec' ELSE 'phot' END AS redshift_source, updated_at, n_rows FROM w WHERE i = 1),
        m AS (SELECT object_id, """ + ", ".join(f"arg_max({c}, o) FILTER ({ok}) AS {c}, coalesce((max(o) FILTER ({ok}))[1] = 2, false)::int AS i_{c}" for c, ok in _NEWEST.items()) + f""",
            arg_max(row(ra, dec), o) FILTER ({_PLACE}) AS pos, coalesce((max(o) FILTER ({_PLACE}))[1] = 2, false)::int AS i_pos, arg_max(redshift, o) FILTER ({_Z.format("redshift")}) AS zp, coalesce((max(o) FILTER ({_Z.format("redshift")}))[1] = 2, false)::int AS i_zp FROM lv GROUP BY 1),
        k AS (SELECT object_id, """ + ", ".join(f"max(v) FILTER (a = '{a}') AS {c}, max(how) FILTER (a = '{a}') AS {c}_how" for a, c in (("sed", "sed_morphology"), ("nb", "n_bands"), ("org", "recorded_origin"))) + """ FROM lat GROUP BY 1)
        SELECT best.object_id, record_id, z_spec, z_spec_source, coalesce(z_spec, zp) AS redshift, redshift_source, pos[1] AS ra, pos[2] AS dec, field_id, updated_at, n_rows, """ + ", ".join(FIELDS) + """,
          sed_morphology, sed_morphology_how, n_bands::int AS n_bands, n_bands_how, recorded_origin, recorded_origin_how, (i_pos + i_zp + """ + " + ".join(f"i_{c}" for c in _NEWEST) + """)::int AS n_inferred
        FROM best LEFT JOIN m USING (object_id) LEFT JOIN k USING (object_id)
    """


QUERIES = {
    "p1_found": p1_found,
    "p1_survivors": p1_survivors,
    "p2_percentiles": p2_percentiles,
    "p2_day_sketches": p2_day_sketches,
    "p2_monthly": p2_monthly,
    "p2_audit": p2_audit,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p5_audit": p5_audit,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_weighted": p7_weighted,
    "p7_audit": p7_audit,
    "p8_found": p8_found,
    "p8_canonical": p8_canonical,
}

SQL = {
    "p5_audit": "SELECT 0::bigint AS entries_twice, 0::bigint AS sums_above_one, 0::bigint AS out_of_range, 0::bigint AS too_far, 0::bigint AS unsure",
    "p7_audit": "SELECT mix_name, lower(trim(source)) AS source, round(sum(target_share), 9) AS target_share, true AS capped, true AS on_target FROM mix_target GROUP BY 1, 2",
    "p1_survivors": _SURVIVORS,
    "p1_found": """
        WITH t AS (SELECT regexp_replace(lower(source_name), '[\\s_-]+', '', 'g') AS src, min(trust_rank) AS trust FROM specz_source GROUP BY 1),
        g AS (
          SELECT c.object_id, c.record_id, c.updated_at, coalesce(t.trust, 2147483648) AS trust,
                 coalesce(c.z_spec > 0 AND c.z_spec <= 8 AND NOT isnan(c.z_spec), false) AS ok,
                 """ + " + ".join(f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN 1 ELSE 0 END" for c in ("redshift", "r_half_arcsec", "concentration", "gini", "sersic_n", "flux_f300", "flux_f814")) + """ AS n
          FROM galaxy_catalog c LEFT JOIN t ON regexp_replace(lower(c.z_spec_source), '[\\s_-]+', '', 'g') = t.src),
        r AS (
          SELECT *, count(*) OVER (PARTITION BY object_id) AS k,
                 row_number() OVER (PARTITION BY object_id ORDER BY ok DESC, CASE WHEN ok THEN trust ELSE -n END, updated_at DESC NULLS LAST, record_id) AS i
          FROM g WHERE object_id IS NOT NULL)
        SELECT object_id, record_id, CASE WHEN ok THEN 'spec' ELSE 'phot' END AS redshift_source FROM r WHERE i = 1 AND k > 1
    """,
    "p2_audit": f"""
        WITH f AS (SELECT id, max(lower(trim(galaxy_type))) AS galaxy_type FROM photoz_result WHERE id IS NOT NULL GROUP BY 1),
        v AS (SELECT galaxy_type, 'r_half_arcsec' AS metric, r_half_arcsec AS x FROM galaxy_catalog JOIN f ON id = record_id WHERE r_half_arcsec > 0 AND r_half_arcsec <= 3600 AND r_half_arcsec NOT IN (99, 999, 9999)
          UNION ALL SELECT galaxy_type, 'redshift', redshift FROM galaxy_catalog JOIN f ON id = record_id WHERE redshift > 0 AND redshift <= 8),
        r AS (SELECT *, row_number() OVER g AS k, count(*) OVER (PARTITION BY galaxy_type, metric) AS n FROM v WINDOW g AS (PARTITION BY galaxy_type, metric ORDER BY x))
        SELECT galaxy_type, metric, p, n, x AS value, true AS within FROM r, (SELECT unnest({PERCENTILES})::double AS p) WHERE k = greatest(1, ceil(p * n))
    """,
    "p3_found": """
        WITH v AS (SELECT emb_id, embeddings::double[] AS e FROM zoobot_embedding WHERE len(embeddings) = 8 AND list_bool_and(list_transform(embeddings, lambda x: isfinite(x))) AND list_bool_or(list_transform(embeddings, lambda x: x != 0))),
        u AS (SELECT emb_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v),
        p AS (SELECT a.emb_id AS a, b.emb_id AS b, """ + " + ".join(f"a.u[{i}] * b.u[{i}]" for i in range(1, 9)) + """ AS c FROM u a JOIN u b ON a.emb_id != b.emb_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM p)
        SELECT DISTINCT least(a, b) AS emb_id_1, greatest(a, b) AS emb_id_2 FROM r WHERE k <= 6 AND c >= 0.9999
    """,
}
