"""Exact quantiles per group, linear between order statistics, at any size.

Up to ``IN_MEMORY`` rows Spark's ``percentile`` does it in one aggregation. Beyond, its per-group value maps would not fit, so
ranks are found by splitting: the interval that holds a wanted rank is cut into equal parts whose rows are counted, and the
part with the rank becomes the next interval, until it holds one value. Every pass is one aggregation with a bounded key
and a map-side step; no value is gathered or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.session import cut, small

#: Rows up to which the one-pass aggregate is used (its largest map then holds as many values, some 200 MB).
IN_MEMORY = 2_000_000
#: Stand-in of an infinite value while intervals are split.
FAR = 8e307
#: Wanted ranks (groups times quantiles) up to which their table is broadcast.
MAX_RANKS = 200_000


def quantile_column(value: str, ps: list[float]) -> Column:
    """The one-pass aggregate, for use beside others; only for up to ``IN_MEMORY`` rows."""
    v = F.col(value).cast("double")
    return F.percentile(F.when(~F.isnan(v), v), F.array(*[F.lit(float(p)) for p in ps]))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, ps: list[float], in_memory: int = IN_MEMORY, known_rows: int | None = None) -> DataFrame:
    """``(keys, q array<double>)``: the quantiles ``ps`` of the non-null, non-NaN values of each group; a group without any, and a null key, has no row. ``known_rows``, an upper bound of the rows, spares their count."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.dropna(subset=keys) if keys else rows
    n = known_rows if known_rows is not None else rows.count()
    if n <= in_memory:
        return rows.groupBy(*keys).agg(quantile_column("_v", ps).alias("q"))
    return _by_splitting(rows, keys, ps)


def _by_splitting(rows: DataFrame, keys: list[str], ps: list[float], fan: int = 4096, passes: int = 12) -> DataFrame:
    """Order statistics by repeated counting: the interval of every wanted rank is cut into ``fan`` equal parts until it holds one value."""
    rows = rows.withColumn("_v", F.greatest(F.least("_v", F.lit(FAR)), F.lit(-FAR)))
    spread = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    want = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p * (F.col("_n") - 1)), F.ceil(p * (F.col("_n") - 1))) for p in ps])))
    live = spread.select(*keys, F.explode(want).alias("_r"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_n")
    done = None
    for _ in range(passes):
        near = small(live, MAX_RANKS)
        j = rows.join(near, keys) if keys else rows.withColumn("_one", F.lit(1)).join(near.withColumn("_one", F.lit(1)), "_one").drop("_one")
        j = j.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * fan), F.lit(fan - 1))
        c = j.groupBy(*keys, "_r", "_below", "_n", F.coalesce(part, F.lit(0)).alias("_part")).agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = W.partitionBy(*keys, "_r").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
        c = c.withColumn("_upto", F.col("_below") + F.sum("_k").over(w)).filter((F.col("_upto") > F.col("_r")) & (F.col("_upto") - F.col("_k") <= F.col("_r")))
        live = c.select(*keys, "_r", "_lo", "_hi", (F.col("_upto") - F.col("_k")).alias("_below"), "_n")
        live = cut(live)
        if live.filter("_lo < _hi").isEmpty():
            done = live
            break
    if done is None:
        raise ValueError("ranks not resolved")
    found = done.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_lo"))).alias("_m"))
    at = [p * (F.col("_n") - 1) for p in ps]
    back = lambda x: F.when(x >= FAR, float("inf")).when(x <= -FAR, float("-inf")).otherwise(x)
    lo, hi = [back(F.element_at("_m", F.floor(a))) for a in at], [back(F.element_at("_m", F.ceil(a))) for a in at]
    return found.select(*keys, F.array(*[F.when(x == y, x).otherwise(x + (y - x) * (a - F.floor(a))) for a, x, y in zip(at, lo, hi)]).alias("q"))


def quantile_list(df: DataFrame, value: str, ps: list[float]) -> list[float]:
    """The quantiles of a column, on the driver; empty without values."""
    got = exact_quantiles(df, [], value, ps).collect()
    return list(got[0]["q"]) if got and got[0]["q"] is not None else []

