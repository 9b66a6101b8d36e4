"""Mixing sources to target weights, measured in tokens.

The size of a mix is the largest at which every source can hold its share with at most its number of repeats. Each
document's expected number of copies is proportional to its weight (1 unless given) and at most the source's repeats; its
whole part is allocated with certainty. The rest of a source's tokens is drawn by Pareto order sampling: documents are
ranked by random odds ``U / (1 - U)`` over inclusion odds ``p / (1 - p)``, ``p`` being the fractional part, and taken in
that order until the source's remaining tokens are reached, to the nearest document.

No source is sorted in one place: ranks fall into ``BUCKETS`` buckets whose token sums say in which one the limit lies;
only that bucket's rows (one of ``BUCKETS``) are ordered exactly. ``U`` is a hash of document, mix and seed, so a lost
task redraws the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.llm.encode import count_tokens
from skyloom.session import cut

#: Buckets of ranks, and buckets of an octave of weights.
BUCKETS, PER_OCTAVE = 8192, 16
#: Most rows of the table of targets (it is collected and broadcast).
MAX_TARGETS = 100_000


def source_label(c: Column) -> Column:
    """A source's name without case and outer blanks; null stays null and belongs to no mix."""
    return F.lower(F.trim(c))


def _targets(targets: DataFrame) -> list[dict]:
    t = targets.select("mix_name", source_label(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
    rows = [r.asDict() for r in t.groupBy("mix_name", "source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).limit(MAX_TARGETS + 1).collect()]
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return [r for r in rows if r["mix_name"] is not None and r["source"] is not None and r["share"] and r["share"] > 0 and r["cap"] and r["cap"] > 0]


def _rate(hist: list[tuple[float, float]], cap: int, goal: float) -> float:
    """Copies per unit of weight at which the expected tokens reach ``goal``. ``hist``: (weight, tokens)."""
    lo, hi = 0.0, cap / min(w for w, _ in hist)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap, mid * w) * t for w, t in hist) < goal else (lo, mid)
    return hi


def plan(hists: dict[str, list[tuple[float, float]]], targets: list[dict]) -> list[dict]:
    """Goal in tokens and rate of every (mix, source). A source without tokens gets nothing and limits nothing; the others keep their proportions."""
    out = []
    for name in sorted({t["mix_name"] for t in targets}):
        own = [t for t in targets if t["mix_name"] == name]
        live = [t for t in own if hists.get(t["source"])]
        size = min((t["cap"] * sum(x for _, x in hists[t["source"]]) / t["share"] for t in live), default=0.0)
        for t in own:
            goal = t["share"] * size if t in live else 0.0
            rate = _rate(hists[t["source"]], t["cap"], goal) if t in live else 0.0
            if t in live and len(hists[t["source"]]) == 1:  # equal weights: no search needed
                w, x = hists[t["source"]][0]
                rate = min(goal / x, t["cap"]) / w
            out.append(t | {"goal": goal, "rate": rate})
    return out


def token_sizes(docs: DataFrame, weight: Column | None = None, **tokenizer) -> DataFrame:
    """``(doc_id, source, n_tokens, weight)`` of documents with a key, a source, tokens and a finite positive weight; materialised."""
    keep = {"source": source_label(F.col("source")), "weight": (weight if weight is not None else F.lit(1.0)).cast("double")}
    ok = "doc_id is not null and n_tokens > 0 and source is not null and weight > 0 and weight < double('Infinity')"
    return cut(count_tokens(docs, keep=keep, **tokenizer).filter(ok).dropDuplicates(["doc_id"]))


def draw(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``(mix_name, source, doc_id, n_tokens, copies)`` of every document that a mix holds, ``copies`` at most the source's repeats.

    Documents of sources that a mix does not name are not in it. Empty tables give no rows.
    """
    spark = sizes.sparkSession
    bins = sizes.groupBy("source", F.floor(F.log2("weight") * PER_OCTAVE).alias("b")).agg(F.sum("n_tokens").alias("t"), (F.sum(F.col("weight") * F.col("n_tokens")) / F.sum("n_tokens")).alias("w"))
    wanted = _targets(targets)
    named = sorted({t["source"] for t in wanted})
    hists: dict[str, list[tuple[float, float]]] = {}
    for r in bins.filter(F.col("source").isin(named)).collect() if named else []:
        hists.setdefault(r["source"], []).append((r["w"], float(r["t"])))
    rows = [(p["mix_name"], p["source"], int(p["cap"]), float(p["goal"]), float(p["rate"])) for p in plan(hists, wanted)]
    rules = F.broadcast(spark.createDataFrame(rows, "mix_name string, source string, cap int, goal double, rate double"))
    d = sizes.join(rules.filter("goal > 0"), "source").withColumn("q", F.least(F.col("rate") * F.col("weight"), F.col("cap").cast("double")))
    d = d.withColumn("whole", F.floor(F.col("q") + 1e-9)).withColumn("p", F.greatest(F.col("q") - F.col("whole"), F.lit(0.0)))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "mix_name", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    odds = u / (1.0 - u) * (1.0 - F.col("p")) / F.col("p")
    d = d.withColumn("v", F.when(F.col("p") > 1e-9, odds / (1.0 + odds)))
    d = d.withColumn("bucket", F.least(F.floor(F.col("v") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    per = d.groupBy("mix_name", "source", "bucket").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("sure"), F.sum("n_tokens").alias("t"), F.first("goal").alias("goal"))
    group = W.partitionBy("mix_name", "source")
    upto = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = per.withColumn("left", F.col("goal") - F.sum("sure").over(group)).withColumn("before", F.sum(F.when(F.col("bucket").isNotNull(), F.col("t")).otherwise(0)).over(upto) - F.when(F.col("bucket").isNotNull(), F.col("t")).otherwise(0))
    limit = per.filter(F.col("bucket").isNotNull() & (F.col("before") < F.col("left"))).groupBy("mix_name", "source").agg(F.max(F.struct("bucket", "before", "left")).alias("m")).select("mix_name", "source", F.col("m.bucket").alias("edge"), F.col("m.before").alias("before"), F.col("m.left").alias("left"))
    d = d.join(F.broadcast(limit), ["mix_name", "source"], "left")
    sure = d.filter(F.col("edge").isNull() | F.col("bucket").isNull() | (F.col("bucket") != F.col("edge")))
    sure = sure.withColumn("extra", F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0))
    run = W.partitionBy("mix_name", "source").orderBy("v", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = d.filter(F.col("bucket") == F.col("edge")).withColumn("upto", F.col("before") + F.sum("n_tokens").over(run))
    last = last.withColumn("extra", F.when(F.col("upto") - F.col("n_tokens") / 2.0 <= F.col("left"), 1).otherwise(0)).drop("upto")
    out = sure.unionByName(last).withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int"))
    return out.filter("copies > 0").select("mix_name", "source", "doc_id", "n_tokens", "copies")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_name, source, target_share, reached_share, tokens, documents, most_copies)``, a row per target, zeros where nothing was drawn."""
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    t = targets.select("mix_name", source_label(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share")).groupBy("mix_name", "source").agg(F.sum("share").alias("target_share"))
    out = t.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_copies"])
    total = F.sum("tokens").over(W.partitionBy("mix_name"))
    return out.select("mix_name", "source", "target_share", F.when(total > 0, F.col("tokens") / total).alias("reached_share"), "tokens", "documents", "most_copies")


