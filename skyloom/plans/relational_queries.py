"""The general relational forms over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skyloom.plans.common import Registry, rounded
from skyloom.session import table

query = Registry()


@query("q_setops", "SELECT c_nationkey AS k, 'both' AS part FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customers' FROM customer EXCEPT SELECT s_nationkey, 'customers' FROM supplier)")
def setops(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("part", F.lit("both")).unionByName(c.subtract(s).withColumn("part", F.lit("customers")))


@query("q_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity"), 2).alias("qty"))


@query("q_window_rank", "SELECT o_custkey, o_orderkey, k::int AS k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def window_rank(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).filter("k <= 3")


@query("q_semi_anti", "SELECT 'with' AS part, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(c.join(o, "c_custkey", "left_semi"), "with").unionByName(count(c.join(o, "c_custkey", "left_anti"), "without"))


@query("q_join_aggregate", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY n_name")
def join_aggregate(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1998-09-02").cast("timestamp_ntz"))
    j = j.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES, SQL = query.queries, query.sql
