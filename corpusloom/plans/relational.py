"""Relational operators on the star tables: joins, aggregates, windows, set operations, top rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def aggregate_filter(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@_query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_inner(spark, sf_dir):
    orders, customers, nations = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(nations, customers["c_nationkey"] == nations["n_nationkey"])
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark, sf_dir):
    counts = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"))


@_query("SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey")
def join_full(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", "customers", "suppliers")


@_query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, sf_dir):
    large = _t(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").join(large, "c_custkey", "left_semi").select("c_custkey")


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark, sf_dir):
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@_query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark, sf_dir):
    return _t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_sums(spark, sf_dir):
    return _t(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))


@_query("SELECT s_nationkey, s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS place FROM supplier QUALIFY place <= 3")
def window_rank(spark, sf_dir):
    order = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return _t(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.rank().over(order).alias("place")).where("place <= 3")


@_query("""SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS before, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_frames(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(order).alias("before"), F.round(F.sum("o_totalprice").over(order.rowsBetween(-2, 0)), 2).alias("last_three"))


@_query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def top_parts(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@_query("SELECT key, side FROM (SELECT c_nationkey AS key, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier)")
def union_rows(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.lit("c").alias("side")).unionByName(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("s").alias("side")))


@_query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).intersect(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")))


@_query("SELECT l_partkey AS key FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 25")
def except_keys(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).subtract(_t(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("key")))
