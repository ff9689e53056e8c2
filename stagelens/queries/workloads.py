"""Workloads of the kind whose logs the engine reads, over the star schema."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import readable as R
from ..sources.shared import new_folder
from . import surrogate as X
from .registry import query, rounded


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return X.table(spark, sf_dir, name)


@query(f"SELECT l_returnflag, {rounded('sum(l_quantity)', 2)} AS qty FROM lineitem GROUP BY 1 ORDER BY 1")
def w01_group_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(R.exact_round(F.sum("l_quantity"), 2).alias("qty")).orderBy("l_returnflag")


@query("SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS tag FROM orders")
def w02_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("tag"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def w03_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(_t(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT n1.n_name, count(s_suppkey) AS n FROM nation n1 LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey > n1.n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def w04_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    s = _t(spark, sf_dir, "supplier")
    return n.join(s, (F.col("s_nationkey") > F.col("n_nationkey")) & (F.col("s_acctbal") > 5000), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query(f"SELECT n_name, count(*) AS n, {rounded('sum(c_acctbal)', 2)} AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def w05_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.groupBy("n_name").agg(F.count("*").alias("n"), R.exact_round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"""WITH a AS (SELECT o_custkey, o_orderstatus || '-' || o_orderpriority AS tag, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, o_totalprice, o_orderkey FROM orders),
g AS (SELECT o_custkey, size, count(*) AS n, {rounded('sum(o_totalprice)', 2)} AS total, min(regexp_replace(tag, '[0-9]-', '')) AS tag FROM a GROUP BY 1, 2)
SELECT * FROM (SELECT *, rank() OVER (PARTITION BY size ORDER BY total DESC, o_custkey) AS r FROM g) WHERE r <= 20""")
def w06_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_custkey", F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("tag"), F.when(F.col("o_totalprice") > 100000, "big").otherwise("small").alias("size"), "o_totalprice")
    g = o.groupBy("o_custkey", "size").agg(F.count("*").alias("n"), R.exact_round(F.sum("o_totalprice"), 2).alias("total"), F.min(F.regexp_replace("tag", "[0-9]-", "")).alias("tag"))
    return g.withColumn("r", F.rank().over(Window.partitionBy("size").orderBy(F.desc("total"), "o_custkey"))).where("r <= 20").withColumn("r", F.col("r").cast("bigint"))


@query("SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys FROM (SELECT a.o_custkey, count(*) AS n FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey GROUP BY 1)")
def w07_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "orders").select("o_custkey")
    return a.join(a, "o_custkey", "left").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("keys"))


@query("SELECT l_shipmode, count(*) AS n FROM (SELECT l_linestatus AS l_shipmode FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000) GROUP BY 1")
def w08_limit_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(1000).groupBy(F.col("l_linestatus").alias("l_shipmode")).agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS k FROM orders) SELECT h.k, count(*) AS n FROM h JOIN (SELECT DISTINCT k FROM h) d ON d.k = h.k GROUP BY 1")
def w09_skew_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _t(spark, sf_dir, "orders").select(F.when(F.pmod("o_custkey", F.lit(3)) == 0, 0).otherwise(F.col("o_custkey")).cast("bigint").alias("k"))
    return h.join(h.distinct(), "k").groupBy("k").agg(F.count("*").alias("n"))


@query(f"SELECT r_name, n_name, count(*) AS n, {rounded('sum(o_totalprice)', 1)} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def w10_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), R.exact_round(F.sum("o_totalprice"), 1).alias("total"))


@query("SELECT p_brand AS k, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part GROUP BY 1")
def w11_repeated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias("n")).unionByName(p.groupBy(F.col("p_type").alias("k")).agg(F.count("*").alias("n")))


@query(f"SELECT l_suppkey, count(*) AS n, {rounded('sum(l_extendedprice)', 1)} AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def w12_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders").select("o_orderkey")
    return li.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey").agg(F.count("*").alias("n"), R.exact_round(F.sum("l_extendedprice"), 1).alias("price"))


@query(f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n, {rounded('sum(l_quantity)', 2)} AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def w13_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("bigint").alias("g"), F.count("*").alias("n"), R.exact_round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT o_orderkey, CAST(o_orderkey * 2 AS BIGINT) AS twice FROM orders")
def w14_pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("bigint")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    return _t(spark, sf_dir, "orders").select("o_orderkey", twice("o_orderkey").alias("twice"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN (SELECT max(o_orderstatus) FROM orders) GROUP BY 1")
def w15_partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written by status, joined with one status that is known at run time: the other folders aren't read."""
    o, path = _t(spark, sf_dir, "orders"), new_folder(spark, "by-status")
    o.select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    dim = o.agg(F.max("o_orderstatus").alias("status")).where("status is not null")
    by_status = spark.read.schema("o_orderkey long, o_orderstatus string").parquet(path)
    return by_status.join(F.broadcast(dim), F.col("o_orderstatus") == F.col("status")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))  # dim has one row


@query("SELECT count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS last FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def w16_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    return orders.where(F.col("o_totalprice") > orders.agg(F.avg("o_totalprice")).scalar()).agg(F.count("*").alias("n"), F.max("o_orderkey").cast("bigint").alias("last"))


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS rank FROM customer) WHERE rank <= 3")
def w16_window_group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_custkey"))
    return _t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.rank().over(w).cast("bigint").alias("rank")).where("rank <= 3")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def w16_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, count(*) FROM nation GROUP BY 1")
def w16_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table that is cached and asked twice."""
    nation = _t(spark, sf_dir, "nation").select("n_regionkey").cache()  # 25 rows
    counts = nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return counts.unionByName(counts)


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 10 GROUP BY 1 UNION ALL SELECT n_regionkey + 100, count(*) FROM nation GROUP BY 1")
def w16_write_append_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is written, appended to, and of which one partition is written over."""
    n, path = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long")), new_folder(spark, "nations")
    half = n.where("n_nationkey < 10")
    half.withColumn("kind", F.lit("half")).write.partitionBy("kind").parquet(path)
    n.where("n_nationkey >= 3").withColumn("kind", F.lit("whole")).write.mode("append").partitionBy("kind").parquet(path)
    n.withColumn("kind", F.lit("whole")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)
    rows = spark.read.schema("n_regionkey long, n_nationkey long, kind string").parquet(path)
    return rows.groupBy((F.col("n_regionkey") + F.when(F.col("kind") == "whole", 100).otherwise(0)).alias("n_regionkey")).agg(F.count("*").alias("n"))


@query("SELECT range AS id, range % 3 AS k FROM range(0, 100)")
def w16_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 100, 1, 4).select("id", (F.col("id") % 3).alias("k"))


@query()
def w16_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").sample(False, 0.5, 42).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines, max(l_linestatus) AS status FROM (SELECT DISTINCT l_returnflag, l_linenumber, l_linestatus FROM lineitem) GROUP BY 1")
def w16_object_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_linestatus").distinct()
    return rows.groupBy("l_returnflag").agg(F.array_join(F.sort_array(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("lines"), F.max("l_linestatus").alias("status"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def w16_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "region").select("r_name").crossJoin(_t(spark, sf_dir, "nation").select("n_name"))  # 5 and 25 rows


@query("SELECT n_nationkey, n_name, upper(n_name) AS big FROM nation")
def w16_map_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def big(batches):
        for b in batches:
            yield b.assign(big=b.n_name.str.upper())

    return _t(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(big, "n_nationkey int, n_name string, big string")


@query("SELECT c_nationkey, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1")
def w16_grouped_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_nationkey": [key[0]], "n": [len(rows)], "last": [rows.c_custkey.max()]})

    return _t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").groupBy("c_nationkey").applyInPandas(one, "c_nationkey int, n long, last long")


@query("SELECT c_nationkey AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey")
def w16_cogrouped_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [len(a)], "suppliers": [len(b)]}) if len(a) and len(b) else pd.DataFrame({"k": [], "customers": [], "suppliers": []})

    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.groupBy("k").cogroup(s.groupBy("k")).applyInPandas(one, "k int, customers long, suppliers long")


@query("SELECT r_regionkey AS id, r_regionkey * 2 AS doubled FROM region")
def w17_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="id int, doubled int")
    class Double:
        def eval(self, id: int):
            yield id, id * 2

    spark.udtf.register("stagelens_double", Double)
    _t(spark, sf_dir, "region").createOrReplaceTempView("stagelens_region")
    return spark.sql("SELECT d.id, d.doubled FROM stagelens_region, LATERAL stagelens_double(r_regionkey) d")


@query("SELECT c_nationkey, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1")
def w17_grouped_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"c_nationkey": pa.array([key[0].as_py()], pa.int64()), "n": [rows.num_rows], "last": pa.array([pc.max(rows["c_custkey"]).as_py()], pa.int64())})

    customer = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long"), F.col("c_custkey").cast("long"))
    return customer.groupBy("c_nationkey").applyInArrow(one, "c_nationkey long, n long, last long")


@query("SELECT c_nationkey AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey")
def w17_cogrouped_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        both = a.num_rows and b.num_rows
        return pa.table({"k": pa.array([key[0].as_py()] if both else [], pa.int64()), "customers": pa.array([a.num_rows] if both else [], pa.int64()), "suppliers": pa.array([b.num_rows] if both else [], pa.int64())})

    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    return c.groupBy("k").cogroup(s.groupBy("k")).applyInArrow(one, "k long, customers long, suppliers long")


@query("SELECT r_regionkey AS id, r_regionkey * 2 AS doubled FROM region")
def w17_arrow_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="id int, doubled int", useArrow=True)
    class Double:
        def eval(self, id: int):
            yield id, id * 2

    region = _t(spark, sf_dir, "region").select("r_regionkey")
    return region.lateralJoin(Double(F.col("r_regionkey").outer())).select("id", "doubled")


@query(f"SELECT n_name, o_orderpriority, count(*) AS n, {rounded('avg(o_totalprice)', 2)} AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def w18_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), R.exact_round(F.avg("o_totalprice"), 2).alias("mean"))
