"""The driver's tables in the canonical form of telemetry, so that operators run on them as on logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each row of lineitem; a job has stages, a query jobs, all by part."""
    one = table(spark, sf_dir, "lineitem")
    big = lambda c: c.cast("bigint")
    hot = F.when((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 1), 20).otherwise(1)
    return one.select(
        (F.col("l_partkey") % 5).alias("query_id"), (F.col("l_partkey") % 10).alias("job_id"), (F.col("l_partkey") % 40).alias("stage_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("task_id"),
        (F.col("l_suppkey") % 4).cast("string").alias("executor_id"), F.concat(F.lit("host"), (F.col("l_suppkey") % 2).cast("string")).alias("host"), (F.col("l_extendedprice") / 1000.0 * hot).alias("task_duration_seconds"),
        big(F.col("l_quantity") * 1048576).alias("bytes_read"), big(F.col("l_quantity") * 100).alias("records_read"), big(F.when(F.col("l_linestatus") == "F", F.col("l_quantity") * 4096).otherwise(0)).alias("bytes_written"),
        big(F.when(F.col("l_discount") >= 0.09, F.col("l_quantity") * 1024).otherwise(0)).alias("memory_bytes_spilled"), big(F.when(F.col("l_discount") >= 0.1, F.col("l_quantity") * 512).otherwise(0)).alias("disk_bytes_spilled"),
        big(F.when(F.col("l_tax") >= 0.04, F.col("l_quantity") * 65536).otherwise(0)).alias("shuffle_bytes_read"), big(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 32768).otherwise(0)).alias("shuffle_bytes_written"),
        ms("l_shipdate").alias("start_ms"), F.concat(F.lit("s3://bucket/part-"), (F.col("l_partkey") % 25).cast("string"), F.lit(".parquet")).alias("path"),
    )


TASK = """
task AS (SELECT l_partkey % 5 AS query_id, l_partkey % 10 AS job_id, l_partkey % 40 AS stage_id, l_orderkey * 8 + l_linenumber AS task_id,
  CAST(l_suppkey % 4 AS VARCHAR) AS executor_id, 'host' || CAST(l_suppkey % 2 AS VARCHAR) AS host,
  l_extendedprice / 1000.0 * (CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN 20 ELSE 1 END) AS task_duration_seconds,
  CAST(l_quantity * 1048576 AS BIGINT) AS bytes_read, CAST(l_quantity * 100 AS BIGINT) AS records_read,
  CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity * 4096 ELSE 0 END AS BIGINT) AS bytes_written,
  CAST(CASE WHEN l_discount >= 0.09 THEN l_quantity * 1024 ELSE 0 END AS BIGINT) AS memory_bytes_spilled,
  CAST(CASE WHEN l_discount >= 0.1 THEN l_quantity * 512 ELSE 0 END AS BIGINT) AS disk_bytes_spilled,
  CAST(CASE WHEN l_tax >= 0.04 THEN l_quantity * 65536 ELSE 0 END AS BIGINT) AS shuffle_bytes_read,
  CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity * 32768 ELSE 0 END AS BIGINT) AS shuffle_bytes_written,
  epoch_ms(l_shipdate) AS start_ms, 's3://bucket/part-' || CAST(l_partkey % 25 AS VARCHAR) || '.parquet' AS path FROM lineitem)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric update for each event: its kind by the event's type, its accumulator by the user."""
    kind = F.when(F.col("event_type") == "click", "timing").when(F.col("event_type") == "view", "nsTiming").when(F.col("event_type") == "purchase", "size").when(F.col("event_type") == "signup", "sum").otherwise("average")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"), (F.col("user_id") % 20).alias("query_id"), F.col("user_id").alias("accumulator_id"), (F.col("event_id") % 7).alias("node_id"), (F.col("event_id") % 3).alias("stage_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("task_id"), kind.alias("metric_type"), F.col("event_type").alias("metric_name"), F.round(F.col("value") * 1000).cast("bigint").alias("upd"),
    )


METRIC = """
metric AS (SELECT event_id AS line_no, user_id % 20 AS query_id, user_id AS accumulator_id, event_id % 7 AS node_id, event_id % 3 AS stage_id,
  user_id * 10 + event_id % 10 AS task_id,
  CASE event_type WHEN 'click' THEN 'timing' WHEN 'view' THEN 'nsTiming' WHEN 'purchase' THEN 'size' WHEN 'signup' THEN 'sum' ELSE 'average' END AS metric_type,
  event_type AS metric_name, CAST(round(value * 1000) AS BIGINT) AS upd FROM events)"""


def metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metrics() in the long form: update, and as value its running total in the accumulator."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "accumulator_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return metrics(spark, sf_dir).withColumn("value", F.sum("upd").over(w)).withColumnRenamed("upd", "update")


LONG = METRIC + """,
long AS (SELECT *, CAST(sum(upd) OVER (PARTITION BY query_id, accumulator_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM metric)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each order: start from its date, length from its price."""
    start = ms("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 50).alias("query_id"), start.alias("start_ms"), (start + F.round("o_totalprice").cast("bigint") * 60).alias("end_ms"), F.col("o_orderstatus").alias("status"))


JOB = """
job AS (SELECT o_orderkey AS job_id, o_custkey % 50 AS query_id, epoch_ms(o_orderdate) AS start_ms,
  epoch_ms(o_orderdate) + CAST(round(o_totalprice) AS BIGINT) * 60 AS end_ms, o_orderstatus AS status FROM orders)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end events of jobs; starts name two stages."""
    job = jobs(spark, sf_dir)
    start = job.select("job_id", F.lit("start").alias("event_type"), F.col("start_ms").alias("job_timestamp"), F.array(F.col("job_id") * 2, F.col("job_id") * 2 + 1).alias("stages"))
    end = job.select("job_id", F.lit("end").alias("event_type"), F.col("end_ms").alias("job_timestamp"), F.lit(None).cast("array<bigint>").alias("stages"))
    return start.unionByName(end)


def plan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan a nation: region below nation below customers below orders; children in order of their keys."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    key = lambda base, col: F.lit(base).cast("bigint") + F.col(col).cast("bigint")
    oc = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("bigint").alias("query_id"), key(2_000_000_000, "c_custkey").alias("parent_id"), key(1_000_000_000, "o_orderkey").alias("child_id"))
    cn = c.select(F.col("c_nationkey").cast("bigint").alias("query_id"), key(3_000_000_000, "c_nationkey").alias("parent_id"), key(2_000_000_000, "c_custkey").alias("child_id"))
    nr = n.select(F.col("n_nationkey").cast("bigint").alias("query_id"), key(4_000_000_000, "n_regionkey").alias("parent_id"), key(3_000_000_000, "n_nationkey").alias("child_id"))
    return oc.unionByName(cn).unionByName(nr)


EDGES = """
edge AS (
  SELECT CAST(c_nationkey AS BIGINT) AS query_id, 2000000000 + c_custkey AS parent_id, 1000000000 + o_orderkey AS child_id FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT CAST(c_nationkey AS BIGINT), 3000000000 + c_nationkey, 2000000000 + c_custkey FROM customer
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), 4000000000 + n_regionkey, 3000000000 + n_nationkey FROM nation)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a day and priority of orders."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.groupBy(day.alias("run_at"), F.col("o_orderpriority").alias("log_name")).agg(F.count("*").alias("n_tasks"), F.sum(F.round("o_totalprice").cast("bigint")).alias("bytes_read"), F.countDistinct("o_custkey").alias("n_queries"))


RUNS = """
run AS (SELECT CAST(o_orderdate AS DATE) AS run_at, o_orderpriority AS log_name, count(*) AS n_tasks,
  CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes_read, count(DISTINCT o_custkey) AS n_queries FROM orders GROUP BY 1, 2)"""
