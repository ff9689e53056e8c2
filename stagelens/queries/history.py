"""Run history and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import readable as R
from ..operators import alerts as L
from ..operators import history as H
from . import surrogate as X
from .registry import query, rounded


@query(f"WITH {X.RUNS} SELECT CAST(run_at AS VARCHAR) AS run_at, log_name, n_tasks FROM (SELECT *, row_number() OVER (PARTITION BY log_name ORDER BY run_at DESC) AS n FROM run) WHERE n <= 5")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = X.runs(spark, sf_dir).withColumn("run_id", F.lit(""))
    return H.last_runs(runs, 5, by_log=True).select(F.col("run_at").cast("string").alias("run_at"), "log_name", "n_tasks")


_BASE = "base AS (SELECT *, coalesce(avg(bytes_read) OVER (PARTITION BY log_name ORDER BY run_at ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS baseline FROM run)"


@query(f"WITH {X.RUNS}, {_BASE} SELECT CAST(run_at AS VARCHAR) AS run_at, log_name, bytes_read, {rounded('baseline', 2)} AS baseline FROM base")
def alert_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.baselines(X.runs(spark, sf_dir), "bytes_read")
    return out.select(F.col("run_at").cast("string").alias("run_at"), "log_name", "bytes_read", R.exact_round(F.col("baseline"), 2).alias("baseline"))


@query(f"""WITH {X.RUNS}, {_BASE}, rule(name, condition, threshold) AS (VALUES ('big', 'threshold', 1500000.0), ('grown', 'pct_increase', 0.5), ('jump', 'absolute_increase', 800000.0))
SELECT CAST(run_at AS VARCHAR) AS run_at, log_name, name, bytes_read AS current, {rounded('baseline', 2)} AS baseline FROM base CROSS JOIN rule
WHERE CASE condition WHEN 'threshold' THEN bytes_read > threshold WHEN 'pct_increase' THEN CASE WHEN baseline = 0 THEN bytes_read > 0 ELSE (bytes_read - baseline) / baseline > threshold END ELSE bytes_read - baseline > threshold END""")
def alerts_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = L.baselines(X.runs(spark, sf_dir), "bytes_read")
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("condition"), F.lit(t).alias("threshold")) for n, c, t in (("big", "threshold", 1_500_000.0), ("grown", "pct_increase", 0.5), ("jump", "absolute_increase", 800_000.0))))
    each = runs.select("*", F.inline(rules))
    fired = each.where(L.fires(F.col("condition"), F.col("bytes_read"), F.col("baseline"), F.col("threshold")))
    return fired.select(F.col("run_at").cast("string").alias("run_at"), "log_name", "name", F.col("bytes_read").alias("current"), R.exact_round(F.col("baseline"), 2).alias("baseline"))


_LAST = f"WITH {X.RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY log_name ORDER BY run_at DESC) AS n FROM run)"


@query(f"""{_LAST}, b AS (SELECT log_name, avg(n_tasks) AS baseline FROM o WHERE n BETWEEN 2 AND 4 GROUP BY 1)
SELECT o.log_name, CAST(n_tasks AS DOUBLE) AS current, {rounded('baseline', 4)} AS baseline FROM o JOIN b USING (log_name) WHERE n = 1 AND (n_tasks - baseline) / baseline > -0.2""")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log's newest run against rules, as the command line checks them."""
    runs = X.runs(spark, sf_dir)
    full = runs.select(F.col("run_at").cast("string").alias("run_id"), F.col("run_at").cast("timestamp").alias("run_at"), "log_name", *(F.col(m) if m in ("n_tasks", "bytes_read", "n_queries") else F.lit(0).alias(m) for m in L.METRICS))
    newest = full.withColumn("__n", F.row_number().over(Window.partitionBy("log_name").orderBy(F.desc("run_at")))).where("__n = 1").drop("__n")
    logs = runs.select("log_name").distinct()
    rules = logs.select(F.concat(F.lit("tasks of "), F.col("log_name")).alias("name"), "log_name", F.lit("n_tasks").alias("metric"), F.lit("pct_increase").alias("condition"), F.lit(-0.2).alias("threshold"), F.lit(3).alias("window"), F.lit("warning").alias("severity"), F.lit("log").alias("on_trigger"))
    return L.check(newest, full, rules).select("log_name", "current", R.exact_round(F.col("baseline"), 4).alias("baseline"))
