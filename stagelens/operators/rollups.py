"""Summaries of the task relation for tables and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import readable as R
from ..plans.parser import CODEGEN_BASE

_SUMS = ("task_duration_seconds", "bytes_read", "bytes_written", "shuffle_bytes_read", "shuffle_bytes_written")


def rollup(combined: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks and sums of time and bytes by keys, with readable strings. Tasks count once, however many jobs or
    queries list them, where they have an id."""
    out = combined.groupBy(*keys).agg(F.count("*").alias("n_tasks"), *(F.sum(c).alias(c) for c in _SUMS))
    out = out.withColumn("task_duration_str", R.readable(F.col("task_duration_seconds") * 1000, "timing")["readable_str"])
    return out.withColumns({f"{c}_str": R.readable(F.col(c), "size")["readable_str"] for c in _SUMS[1:]})


def executor_rollup(combined: DataFrame) -> DataFrame:
    return rollup(combined, ["executor_id", "host"])


def stage_rollup(combined: DataFrame, keys: tuple[str, ...] = ("query_id", "query_function", "job_id", "stage_id", "query_duration_seconds", "job_duration_seconds", "stage_duration_seconds")) -> DataFrame:
    return rollup(combined, list(keys)).orderBy(*keys)


def wall_and_job_time(jobs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """From jobs (keys, job_id, start_ms, end_ms): the sum of their times, the wall time they span, and the idle
    share, of all jobs or of each key's."""
    each = jobs.select(*keys, "job_id", "start_ms", "end_ms").distinct()
    out = each.groupBy(*keys).agg(F.sum((F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0)).alias("job_seconds"), ((F.max("end_ms") - F.min("start_ms")) / F.lit(1000.0)).alias("wall_seconds"))
    return out.withColumn("pct_idle", F.greatest(F.lit(0.0), (1 - F.col("job_seconds") / F.col("wall_seconds")) * 100.0))


def stage_timeline(stages: DataFrame) -> DataFrame:
    """From stages (query_id, job_id, stage_id, start, end): rank by stage within the log, and a label."""
    each = stages.select("query_id", "job_id", "stage_id", "stage_start", "stage_end").distinct()
    ids = each.select("stage_id").distinct().withColumn("stage_rank", F.dense_rank().over(Window.orderBy("stage_id")))
    label = F.concat(F.lit("Query "), F.col("query_id").cast("string"), F.lit(" / Job "), F.col("job_id").cast("string"), F.lit(" / Stage "), F.col("stage_id").cast("string"))
    return each.join(ids, "stage_id").withColumn("label", label)


def sorted_table(table: DataFrame, by: list[tuple[str, bool]], shown: dict[str, str] | None = None) -> DataFrame:
    """The table by several columns, (name, ascending) each; shown maps displayed names to the columns behind them."""
    return table.orderBy(*(F.col((shown or {}).get(c, c)).asc_nulls_last() if up else F.col((shown or {}).get(c, c)).desc_nulls_last() for c, up in by))


def metric_distribution(rows: DataFrame, keys: tuple[str, ...] = ("query_id", "node_id", "metric_name")) -> DataFrame:
    """Each metric row with mean, median, quartiles and number over its node and metric; only where there are more
    rows than one."""
    stats = rows.groupBy(*keys).agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"), F.count("*").alias("n")).where("n > 1")
    return rows.join(stats, list(keys))


def codegen_containers(dag: DataFrame) -> DataFrame:
    """Stretches of generated code with their totals and the names of the operators in them."""
    keys = [c for c in ("log_name",) if c in dag.columns] + ["query_id", "whole_stage_codegen_id"]
    outer = dag.where(F.col("node_id") >= CODEGEN_BASE).select(*keys, "node_id", "node_duration_minutes", "accumulator_totals")
    inner = dag.where((F.col("node_id") < CODEGEN_BASE) & F.col("whole_stage_codegen_id").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("node_id", "node_name"))).alias("n"))
    return outer.join(inner.select(*keys, F.transform("n", lambda x: x["node_name"]).alias("nodes")), keys)


def hotspot_metrics(metrics: DataFrame) -> DataFrame:
    """Names of metrics that more nodes than one have, but duration."""
    each = metrics.select("query_id", "node_id", "metric_name").distinct()
    return each.where("metric_name <> 'duration'").groupBy("metric_name").agg(F.count("*").alias("n_nodes")).where("n_nodes > 1").orderBy("metric_name")


def query_picker(dag: DataFrame) -> DataFrame:
    return dag.select("query_id", "query_header").distinct().orderBy("query_id")
