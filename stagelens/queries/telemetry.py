"""Operators of telemetry and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import readable as R
from ..operators import rollups as P
from ..operators import telemetry as T
from . import surrogate as X
from .registry import query, rounded


@query(f"""WITH {X.JOB}
SELECT job_id, stage_id, start_ms AS job_start_timestamp, end_ms AS job_end_timestamp, {rounded('(end_ms - start_ms) / 1000.0', 3)} AS job_duration_seconds
FROM (SELECT *, unnest([job_id * 2, job_id * 2 + 1, NULL]) AS stage_id FROM job)""")
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.clean_jobs(X.job_events(spark, sf_dir), ())
    return out.select("job_id", "stage_id", "job_start_timestamp", "job_end_timestamp", R.exact_round(F.col("job_duration_seconds"), 3).alias("job_duration_seconds"))


@query(f"""WITH {X.JOB}
SELECT job_id % 100 AS stage_id, min(start_ms) AS stage_start_timestamp, max(end_ms) AS stage_end_timestamp, {rounded('(max(end_ms) - min(start_ms)) / 1000.0', 3)} AS stage_duration_seconds
FROM job GROUP BY 1""")
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.job_events(spark, sf_dir).select((F.col("job_id") % 100).alias("stage_id"), "event_type", F.col("job_timestamp").alias("stage_timestamp"))
    return T.clean_stages(events, ()).withColumn("stage_duration_seconds", R.exact_round(F.col("stage_duration_seconds"), 3))


@query(f"""WITH {X.TASK}
SELECT task_id, stage_id, start_ms AS task_start_timestamp, start_ms + records_read AS task_end_timestamp, {rounded('records_read / 1000.0', 3)} AS task_duration_seconds FROM task""")
def task_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.tasks(spark, sf_dir).select("task_id", "stage_id", F.col("start_ms").alias("task_start_time"), (F.col("start_ms") + F.col("records_read")).alias("task_finish_time"))
    return T.clean_tasks(rows).withColumn("task_duration_seconds", R.exact_round(F.col("task_duration_seconds"), 3))


_MINUTES = "round(CAST(query_duration_seconds / 60.0 AS DECIMAL(38,6)), 2)"


@query(f"""WITH {X.JOB}, q AS (
  SELECT query_id, min(start_ms) AS query_start_timestamp, max(end_ms) AS query_end_timestamp,
    {rounded('(max(end_ms) - min(start_ms)) / 1000.0', 2)} AS query_duration_seconds,
    CASE WHEN max(status) = 'P' THEN 'count' WHEN max(status) = 'O' THEN 'save' END AS query_function FROM job GROUP BY 1)
SELECT *, CAST(query_id AS VARCHAR) || ' - ' || query_function || ' [' ||
  regexp_replace(regexp_replace(CAST(CAST({_MINUTES} AS DECIMAL(38,2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '.0') || ' min]' AS query_header FROM q""")
def query_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = X.jobs(spark, sf_dir)
    last = F.max("status").over(Window.partitionBy("query_id"))
    function = F.when(last == "P", "count").when(last == "O", "save")
    job = job.withColumn("function", function)
    start = job.select("query_id", F.lit("start").alias("event_type"), F.col("start_ms").alias("query_time"), F.col("function").alias("query_function"))
    end = job.select("query_id", F.lit("end").alias("event_type"), F.col("end_ms").alias("query_time"), F.lit(None).cast("string").alias("query_function"))
    return T.query_headers(start.unionByName(end), ())


@query(f"""WITH {X.METRIC},
plan AS (SELECT DISTINCT query_id, node_id, metric_name, accumulator_id, metric_type FROM metric),
t AS (SELECT stage_id, task_id, accumulator_id, upd, upd * 2 AS v FROM metric WHERE metric_type <> 'average'),
d AS (SELECT query_id, accumulator_id, sum(upd) AS u FROM metric WHERE metric_type = 'average' GROUP BY 1, 2)
SELECT plan.query_id, node_id, metric_name, plan.accumulator_id, metric_type, stage_id, task_id, CAST(coalesce(v, u) AS BIGINT) AS value, CAST(coalesce(upd, u) AS BIGINT) AS "update"
FROM plan LEFT JOIN t ON t.accumulator_id = plan.accumulator_id LEFT JOIN d ON d.query_id = plan.query_id AND d.accumulator_id = plan.accumulator_id""")
def accumulator_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an update: averages of the driver's, all others of tasks'."""
    m = X.metrics(spark, sf_dir)
    plan = m.select("query_id", "node_id", "metric_name", "accumulator_id", "metric_type").distinct()
    tasks = m.where("metric_type <> 'average'").select("stage_id", "task_id", "accumulator_id", F.col("upd").alias("update"), (F.col("upd") * 2).alias("value"))
    driver = m.where("metric_type = 'average'").groupBy("query_id", "accumulator_id").agg(F.sum("upd").alias("driver_update")).withColumn("driver_value", F.col("driver_update"))
    return T.accumulator_long(plan, tasks, driver, ())


@query(f"WITH {X.LONG} SELECT line_no, query_id, accumulator_id, upd AS driver_update, value AS driver_value FROM long")
def driver_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.metrics(spark, sf_dir).select("line_no", "query_id", "accumulator_id", F.col("upd").alias("update"))
    return T.driver_running_total(rows, ("line_no",), ()).select("line_no", "query_id", "accumulator_id", "driver_update", "driver_value")


_SIZE = "CASE WHEN v < 1024 THEN v WHEN v < 1048576 THEN v / 1024.0 WHEN v < 1073741824 THEN v / 1048576.0 WHEN v < 1099511627776 THEN v / 1073741824.0 ELSE v / 1099511627776.0 END"
_SIZE_UNIT = "CASE WHEN v < 1024 THEN 'B' WHEN v < 1048576 THEN 'KiB' WHEN v < 1073741824 THEN 'MiB' WHEN v < 1099511627776 THEN 'GiB' ELSE 'TiB' END"
_TIME = "CASE WHEN v < 1000 THEN v WHEN v < 60000 THEN v / 1000.0 WHEN v < 3600000 THEN v / 60000.0 ELSE v / 3600000.0 END"
_TIME_UNIT = "CASE WHEN v < 1000 THEN 'ms' WHEN v < 60000 THEN 's' WHEN v < 3600000 THEN 'min' ELSE 'hr' END"


def _readable_sql(value: str, unit: str, digits: int = 4) -> str:
    return f"SELECT k, v, {rounded(value, digits)} AS readable_value, {unit} AS readable_unit FROM x"


@query(f"WITH x AS (SELECT l_orderkey AS k, CAST(l_quantity * l_quantity * l_partkey * l_partkey AS BIGINT) AS v FROM lineitem) {_readable_sql(_SIZE, _SIZE_UNIT)}")
def readable_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("l_quantity") * F.col("l_quantity") * F.col("l_partkey") * F.col("l_partkey")).cast("bigint")
    rows = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), v.alias("v"))
    made = R.readable(F.col("v"), "size")
    return rows.select("k", "v", R.exact_round(made["readable_value"], 4).alias("readable_value"), made["readable_unit"].alias("readable_unit"))


@query(f"WITH x AS (SELECT l_orderkey AS k, CAST(round(l_extendedprice * l_quantity) AS BIGINT) AS v FROM lineitem) {_readable_sql(_TIME, _TIME_UNIT)}")
def readable_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.round(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint").alias("v"))
    made = R.readable(F.col("v"), "timing")
    return rows.select("k", "v", R.exact_round(made["readable_value"], 4).alias("readable_value"), made["readable_unit"].alias("readable_unit"))


_METRIC_COLS = """query_id, node_id, stage_id, task_id, accumulator_id, metric_name,
  CASE metric_type WHEN 'nsTiming' THEN 'timing' ELSE metric_type END AS metric_type,
  {v} AS value, CASE metric_type WHEN 'timing' THEN 'ms' WHEN 'nsTiming' THEN 'ms' WHEN 'size' THEN 'B' ELSE '' END AS unit"""


def _value(column: str) -> str:
    return rounded(f"CASE metric_type WHEN 'nsTiming' THEN {column} / 1e6 ELSE {column} END", 6)


@query(f"WITH {X.LONG} SELECT {_METRIC_COLS.format(v=_value('upd'))} FROM long")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.metric_rows(X.metric_long(spark, sf_dir), ()).withColumn("value", R.exact_round(F.col("value"), 6)).drop("readable_value", "readable_unit", "readable_str")


_BEST = "b AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id, metric_type, metric_name ORDER BY value DESC, stage_id, task_id, accumulator_id) AS n FROM long)"


@query(f"WITH {X.LONG}, {_BEST} SELECT {_METRIC_COLS.format(v=_value('value'))} FROM b WHERE n = 1")
def metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.metric_totals(X.metric_long(spark, sf_dir), ()).withColumn("value", R.exact_round(F.col("value"), 6)).drop("readable_value", "readable_unit", "readable_str")


@query(f"WITH {X.METRIC} SELECT accumulator_id, {rounded('median(upd)', 4)} AS median_of_average_value FROM metric WHERE metric_type = 'average' GROUP BY 1")
def average_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.metric_rows(X.metric_long(spark, sf_dir), ())
    return T.average_medians(rows, ()).withColumn("median_of_average_value", R.exact_round(F.col("median_of_average_value"), 4))


@query(f"""WITH {X.LONG}, {_BEST}
SELECT query_id, node_id, {rounded("sum(CASE metric_type WHEN 'timing' THEN value / 60000.0 WHEN 'nsTiming' THEN value / 60000.0 / 1e6 ELSE 0 END)", 4)} AS node_duration_minutes FROM b WHERE n = 1 GROUP BY 1, 2""")
def node_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.node_durations(T.metric_totals(X.metric_long(spark, sf_dir), ()), ()).withColumn("node_duration_minutes", R.exact_round(F.col("node_duration_minutes"), 4))


@query(f"""WITH {X.LONG}, {_BEST}, t AS (
  SELECT query_id, node_id, string_agg(metric_name || '=' || CAST(accumulator_id AS VARCHAR), ',' ORDER BY CASE metric_type WHEN 'timing' THEN 1 WHEN 'nsTiming' THEN 1 WHEN 'size' THEN 2 WHEN 'sum' THEN 3 ELSE 4 END, metric_name) AS totals, count(*) AS n_totals FROM b WHERE n = 1 GROUP BY 1, 2)
SELECT t.*, n_accumulators FROM t JOIN (SELECT query_id, node_id, count(*) AS n_accumulators FROM long GROUP BY 1, 2) USING (query_id, node_id)""")
def nested_metrics_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = X.metric_long(spark, sf_dir)
    totals = T.nest_metrics(T.metric_totals(long, ()), "totals", ())
    rows = T.nest_metrics(T.metric_rows(long, ()), "accumulators", ()).drop("accumulators")
    flat = F.array_join(F.transform("totals", lambda m: F.concat(m["metric_name"], F.lit("="), m["accumulator_id"].cast("string"))), ",")
    return totals.withColumn("totals", flat).join(rows, ["query_id", "node_id"])


@query(f"""WITH {X.METRIC}
SELECT query_id, stage_id, task_id, string_agg('[' || CAST(node_id AS VARCHAR) || '] ' || metric_name, ',' ORDER BY node_id, metric_name) AS nodes
FROM (SELECT DISTINCT query_id, stage_id, task_id, node_id, metric_name FROM metric) GROUP BY 1, 2, 3""")
def task_node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.metrics(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    name = F.concat(F.lit("["), F.col("node_id").cast("string"), F.lit("] "), F.col("metric_name"))
    dag = rows.groupBy("query_id", "node_id", name.alias("node_name")).agg(F.collect_list(F.struct("stage_id", "task_id")).alias("accumulators"))
    dag = dag.select(F.lit("x").alias("log_name"), "*", none("string").alias("query_function"), none("string").alias("query_start_timestamp"), none("string").alias("query_end_timestamp"), none("double").alias("query_duration_seconds"))
    return T.task_nodes(dag).select("query_id", "stage_id", "task_id", F.array_join("nodes", ",").alias("nodes"))


@query(f"""WITH {X.JOB}, g AS (SELECT query_id, greatest(0, start_ms - lag(end_ms) OVER (PARTITION BY query_id ORDER BY job_id, start_ms)) AS gap FROM (SELECT DISTINCT query_id, job_id, start_ms, end_ms FROM job))
SELECT query_id, CAST(coalesce(sum(gap), 0) AS BIGINT) AS idle_time_ms FROM g GROUP BY 1""")
def job_idle_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.job_idle_time(X.jobs(spark, sf_dir), keys=("query_id",)).drop("readable")


_SUMS = f"count(*) AS n_tasks, {rounded('sum(task_duration_seconds)', 2)} AS task_duration_seconds, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("bytes_read", "bytes_written", "shuffle_bytes_read", "shuffle_bytes_written"))


def _sums(df: DataFrame) -> DataFrame:
    return df.withColumn("task_duration_seconds", R.exact_round(F.col("task_duration_seconds"), 2)).select(*(c for c in df.columns if not c.endswith("_str")))


@query(f"WITH {X.TASK} SELECT executor_id, host, {_SUMS} FROM task GROUP BY 1, 2")
def executor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(P.executor_rollup(X.tasks(spark, sf_dir)))


@query(f"WITH {X.TASK} SELECT query_id, job_id, stage_id, {_SUMS} FROM task GROUP BY 1, 2, 3")
def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(P.stage_rollup(X.tasks(spark, sf_dir), ("query_id", "job_id", "stage_id")))


_WALL = f"""{rounded('sum((end_ms - start_ms) / 1000.0)', 2)} AS job_seconds, {rounded('(max(end_ms) - min(start_ms)) / 1000.0', 2)} AS wall_seconds,
{rounded('greatest(0.0, (1 - sum((end_ms - start_ms) / 1000.0) / ((max(end_ms) - min(start_ms)) / 1000.0)) * 100)', 3)} AS pct_idle FROM (SELECT DISTINCT query_id, job_id, start_ms, end_ms FROM job)"""


@query(f"WITH {X.JOB} SELECT NULL AS query_id, {_WALL} UNION ALL SELECT query_id, {_WALL} GROUP BY query_id")
def wall_vs_job_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all jobs, and of each query's."""
    jobs = X.jobs(spark, sf_dir)
    out = P.wall_and_job_time(jobs, ("query_id",)).unionByName(P.wall_and_job_time(jobs), allowMissingColumns=True)
    return out.select("query_id", R.exact_round(F.col("job_seconds"), 2).alias("job_seconds"), R.exact_round(F.col("wall_seconds"), 2).alias("wall_seconds"), R.exact_round(F.col("pct_idle"), 3).alias("pct_idle"))


@query(f"""WITH {X.TASK}, s AS (SELECT query_id, job_id, stage_id, min(start_ms) AS stage_start, max(start_ms) AS stage_end FROM task GROUP BY 1, 2, 3)
SELECT *, dense_rank() OVER (ORDER BY stage_id) AS stage_rank, 'Query ' || query_id || ' / Job ' || job_id || ' / Stage ' || stage_id AS label FROM s""")
def stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = X.tasks(spark, sf_dir).groupBy("query_id", "job_id", "stage_id").agg(F.min("start_ms").alias("stage_start"), F.max("start_ms").alias("stage_end"))
    return P.stage_timeline(stages).withColumn("stage_rank", F.col("stage_rank").cast("bigint"))


@query(f"""WITH {X.METRIC}, s AS (SELECT query_id, node_id, metric_name, avg(upd) AS mean, median(upd) AS median, quantile_cont(upd, 0.25) AS q1, quantile_cont(upd, 0.75) AS q3, count(*) AS n FROM metric GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT query_id, node_id, metric_name, line_no, upd AS value, {rounded('mean', 3)} AS mean, {rounded('median', 3)} AS median, {rounded('q1', 3)} AS q1, {rounded('q3', 3)} AS q3, n FROM metric JOIN s USING (query_id, node_id, metric_name)""")
def metric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.metrics(spark, sf_dir).select("query_id", "node_id", "metric_name", "line_no", F.col("upd").alias("value"))
    out = P.metric_distribution(rows)
    return out.withColumns({c: R.exact_round(F.col(c), 3) for c in ("mean", "median", "q1", "q3")})


@query(f"""WITH {X.METRIC}, i AS (SELECT query_id, node_id % 3 AS whole_stage_codegen_id, string_agg(name, ',' ORDER BY node_id) AS nodes FROM (SELECT DISTINCT query_id, node_id, '[' || CAST(node_id AS VARCHAR) || '] node' AS name FROM metric) GROUP BY 1, 2)
SELECT o.query_id, o.whole_stage_codegen_id, 100000 + o.whole_stage_codegen_id AS node_id, nodes, CAST(upd AS BIGINT) AS total FROM (SELECT query_id, node_id % 3 AS whole_stage_codegen_id, sum(upd) AS upd FROM metric GROUP BY 1, 2) o JOIN i USING (query_id, whole_stage_codegen_id)""")
def codegen_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.metrics(spark, sf_dir)
    code = (F.col("node_id") % 3).alias("whole_stage_codegen_id")
    inner = m.select("query_id", code, "node_id", F.concat(F.lit("["), F.col("node_id").cast("string"), F.lit("] node")).alias("node_name"), F.lit(0.0).alias("node_duration_minutes"), F.lit(None).cast("bigint").alias("accumulator_totals")).distinct()
    outer = m.groupBy("query_id", code).agg(F.sum("upd").alias("accumulator_totals")).select("query_id", "whole_stage_codegen_id", (F.col("whole_stage_codegen_id") + 100_000).alias("node_id"), F.lit("").alias("node_name"), F.lit(0.0).alias("node_duration_minutes"), "accumulator_totals")
    return P.codegen_containers(inner.unionByName(outer)).select("query_id", "whole_stage_codegen_id", "node_id", F.array_join("nodes", ",").alias("nodes"), F.col("accumulator_totals").alias("total"))


@query(f"WITH {X.METRIC} SELECT metric_name, count(*) AS n_nodes FROM (SELECT DISTINCT query_id, node_id, metric_name FROM metric WHERE metric_name <> 'duration') GROUP BY 1 HAVING count(*) > 1")
def hotspot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hotspot_metrics(X.metrics(spark, sf_dir))


@query(f"WITH {X.JOB} SELECT DISTINCT query_id, CAST(query_id AS VARCHAR) || ' - ' || status AS query_header FROM job")
def query_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.query_picker(X.jobs(spark, sf_dir).select("query_id", F.concat(F.col("query_id").cast("string"), F.lit(" - "), F.col("status")).alias("query_header")))


@query(f"WITH {X.TASK} SELECT executor_id, stage_id, count(*) AS n FROM task GROUP BY 1, 2")
def sorted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.tasks(spark, sf_dir).groupBy("executor_id", "stage_id").agg(F.count("*").alias("n"))
    return P.sorted_table(out, [("Executor", True), ("n", False), ("stage_id", True)], {"Executor": "executor_id"})
