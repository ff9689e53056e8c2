"""From event tables to the two published relations: dag, a row an operator, and combined, a row a task.

Every function takes and returns DataFrames over the canonical columns, so real logs and other tables in their form
are treated alike. log_name is a column throughout; many logs are one computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import readable as R
from ..plans.parser import CODEGEN_BASE
from ..sources import schemas as S
from ..sources.shared import kept


def _seconds(start: str, end: str) -> Column:
    return (F.col(end) - F.col(start)) / F.lit(1000.0)


def pivot_times(events: DataFrame, keys: list[str], time: str, prefix: str) -> DataFrame:
    """Start and end events as one row: <prefix>_start_timestamp, <prefix>_end_timestamp and duration in seconds.
    Of repeated events the first start and the last end count."""
    when = lambda kind: F.when(F.col("event_type") == kind, F.col(time))
    out = events.groupBy(*keys).agg(F.min(when("start")).alias(f"{prefix}_start_timestamp"), F.max(when("end")).alias(f"{prefix}_end_timestamp"))
    return out.withColumn(f"{prefix}_duration_seconds", _seconds(f"{prefix}_start_timestamp", f"{prefix}_end_timestamp"))


def clean_jobs(jobs: DataFrame, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """A row a job and stage of it; end events, which name no stages, give a row without one."""
    times = pivot_times(jobs, [*keys, "job_id"], "job_timestamp", "job")
    stages = jobs.select(*keys, "job_id", F.explode_outer("stages").alias("stage_id"))
    return stages.join(times, [*keys, "job_id"], "left")


def clean_stages(stages: DataFrame, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """A row a stage and attempt."""
    attempt = ["stage_attempt_id"] if "stage_attempt_id" in stages.columns else []
    return pivot_times(stages, [*keys, "stage_id", *attempt], "stage_timestamp", "stage")


def clean_tasks(tasks: DataFrame) -> DataFrame:
    out = tasks.withColumnsRenamed({"task_start_time": "task_start_timestamp", "task_finish_time": "task_end_timestamp"})
    return out.withColumn("task_duration_seconds", _seconds("task_start_timestamp", "task_end_timestamp"))


def query_headers(queries: DataFrame, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """A row a query: times, duration rounded to two places, and "id - function [x min]" (null without a function)."""
    times = pivot_times(queries, [*keys, "query_id"], "query_time", "query").withColumn("query_duration_seconds", R.exact_round(F.col("query_duration_seconds"), 2))
    function = queries.groupBy(*keys, "query_id").agg(F.max("query_function").alias("query_function"))
    minutes = R.number_text(F.col("query_duration_seconds") / 60.0, 2)
    header = F.concat(F.col("query_id").cast("string"), F.lit(" - "), F.col("query_function"), F.lit(" ["), minutes, F.lit(" min]"))
    return times.join(function, [*keys, "query_id"]).withColumn("query_header", header)


def clean_plan(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Plan nodes with their query's times and header; children as "1, 2"."""
    joined = nodes.withColumn("child_nodes", F.array_join(F.col("child_nodes").cast("array<string>"), ", "))
    return joined.join(query_headers(queries), ["log_name", "query_id"], "left")


def driver_running_total(updates: DataFrame, order: tuple[str, ...] = ("place", "pos"), keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """Updates of driver accumulators with their running total, in the log's order."""
    w = Window.partitionBy(*keys, "query_id", "accumulator_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return updates.withColumnRenamed("update", "driver_update").withColumn("driver_value", F.sum("driver_update").over(w))


def accumulator_long(plan: DataFrame, tasks: DataFrame, driver: DataFrame, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """A row a plan metric and task or driver update of it; metrics that nothing updated stay with nulls.

    plan: query_id, node_id, metric_name, accumulator_id, metric_type; tasks: stage_id, task_id, accumulator_id,
    update, value; driver: query_id, accumulator_id, driver_update, driver_value. The driver's side is joined before
    rows multiply, and the tasks' rows are those that stream: a task holds the metrics of one accumulator at most.
    """
    metrics = plan.join(driver, [*keys, "query_id", "accumulator_id"], "left")
    return _with_tasks(metrics, tasks, keys)


def _with_tasks(metrics: DataFrame, tasks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """accumulator_long() of metrics that have their driver's side already."""
    met = tasks.join(metrics, [*keys, "accumulator_id"])
    unmet = metrics.join(tasks.select(*keys, "accumulator_id").distinct(), [*keys, "accumulator_id"], "left_anti")
    order = [*keys, "query_id", "accumulator_id", *(c for c in (*metrics.columns, *tasks.columns) if c not in (*keys, "query_id", "accumulator_id"))]
    joined = met.unionByName(unmet, allowMissingColumns=True).select(*order)
    return joined.withColumn("value", F.coalesce("value", "driver_value")).withColumn("update", F.coalesce("update", "driver_update")).drop("driver_value", "driver_update")


_IDS = ("query_id", "node_id", "stage_id", "task_id", "accumulator_id", "metric_name")


def _as_metric(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows with value: nanoseconds become milliseconds, then unit and readable form."""
    nano = F.col("metric_type") == "nsTiming"
    rows = rows.withColumn("value", F.when(nano, F.col("value") / F.lit(1e6)).otherwise(F.col("value").cast("double")))
    rows = rows.withColumn("metric_type", F.when(nano, "timing").otherwise(F.col("metric_type"))).withColumn("unit", R.unit_of(F.col("metric_type")))
    rows = rows.withColumn("__r", R.readable_metric(F.col("value"), F.col("metric_type")))
    return rows.select(*keys, *_IDS, "metric_type", "value", "unit", R.exact_round(F.col("__r.readable_value"), 1).alias("readable_value"), F.col("__r.readable_unit").alias("readable_unit"), F.col("__r.readable_str").alias("readable_str"))


def metric_rows(long: DataFrame, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """Updates of each metric by task, readable."""
    return _as_metric(long.where(F.col("update").isNotNull()).drop("value").withColumnRenamed("update", "value"), keys)


def metric_totals(long: DataFrame, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """Of each node's metric the row with the largest running value; ties by stage, task and accumulator."""
    group = [*keys, "query_id", "node_id", "metric_type", "metric_name"]
    best = long.where(F.col("value").isNotNull()).groupBy(*group).agg(F.max_by(F.struct("stage_id", "task_id", "accumulator_id", "value"), F.struct("value", *(-F.coalesce(c, F.lit(-1)) for c in ("stage_id", "task_id", "accumulator_id")))).alias("b"))
    return _as_metric(best.select(*group, "b.*"), keys)


def average_medians(rows: DataFrame, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """The median of tasks' values for each accumulator of an average metric."""
    return rows.where("metric_type = 'average'").groupBy(*keys, "accumulator_id").agg(F.median("value").alias("median_of_average_value"))


def with_medians(totals: DataFrame, medians: DataFrame, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """Totals of average metrics replaced by their median, in number and in text."""
    joined = totals.join(medians, [*keys, "accumulator_id"], "left")
    average = (F.col("metric_type") == "average") & F.col("median_of_average_value").isNotNull()
    median = F.col("median_of_average_value")
    joined = joined.withColumn("value", F.when(average, median).otherwise(F.col("value")))
    joined = joined.withColumn("readable_value", F.when(average, R.exact_round(median, 1)).otherwise(F.col("readable_value")))
    return joined.withColumn("readable_str", F.when(average, R.number_text(median, 2)).otherwise(F.col("readable_str"))).drop("median_of_average_value")


def node_durations(totals: DataFrame, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """Minutes of each node: the sum of its timing totals."""
    minutes = F.when(F.col("metric_type") == "timing", F.col("value") / F.lit(60_000.0)).otherwise(F.lit(0.0))
    return totals.groupBy(*keys, "query_id", "node_id").agg(F.sum(minutes).alias("node_duration_minutes"))


def nest_metrics(rows: DataFrame, name: str, keys: tuple[str, ...] = ("log_name",)) -> DataFrame:
    """A node's metrics as a list <name> ordered by kind and name, and their number n_<name>, for which alone no list
    is made."""
    fields = ("stage_id", "task_id", "accumulator_id", "metric_name", "metric_type", "value", "unit", "readable_value", "readable_unit", "readable_str")
    one = F.struct(R.order_of(F.col("metric_type")).alias("o"), F.col("metric_name").alias("m"), F.col("stage_id").alias("s"), F.col("task_id").alias("t"), F.col("accumulator_id").alias("a"), F.struct(*fields).alias("metric"))
    nested = rows.groupBy(*keys, "query_id", "node_id").agg(F.sort_array(F.collect_list(one)).alias("l"), F.count("*").alias(f"n_{name}"))
    return nested.select(*keys, "query_id", "node_id", F.transform("l", lambda x: x["metric"]).alias(name), f"n_{name}")


def dag(nodes: DataFrame, queries: DataFrame, tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """The node relation: a row a query and operator, with its metrics by task and in total. The plans' metrics are
    kept as a table, so that tasks meet them where they are instead of being shuffled by accumulator."""
    keys = ["log_name", "query_id", "node_id"]
    plan = clean_plan(nodes, queries)
    metrics = nodes.select("log_name", "query_id", "node_id", F.explode("accumulators").alias("m")).select("log_name", "query_id", "node_id", "m.*")
    by_task = tasks.select("log_name", "stage_id", "task_id", F.explode("accumulators").alias("a")).select("log_name", "stage_id", "task_id", F.col("a.accumulator_id").alias("accumulator_id"), F.col("a.update").alias("update"), F.col("a.value").alias("value"))
    driver = driver_running_total(updates).select("log_name", "query_id", "accumulator_id", "driver_update", "driver_value")
    metrics = kept(metrics.join(driver, ["log_name", "query_id", "accumulator_id"], "left"), "metrics")
    long = _with_tasks(metrics, by_task, ("log_name",))
    rows = metric_rows(long)
    totals = with_medians(metric_totals(long), average_medians(rows))
    out = plan.join(nest_metrics(rows, "accumulators"), keys, "left") if "accumulators" not in plan.columns else plan.drop("accumulators").join(nest_metrics(rows, "accumulators"), keys, "left")
    out = out.join(nest_metrics(totals, "accumulator_totals"), keys, "left").join(node_durations(totals), keys, "left")
    out = out.fillna(0, ["n_accumulators", "n_accumulator_totals"]).fillna(0.0, ["node_duration_minutes"])
    adjusted = F.when(F.col("node_id") >= CODEGEN_BASE, F.col("node_id") - CODEGEN_BASE).otherwise(F.col("node_id"))
    out = out.withColumn("node_id_adj", adjusted).withColumn("node_name", F.concat(F.lit("["), adjusted.cast("string"), F.lit("] "), F.col("node_type")))
    for c in ("query_start_timestamp", "query_end_timestamp"):
        out = out.withColumn(c, R.iso_seconds(F.col(c)))
    return out.select("log_name", *S.DAG_COLUMNS)


def check_dag(dag: DataFrame, nodes: DataFrame) -> None:
    """Raises where the relation lost or repeated plan nodes. An action: counts."""
    got, want = dag.count(), nodes.count()
    if got != want:
        raise ValueError(f"dag has {got} rows for {want} plan nodes")


def task_nodes(dag: DataFrame) -> DataFrame:
    """The names of the operators that each task ran, and the task's query; pseudo nodes aside."""
    query = ["log_name", "query_id", "query_function", "query_start_timestamp", "query_end_timestamp", "query_duration_seconds"]
    each = dag.where(F.col("node_id") < CODEGEN_BASE).select(*query, "node_id", "node_name", F.explode("accumulators").alias("a"))
    each = each.select(*query, F.col("a.stage_id").alias("stage_id"), F.col("a.task_id").alias("task_id"), "node_id", "node_name").where("stage_id is not null and task_id is not null")
    named = each.groupBy(*query, "stage_id", "task_id").agg(F.sort_array(F.collect_set(F.struct("node_id", "node_name"))).alias("n"))
    return named.select(*query, "stage_id", "task_id", F.transform("n", lambda x: x["node_name"]).alias("nodes"))


def stage_nodes(nodes: DataFrame, queries: DataFrame, tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """The operators that the tasks of a stage can have run: a row a query and stage, with (node_id, node_name,
    accumulator_id, by_driver) as a list in the order of nodes. Its size follows the plans and not the tasks."""
    query = ["log_name", "query_id", "query_function", "query_start_timestamp", "query_end_timestamp", "query_duration_seconds"]
    plan = clean_plan(nodes, queries).where(F.col("node_id") < CODEGEN_BASE).withColumns({c: R.iso_seconds(F.col(c)) for c in query[3:5]})
    plan = plan.select(*query, "node_id", F.concat(F.lit("["), F.col("node_id").cast("string"), F.lit("] "), F.col("node_type")).alias("node_name"), F.explode("accumulators.accumulator_id").alias("accumulator_id"))
    driver = updates.where(F.col("update").isNotNull()).select("log_name", "query_id", "accumulator_id", F.lit(True).alias("by_driver")).distinct()
    plan = plan.join(driver, ["log_name", "query_id", "accumulator_id"], "left")
    ran = tasks.select("log_name", "stage_id", F.explode("accumulators.accumulator_id").alias("accumulator_id")).distinct()
    metric = F.struct("node_id", "node_name", "accumulator_id", F.coalesce("by_driver", F.lit(False)).alias("by_driver"))
    return ran.where("stage_id is not null").join(plan, ["log_name", "accumulator_id"]).groupBy(*query, "stage_id").agg(F.sort_array(F.collect_set(metric)).alias("metrics"))


def ran_nodes(metrics: str = "metrics", accumulators: str = "accumulators") -> Column:
    """The names of stage_nodes()' operators whose metrics a task updated, in the order of nodes."""
    touched = F.filter(metrics, lambda m: F.exists(accumulators, lambda a: (a["accumulator_id"] == m["accumulator_id"]) & (a["update"].isNotNull() | m["by_driver"])))
    return F.transform(F.array_distinct(F.transform(touched, lambda m: F.struct(m["node_id"].alias("node_id"), m["node_name"].alias("node_name")))), lambda n: n["node_name"])


#: Milliseconds and nanoseconds of task metrics that combined gives in seconds.
_MILLIS = ("executor_run_time", "executor_deserialize_time", "jvm_gc_time", "result_serialization_time", "shuffle_fetch_wait_time")
_NANOS = ("executor_cpu_time", "executor_deserialize_cpu_time", "shuffle_write_time")


def combined(tasks: DataFrame, stages: DataFrame, jobs: DataFrame, ran: DataFrame, parsed_log_name: Column | str | None = None) -> DataFrame:
    """The task relation: a row a query, task and job of the task's stage; tasks of no query are left out. ran is of
    stage_nodes(). A task's operators follow from its own accumulables; what it is joined with is small and kept as
    tables, so that no task is shuffled."""
    rows = clean_tasks(tasks).drop("place").where("task_id is not null").join(clean_stages(stages), ["log_name", "stage_id", "stage_attempt_id"], "left")
    rows = rows.join(kept(clean_jobs(jobs).where("stage_id is not null"), "jobs"), ["log_name", "stage_id"], "left")
    rows = rows.join(kept(ran, "ran"), ["log_name", "stage_id"]).withColumn("nodes", ran_nodes()).where(F.size("nodes") > 0).drop("accumulators", "metrics")
    rows = rows.withColumnsRenamed({"result_size": "result_size_bytes", "peak_execution_memory": "peak_execution_memory_bytes"})
    rows = rows.withColumn("shuffle_bytes_read", F.col("shuffle_remote_bytes_read") + F.col("shuffle_local_bytes_read"))
    rows = rows.withColumns({f"{c}_seconds": F.col(c) / F.lit(d) for names, d in ((_MILLIS, 1e3), (_NANOS, 1e9)) for c in names})
    times = [f"{x}_{e}_timestamp" for x in ("job", "stage", "task") for e in ("start", "end")]
    rows = rows.withColumns({c: R.iso_micros(F.col(c)) for c in times})
    rows = rows.withColumn("parsed_log_name", F.lit(parsed_log_name) if isinstance(parsed_log_name, str) else F.col("log_name") if parsed_log_name is None else parsed_log_name)
    return rows.select(*S.COMBINED_COLUMNS)


def job_idle_time(jobs: DataFrame, start: str = "start_ms", end: str = "end_ms", keys: tuple[str, ...] = ()) -> DataFrame:
    """Milliseconds between jobs in which none ran, job after job by id, and a readable form."""
    jobs = jobs.select(*keys, "job_id", start, end).distinct()
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy("job_id", start))
    gaps = jobs.withColumn("gap", F.greatest(F.lit(0), F.col(start) - before))
    total = gaps.groupBy(*keys).agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("idle_time_ms"))
    return total.withColumn("readable", R.readable(F.col("idle_time_ms"), "timing"))
