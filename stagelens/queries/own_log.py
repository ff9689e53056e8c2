"""Logs of our own, written from the tables as Spark writes them, and read again: the whole way from lines to findings.

Two applications run the same five queries, with the same ids for queries, jobs, stages, tasks and accumulators; the
second reads twice the bytes. Each row of lineitem is a finished task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import readable as R
from ..operators import detect as D
from ..operators import history as H
from ..sources import eventlog as E
from ..sources.shared import drop_folder, new_folder
from . import surrogate as X
from .plans import JOIN_INFO, JOIN_PLAN
from .registry import query, rounded

QUERIES, START = 5, 1_700_000_000_000
#: Lines in a compressed file, which one task reads.
LINES_A_FILE = 1_000_000
LOGS = ("app-1", "app-2")
#: Metrics of nodes: what they are, and which stage of a query's two updates them. The id is the query's hundred.
METRICS = (("Scan parquet ", 1, "number of output rows", "sum", 0), ("Exchange", 2, "data size", "size", 0), ("Sort", 3, "sort time", "timing", 1), ("SortMergeJoin", 4, "number of output rows", "sum", 1), ("Range", 5, "number of output rows", "sum", 1))


def _info(info: dict, q: int, right: bool = False) -> dict:
    """The metrics' tree of query q: each named node has its metric, the sort of the left side alone."""
    name = info["nodeName"]
    own = [{"name": m, "accumulatorId": 100 * q + k, "metricType": t} for n, k, m, t, _ in METRICS if n == name and not (right and n in ("Sort", "Exchange"))]
    below = [_info(c, q, right or name == "SortMergeJoin" and i == 1) for i, c in enumerate(info["children"])]
    return info | {"metrics": own, "children": below, "simpleString": "AdaptiveSparkPlan isFinalPlan=true" if name == "AdaptiveSparkPlan" else name}


def _head(log: int) -> list[dict]:
    """What a log says beside its tasks: the start of the application, and queries, plans, jobs and stages."""
    sql = "org.apache.spark.sql.execution.ui."
    out: list[dict] = [{"Event": E.START, "Timestamp": START}]
    for q in range(QUERIES):
        at = START + 100_000 * q
        out += [
            {"Event": sql + "SparkListenerSQLExecutionStart", "executionId": q, "description": "count at own.py:1", "time": at},
            {"Event": sql + "SparkListenerSQLAdaptiveExecutionUpdate", "executionId": q, "physicalPlanDescription": JOIN_PLAN, "sparkPlanInfo": _info(JOIN_INFO, q)},
            {"Event": "SparkListenerJobStart", "Job ID": q, "Submission Time": at + 1000, "Stage IDs": [2 * q, 2 * q + 1]},
        ]
        for s in (2 * q, 2 * q + 1):
            stage = {"Stage ID": s, "Stage Attempt ID": 0, "Submission Time": at + 2000}
            out += [{"Event": "SparkListenerStageSubmitted", "Stage Info": stage}, {"Event": "SparkListenerStageCompleted", "Stage Info": stage | {"Completion Time": at + 50_000}}]
        out += [
            {"Event": sql + "SparkListenerDriverAccumUpdates", "executionId": q, "accumUpdates": [[100 * q + 5, 4 + log], [100 * q + 5, 2]]},
            {"Event": "SparkListenerJobEnd", "Job ID": q, "Completion Time": at + 60_000},
            {"Event": sql + "SparkListenerSQLExecutionEnd", "executionId": q, "time": at + 65_000 + 5000 * log},
        ]
    return [*out, {"Event": "SparkListenerApplicationEnd", "Timestamp": START + 465_000 + 5000 * log}]


def _task_lines(spark: SparkSession, sf_dir: str, log: int) -> DataFrame:
    t = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    q = F.col("l_partkey") % QUERIES
    second = (F.col("l_linenumber") % 2).cast("bigint")
    start = F.lit(START + 3000) + 100_000 * q
    long = lambda c: c.cast("bigint")
    rows = long(F.col("l_quantity"))

    def update(k: int, amount: Column) -> Column:
        return F.struct((100 * q + k).alias("ID"), F.lit("metric").alias("Name"), amount.cast("string").alias("Update"), (amount * 10).cast("string").alias("Value"), F.lit(False).alias("Internal"))

    accumulables = F.when(second == 0, F.array(update(1, rows), update(2, rows * 1024))).otherwise(F.array(update(3, rows * 60), update(4, rows * 100)))
    info = F.struct(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("Task ID"), F.lit(0).alias("Index"), F.lit(0).alias("Attempt"), start.alias("Launch Time"), (start + rows * F.when(rows == 50, 40).otherwise(1) * 10).alias("Finish Time"),
        (F.col("l_suppkey") % 4).cast("string").alias("Executor ID"), F.lit("host").alias("Host"), F.lit("ANY").alias("Locality"), F.lit(False).alias("Speculative"), F.lit(False).alias("Failed"), F.lit(False).alias("Killed"), accumulables.alias("Accumulables"),
    )
    metrics = F.struct(
        (rows * 10).alias("Executor Run Time"), F.when(F.col("l_discount") >= 0.09, rows * 1024).otherwise(F.lit(0).cast("bigint")).alias("Memory Bytes Spilled"), F.lit(0).alias("Disk Bytes Spilled"),
        F.struct(F.lit(0).alias("Remote Bytes Read"), F.when(second == 1, rows * 1024).otherwise(F.lit(0).cast("bigint")).alias("Local Bytes Read")).alias("Shuffle Read Metrics"), F.struct(F.when(second == 0, rows * 1024).otherwise(F.lit(0).cast("bigint")).alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
        F.struct(F.when(second == 0, rows * 1_048_576 * (log + 1)).otherwise(F.lit(0).cast("bigint")).alias("Bytes Read"), rows.alias("Records Read")).alias("Input Metrics"), F.struct(F.lit(0).alias("Bytes Written"), F.lit(0).alias("Records Written")).alias("Output Metrics"),
    )
    line = F.struct(F.lit("SparkListenerTaskEnd").alias("Event"), (2 * q + second).alias("Stage ID"), F.lit(0).alias("Stage Attempt ID"), F.lit("ShuffleMapTask").alias("Task Type"), info.alias("Task Info"), metrics.alias("Task Metrics"))
    # As tasks end: query by query, stage by stage, by time. Lines beside each other are alike then, and compress.
    ended = t.sortWithinPartitions(q, second, "l_quantity", F.col("l_discount") >= 0.09, F.col("l_suppkey") % 4, "l_orderkey")
    return ended.select(F.to_json(line).alias("value"))


def written(spark: SparkSession, sf_dir: str) -> str:
    """Writes both logs, as compressed rolling logs of two parts, and returns their folder."""
    folder = new_folder(spark, "own-log")
    for log, name in enumerate(LOGS):
        own = f"{folder}/eventlog_v2_{name}"
        lines = [json.dumps(e) for e in _head(log)]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{own}/events_1_{name}")
        _task_lines(spark, sf_dir, log).write.option("compression", "gzip").option("maxRecordsPerFile", LINES_A_FILE).text(f"{own}/events_2_{name}")
    return folder


def _relations(spark: SparkSession, sf_dir: str) -> api.Relations:
    folder = written(spark, sf_dir)
    out = api.relations(spark, folder)
    drop_folder(spark, folder)  # the relations read the tables that were made of it
    return out


_TASKS = f"""
log AS (SELECT * FROM (VALUES ('app-1', 0), ('app-2', 1)) l(log_name, n)),
task AS (
  SELECT log_name, l_partkey % 5 AS query_id, 2 * (l_partkey % 5) + l_linenumber % 2 AS stage_id, l_orderkey * 8 + l_linenumber AS task_id, l_linenumber % 2 AS second, CAST(l_quantity AS BIGINT) AS q,
    CAST(l_quantity AS BIGINT) * CASE WHEN l_quantity = 50 THEN 40 ELSE 1 END / 100.0 AS seconds, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) * 1048576 * (n + 1) ELSE 0 END AS bytes_read,
    CASE WHEN l_discount >= 0.09 THEN CAST(l_quantity AS BIGINT) * 1024 ELSE 0 END AS spilled, CAST(l_quantity AS BIGINT) * 1024 AS shuffled, l_suppkey % 4 AS executor, {START + 3000} + 100000 * (l_partkey % 5) AS start_ms
  FROM lineitem CROSS JOIN log)"""
_ISO = "strftime(make_timestamp({} * 1000), '%Y-%m-%dT%H:%M:%S')"


@query(f"""WITH {_TASKS}, plan(node_id, node_type, child_nodes, codegen, name, k) AS (VALUES
  (13, 'ResultQueryStage', '12', NULL, NULL, 0), (12, 'SortMergeJoin', '5, 11', 4, 'number of output rows', 4), (5, 'Sort', '4', 3, 'sort time', 3), (4, 'AQEShuffleRead', '3', NULL, NULL, 0), (3, 'ShuffleQueryStage', '2', NULL, NULL, 0),
  (2, 'Exchange', '1', NULL, 'data size', 2), (1, 'Scan', '', NULL, 'number of output rows', 1), (11, 'Sort', '10', 2, NULL, 0), (10, 'ShuffleQueryStage', '9', NULL, NULL, 0), (9, 'Exchange', '8', NULL, NULL, 0), (8, 'Project', '7', 1, NULL, 0),
  (7, 'Range', '', 1, 'number of output rows', 5), (100001, 'WholeStageCodegen', NULL, 1, NULL, 0), (100002, 'WholeStageCodegen', NULL, 2, NULL, 0), (100003, 'WholeStageCodegen', NULL, 3, NULL, 0), (100004, 'WholeStageCodegen', NULL, 4, NULL, 0)),
s AS (SELECT log_name, query_id, second, count(*) AS n, max(q) AS top FROM task GROUP BY 1, 2, 3),
m AS (SELECT log_name, query_id, CASE second WHEN 0 THEN unnest([1, 2]) ELSE unnest([3, 4]) END AS k, n, top FROM s UNION ALL SELECT log_name, query_id, 5, 2, n + 6 FROM log CROSS JOIN (SELECT unnest(range(5)) AS query_id))
SELECT log.log_name, query_id, node_id, '[' || CASE WHEN node_id >= 100000 THEN node_id - 100000 ELSE node_id END || '] ' || node_type AS node_name, coalesce(child_nodes, '') AS child_nodes, codegen AS whole_stage_codegen_id,
  coalesce(m.n, 0) AS n_accumulators, CASE WHEN m.n > 0 THEN 1 ELSE 0 END AS n_accumulator_totals,
  CASE k WHEN 1 THEN 10 * top WHEN 2 THEN 10240 * top WHEN 3 THEN 600 * top WHEN 4 THEN 1000 * top WHEN 5 THEN top END AS total, {rounded("CASE k WHEN 3 THEN coalesce(600 * top, 0) / 60000.0 ELSE 0 END", 4)} AS node_duration_minutes,
  query_id || ' - count [' || CAST(CAST(round((65 + 5 * log.n) / 60.0, 2) AS DECIMAL(9,2)) AS VARCHAR) || ' min]' AS query_header
FROM log CROSS JOIN (SELECT CAST(unnest(range(5)) AS BIGINT) AS query_id) CROSS JOIN plan LEFT JOIN m USING (log_name, query_id, k)""")
def log_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node relation of both logs."""
    total = F.get("accumulator_totals", F.lit(0))["value"].cast("bigint").alias("total")
    columns = ["log_name", "query_id", "node_id", "node_name", F.coalesce("child_nodes", F.lit("")).alias("child_nodes"), "whole_stage_codegen_id", "n_accumulators", "n_accumulator_totals", total, R.exact_round(F.col("node_duration_minutes"), 4).alias("node_duration_minutes"), "query_header"]
    return _relations(spark, sf_dir).dag.select(*columns)


@query(f"""WITH {_TASKS}
SELECT log_name, query_id, query_id AS job_id, stage_id, task_id, CAST(executor AS VARCHAR) AS executor_id, CASE second WHEN 0 THEN '[1] Scan,[2] Exchange' ELSE '[5] Sort,[12] SortMergeJoin' END AS nodes, CAST(bytes_read AS BIGINT) AS bytes_read, {rounded('seconds', 3)} AS task_duration_seconds,
  {rounded('q / 100.0', 3)} AS executor_run_time_seconds, CAST(spilled AS BIGINT) AS memory_bytes_spilled, CASE second WHEN 1 THEN shuffled ELSE 0 END AS shuffle_bytes_read, 59.0 AS job_duration_seconds, 48.0 AS stage_duration_seconds, 'count' AS query_function,
  {_ISO.format(f"({START} + 100000 * query_id)")} AS query_start_timestamp FROM task""")
def log_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task relation of both logs."""
    rounded_ = {c: R.exact_round(F.col(c), 3) for c in ("task_duration_seconds", "executor_run_time_seconds")}
    out = _relations(spark, sf_dir).combined.withColumns(rounded_).withColumn("nodes", F.array_join("nodes", ","))
    return out.select("log_name", "query_id", "job_id", "stage_id", "task_id", "executor_id", "nodes", "bytes_read", "task_duration_seconds", "executor_run_time_seconds", "memory_bytes_spilled", "shuffle_bytes_read", "job_duration_seconds", "stage_duration_seconds", "query_function", "query_start_timestamp")


_STAGES = "g AS (SELECT log_name, query_id, stage_id, second, count(*) AS n, count(*) FILTER (WHERE spilled > 0) AS spills, max(seconds) / median(seconds) AS ratio, sum(shuffled) AS shuffled, max(q) AS top FROM task GROUP BY ALL)"


@query(f"""WITH {_TASKS}, {_STAGES},
j AS (SELECT a.log_name, a.query_id, 1000 * b.top AS output, greatest(10 * a.top, a.query_id * 0 + 6 + log.n) AS most FROM g a JOIN g b ON a.log_name = b.log_name AND a.query_id = b.query_id AND a.second = 0 AND b.second = 1 JOIN log ON log.log_name = a.log_name)
SELECT log_name, 'critical' AS severity, 'Row Count Explosion' AS category, query_id, NULL AS stage_id FROM j WHERE output >= 1.1 * most
UNION ALL SELECT log_name, 'critical', 'Spill', query_id, stage_id FROM g WHERE spills > 0
UNION ALL SELECT log_name, 'warning', 'Repeated Scan', NULL, NULL FROM log
UNION ALL SELECT log_name, 'warning', 'Task Skew', query_id, stage_id FROM g WHERE ratio >= 5
UNION ALL SELECT log_name, 'warning', 'Heavy Shuffle', query_id, stage_id FROM g WHERE shuffled > 1073741824""")
def log_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of both logs, explosions too."""
    r = _relations(spark, sf_dir)
    return D.issues(r.dag, r.combined).select("log_name", "severity", "category", "query_id", "stage_id")


@query(f"""WITH {_TASKS}, {_STAGES}
SELECT log_name, 465.0 + 5.0 * (log_name = 'app-2')::INT AS duration_s, CAST(sum(bytes_read) AS BIGINT) AS bytes_read, CAST(0 AS BIGINT) AS bytes_written, CAST(sum(shuffled) AS BIGINT) AS shuffle_bytes, CAST(sum(spilled) AS BIGINT) AS spill_bytes, count(DISTINCT query_id) AS n_queries,
  count(DISTINCT stage_id) AS n_stages, count(*) AS n_tasks, CAST(0 AS BIGINT) AS n_cartesian_joins, {rounded('(SELECT max(600 * top) / 60000.0 FROM g WHERE second = 1 AND g.log_name = task.log_name)', 4)} AS max_node_duration_min,
  (SELECT CAST(max(b) AS BIGINT) FROM (SELECT log_name AS l, query_id, sum(bytes_read) AS b FROM task GROUP BY 1, 2) WHERE l = task.log_name) AS max_scan_bytes FROM task GROUP BY log_name""")
def log_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each log."""
    r = _relations(spark, sf_dir)
    one = lambda name: H.run_record(r.dag.where(F.col("log_name") == name), r.combined.where(F.col("log_name") == name), name)
    out = one(LOGS[0]).unionByName(one(LOGS[1])).drop("run_id", "run_at")
    return out.withColumn("max_node_duration_min", R.exact_round(F.col("max_node_duration_min"), 4))


@query(f"""WITH {_TASKS}
SELECT log_name, query_id, 'count' AS query_function, CAST(65.0 + 5 * n AS DOUBLE) AS duration_seconds, CAST(16 AS BIGINT) AS n_nodes, 'file:/data/t' AS paths, 'Inner' AS join_type, 'a#1L=id#3L' AS keys, {_ISO.format(f"({START} + 100000 * query_id)")} AS start
FROM log CROSS JOIN (SELECT CAST(unnest(range(5)) AS BIGINT) AS query_id)""".replace("file:/data/t", "/data/t"))
def log_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary says of each query: its nodes, and details of its scan and its join."""
    out = D.plan_summary(_relations(spark, sf_dir).dag)
    facts = lambda kind: F.get(F.filter("nodes", lambda n: n["node_type"] == kind), F.lit(0))["details"]
    keys = F.concat_ws("=", F.get(facts("SortMergeJoin")["left_keys"], F.lit(0)), F.get(facts("SortMergeJoin")["right_keys"], F.lit(0)))
    return out.select("log_name", "query_id", "query_function", "duration_seconds", F.size("nodes").cast("bigint").alias("n_nodes"), F.array_join(facts("Scan")["paths"], ",").alias("paths"), facts("SortMergeJoin")["join_type"].alias("join_type"), keys.alias("keys"), "start")


@query(f"""WITH {_TASKS}
SELECT log_name, 'job' AS kind, CAST(10 AS BIGINT) AS n FROM log UNION ALL SELECT log_name, 'stage', 20 FROM log UNION ALL SELECT log_name, 'task', (SELECT count(*) FROM lineitem) FROM log
UNION ALL SELECT log_name, 'query', 10 FROM log UNION ALL SELECT log_name, 'plan', 5 FROM log UNION ALL SELECT log_name, 'driver update', 10 FROM log""")
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each kind of event table."""
    folder = written(spark, sf_dir)
    t = E.read(spark, folder)
    drop_folder(spark, folder)
    tables = {"job": t.jobs, "stage": t.stages, "task": t.tasks, "query": t.queries, "plan": t.plans, "driver update": t.driver_updates}
    out = None
    for kind, table in tables.items():
        one = table.groupBy("log_name").agg(F.count("*").alias("n")).select("log_name", F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES ('app-1', '7.75 min'), ('app-2', '7.83 min')) t(log_name, duration)")
def log_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both logs as the catalogue lists them: from the first timestamp to the last."""
    return E.catalogue(spark, written(spark, sf_dir)).select("log_name", "duration")
