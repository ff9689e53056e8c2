"""Detectors, the feed of issues and the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import readable as R
from ..operators import detect as D
from ..operators import graph as G
from ..render import heat
from . import surrogate as X
from .registry import bytes_text, query, rounded, text1

_SPILL = """spill AS (SELECT query_id, stage_id, CAST(sum(memory_bytes_spilled) AS BIGINT) AS memory_bytes_spilled, CAST(sum(disk_bytes_spilled) AS BIGINT) AS disk_bytes_spilled, count(*) AS task_count
  FROM task WHERE memory_bytes_spilled > 0 OR disk_bytes_spilled > 0 GROUP BY 1, 2)"""
_SKEW = """skew AS (SELECT query_id, stage_id, count(*) AS task_count, median(task_duration_seconds) AS median_duration_seconds, max(task_duration_seconds) AS max_duration_seconds,
  max(task_duration_seconds) / median(task_duration_seconds) AS skew_ratio FROM task GROUP BY 1, 2 HAVING median(task_duration_seconds) > 0 AND max(task_duration_seconds) / median(task_duration_seconds) >= 5)"""
_SHUFFLE = """heavy AS (SELECT query_id, stage_id, CAST(sum(shuffle_bytes_written) AS BIGINT) AS shuffle_bytes_written, CAST(sum(shuffle_bytes_read) AS BIGINT) AS shuffle_bytes_read, count(*) AS task_count,
  CAST(sum(shuffle_bytes_written) + sum(shuffle_bytes_read) AS BIGINT) AS total_shuffle_bytes FROM task GROUP BY 1, 2)"""
_REPEATED = """repeated AS (SELECT path, count(*) AS scan_count, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS query_ids FROM (SELECT DISTINCT path, query_id FROM scan) GROUP BY 1 HAVING count(*) > 1)"""
_SCAN = "scan AS (SELECT path, job_id + stage_id % 3 AS query_id FROM task)"


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.tasks(spark, sf_dir).select("path", (F.col("job_id") + F.col("stage_id") % 3).alias("query_id"))


@query(f"WITH {X.TASK}, {_SPILL} SELECT * FROM spill")
def spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spill(X.tasks(spark, sf_dir))


@query(f"WITH {X.TASK}, {_SKEW} SELECT query_id, stage_id, task_count, {rounded('median_duration_seconds', 4)} AS median_duration_seconds, {rounded('max_duration_seconds', 4)} AS max_duration_seconds, {rounded('skew_ratio', 4)} AS skew_ratio FROM skew")
def skewed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.skewed_tasks(X.tasks(spark, sf_dir))
    return out.withColumns({c: R.exact_round(F.col(c), 4) for c in ("median_duration_seconds", "max_duration_seconds", "skew_ratio")})


@query(f"WITH {X.TASK}, {_SHUFFLE} SELECT * FROM heavy WHERE total_shuffle_bytes > 0")
def shuffle_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.heavy_shuffles(X.tasks(spark, sf_dir))


@query(f"WITH {X.TASK} SELECT query_id, stage_id AS node_id, '[' || stage_id || '] Stage' AS node_name, 'Stage' AS node_type, {rounded('sum(task_duration_seconds) / 60000', 4)} AS node_duration_minutes FROM task GROUP BY 1, 2 HAVING sum(task_duration_seconds) / 60000 >= 1")
def long_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = X.tasks(spark, sf_dir).groupBy("query_id", F.col("stage_id").alias("node_id")).agg((F.sum("task_duration_seconds") / 60000).alias("node_duration_minutes"))
    nodes = nodes.withColumn("node_name", F.concat(F.lit("["), F.col("node_id").cast("string"), F.lit("] Stage"))).withColumn("node_type", F.lit("Stage"))
    return D.long_nodes(nodes).withColumn("node_duration_minutes", R.exact_round(F.col("node_duration_minutes"), 4))


@query(f"WITH {X.TASK}, {_SCAN}, {_REPEATED} SELECT * FROM repeated")
def repeated_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.repeated_scans(_scans(spark, sf_dir)).withColumn("query_ids", F.array_join(F.col("query_ids").cast("array<string>"), ","))


@query(f"WITH {X.TASK} SELECT query_id, path AS node_name, CAST(sum(bytes_read) AS BIGINT) AS bytes_read, CAST(sum(records_read) AS BIGINT) AS records_read, min(path) AS paths FROM task GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def largest_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = X.tasks(spark, sf_dir).withColumn("node_name", F.col("path"))
    scans = tasks.select("query_id", "node_name", F.col("path").alias("paths")).distinct()
    return D.largest_scans(tasks, scans)


_DETAIL = """node AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS node_id, CASE o_orderkey % 4 WHEN 0 THEN 'BroadcastNestedLoopJoin' WHEN 1 THEN 'BroadcastHashJoin' WHEN 2 THEN 'SortMergeJoin' ELSE 'Project' END AS node_type,
  '{"node_id": ' || o_orderkey || ', "detail": {"join_type": "' || CASE o_orderstatus WHEN 'F' THEN 'Cross' ELSE 'Inner' END || '"}}' AS details, o_totalprice / 1000 AS node_duration_minutes FROM orders)"""


@query(f"""WITH {_DETAIL} SELECT query_id, node_id, '[' || node_id || '] ' || node_type AS node_name, node_type, details, {rounded('node_duration_minutes', 3)} AS node_duration_minutes FROM node
WHERE node_type = 'BroadcastNestedLoopJoin' OR (node_type IN ('BroadcastHashJoin', 'SortMergeJoin') AND json_extract_string(details, '$.detail.join_type') = 'Cross')""")
def cartesian_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    o = X.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("query_id"), key.alias("node_id"), F.when(kind == 0, "BroadcastNestedLoopJoin").when(kind == 1, "BroadcastHashJoin").when(kind == 2, "SortMergeJoin").otherwise("Project").alias("node_type"),
        F.concat(F.lit('{"node_id": '), key.cast("string"), F.lit(', "detail": {"join_type": "'), F.when(F.col("o_orderstatus") == "F", "Cross").otherwise("Inner"), F.lit('"}}')).alias("details"), (F.col("o_totalprice") / 1000).alias("node_duration_minutes"),
    )
    o = o.withColumn("node_name", F.concat(F.lit("["), F.col("node_id").cast("string"), F.lit("] "), F.col("node_type")))
    return D.cartesian_joins(o).withColumn("node_duration_minutes", R.exact_round(F.col("node_duration_minutes"), 3))


@query(f"""WITH RECURSIVE {X.EDGES}, walk(query_id, node_id) AS (SELECT CAST(n_nationkey AS BIGINT), 3000000000 + n_nationkey FROM nation UNION SELECT w.query_id, e.child_id FROM walk w JOIN edge e ON e.query_id = w.query_id AND e.parent_id = w.node_id)
SELECT query_id, count(*) AS n_nodes, min(node_id) AS least, max(node_id) AS most FROM walk GROUP BY 1""")
def source_scan_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), (F.lit(3_000_000_000).cast("bigint") + F.col("n_nationkey")).alias("node_id"))
    return G.reach(starts, X.plan_edges(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n_nodes"), F.min("node_id").alias("least"), F.max("node_id").alias("most"))


_JOINED = """j AS (SELECT CAST(c_nationkey AS BIGINT) AS query_id, c_custkey AS node_id, count(*) AS l, CAST(sum(o_orderkey % 13) AS BIGINT) AS price FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query(f"""WITH {_JOINED}, x AS (SELECT query_id, node_id, l AS left_input_rows, node_id % 7 + 1 AS right_input_rows, price % 50 AS output_rows FROM j)
SELECT query_id, node_id, 'SortMergeJoin' AS node_type, 'Inner' AS join_type, output_rows, left_input_rows, right_input_rows, {rounded('output_rows / CAST(greatest(left_input_rows, right_input_rows) AS DOUBLE)', 4)} AS ratio
FROM x WHERE output_rows > 0 AND output_rows / CAST(greatest(left_input_rows, right_input_rows) AS DOUBLE) >= 1.1""")
def row_explosions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join a customer: below its left side a scan an order, of a row each; below its right side one scan."""
    o, c = X.table(spark, sf_dir, "orders"), X.table(spark, sf_dir, "customer")
    oc = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("bigint").alias("query_id"), F.col("c_custkey").alias("cust"), F.col("o_orderkey").alias("ord"), "o_totalprice")
    left, right, scan = 10_000_000_000, 20_000_000_000, 30_000_000_000
    none = F.lit(None)
    joins = oc.groupBy("query_id", F.col("cust").alias("node_id")).agg((F.sum(F.col("ord") % 13) % 50).alias("output_rows"))
    joins = joins.select("query_id", "node_id", F.lit("SortMergeJoin").alias("node_type"), "output_rows", F.lit("Inner").alias("join_type"))
    ids = oc.select("query_id", "cust").distinct()
    rights = ids.select("query_id", (F.col("cust") + right).alias("node_id"), F.lit("Scan").alias("node_type"), (F.col("cust") % 7 + 1).alias("output_rows"), none.cast("string").alias("join_type"))
    lefts = ids.select("query_id", (F.col("cust") + left).alias("node_id"), F.lit("Project").alias("node_type"), none.cast("bigint").alias("output_rows"), none.cast("string").alias("join_type"))
    scans = oc.select("query_id", (F.col("ord") + scan).alias("node_id"), F.lit("Scan").alias("node_type"), F.lit(1).cast("bigint").alias("output_rows"), none.cast("string").alias("join_type"))
    nodes = joins.unionByName(rights).unionByName(lefts).unionByName(scans)
    nodes = nodes.withColumns({"left_keys": none.cast("array<string>"), "right_keys": none.cast("array<string>"), "paths": F.array().cast("array<string>")})
    edges = ids.select("query_id", F.col("cust").alias("parent_id"), F.lit(0).alias("child_ord"), (F.col("cust") + left).alias("child_id"))
    edges = edges.unionByName(ids.select("query_id", F.col("cust").alias("parent_id"), F.lit(1).alias("child_ord"), (F.col("cust") + right).alias("child_id")))
    edges = edges.unionByName(oc.select("query_id", (F.col("cust") + left).alias("parent_id"), F.lit(0).alias("child_ord"), (F.col("ord") + scan).alias("child_id")))
    return D.row_explosions(nodes, edges).select("query_id", "node_id", "node_type", "join_type", "output_rows", "left_input_rows", "right_input_rows", R.exact_round(F.col("ratio"), 4).alias("ratio"))


@query(f"""WITH RECURSIVE {X.EDGES}, t AS (SELECT query_id, parent_id, child_id, child_id >= 2000000000 AND child_id < 4000000000 AS hidden FROM edge),
w(query_id, parent_id, child_id, hidden) AS (SELECT * FROM t WHERE parent_id >= 4000000000 UNION SELECT w.query_id, w.parent_id, t.child_id, t.hidden FROM w JOIN t ON w.hidden AND t.query_id = w.query_id AND t.parent_id = w.child_id)
SELECT DISTINCT query_id, parent_id, child_id FROM w WHERE NOT hidden""")
def edge_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = X.plan_edges(spark, sf_dir)
    ids = edges.select("query_id", F.col("parent_id").alias("node_id")).unionByName(edges.select("query_id", F.col("child_id").alias("node_id"))).distinct()
    hidden = (F.col("node_id") >= 2_000_000_000) & (F.col("node_id") < 4_000_000_000)
    return G.contract(ids.withColumn("node_type", F.when(hidden, "ReusedExchange").otherwise("Scan")), edges)


@query(f"""WITH {X.METRIC}, n AS (SELECT query_id, node_id, CAST(sum(upd) AS DOUBLE) AS v FROM metric GROUP BY 1, 2)
SELECT query_id, node_id, {rounded('CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0.5 END', 5)} AS heat FROM n WINDOW w AS (PARTITION BY query_id)""")
def node_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = X.metrics(spark, sf_dir).groupBy("query_id", "node_id").agg(F.sum("upd").alias("v"))
    return nodes.select("query_id", "node_id", R.exact_round(heat(F.col("v"), "query_id"), 5).alias("heat"))


@query(f"""WITH {X.TASK}, {_SPILL}, {_SKEW}, {_SHUFFLE}, {_SCAN}, {_REPEATED}
SELECT 'critical' AS severity, 'Spill' AS category, 'Query ' || query_id || ', stage ' || stage_id || ' spilled ' || {bytes_text('memory_bytes_spilled')} || ' from memory and ' || {bytes_text('disk_bytes_spilled')} || ' to disk in ' || task_count || ' tasks' AS message, query_id, stage_id FROM spill
UNION ALL SELECT 'warning', 'Repeated Scan', regexp_extract(path, '[^/]+$') || ' is scanned by ' || scan_count || ' queries', NULL, NULL FROM repeated
UNION ALL SELECT 'warning', 'Task Skew', 'Query ' || query_id || ', stage ' || stage_id || ' has a task of ' || {text1('skew_ratio')} || ' times the median', query_id, stage_id FROM skew
UNION ALL SELECT 'warning', 'Heavy Shuffle', 'Query ' || query_id || ', stage ' || stage_id || ' shuffled ' || {bytes_text('total_shuffle_bytes')}, query_id, stage_id FROM heavy WHERE total_shuffle_bytes > 1073741824""")
def issues_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.issue_rows(D.stage_statistics(X.tasks(spark, sf_dir)), repeated=D.repeated_scans(_scans(spark, sf_dir)))


@query(f"WITH {X.TASK} SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("bytes_read", "records_read", "bytes_written", "memory_bytes_spilled", "disk_bytes_spilled", "shuffle_bytes_read", "shuffle_bytes_written")) + " FROM task")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.totals(X.tasks(spark, sf_dir), ("bytes_read", "records_read", "bytes_written", "memory_bytes_spilled", "disk_bytes_spilled", "shuffle_bytes_read", "shuffle_bytes_written"))
