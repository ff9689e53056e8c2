"""Detectors over the two relations, the feed of issues and the summary of plans."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import readable as R
from .graph import SOURCES, reach, shared_keys

# Joins that can make rows, and the defaults of the detectors.
JOINS = ("BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct")
EXPLOSION_RATIO, SKEW_RATIO, LONG_MINUTES, LARGEST_SCANS = 1.1, 5.0, 1.0, 10
HEAVY_SHUFFLE_BYTES = 1024**3
ROW_METRICS = ("number of output rows", "numOutputRows")
_LIST = "array<string>"


def detail(path: str, column: str = "details") -> Column:
    """A field of a node's details; null where they aren't JSON or don't have it."""
    return F.get_json_object(column, f"$.detail.{path}")


def detail_list(path: str) -> Column:
    return F.from_json(detail(path), _LIST)


def scan_paths() -> Column:
    return F.coalesce(detail_list("location.location"), F.array().cast(_LIST))


def output_rows(totals: str = "accumulator_totals") -> Column:
    """Rows that a node gave, by the first name that has a value other than 0."""

    def value(name: str) -> Column:
        return F.get(F.filter(totals, lambda a: a["metric_name"] == name), F.lit(0))["value"].cast("long")

    return F.coalesce(F.nullif(value(ROW_METRICS[0]), F.lit(0)), value(ROW_METRICS[1]), value(ROW_METRICS[0]))


def edges(dag: DataFrame) -> DataFrame:
    """Edges of the node relation, whose children are "1, 2"."""
    keys = shared_keys(dag)
    return dag.select(*keys, F.col("node_id").alias("parent_id"), F.posexplode(F.split("child_nodes", ",\\s*")).alias("child_ord", "c")).select(*keys, "parent_id", "child_ord", F.col("c").try_cast("long").alias("child_id")).where("child_id is not null")


def cartesian_joins(dag: DataFrame) -> DataFrame:
    """Nested-loop joins, and hash and merge joins whose type is Cross."""
    cross = F.col("node_type").isin("BroadcastHashJoin", "SortMergeJoin") & (detail("join_type") == "Cross")
    keys = shared_keys(dag)
    return dag.where((F.col("node_type") == "BroadcastNestedLoopJoin") | F.coalesce(cross, F.lit(False))).select(*keys, "node_id", "node_name", "node_type", "details", "node_duration_minutes").orderBy(*keys, "node_id")


def source_scans(nodes: DataFrame, starts: DataFrame, edges: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(start columns..., scan's node_id): source scans below each start; walks stop at a scan."""
    scans = nodes.where(F.col("node_type").isin(*sources)).select(*shared_keys(nodes), "node_id")
    return reach(starts, edges, stop=scans).join(scans, [*shared_keys(nodes), "node_id"], "left_semi")


def row_explosions(nodes: DataFrame, edges: DataFrame, ratio: float = EXPLOSION_RATIO) -> DataFrame:
    """Joins that gave ratio times as many rows as the scans below their larger side, largest first.

    nodes: query_id, node_id, node_type, output_rows, join_type, left_keys, right_keys, paths.
    """
    keys = shared_keys(nodes)
    joins = nodes.where(F.col("node_type").isin(*JOINS) & (F.col("output_rows") > 0))
    sides = edges.where("child_ord < 2").join(joins.select(*keys, F.col("node_id").alias("parent_id")), [*keys, "parent_id"], "left_semi")
    starts = sides.select(*keys, "parent_id", "child_ord", F.col("child_id").alias("node_id"))
    found = source_scans(nodes, starts, edges).join(nodes.select(*keys, "node_id", "output_rows", "paths"), [*keys, "node_id"])
    side = lambda k, c: F.when(F.col("child_ord") == k, c)
    paths = lambda k: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("child_ord") == k, F.struct("node_id", "paths")))), lambda x: x["paths"]))
    rows = found.groupBy(*keys, F.col("parent_id").alias("node_id")).agg(
        F.sum(side(0, F.col("output_rows"))).alias("left_input_rows"), F.sum(side(1, F.col("output_rows"))).alias("right_input_rows"), paths(0).alias("left_scan_paths"), paths(1).alias("right_scan_paths")
    )
    two = sides.groupBy(*keys, F.col("parent_id").alias("node_id")).agg(F.max("child_ord").alias("last")).where("last = 1").drop("last")
    out = joins.drop("paths").join(two, [*keys, "node_id"], "left_semi").join(rows, [*keys, "node_id"])
    largest = F.greatest(F.coalesce("left_input_rows", F.lit(0)), F.coalesce("right_input_rows", F.lit(0)))
    out = out.where(largest > 0).withColumn("ratio", F.col("output_rows") / largest).where(F.col("ratio") >= ratio)
    names = ["node_id", "node_type", "join_type", "left_keys", "right_keys", "output_rows", "left_input_rows", "right_input_rows", "ratio", "left_scan_paths", "right_scan_paths"]
    nothing = lambda c: F.nullif(F.col(c), F.lit(0)).alias(c)
    return out.select(*keys, *(nothing(c) if c.endswith("input_rows") else c for c in names)).orderBy(F.desc("ratio"), *keys, "node_id")


def explosion_nodes(dag: DataFrame) -> DataFrame:
    """What row_explosions() asks of nodes, from the node relation."""
    return dag.select(*shared_keys(dag), "node_id", "node_type", output_rows().alias("output_rows"), detail("join_type").alias("join_type"), detail_list("left_keys").alias("left_keys"), detail_list("right_keys").alias("right_keys"), scan_paths().alias("paths"))


def find_row_explosions(dag: DataFrame, ratio: float = EXPLOSION_RATIO) -> DataFrame:
    return row_explosions(explosion_nodes(dag), edges(dag), ratio)


def largest_scans(reads: DataFrame, scans: DataFrame | None = None, n: int = LARGEST_SCANS) -> DataFrame:
    """The n scans that read most, by bytes. reads: query_id, node_name, bytes_read, records_read, a row a task and
    node; scans: query_id, node_name, paths of the scan nodes; log_name in both where there are many logs."""
    node = [*shared_keys(reads), "node_name"]
    out = reads.groupBy(*node).agg(F.sum("bytes_read").alias("bytes_read"), F.sum("records_read").alias("records_read"))
    if scans is not None:
        out = out.join(scans.select(*node, "paths"), node, "left")
    return out.orderBy(F.desc("bytes_read"), *node).limit(n)


def find_largest_scans(dag: DataFrame, combined: DataFrame, n: int = LARGEST_SCANS) -> DataFrame:
    keys = shared_keys(combined)
    scans = dag.where("node_type = 'Scan'").select(*keys, "node_name", scan_paths().alias("paths"))
    reads = combined.select(*keys, F.explode("nodes").alias("node_name"), "bytes_read", "records_read")
    reads = reads.groupBy(*keys, "node_name").agg(F.sum("bytes_read").alias("bytes_read"), F.sum("records_read").alias("records_read"))  # tasks add up before any join
    reads = reads.join(scans.select(*keys, "node_name"), [*keys, "node_name"], "left_semi")
    return largest_scans(reads, scans, n)


def repeated_scans(scans: DataFrame) -> DataFrame:
    """Paths that several queries of a log scan, most often first. scans: path, query_id, and log_name where there
    are many logs."""
    log = [c for c in ("log_name",) if c in scans.columns]
    out = scans.select(*log, "path", "query_id").distinct().groupBy(*log, "path").agg(F.count("*").alias("scan_count"), F.sort_array(F.collect_list("query_id")).alias("query_ids"))
    return out.where("scan_count > 1").orderBy(F.desc("scan_count"), *log, "path")


def find_repeated_scans(dag: DataFrame) -> DataFrame:
    return repeated_scans(dag.where("node_type = 'Scan'").select(F.explode(scan_paths()).alias("path"), *shared_keys(dag)))


def _stage(combined: DataFrame) -> list[str]:
    """What a stage is known by: applications all number their queries and stages from 0."""
    return [*shared_keys(combined), "stage_id"]


def spill(combined: DataFrame) -> DataFrame:
    """Stages whose tasks spilled, with the sums and the number of those tasks."""
    stage = _stage(combined)
    spilled = combined.where("memory_bytes_spilled > 0 or disk_bytes_spilled > 0")
    out = spilled.groupBy(*stage).agg(F.sum("memory_bytes_spilled").alias("memory_bytes_spilled"), F.sum("disk_bytes_spilled").alias("disk_bytes_spilled"), F.count("*").alias("task_count"))
    return out.orderBy(*stage)


def _median(exact: bool) -> Column:
    return F.median("task_duration_seconds") if exact else F.percentile_approx("task_duration_seconds", 0.5, 10_000)


def skewed_tasks(combined: DataFrame, ratio: float = SKEW_RATIO, exact: bool = True) -> DataFrame:
    """Stages whose longest task took ratio times the median. exact=False takes an approximate median, in memory
    that doesn't grow with a stage's tasks."""
    stage = _stage(combined)
    out = combined.groupBy(*stage).agg(F.count("*").alias("task_count"), _median(exact).cast("double").alias("median_duration_seconds"), F.max("task_duration_seconds").alias("max_duration_seconds")).where("median_duration_seconds > 0")
    return out.withColumn("skew_ratio", F.col("max_duration_seconds") / F.col("median_duration_seconds")).where(F.col("skew_ratio") >= ratio).orderBy(F.desc("skew_ratio"), *stage)


def heavy_shuffles(combined: DataFrame, threshold_bytes: int = 0) -> DataFrame:
    """Stages that wrote and read more shuffle bytes than the threshold."""
    stage = _stage(combined)
    out = combined.groupBy(*stage).agg(F.sum("shuffle_bytes_written").alias("shuffle_bytes_written"), F.sum("shuffle_bytes_read").alias("shuffle_bytes_read"), F.count("*").alias("task_count"))
    out = out.withColumn("total_shuffle_bytes", F.coalesce("shuffle_bytes_written", F.lit(0)) + F.coalesce("shuffle_bytes_read", F.lit(0)))
    return out.where(F.col("total_shuffle_bytes") > threshold_bytes).orderBy(F.desc("total_shuffle_bytes"), *stage)


def long_nodes(dag: DataFrame, minutes: float = LONG_MINUTES) -> DataFrame:
    keys = shared_keys(dag)
    return dag.where(F.col("node_duration_minutes") >= minutes).select(*keys, "node_id", "node_name", "node_type", "node_duration_minutes").orderBy(F.desc("node_duration_minutes"), *keys, "node_id")


_ISSUE = ("severity", "category", "message", "query_id", "stage_id")


def stage_statistics(combined: DataFrame, exact: bool = True) -> DataFrame:
    """What the detectors of stages ask, in one pass: spilled bytes and the tasks that spilled, durations, shuffles;
    the median as in skewed_tasks()."""
    spilled = (F.col("memory_bytes_spilled") > 0) | (F.col("disk_bytes_spilled") > 0)
    return combined.groupBy(*_stage(combined)).agg(
        F.sum(F.when(spilled, F.col("memory_bytes_spilled"))).alias("memory_bytes_spilled"), F.sum(F.when(spilled, F.col("disk_bytes_spilled"))).alias("disk_bytes_spilled"), F.count_if(spilled).alias("spilled_tasks"),
        _median(exact).cast("double").alias("median"), F.max("task_duration_seconds").alias("longest"), (F.coalesce(F.sum("shuffle_bytes_written"), F.lit(0)) + F.coalesce(F.sum("shuffle_bytes_read"), F.lit(0))).alias("shuffled"),
    )


def _issue(order: int, weight: Column, severity: str, category: Column | str, message: list, query: Column | None = None, stage: Column | None = None) -> Column:
    """A finding; its kind's order and its weight in the kind place it in the feed."""
    text = F.concat(*(F.lit(m) if isinstance(m, str) else m.cast("string") for m in message))
    number = lambda c: (F.lit(None) if c is None else c).cast("long")
    kind = F.lit(category) if isinstance(category, str) else category
    return F.struct(F.lit(order).alias("o"), weight.cast("double").alias("w"), F.lit(severity).alias("severity"), kind.alias("category"), text.alias("message"), number(query).alias("query_id"), number(stage).alias("stage_id"))


def _log(rows: DataFrame) -> list[str]:
    return [c for c in ("log_name",) if c in rows.columns]


def _stage_issues(stats: DataFrame, skew: float, heavy: int) -> DataFrame:
    """Findings of stages: up to three a row, so that no detector reads the tasks again."""
    q, s, ratio = F.col("query_id"), F.col("stage_id"), F.col("longest") / F.col("median")
    spill_text = ["Query ", q, ", stage ", s, " spilled ", R.bytes_text(F.col("memory_bytes_spilled")), " from memory and ", R.bytes_text(F.col("disk_bytes_spilled")), " to disk in ", F.col("spilled_tasks"), " tasks"]
    found = F.array(
        F.when(F.col("spilled_tasks") > 0, _issue(1, F.col("disk_bytes_spilled"), "critical", "Spill", spill_text, q, s)),
        F.when((F.col("median") > 0) & (ratio >= skew), _issue(3, ratio, "warning", "Task Skew", ["Query ", q, ", stage ", s, " has a task of ", R.one_decimal(ratio), " times the median"], q, s)),
        F.when(F.col("shuffled") > heavy, _issue(4, F.col("shuffled"), "warning", "Heavy Shuffle", ["Query ", q, ", stage ", s, " shuffled ", R.bytes_text(F.col("shuffled"))], q, s)),
    )
    return stats.select(*_log(stats), F.inline(F.array_compact(found)))


def _explosion_issues(explosions: DataFrame) -> DataFrame:
    crossed = (F.col("node_type") == "BroadcastNestedLoopJoin") | (F.coalesce("join_type", F.lit("")) == "Cross")
    names = lambda c, other: F.coalesce(F.nullif(F.array_join(F.transform(c, R.path_name), ", "), F.lit("")), F.lit(other))
    rows = lambda c: R.count_text(F.col(c))
    listed = lambda c: F.array_join(F.transform(c, lambda k: F.regexp_replace(k, r"#\w+", "")), ", ")
    both = (F.coalesce(F.size("left_keys"), F.lit(0)) > 0) & (F.coalesce(F.size("right_keys"), F.lit(0)) > 0)
    keys = F.when(both, F.concat(F.lit(" on "), listed("left_keys"), F.lit(" = "), listed("right_keys"))).otherwise(" without join keys")
    message = [F.coalesce("join_type", F.lit("Unknown")), " join of ", names("left_scan_paths", "left"), " (", rows("left_input_rows"), " rows) and ", names("right_scan_paths", "right"), " (", rows("right_input_rows"), " rows) gave ", rows("output_rows"), " rows (", R.one_decimal(F.col("ratio")), "x)", keys]
    return explosions.select(*_log(explosions), F.inline(F.array(_issue(0, F.col("ratio"), "critical", F.when(crossed, "Cartesian Join").otherwise("Row Count Explosion"), message, F.col("query_id")))))


def issue_rows(stats: DataFrame, explosions: DataFrame | None = None, repeated: DataFrame | None = None, skew: float = SKEW_RATIO, heavy: int = HEAVY_SHUFFLE_BYTES) -> DataFrame:
    """One list of findings, ordered by kind and weight: severity, category, message, query_id, stage_id, and log_name
    where there are many logs."""
    out = _stage_issues(stats, skew, heavy)
    if explosions is not None:
        out = out.unionByName(_explosion_issues(explosions), allowMissingColumns=True)
    if repeated is not None:
        out = out.unionByName(repeated.select(*_log(repeated), F.inline(F.array(_issue(2, F.col("scan_count"), "warning", "Repeated Scan", [R.path_name(F.col("path")), " is scanned by ", F.col("scan_count"), " queries"])))), allowMissingColumns=True)
    return out.orderBy("o", F.desc("w"), "query_id", "stage_id", "message").select(*_log(out), *_ISSUE)


def issues(dag: DataFrame, combined: DataFrame, exact: bool = True) -> DataFrame:
    """Findings of all detectors with their defaults; shuffles count as heavy above 1 GiB."""
    return issue_rows(stage_statistics(combined, exact), find_row_explosions(dag), find_repeated_scans(dag))


_TOTALS = ("bytes_read", "records_read", "bytes_written", "records_written", "memory_bytes_spilled", "disk_bytes_spilled", "shuffle_bytes_read", "shuffle_bytes_written", "executor_run_time_seconds", "jvm_gc_time_seconds")


def totals(combined: DataFrame, columns: tuple[str, ...] = _TOTALS) -> DataFrame:
    """One row with the sums over all tasks."""
    return combined.agg(*(F.sum(c).alias(c) for c in columns))


def plan_summary(dag: DataFrame) -> DataFrame:
    """A row a query with its nodes as a list: what a reader needs of each, and details of scans and joins."""
    join = F.col("node_type").isin("BroadcastHashJoin", "SortMergeJoin")
    loop = F.col("node_type") == "BroadcastNestedLoopJoin"
    has = detail("join_type").isNotNull() | detail("read_schema").isNotNull()
    facts = F.struct(
        F.when(F.col("node_type") == "Scan", scan_paths()).alias("paths"), F.when(F.col("node_type") == "Scan", detail("read_schema")).alias("read_schema"), F.when(join | loop, detail("join_type")).alias("join_type"),
        F.when(join, detail_list("left_keys")).alias("left_keys"), F.when(join, detail_list("right_keys")).alias("right_keys"), F.when(join | loop, detail("join_condition")).alias("join_condition"),
    )
    metrics = F.transform(F.coalesce("accumulator_totals", F.array().cast(dag.schema["accumulator_totals"].dataType)), lambda m: F.struct(m["metric_name"].alias("name"), m["readable_str"].alias("value")))
    node = F.struct("node_id", "node_type", "node_name", "child_nodes", F.col("node_duration_minutes").alias("duration_minutes"), metrics.alias("metrics"), F.when(has & (join | loop | (F.col("node_type") == "Scan")), facts).alias("details"))
    query = [*shared_keys(dag), "query_function", F.col("query_start_timestamp").alias("start"), F.col("query_end_timestamp").alias("end"), F.col("query_duration_seconds").alias("duration_seconds")]
    return dag.groupBy(*query).agg(F.array_sort(F.collect_list(node), lambda a, b: (a["node_id"] - b["node_id"]).cast("int")).alias("nodes")).orderBy(*shared_keys(dag))


def summary(dag: DataFrame, combined: DataFrame, log_name: str) -> dict[str, Any]:
    """The summary of one log as a dictionary. Its size follows the plans, not the data; it is brought to the driver."""
    queries = [json.loads(r[0]) for r in plan_summary(dag).drop("log_name").select(F.to_json(F.struct("*"))).collect()]
    return {"log_name": log_name, "queries": queries, "totals": totals(combined).first().asDict()}
