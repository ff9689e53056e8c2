"""A log in, its two relations out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .operators import telemetry
from .plans.parser import plan_nodes
from .sources import eventlog, sinks, storage


@dataclass
class Relations:
    """dag: a row a query and operator; combined: a row a query, task and job. nodes are the plans behind dag."""

    dag: DataFrame
    combined: DataFrame
    nodes: DataFrame
    name: str = ""


def relations(spark: SparkSession, path: str | list[str], strict: bool = False, fallback: bool = False, out_name: str | None = None) -> Relations:
    """The relations of the logs at a path. Plans are parsed once and kept, as they are few and asked often."""
    events = eventlog.read(spark, path, strict, fallback)
    nodes = plan_nodes(events.plans, strict).persist()
    if nodes.isEmpty():
        raise ValueError("No queries found in log file")
    dag = telemetry.dag(nodes, events.queries, events.tasks, events.driver_updates)
    ran = telemetry.stage_nodes(nodes, events.queries, events.tasks, events.driver_updates)
    name = sinks.parsed_name(nodes, out_name, datetime.now().strftime("%Y-%m-%dT%H-%M-%S"))
    return Relations(dag, telemetry.combined(events.tasks, events.stages, events.jobs, ran, name), nodes, name)


def get(spark: SparkSession, log_dir: str, log_file: str | None = None, out_dir: str | None = None, out_name: str | None = None, out_format: str | None = "csv", strict: bool = False) -> Relations:
    """Relations of a folder's log, its last by name unless one is named; written to out_dir where there is one."""
    path = storage.join_path(log_dir, log_file) if log_file else eventlog.latest(spark, log_dir)
    out = relations(spark, path, strict, out_name=out_name)
    if out_dir is not None and out_format is not None:
        sinks.write_relations(out.dag, out.combined, out_dir, out.name, out_format)
    return out
