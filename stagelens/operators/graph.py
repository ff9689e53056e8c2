"""Questions about plan graphs: what can be reached, and edges without the nodes that only pass rows on.

A plan is small, and there are many: each is walked in memory where its rows are, and plans are dealt over tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Operators that read from outside, and those that a diagram leaves out.
SOURCES = ("Scan", "BatchScan", "LocalTableScan")
HIDDEN = ("BroadcastQueryStage", "ShuffleQueryStage", "ReusedExchange", "TableCacheQueryStage", "InMemoryRelation")


def shared_keys(df: DataFrame) -> list[str]:
    """What a plan is known by: the query, and the log where there are many."""
    return [c for c in ("log_name", "query_id") if c in df.columns]


def reach(starts: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(start columns..., node_id): every node reached from starts (query_id, others..., node_id), starts included.

    edges: query_id, parent_id, child_id, and log_name in both where there are many logs. Walks stop at nodes of stop
    (query_id, node_id). A plan is walked whole where its rows are, to any depth and with no node visited twice from
    a start, so a cycle ends too; a task holds one plan, which a driver held before. Starts that repeat count once.
    """
    plan = shared_keys(edges)
    out = edges.select(*plan, "parent_id", "child_id")
    if stop is not None:  # an edge out of a stop isn't walked
        out = out.join(stop.select(*plan, F.col("node_id").alias("parent_id")), [*plan, "parent_id"], "left_anti")
    # Names of their own, as starts often come from the same edges.
    out = out.select(*(F.col(c).alias(f"__{c}") for c in plan), F.col("parent_id").alias("__parent"), F.col("child_id").alias("__child"))
    schema = StructType([*(starts.schema[c] for c in starts.columns if c != "node_id"), StructField("node_id", LongType())])

    def walk(some: pa.Table, edges: pa.Table) -> pa.Table:
        below: dict[int, list[int]] = {}
        for parent, child in zip(edges["__parent"].to_pylist(), edges["__child"].to_pylist(), strict=True):
            below.setdefault(parent, []).append(child)
        done, at, found = set(), [], []
        for i, row in enumerate(some.to_pylist()):
            key = tuple(row.values())
            if key in done:
                continue
            done.add(key)
            seen, todo = {row["node_id"]}, [row["node_id"]]
            while todo:
                for child in below.get(todo.pop(), ()):
                    if child not in seen:
                        seen.add(child)
                        todo.append(child)
            at += [i] * len(seen)
            found += seen
        taken = some.drop_columns("node_id").take(pa.array(at, pa.int64()))
        return taken.append_column("node_id", pa.array(found, pa.int64()))

    return starts.groupBy(*plan).cogroup(out.groupBy(*(f"__{c}" for c in plan))).applyInArrow(walk, schema)


def contract(nodes: DataFrame, edges: DataFrame, hidden: tuple[str, ...] = HIDDEN) -> DataFrame:
    """(query_id, parent_id, child_id): edges between nodes that are shown, past the hidden ones between them.

    nodes: query_id, node_id, node_type; a hidden node's children stand in for it.
    """
    plan = shared_keys(edges)
    is_hidden = F.coalesce(F.col("node_type").isin(*hidden), F.lit(False))
    gone, shown = nodes.where(is_hidden).select(*plan, "node_id"), nodes.where(~is_hidden).select(*plan, "node_id")
    as_parent = lambda d: d.withColumnRenamed("node_id", "parent_id")
    first = edges.join(as_parent(shown), [*plan, "parent_id"], "left_semi").select(*plan, "parent_id", F.col("child_id").alias("node_id"))
    through = edges.join(as_parent(gone), [*plan, "parent_id"], "left_semi")
    ends = reach(first, through).join(shown, [*plan, "node_id"], "left_semi")
    return ends.select(*plan, "parent_id", F.col("node_id").alias("child_id")).distinct()
