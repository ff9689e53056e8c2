"""Plan metrics of a Spark Connect client, in the form of the node relation.

A client sees no event log, only the metrics that come with each answer: nodes with their parent, name and values.
They are few; as soon as they are rows, everything is DataFrame functions, so the detectors work on them too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import readable as R
from . import schemas as S

# First words of node names, as a vectorised engine and as Spark print them, and our node types.
NODE_TYPES = {
    "PhotonScan": "Scan",
    "PhotonGroupingAgg": "HashAggregate",
    "PhotonAgg": "HashAggregate",
    "PhotonSort": "Sort",
    "PhotonShuffleExchangeSink": "Exchange",
    "PhotonShuffleExchangeSource": "Exchange",
    "PhotonBroadcastHashJoin": "BroadcastHashJoin",
    "PhotonSortMergeJoin": "SortMergeJoin",
    "PhotonBroadcastNestedLoopJoin": "BroadcastNestedLoopJoin",
    "PhotonProject": "Project",
    "PhotonFilter": "Filter",
    "PhotonBroadcastExchange": "BroadcastExchange",
    "PhotonUnion": "Union",
    "PhotonExpand": "Expand",
    "PhotonTopK": "TakeOrderedAndProject",
    "PhotonWindow": "Window",
    "PhotonShuffleMapStage": "Exchange",
    "PhotonResultStage": "ResultQueryStage",
    "PhotonColumnarToRow": "ColumnarToRow",
    "AdaptiveSparkPlan": "AdaptiveSparkPlan",
    "ResultQueryStage": "ResultQueryStage",
    "ShuffleQueryStage": "ShuffleQueryStage",
    "BroadcastQueryStage": "BroadcastQueryStage",
    "TableCacheQueryStage": "TableCacheQueryStage",
    "AQEShuffleRead": "AQEShuffleRead",
    "CollectLimit": "CollectLimit",
    "GlobalLimit": "GlobalLimit",
    "LocalLimit": "LocalLimit",
    "Project": "Project",
    "Filter": "Filter",
    "Sort": "Sort",
    "Exchange": "Exchange",
    "BroadcastExchange": "BroadcastExchange",
    "BroadcastHashJoin": "BroadcastHashJoin",
    "SortMergeJoin": "SortMergeJoin",
    "BroadcastNestedLoopJoin": "BroadcastNestedLoopJoin",
    "CartesianProduct": "CartesianProduct",
    "HashAggregate": "HashAggregate",
    "ObjectHashAggregate": "ObjectHashAggregate",
    "Union": "Union",
    "Coalesce": "Coalesce",
    "ReusedExchange": "ReusedExchange",
    "Scan": "Scan",
    "LocalTableScan": "LocalTableScan",
    "Range": "Range",
    "Window": "Window",
    "Expand": "Expand",
    "TakeOrderedAndProject": "TakeOrderedAndProject",
    "ColumnarToRow": "ColumnarToRow",
}
# Join types of a logical plan by their number, and as names in a physical one.
JOIN_TYPES = {1: "Inner", 2: "FullOuter", 3: "LeftOuter", 4: "RightOuter", 5: "LeftAnti", 6: "LeftSemi", 7: "Cross"}
_JOINS = ("BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin")

RAW = "query_id long, plan_id long, parent_plan_id long, name string, metrics array<struct<name: string, value: double, metric_type: string>>"
JOIN_INFO = "ord long, join_type string, left_keys array<string>, right_keys array<string>"


def raw_rows(query_id: int, answer: Iterable[Any]) -> list[tuple]:
    """Rows of RAW from one answer's plan metrics."""
    return [(query_id, n.plan_id, n.parent_plan_id, n.name, [(m.name, float(m.value), m.metric_type) for m in n.metrics]) for n in answer]


def logical_joins(relation: Any) -> list[dict]:
    """Joins of a logical plan from its root down, left before right: type, and the columns that both sides share."""
    try:
        kind = relation.WhichOneof("rel_type")
    except Exception:
        return []
    inner = getattr(relation, kind, None) if kind else None
    if inner is None:
        return []
    out = []
    if kind == "join":
        columns = list(inner.using_columns)
        out.append({"join_type": JOIN_TYPES.get(inner.join_type, ""), "left_keys": columns, "right_keys": columns})
    for name in ("input", "child", "left", "right"):
        below = getattr(inner, name, None)
        if hasattr(below, "WhichOneof"):
            out += logical_joins(below)
    return out


def joins_in_name(name: str) -> dict:
    """Keys and type from a name like "BroadcastHashJoin [a#1], [b#2], Inner, BuildRight"."""
    groups = [[re.sub(r"#\w+", "", k).strip() for k in g.split(",") if k.strip()] for g in re.findall(r"\[([^\]]*)\]", name)]
    words = [t.strip() for t in re.sub(r"\[[^\]]*\]", "", name).split(",")]
    kind = next((w for w in words if w in JOIN_TYPES.values()), None)
    return ({"left_keys": groups[0], "right_keys": groups[1]} if len(groups) > 1 else {}) | ({"join_type": kind} if kind else {})


def node_type(name) -> Any:
    """A column with the node type of a name; null where its first word isn't known."""
    table = F.create_map(*(F.lit(x) for pair in NODE_TYPES.items() for x in pair))
    return F.try_element_at(table, F.split(name, " ")[0])


def require_known(raw: DataFrame) -> None:
    """Raises ValueError with the names of nodes that no type is known for."""
    unknown = sorted(r[0] for r in raw.where(node_type(F.col("name")).isNull()).select("name").distinct().limit(50).collect())
    if unknown:
        raise ValueError(f"Unmapped node names: {', '.join(unknown)}")


def dag(raw: DataFrame, log_name: str, joins: DataFrame | None = None) -> DataFrame:
    """The node relation of raw plan metrics. Joins of the logical plan, JOIN_INFO in their order, give the keys of a
    query's join nodes in order of id; where they run out, the nodes' names do."""
    joins = raw.sparkSession.createDataFrame([], JOIN_INFO) if joins is None else joins
    kind = node_type(F.col("name"))
    rows = raw.withColumn("node_type", kind).where("node_type is not null")
    children = raw.where("parent_plan_id <> plan_id").groupBy("query_id", F.col("parent_plan_id").alias("plan_id")).agg(F.array_join(F.sort_array(F.collect_list("plan_id"), asc=False).cast("array<string>"), ", ").alias("child_nodes"))
    time = F.get(F.filter("metrics", lambda m: (m["name"] == "cumulTime") & (m["metric_type"] == "nsTiming")), F.lit(0))["value"]
    roots = raw.where("parent_plan_id = plan_id").groupBy("query_id").agg(F.min_by("name", "plan_id").alias("query_header"), F.min_by(R.exact_round(time / 1e9, 2), "plan_id").alias("query_duration_seconds"))

    def metric(m):
        value = F.when(m["metric_type"] == "nsTiming", m["value"] / 1e6).otherwise(m["value"])
        own = F.when(m["metric_type"] == "nsTiming", "timing").otherwise(m["metric_type"])
        made = R.readable_metric(value, own)
        none = F.lit(None).cast("bigint")
        return F.struct(none.alias("stage_id"), none.alias("task_id"), none.alias("accumulator_id"), m["name"].alias("metric_name"), own.alias("metric_type"), value.alias("value"), R.unit_of(own).alias("unit"), R.exact_round(made["readable_value"], 1).alias("readable_value"), made["readable_unit"].alias("readable_unit"), made["readable_str"].alias("readable_str"))

    out = rows.join(children, ["query_id", "plan_id"], "left").join(roots, "query_id", "left")
    is_join = F.col("node_type").isin(*_JOINS)
    ord_ = F.sum(is_join.cast("long")).over(Window.partitionBy("query_id").orderBy("plan_id")) - 1
    out = out.withColumn("ord", F.when(is_join, ord_)).join(joins, "ord", "left")
    keys = F.regexp_extract_all("name", F.lit(r"\[([^\]]*)\]"), 1)
    clean = lambda k: F.when(F.size(keys) > 1, F.transform(F.split(F.get(keys, F.lit(k)), ","), lambda c: F.trim(F.regexp_replace(c, r"#\w+", ""))))
    said = F.nullif(F.regexp_extract("name", rf"\b({'|'.join(JOIN_TYPES.values())})\b(?!Join)", 1), F.lit(""))
    scanned = F.when((F.col("node_type") == "Scan") & (F.size(F.split("name", " ")) > 2), F.array(F.split(F.split("name", " ")[2], r"\[")[0]))
    detail = F.struct(
        F.col("name").alias("raw_name"), F.when(is_join, F.coalesce("join_type", said)).alias("join_type"), F.when(is_join, F.coalesce("left_keys", clean(0))).alias("left_keys"), F.when(is_join, F.coalesce("right_keys", clean(1))).alias("right_keys"),
        F.when(scanned.isNotNull(), F.struct(scanned.alias("location"))).alias("location"),
    )
    none = lambda t: F.lit(None).cast(t)
    made = {
        "log_name": F.lit(log_name), "query_start_timestamp": none("string"), "query_end_timestamp": none("string"), "whole_stage_codegen_id": none("bigint"), "node_id": F.col("plan_id"),
        "details": F.to_json(F.struct(detail.alias("detail"))), "query_function": none("string"), "accumulators": F.array().cast(f"array<{S.METRIC}>"), "accumulator_totals": F.transform("metrics", metric),
        "n_accumulators": F.lit(0).cast("bigint"), "n_accumulator_totals": F.size("metrics").cast("bigint"), "node_duration_minutes": F.coalesce(time / 6e10, F.lit(0.0)), "node_id_adj": F.col("plan_id"),
        "node_name": F.concat(F.lit("["), F.col("plan_id").cast("string"), F.lit("] "), F.col("node_type")),
    }
    return out.withColumns(made).select("log_name", *S.DAG_COLUMNS)


class ConnectCapture:
    """Collects the plan metrics of a client's answers while its block runs.

    A client gives metrics to one function for each answer; it is wrapped while the block runs, and put back. Where a
    DataFrame's executionInfo is at hand, add() takes it without any wrapping.
    """

    def __init__(self, spark: SparkSession, log_name: str = "connect"):
        self.spark, self.log_name = spark, log_name
        self.answers: list[list[Any]] = []
        self.joins: list[dict] = []
        self._put_back: list[Callable[[], None]] = []

    def add(self, df: DataFrame) -> None:
        if df.executionInfo is not None:
            self.answers.append(list(df.executionInfo.metrics))

    def _wrap(self, client: Any, name: str, around: Callable) -> None:
        inner = getattr(client, name, None)
        if inner is not None:
            setattr(client, name, around(inner))
            self._put_back.append(lambda: setattr(client, name, inner))

    def __enter__(self) -> ConnectCapture:
        client = self.spark._client

        def metrics(inner: Callable) -> Callable:
            def call(proto: Any) -> Any:
                got = inner(proto)
                if got:
                    self.answers.append(list(got))
                return got

            return call

        def plans(inner: Callable) -> Callable:
            def call(plan: Any, *args: Any, **kwargs: Any) -> Any:
                if plan.HasField("root"):
                    for one in logical_joins(plan.root):
                        if one not in self.joins:
                            self.joins.append(one)
                return inner(plan, *args, **kwargs)

            return call

        self._wrap(client, "_build_metrics", metrics)
        self._wrap(client, "to_table", plans)
        return self

    def __exit__(self, *_: Any) -> None:
        while self._put_back:
            self._put_back.pop()()

    def dag(self, spark: SparkSession | None = None) -> DataFrame:
        """The node relation of what was collected."""
        spark = spark or self.spark
        raw = spark.createDataFrame([r for i, a in enumerate(self.answers) for r in raw_rows(i, a)], RAW)
        require_known(raw)
        joins = spark.createDataFrame([(i, j["join_type"], j["left_keys"], j["right_keys"]) for i, j in enumerate(self.joins)], JOIN_INFO)
        return dag(raw, self.log_name, joins)
