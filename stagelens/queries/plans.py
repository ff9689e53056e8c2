"""The plan parser over plan texts of our own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detail
from ..plans import parser
from ..plans.details import READERS
from .registry import query

JOIN_PLAN = """== Physical Plan ==
AdaptiveSparkPlan (14)
+- == Final Plan ==
   ResultQueryStage (13), Statistics(sizeInBytes=8.0 EiB)
   +- * SortMergeJoin Inner (12)
      :- * Sort (5)
      :  +- AQEShuffleRead (4)
      :     +- ShuffleQueryStage (3), Statistics(sizeInBytes=1.0 KiB, rowCount=10)
      :        +- Exchange (2)
      :           +- Scan parquet  (1)
      +- * Sort (11)
         +- ShuffleQueryStage (10), Statistics(sizeInBytes=1.0 KiB, rowCount=10)
            +- Exchange (9)
               +- * Project (8)
                  +- * Range (7)
+- == Initial Plan ==
   SortMergeJoin Inner (22)
   :- Sort (21)
   +- Sort (20)


(1) Scan parquet 
Output [2]: [a#1L, b#2]
Batched: true
Location: InMemoryFileIndex [file:/data/t]
PushedFilters: [IsNotNull(a), In(b, [x,y])]
ReadSchema: struct<a:bigint,b:string>

(2) Exchange
Input [2]: [a#1L, b#2]
Arguments: hashpartitioning(a#1L, 200), ENSURE_REQUIREMENTS, [plan_id=11]

(3) ShuffleQueryStage
Output [2]: [a#1L, b#2]
Arguments: 0

(4) AQEShuffleRead
Input [2]: [a#1L, b#2]
Arguments: coalesced and skewed

(5) Sort [codegen id : 3]
Input [2]: [a#1L, b#2]
Arguments: [a#1L ASC NULLS FIRST], false, 0

(7) Range [codegen id : 1]
Output [1]: [id#3L]
Arguments: Range (0, 10, step=1, splits=Some(2))

(8) Project [codegen id : 1]
Output [2]: [id#3L, concat(cast(id#3L as string), x) AS c#4]
Input [1]: [id#3L]

(9) Exchange
Input [2]: [id#3L, c#4]
Arguments: rangepartitioning(id#3L ASC NULLS FIRST, 8), REPARTITION_BY_COL, [plan_id=12]

(10) ShuffleQueryStage
Output [2]: [id#3L, c#4]
Arguments: 1

(11) Sort [codegen id : 2]
Input [2]: [id#3L, c#4]
Arguments: [id#3L DESC NULLS LAST], true, 0

(12) SortMergeJoin [codegen id : 4]
Left keys [1]: [a#1L]
Right keys [1]: [id#3L]
Join type: Inner
Join condition: None

(13) ResultQueryStage
Output [4]: [a#1L, b#2, id#3L, c#4]
Arguments: 2

(14) AdaptiveSparkPlan
Output [4]: [a#1L, b#2, id#3L, c#4]
Arguments: isFinalPlan=true

"""


def _info(name: str, children: list, metrics: int = 1) -> dict:
    return {"nodeName": name, "simpleString": name, "children": children, "metrics": [{"name": "number of output rows", "accumulatorId": hash(name) % 1000, "metricType": "sum"}] * metrics}


JOIN_INFO = _info("AdaptiveSparkPlan", [_info("ResultQueryStage", [_info("WholeStageCodegen (4)", [_info("SortMergeJoin", [
    _info("InputAdapter", [_info("WholeStageCodegen (3)", [_info("Sort", [_info("InputAdapter", [_info("AQEShuffleRead", [_info("ShuffleQueryStage", [_info("Exchange", [_info("Scan parquet ", [])])])])])])])]),
    _info("InputAdapter", [_info("WholeStageCodegen (2)", [_info("Sort", [_info("InputAdapter", [_info("ShuffleQueryStage", [_info("Exchange", [_info("WholeStageCodegen (1)", [_info("Project", [_info("Range", [])])])])])])])])]),
])])], 0)], 0)


def _plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("own", 1, JOIN_PLAN, json.dumps(JOIN_INFO), True)], "log_name string, query_id long, plan string, info string, is_final boolean")


@query("""SELECT CAST(1 AS BIGINT) AS query_id, * FROM (VALUES
  (13, 'ResultQueryStage', '12', NULL, NULL), (12, 'SortMergeJoin', '5,11', 4, 1), (5, 'Sort', '4', 3, 1), (4, 'AQEShuffleRead', '3', NULL, 1), (3, 'ShuffleQueryStage', '2', NULL, 1), (2, 'Exchange', '1', NULL, 1), (1, 'Scan', '', NULL, 1),
  (11, 'Sort', '10', 2, 1), (10, 'ShuffleQueryStage', '9', NULL, 1), (9, 'Exchange', '8', NULL, 1), (8, 'Project', '7', 1, 1), (7, 'Range', '', 1, 1),
  (100001, 'WholeStageCodegen', NULL, 1, 1), (100002, 'WholeStageCodegen', NULL, 2, 1), (100003, 'WholeStageCodegen', NULL, 3, 1), (100004, 'WholeStageCodegen', NULL, 4, 1)
) n(node_id, node_type, child_nodes, whole_stage_codegen_id, n_metrics)""")
def plan_nodes_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, children, code generation and metrics of a join's plan."""
    nodes = parser.plan_nodes(_plans(spark))
    return nodes.select("query_id", "node_id", "node_type", F.array_join(F.col("child_nodes").cast("array<string>"), ",").alias("child_nodes"), "whole_stage_codegen_id", F.size("accumulators").alias("n_metrics"))


@query("""SELECT * FROM (VALUES
  (1, 'output', '["a#1L","b#2"]'), (1, 'location.location', '["/data/t"]'), (1, 'pushed_filters', '["IsNotNull(a)","In(b, [x,y])"]'), (2, 'arguments.partitioning', 'hashpartitioning'), (2, 'arguments.n_partitions', '200'), (2, 'arguments.plan_identifier', '11'),
  (4, 'arguments', 'coalesced and skewed'), (5, 'arguments.global_sort', 'false'), (9, 'arguments.partitioning', 'rangepartitioning'), (9, 'arguments.n_partitions', '8'), (9, 'arguments.exchange_type', 'REPARTITION_BY_COL'), (11, 'arguments.global_sort', 'true'),
  (12, 'join_type', 'Inner'), (12, 'left_keys', '["a#1L"]'), (12, 'right_keys', '["id#3L"]')) d(node_id, field, value)""")
def plan_details_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the operators' details, as the detail accessor reads them."""
    asked = {1: ("output", "location.location", "pushed_filters"), 2: ("arguments.partitioning", "arguments.n_partitions", "arguments.plan_identifier"), 4: ("arguments",), 5: ("arguments.global_sort",),
             9: ("arguments.partitioning", "arguments.n_partitions", "arguments.exchange_type"), 11: ("arguments.global_sort",), 12: ("join_type", "left_keys", "right_keys")}
    nodes = parser.plan_nodes(_plans(spark)).where("details is not null")
    out = None
    for node, fields in asked.items():
        for field in fields:
            one = nodes.where(F.col("node_id") == node).select("node_id", F.lit(field).alias("field"), detail(field).alias("value"))
            out = one if out is None else out.unionByName(one)
    return out


@query()
def node_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each operator that is told apart, and the fields that its details give."""
    from ..plans.tree import NODE_TYPES

    rows = [(t, ",".join(READERS.get(t, {})) or None) for t in NODE_TYPES]
    return spark.createDataFrame(rows, "node_type string, fields string")
