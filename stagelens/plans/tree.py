"""Spark's plan tree in ASCII art, as nodes with their children."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

log = logging.getLogger(__name__)

# Names of physical operators that are told apart. Spark prints some without the class's Exec.
NODE_TYPES = """
Sort WriteFiles Exchange Project BroadcastHashJoin ColumnarToRow Scan InsertIntoHadoopFsRelationCommand
AQEShuffleRead ShuffleQueryStage HashAggregate BroadcastQueryStage BroadcastExchange Filter GlobalLimit LocalLimit
TakeOrderedAndProject Union LocalTableScan Coalesce Window WindowGroupLimit SortMergeJoin TableCacheQueryStage
InMemoryTableScan InMemoryRelation WholeStageCodegen BroadcastNestedLoopJoin ReusedExchange Generate AdaptiveSparkPlan
ObjectHashAggregate SortAggregate Expand ArrowEvalPython BatchEvalPython MapInPandas MapInArrow PythonMapInArrow
FlatMapGroupsInPandas FlatMapCoGroupsInPandas BatchScan WriteToDataSourceV2 AppendData OverwriteByExpression
OverwritePartitionsDynamic SubqueryExec ReusedSubqueryExec SubqueryBroadcast RepartitionByExpression Sample Range
CartesianProduct ArrowEvalPythonUDTF BatchEvalPythonUDTF FlatMapGroupsInArrow FlatMapCoGroupsInArrow
TransformWithStateExec TransformWithStateInPandas TransformWithStateInPySpark SubqueryAdaptiveBroadcast
ResultQueryStage CollectLimit Unknown
""".split()
UNKNOWN = "Unknown"
_KNOWN = frozenset(NODE_TYPES)
_PRINTED = {"Subquery": "SubqueryExec", "ReusedSubquery": "ReusedSubqueryExec", "TransformWithState": "TransformWithStateExec"}

_LINE = re.compile(r"^(?P<art>(?:[ :]  )*(?:[+:]- )?)(?P<label>.*?)\s*\((?P<id>\d+)\)(?:, Statistics\(.*)?\s*$")
_SECTION = re.compile(r"^(?P<art>(?:[ :]  )*[+:]- )== (?P<name>Final|Current|Initial) Plan ==\s*$")


@dataclass
class PlanNode:
    node_id: int
    node_type: str
    label: str
    children: list[int] = field(default_factory=list)


def type_of(label: str, strict: bool = False) -> str:
    """The operator that a line of a tree names: "* Execute Foo bar" is Foo."""
    words = label.removeprefix("* ").removeprefix("Execute ").split()
    name = re.match(r"\w*", words[0])[0] if words else ""
    name = _PRINTED.get(name, name)
    if name in _KNOWN:
        return name
    if strict:
        raise ValueError(f"Unknown node type: {name}")
    log.warning("Unknown node type: %s", name)
    return UNKNOWN


def tree_lines(plan: str) -> list[str]:
    """Lines of the plan's tree: from its heading to the first blank line."""
    lines = plan.split("\n")
    begin = next((i + 1 for i, x in enumerate(lines) if x.strip() == "== Physical Plan =="), 0)
    while begin < len(lines) and not lines[begin].strip():
        begin += 1
    end = next((i for i in range(begin, len(lines)) if not lines[i].strip()), len(lines))
    return lines[begin:end]


def parse_tree(lines: list[str], strict: bool = False) -> dict[int, PlanNode]:
    """Nodes by id, in the order of their lines, with their children in order.

    Of an adaptive plan the final (or current) section counts, wherever it is nested; what stands under "Initial
    Plan" is passed over. The outermost AdaptiveSparkPlan is no node where it has such sections. There must be one
    root.
    """
    nodes: dict[int, PlanNode] = {}
    open_: list[tuple[int, int]] = []  # columns and ids from the root down to the last line
    skip: int | None = None  # lines right of this column are an initial plan
    drop: int | None = None
    for line in lines:
        if m := _SECTION.match(line):
            at = len(m["art"]) - 3
            if skip is not None and at > skip:
                continue
            skip = at if m["name"] == "Initial" else None
            if at == 0 and len(open_) == 1 and nodes[open_[0][1]].node_type == "AdaptiveSparkPlan":
                drop = open_[0][1]
            continue
        m = _LINE.match(line)
        if not m:
            continue
        at = len(m["art"])
        if skip is not None:
            if at > skip:
                continue
            skip = None
        node = PlanNode(int(m["id"]), type_of(m["label"], strict), m["label"].removeprefix("* ").strip())
        while open_ and open_[-1][0] >= at:
            open_.pop()
        if open_:
            nodes[open_[-1][1]].children.append(node.node_id)
        nodes[node.node_id] = node
        open_.append((at, node.node_id))
    if drop is not None:
        del nodes[drop]
    below = {c for n in nodes.values() for c in n.children}
    roots = [i for i in nodes if i not in below]
    if len(roots) != 1:
        raise ValueError(f"A plan has one root; this has {len(roots)}: {roots}")
    return nodes
