"""Final plans to rows: one for each operator, with children, code generation, metrics and details."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .details import blocks, codegen_ids, detail
from .tree import PlanNode, parse_tree, tree_lines

#: Pseudo nodes of code generation have this and their id as node id.
CODEGEN_BASE = 100_000

NODE_SCHEMA = (
    "log_name string, query_id long, node_id long, node_type string, child_nodes array<long>, whole_stage_codegen_id long, "
    "accumulators array<struct<metric_name: string, accumulator_id: long, metric_type: string>>, node_string string, details string, is_final boolean"
)
_METRIC = pa.struct([("metric_name", pa.string()), ("accumulator_id", pa.int64()), ("metric_type", pa.string())])
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(_METRIC), pa.string(), pa.string(), pa.bool_()]


def _name(info: dict) -> str:
    return info["nodeName"].removeprefix("Execute ").split(" ")[0].split("(")[0]


def _matches(info: dict, node: PlanNode) -> bool:
    name = _name(info)
    return node.node_type == "Unknown" or name in node.node_type or node.label.removeprefix("Execute ").startswith(name)


def _below(info: dict, codegen: dict[int, dict]) -> list[dict]:
    """Children past the wrappers that a tree doesn't print; wrappers of generated code are noted."""
    out = []
    for child in info.get("children") or []:
        name = child["nodeName"]
        if name.startswith("WholeStageCodegen"):
            codegen[int(name.split("(")[-1].split(")")[0])] = child
            out += _below(child, codegen)
        elif name.startswith("InputAdapter"):
            out += _below(child, codegen)
        else:
            out.append(child)
    return out


def align(info: dict, nodes: dict[int, PlanNode]) -> tuple[dict[int, dict], dict[int, dict]]:
    """The metrics' tree laid on the plan's: infos by node id, and wrappers of generated code by their id.

    Both are walked together from their roots. Children are matched in order by name; an operator that only one of
    the trees has (a cached relation, a stage that is reused) is passed over with what is below it.
    """
    below = {c for n in nodes.values() for c in n.children}
    root = next(i for i in nodes if i not in below)
    found: dict[int, dict] = {}
    codegen: dict[int, dict] = {}

    def lay(infos: list[dict], ids: list[int]) -> None:
        at = 0
        for one in infos:
            hit = next((k for k in range(at, len(ids)) if _matches(one, nodes[ids[k]])), None)
            if hit is None:
                continue
            at = hit + 1
            node = nodes[ids[hit]]
            found[node.node_id] = one
            if not node.node_type.startswith("Reused"):
                lay(_below(one, codegen), node.children)

    tops = [info] if _matches(info, nodes[root]) and _name(info) != "AdaptiveSparkPlan" else _below(info, codegen)
    lay(tops, [root])
    return found, codegen


def _metrics(info: dict | None, most: int | None = None) -> list[dict] | None:
    rows = [{"metric_name": m["name"], "accumulator_id": m["accumulatorId"], "metric_type": m["metricType"]} for m in (info or {}).get("metrics") or []]
    return rows[:most] or None


def parse_plan(plan: str, info: dict, strict: bool = False) -> list[dict]:
    """Rows for the operators of one plan and for its stretches of generated code. A reused exchange or subquery is
    also a child of what it reuses."""
    nodes = parse_tree(tree_lines(plan), strict)
    found = blocks(plan)
    infos, codegen = align(info, nodes)
    generated = codegen_ids(found)
    children = {i: list(n.children) for i, n in nodes.items()}
    rows = {}
    for i, node in nodes.items():
        text = detail(node.node_type, found[i], strict) if i in found else None
        reused = (text or {}).get("reuses_node_id")
        if reused in children:
            children[reused].append(i)
        rows[i] = {
            "node_id": i, "node_type": node.node_type, "child_nodes": children[i], "whole_stage_codegen_id": generated.get(i), "accumulators": _metrics(infos.get(i)),
            "node_string": (infos.get(i) or {}).get("simpleString"), "details": json.dumps({"node_id": i, "node_type": node.node_type, "detail": text}),
        }
    for k, wrapper in codegen.items():
        i = CODEGEN_BASE + k
        rows[i] = {"node_id": i, "node_type": "WholeStageCodegen", "child_nodes": None, "whole_stage_codegen_id": k, "accumulators": _metrics(wrapper, 1), "node_string": wrapper.get("simpleString"), "details": None}
    return list(rows.values())


def plan_nodes(plans: DataFrame, strict: bool = False) -> DataFrame:
    """NODE_SCHEMA's rows from plans (log_name, query_id, plan, info, is_final), one row a query. The trees are small
    and few; each is parsed where its row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ("log_name", "query_id", "node_id", "node_type", "child_nodes", "whole_stage_codegen_id", "accumulators", "node_string", "details", "is_final")]
        for batch in batches:
            for row in batch.to_pylist():
                rows = [{"log_name": row["log_name"], "query_id": row["query_id"], "is_final": row["is_final"], **n} for n in parse_plan(row["plan"], json.loads(row["info"]), strict)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, _TYPES, strict=True)], names=names)

    return plans.select("log_name", "query_id", "plan", "info", F.col("is_final").alias("is_final")).mapInArrow(run, NODE_SCHEMA)


def edges(nodes: DataFrame) -> DataFrame:
    """(log_name, query_id, parent_id, child_ord, child_id) of the nodes' child lists."""
    return nodes.select("log_name", "query_id", F.col("node_id").alias("parent_id"), F.posexplode("child_nodes").alias("child_ord", "child_id"))
