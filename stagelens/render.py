"""One query's plan as a page of HTML that needs nothing else: boxes by depth, edges, colours by a metric."""

from __future__ import annotations

import html
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators.detect import edges
from .operators.graph import HIDDEN, contract

_LIGHT, _DARK = ((255, 247, 236), (179, 0, 0)), ((40, 40, 46), (252, 141, 89))
WIDTH, HEIGHT, GAP = 210, 46, 28


def heat(value: Column, *keys: str) -> Column:
    """A value between the least and the largest of its keys, as 0 to 1; null and NaN count as 0, and where all are
    alike it is 0.5."""
    w = Window.partitionBy(*keys)
    value = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.5))


def node_color(value: float | None, low: float, high: float, dark: bool = False) -> str:
    """The colour of a value between low and high."""
    value = 0.0 if value is None or math.isnan(value) else value
    share = (value - low) / (high - low) if high > low else 0.5
    first, last = _DARK if dark else _LIGHT
    return "#" + "".join(f"{round(a + (b - a) * min(1, max(0, share))):02x}" for a, b in zip(first, last, strict=True))


def tooltip(node: dict) -> str:
    """A node's name, time and metrics, those of a kind together."""
    lines = [node["node_name"], f"duration: {node['node_duration_minutes']:.2f} min"]
    kind = None
    for m in node["accumulator_totals"] or []:
        if m["metric_type"] != kind:
            kind = m["metric_type"]
            lines.append(header(kind or ""))
        lines.append(f"{m['metric_name']}: {m['readable_str']}")
    return "\n".join(lines)


def header(title: str, width: int = 30, mark: str = "-") -> str:
    return f" {title} ".center(width, mark)


def _placed(ids: list[int], depth: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Row and place in it of each node: a child is below all its parents."""
    seen: dict[int, int] = {}
    out = {}
    for i in sorted(ids, reverse=True):
        out[i] = (depth[i], seen.get(depth[i], 0))
        seen[depth[i]] = seen.get(depth[i], 0) + 1
    return out


def plot_dag(dag: DataFrame, query_id: int | None = None, metric: str = "node_duration_minutes", dark: bool = False, issues: list[dict] | None = None) -> str:
    """HTML with one query's plan, the first one's unless it is named, and below it the findings that are given. One
    plan is brought to the driver."""
    if query_id is None:
        query_id = dag.agg(F.min("query_id")).first()[0]
    one = dag.where(F.col("query_id") == query_id)
    if metric != "node_duration_minutes":
        value = F.get(F.filter("accumulator_totals", lambda m: m["metric_name"] == metric), F.lit(0))["value"]
        one = one.withColumn("__value", value)
    else:
        one = one.withColumn("__value", F.col(metric))
    shown = one.where(~F.col("node_type").isin(*HIDDEN, "WholeStageCodegen"))
    nodes = {r["node_id"]: r.asDict(recursive=True) for r in shown.select("node_id", "node_name", "node_duration_minutes", "accumulator_totals", "query_header", "__value").collect()}
    links = [(r["parent_id"], r["child_id"]) for r in contract(one.where("node_type <> 'WholeStageCodegen'"), edges(one)).select("parent_id", "child_id").collect() if r["parent_id"] in nodes and r["child_id"] in nodes]
    values = [n["__value"] or 0.0 for n in nodes.values()] or [0.0]
    low, high = min(values), max(values)
    at = _placed(list(nodes), _depths(list(nodes), links))
    x = lambda i: GAP + at[i][1] * (WIDTH + GAP)
    y = lambda i: GAP + at[i][0] * (HEIGHT + GAP)
    ink, paper = ("#eee", "#1b1b1f") if dark else ("#222", "#fff")
    parts = [f'<line x1="{x(a) + WIDTH / 2}" y1="{y(a) + HEIGHT}" x2="{x(b) + WIDTH / 2}" y2="{y(b)}" stroke="{ink}" stroke-opacity="0.5"/>' for a, b in links]
    for i, n in nodes.items():
        parts.append(
            f'<g><title>{html.escape(tooltip(n))}</title><rect x="{x(i)}" y="{y(i)}" width="{WIDTH}" height="{HEIGHT}" rx="5" fill="{node_color(n["__value"], low, high, dark)}" stroke="{ink}"/>'
            f'<text x="{x(i) + WIDTH / 2}" y="{y(i) + 28}" text-anchor="middle" font-size="12" fill="{ink}">{html.escape(n["node_name"][:32])}</text></g>'
        )
    wide, tall = max((x(i) for i in nodes), default=0) + WIDTH + GAP, max((y(i) for i in nodes), default=0) + HEIGHT + GAP
    title = html.escape(next((n["query_header"] for n in nodes.values() if n["query_header"]), None) or f"Query {query_id}")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body style="background:{paper};color:{ink};font-family:sans-serif"><h3>{title}</h3><svg width="{wide}" height="{tall}">{"".join(parts)}</svg>{issues_panel(issues) if issues is not None else ""}</body></html>'


def issues_panel(issues: list[dict]) -> str:
    """Findings as a list, marked by their severity."""
    mark = {"critical": "#c0392b", "warning": "#d68910"}
    rows = "".join(f'<li style="border-left:4px solid {mark.get(i["severity"], "#888")};padding-left:8px;margin:4px 0"><b>{html.escape(i["category"])}</b> {html.escape(i["message"])}</li>' for i in issues)
    return f'<h3>Issues ({len(issues)})</h3><ul style="list-style:none;padding:0">{rows}</ul>' if issues else "<h3>No issues</h3>"


def _depths(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    """The longest way from a root to each node."""
    depth = dict.fromkeys(ids, 0)
    for _ in ids:
        moved = False
        for a, b in links:
            if depth[b] <= depth[a] < len(ids):
                depth[b], moved = depth[a] + 1, True
        if not moved:
            break
    return depth
