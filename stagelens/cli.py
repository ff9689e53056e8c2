"""python -m stagelens: get, analyze, history, check-alerts, viz."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import __version__, api, render
from .operators import alerts, detect, history
from .sources import sinks, storage


#: Findings that a report lists at most; the feed itself has all.
MOST_ISSUES = 200


def _spark() -> SparkSession:
    return SparkSession.builder.appName("stagelens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _get(a: argparse.Namespace) -> int:
    out = api.get(_spark(), a.log_dir, a.log_file, a.out_dir, a.out_name, a.out_format, a.strict)
    print(out.name)
    return 0


def _as_text(summary: dict) -> str:
    lines = [f"Log: {summary['log_name']}", ""]
    for q in summary["queries"]:
        lines.append(f"Query {q['query_id']} ({q.get('query_function')}): {q.get('duration_seconds')} s")
        lines += [f"  {n['node_name']}  {n['duration_minutes']:.2f} min" for n in q["nodes"]]
    lines += ["", "Totals", *(f"  {k}: {v}" for k, v in summary["totals"].items())]
    return "\n".join([*lines, "", "Issues", *(f"  {i['severity']}: {i['category']}: {i['message']}" for i in summary["issues"] or [])])


def _issues(out: api.Relations) -> list[dict]:
    return [r.asDict() for r in detect.issues(out.dag, out.combined).limit(MOST_ISSUES).collect()]


def _analyze(a: argparse.Namespace) -> int:
    out = api.get(_spark(), a.log_dir, a.log_file)
    summary = detect.summary(out.dag, out.combined, out.name)
    summary["issues"] = _issues(out)
    text = json.dumps(summary, indent=2, default=str) if a.format == "json" else _as_text(summary)
    storage.write_text(a.out_file, text) if a.out_file else print(text)
    return 0


def _history(a: argparse.Namespace) -> int:
    rows = history.read(_spark(), a.history_path, a.log_name, a.last_n).collect()
    if a.format == "json":
        print(json.dumps([r.asDict() for r in rows], indent=2, default=str))
    else:
        for r in rows:
            print(f"{r['run_at']}  {r['log_name']}  {r['duration_s']:.1f} s  {r['n_tasks']} tasks  {r['spill_bytes']} B spilled")
    return 0


def _check_alerts(a: argparse.Namespace) -> int:
    spark = _spark()
    runs = history.read(spark, a.history_path, a.log_name)
    newest = history.last_runs(runs, 1).persist()
    if newest.isEmpty():
        print("No history", file=sys.stderr)
        return 1
    for one in alerts.check_rules(newest, runs, alerts.load_rules(a.config), a.alert_output):
        print(f"{one['severity']}: {one['name']}: {one['metric']} is {one['current']}, baseline {one['baseline']}")
    return 0


def _viz(a: argparse.Namespace) -> int:
    out = api.get(_spark(), a.log_dir, a.log_file)
    page = render.plot_dag(out.dag, a.query_id, a.metric, a.dark, _issues(out))
    storage.write_text(a.out_file, page)
    print(a.out_file)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stagelens")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        own = sub.add_parser(name)
        own.set_defaults(run=run)
        for flag, options in arguments:
            own.add_argument(flag, **options)

    log = (("log_dir", {}), ("--log-file", {}))
    command("get", _get, *log, ("--out-dir", {}), ("--out-name", {}), ("--out-format", {"default": "csv", "choices": sinks.FORMATS}), ("--strict", {"action": "store_true"}))
    command("analyze", _analyze, *log, ("--out-file", {}), ("--format", {"default": "json", "choices": ("json", "text")}))
    command("history", _history, ("history_path", {}), ("--log-name", {}), ("--last-n", {"type": int}), ("--format", {"default": "table", "choices": ("table", "json")}))
    command("check-alerts", _check_alerts, ("history_path", {}), ("config", {}), ("--log-name", {}), ("--alert-output", {}))
    command("viz", _viz, *log, ("--query-id", {"type": int}), ("--metric", {"default": "node_duration_minutes"}), ("--dark", {"action": "store_true"}), ("--out-file", {"default": "plan.html"}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)
