"""Alert rules over run records: thresholds, and regressions against the mean of earlier runs."""

from __future__ import annotations

import json
import logging
import tomllib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import storage

log = logging.getLogger(__name__)

# Metrics of a run record that a rule may name, and kinds of rules.
METRICS = ("duration_s", "bytes_read", "bytes_written", "shuffle_bytes", "spill_bytes", "n_queries", "n_stages", "n_tasks", "n_cartesian_joins", "max_node_duration_min", "max_scan_bytes")
CONDITIONS = ("threshold", "pct_increase", "absolute_increase")


@dataclass
class AlertRule:
    """on_trigger: log, raise or file; window: earlier runs that the baseline is the mean of."""

    name: str
    log_name: str
    metric: str
    condition: str
    threshold: float
    window: int = 10
    severity: str = "warning"
    on_trigger: str = "log"

    def __post_init__(self) -> None:
        if self.condition not in CONDITIONS:
            raise ValueError(f"Unknown condition: {self.condition}")
        self.threshold = float(self.threshold)  # a rule's file may give a whole number


class AlertError(Exception):
    """Raised by a rule that says so; carries what fired."""

    def __init__(self, name: str, metric: str, current: float, baseline: float):
        super().__init__(f"Alert {name}: {metric} is {current}, baseline {baseline}")
        self.name, self.metric, self.current, self.baseline = name, metric, current, baseline


def load_rules(path: str) -> list[AlertRule]:
    """Rules of the [[alerts]] tables of a TOML file."""
    return [AlertRule(**one) for one in tomllib.loads(storage.read_text(path)).get("alerts", [])]


def rules_frame(spark: SparkSession, rules: list[AlertRule]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rules], "name string, log_name string, metric string, condition string, threshold double, window int, severity string, on_trigger string")


def fires(condition: Column, current: Column, baseline: Column, threshold: Column) -> Column:
    """Whether a rule fires; an increase over a baseline of 0 does if there is anything."""
    over_zero = F.when(baseline == 0, current > 0).otherwise((current - baseline) / baseline > threshold)
    return F.when(condition == "threshold", current > threshold).when(condition == "pct_increase", over_zero).when(condition == "absolute_increase", current - baseline > threshold).otherwise(F.lit(False))


def metric_long(records: DataFrame) -> DataFrame:
    """(run_id, run_at, log_name, metric, current): a row a run and metric."""
    return records.select("run_id", "run_at", "log_name", *(F.col(m).cast("double").alias(m) for m in METRICS)).unpivot(["run_id", "run_at", "log_name"], list(METRICS), "metric", "current")


def check(record: DataFrame, history: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that fire for the record: its value and the mean of the window's runs of the same log before it, 0 where
    there are none. Rules of other logs or of unknown metrics don't apply."""
    applied = metric_long(record).join(rules, ["log_name", "metric"])
    earlier = metric_long(history).withColumnsRenamed({"run_id": "__run", "run_at": "__at", "current": "past"})
    w = Window.partitionBy("name").orderBy(F.desc("__at"), F.desc("__run"))
    past = applied.join(earlier, ["log_name", "metric"]).where("__run <> run_id").withColumn("__n", F.row_number().over(w)).where("__n <= window")
    baseline = past.groupBy("name").agg(F.avg("past").alias("baseline"))
    out = applied.join(baseline, "name", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
    return out.where(fires(F.col("condition"), F.col("current"), F.col("baseline"), F.col("threshold"))).select("name", "log_name", "metric", "condition", "threshold", "current", "baseline", "severity", "on_trigger", "run_id")


def baselines(runs: DataFrame, metric: str, window: int = 10, order: str = "run_at") -> DataFrame:
    """Each run with the mean of the metric over the window's runs of its log before it; 0 for the first."""
    w = Window.partitionBy("log_name").orderBy(order).rowsBetween(-window, -1)
    return runs.withColumn("baseline", F.coalesce(F.avg(metric).over(w), F.lit(0.0)))


def dispatch(fired: list[dict], path: str | None = None) -> None:
    """Acts on fired rules in order: a log line, a line of JSON in a file, or an AlertError that ends it. A rule that
    writes to a file where there is no path is an error in the log, and the others go on."""
    for one in fired:
        if one["on_trigger"] == "raise":
            raise AlertError(one["name"], one["metric"], one["current"], one["baseline"])
        if one["on_trigger"] == "file":
            if path is None:
                log.error("Alert %s writes to a file, but there is no path", one["name"])
                continue
            storage.append_text(path, json.dumps(one, default=str) + "\n")
        else:
            log.log(logging.ERROR if one["severity"] == "critical" else logging.WARNING, "Alert %s: %s is %s, baseline %s", one["name"], one["metric"], one["current"], one["baseline"])


def check_rules(record: DataFrame, history: DataFrame, rules: list[AlertRule], path: str | None = None) -> list[dict]:
    """check() and dispatch(); returns the rules that fired, in the rules' order."""
    if not rules:
        return []
    order = {r.name: i for i, r in enumerate(rules)}
    fired = sorted((r.asDict() for r in check(record, history, rules_frame(record.sparkSession, rules)).collect()), key=lambda r: order[r["name"]])
    dispatch(fired, path)
    return fired
