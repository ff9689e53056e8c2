"""Capture of what a block of code runs: its event log, read when the block ends."""

from __future__ import annotations

import functools
import inspect
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

from . import api, render
from .operators import alerts, detect, history
from .session import event_log_conf
from .sources import storage

ACTIONS = ("get", "analyze", "viz")


class Capture:
    """What a capture found once its block has ended: relations, and by action the summary or the diagram."""

    def __init__(self, spark: SparkSession, action: str):
        if action not in ACTIONS:
            raise ValueError(f"Unknown action: {action}")
        self.spark, self.action = spark, action
        self.relations: api.Relations | None = None
        self.summary: dict | None = None
        self.html: str | None = None
        self.alerts: list[dict] = []


def _logging_session(spark: SparkSession | None, folder: str) -> tuple[SparkSession, bool]:
    """The session if it logs to plain files already, else one with the same settings that does: an application's
    log can't be begun later, so the old session ends and DataFrames of it with it."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        conf = dict(spark.sparkContext.getConf().getAll())
        if conf.get("spark.eventLog.enabled") == "true":
            return spark, False
        keep = {k: v for k, v in conf.items() if not k.startswith(("spark.app.id", "spark.app.startTime", "spark.driver.port", "spark.executor.id", "spark.eventLog"))}
        spark.stop()
    else:
        keep = {"spark.app.name": "stagelens"}
    return SparkSession.builder.config(map=keep | event_log_conf(folder)).getOrCreate(), True


@contextmanager
def capture_context(action: str = "get", spark: SparkSession | None = None, log_name: str | None = None, history_path: str | None = None, rules: str | list | None = None, temp_dir: str | None = None, strict: bool = False) -> Iterator[Capture]:
    """Runs a block and gives what it ran. An exception in the block leaves everything unread.

    The session that logs stays; use capture.spark in the block. With history_path the run's record is appended, and
    rules (a TOML file or a list) are checked against the records before it.
    """
    folder = temp_dir or tempfile.mkdtemp(prefix="stagelens-log-")
    storage.ensure_dir(folder)
    session, own = _logging_session(spark, folder)
    out = Capture(session, action)
    yield out
    context = session.sparkContext
    app = context.applicationId
    where = folder if own else context.getConf().get("spark.eventLog.dir").removeprefix("file://").removeprefix("file:")
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    if own:
        conf = dict(context.getConf().getAll())
        session.stop()  # the log is whole when its application has ended
        out.spark = session = SparkSession.builder.config(map={k: v for k, v in conf.items() if not k.startswith(("spark.app.id", "spark.eventLog", "spark.driver.port", "spark.app.startTime", "spark.executor.id"))}).getOrCreate()
    path = next((p for p in (f"{where}/{app}", f"{where}/{app}.inprogress", f"{where}/eventlog_v2_{app}") if storage.path_exists(p)), where)
    out.relations = api.relations(session, path, strict, out_name=log_name)
    name = log_name or app
    if action == "viz":
        out.html = render.plot_dag(out.relations.dag)
        return
    if action == "analyze":
        out.summary = detect.summary(out.relations.dag, out.relations.combined, name)
    if history_path is not None:
        record = history.run_record(out.relations.dag, out.relations.combined, name).persist()
        before = history.read(session, history_path)
        if rules:
            loaded = alerts.load_rules(rules) if isinstance(rules, str) else rules
            try:
                out.alerts = alerts.check_rules(record, before, loaded, os.path.join(os.path.dirname(history_path), "alerts.jsonl"))
            finally:
                history.append(record, history_path)
        else:
            history.append(record, history_path)


def capture(function: Callable | None = None, **options: Any) -> Callable:
    """A decorator, bare or with capture_context()'s options: the call returns (result, Capture). A parameter named
    spark gets the session unless the caller gives one."""

    def wrap(inner: Callable) -> Callable:
        takes = "spark" in inspect.signature(inner).parameters

        @functools.wraps(inner)
        def call(*args, **kwargs):
            with capture_context(**options) as out:
                if takes and "spark" not in kwargs and len(args) < len(inspect.signature(inner).parameters):
                    kwargs["spark"] = out.spark
                result = inner(*args, **kwargs)
            return result, out

        return call

    return wrap(function) if callable(function) else wrap
