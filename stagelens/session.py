"""Sessions that write event logs, and a timer."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)


def event_log_conf(log_dir: str) -> dict[str, str]:
    """One plain file an application: nothing rolls, nothing is compressed."""
    return {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir if ":" in log_dir else f"file://{log_dir}", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"}


def get_spark(log_dir: str, name: str = "stagelens", **conf: str) -> SparkSession:
    """A session with adaptive execution that logs its events to the folder."""
    return SparkSession.builder.appName(name).config(map={"spark.sql.adaptive.enabled": "true", **event_log_conf(log_dir), **conf}).getOrCreate()


def timed(function: Callable) -> Callable:
    """Logs how long each call takes."""

    @functools.wraps(function)
    def call(*args, **kwargs):
        began = time.perf_counter()
        try:
            return function(*args, **kwargs)
        finally:
            log.info("%s took %.1f ms", function.__name__, 1e3 * (time.perf_counter() - began))

    return call
