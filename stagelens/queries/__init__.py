"""One entry per operator of the engine over the driver's tables, with the SQL that must give the same rows."""

from . import detectors, history, misc, own_log, plans, telemetry, workloads  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
