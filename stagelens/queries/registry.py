"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


def rounded(expression: str, digits: int) -> str:
    """SQL like functions.readable.exact_round."""
    return f"CAST(round(CAST({expression} AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def text1(expression: str) -> str:
    """SQL like functions.readable.one_decimal."""
    return f"CAST(CAST(round(CAST({expression} AS DECIMAL(38,6)), 1) AS DECIMAL(37,1)) AS VARCHAR)"


def bytes_text(x: str) -> str:
    """SQL like functions.readable.bytes_text."""
    parts = "".join(f" WHEN {x} < {bound} THEN {text1(f'{x} / {d}.0')} || ' {u}'" for u, bound, d in (("KiB", 1024**2, 1024), ("MiB", 1024**3, 1024**2), ("GiB", 1024**4, 1024**3)))
    return f"(CASE WHEN {x} < 1024 THEN CAST({x} AS VARCHAR) || ' B'{parts} ELSE {text1(f'{x} / {1024**4}.0')} || ' TiB' END)"
