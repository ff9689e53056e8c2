"""Sizes, times, counts and names for readers, as columns and as plain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units with the bound below which each is used, and the divisor.
SIZE_UNITS = (("B", 1024, 1), ("KiB", 1024**2, 1024), ("MiB", 1024**3, 1024**2), ("GiB", 1024**4, 1024**3), ("TiB", None, 1024**4))
TIME_UNITS = (("ms", 1_000, 1), ("s", 60_000, 1_000), ("min", 3_600_000, 60_000), ("hr", None, 3_600_000))
#: Units by kind of metric, and the order in which kinds are listed.
METRIC_UNITS = {"timing": "ms", "size": "B", "sum": "", "average": "", "nsTiming": "ms"}
METRIC_ORDER = {"timing": 1, "size": 2, "sum": 3, "average": 4}
OTHER_ORDER = 99
_COUNTS = ((10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "K"))


def exact_round(value: Column, digits: int) -> Column:
    """Rounds half up on the decimal value: doubles on a half round alike in every engine."""
    return F.round(value.cast("decimal(38,6)"), digits).cast("double")


def _scaled(value: Column, units: tuple) -> Column:
    out = None
    for unit, bound, divisor in units:
        one = F.struct((value.cast("double") / F.lit(float(divisor))).alias("readable_value"), F.lit(unit).alias("readable_unit"))
        if out is None:
            out = F.when(value < bound, one)
        else:
            out = out.when(value < bound, one) if bound else out.otherwise(one)
    return F.when(value.isNotNull(), out)


def readable_size(value: Column) -> Column:
    """Struct readable_value, readable_unit of a number of bytes; null for null."""
    return _scaled(value, SIZE_UNITS)


def readable_time(value: Column) -> Column:
    """Struct readable_value, readable_unit of milliseconds; null for null."""
    return _scaled(value, TIME_UNITS)


def number_text(value: Column, digits: int) -> Column:
    """A rounded number as text without needless zeros but one decimal at least: 2.0, 1.25."""
    plain = F.round(value.cast("decimal(38,6)"), digits).cast("string")
    return F.regexp_replace(F.regexp_replace(F.concat(plain, F.when(plain.contains("."), F.lit("")).otherwise(F.lit(".0"))), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")


def readable(value: Column, kind: str, digits: int = 2) -> Column:
    """Struct readable_value, readable_unit, readable_str ("1.5 KiB") of a size or timing."""
    made = {"size": readable_size, "timing": readable_time}[kind](value)
    text = F.concat_ws(" ", number_text(made["readable_value"], digits), made["readable_unit"])
    return F.when(value.isNotNull(), F.struct(made["readable_value"].alias("readable_value"), made["readable_unit"].alias("readable_unit"), text.alias("readable_str")))


def readable_metric(value: Column, kind: Column) -> Column:
    """readable() by the kind of metric; other kinds keep their value, with the kind's unit or none."""
    plain = F.struct(value.cast("double").alias("readable_value"), unit_of(kind).alias("readable_unit"), number_text(value, 2).alias("readable_str"))
    return F.when(kind == "size", readable(value, "size")).when(kind == "timing", readable(value, "timing")).when(value.isNotNull(), plain)


def _lookup(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def unit_of(kind: Column) -> Column:
    """The unit of a kind of metric; none for kinds of other data sources."""
    return F.coalesce(F.try_element_at(_lookup(METRIC_UNITS), kind), F.lit(""))


def order_of(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(METRIC_ORDER), kind), F.lit(OTHER_ORDER))


def count_text(value: Column) -> Column:
    """A count in K, M, B or T: 1.5K; below 1000 as it is; "unknown" for null."""
    out = F.when(value.isNull(), F.lit("unknown"))
    for bound, unit in _COUNTS:
        out = out.when(value >= bound, F.concat(one_decimal(value / F.lit(float(bound))), F.lit(unit)))
    return out.otherwise(value.cast("string"))


def one_decimal(value: Column) -> Column:
    return F.round(value.cast("decimal(38,6)"), 1).cast("decimal(38,1)").cast("string")


def bytes_text(value: Column) -> Column:
    """A size with one decimal: 1.5 GiB; "0 B" for null."""
    out = F.when(F.coalesce(value, F.lit(0)) < 1024, F.concat(F.coalesce(value, F.lit(0)).cast("string"), F.lit(" B")))
    for unit, bound, divisor in SIZE_UNITS[1:]:
        text = F.concat(one_decimal(value / F.lit(float(divisor))), F.lit(f" {unit}"))
        out = out.when(value < bound, text) if bound else out.otherwise(text)
    return out


def iso_seconds(ms: Column) -> Column:
    """Epoch milliseconds as 2024-01-31T12:00:00 in the session's zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")


def iso_micros(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def path_name(path: Column) -> Column:
    """The last part of a path, without slashes at its end."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def path_stem(path: Column) -> Column:
    """The last part without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]*$", "")


def is_cloud_path(path: Column) -> Column:
    """Whether a path is in an object store or a remote file system by its scheme."""
    return path.rlike(r"^(s3|s3a|abfss|abfs|gs|dbfs|wasbs):/")
