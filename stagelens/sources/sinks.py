"""Writing of the relations: a folder a table, in one of four formats."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import join_path

FORMATS = ("csv", "parquet", "delta", "json")
NAME_LENGTH = 100


def write_table(df: DataFrame, path: str, fmt: str, overwrite: bool = True) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"Unknown output format: {fmt}")
    if fmt == "delta" and importlib.util.find_spec("delta") is None:
        raise RuntimeError("Delta isn't installed")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def _flat(df: DataFrame, name: str) -> DataFrame:
    fields = [f.name for f in df.schema[name].dataType.elementType.fields]
    return df.withColumn(name, F.explode_outer(name)).select(*(c for c in df.columns if c != name), *(F.col(f"{name}.{f}").alias(f"{name}_{f}") for f in fields))


def flatten_dag(dag: DataFrame) -> DataFrame:
    """The node relation without lists: a row a node, task metric and total, the two lists' fields prefixed."""
    return _flat(_flat(dag, "accumulators"), "accumulator_totals")


def flatten_combined(combined: DataFrame) -> DataFrame:
    return combined.withColumn("nodes", F.array_join("nodes", ", "))


def write_relations(dag: DataFrame, combined: DataFrame, out_dir: str, name: str, fmt: str = "csv") -> tuple[str, str]:
    """Writes <name>__dag and <name>__combined, flat for csv; returns the two paths."""
    if fmt == "csv":
        dag, combined = flatten_dag(dag), flatten_combined(combined)
    paths = join_path(out_dir, f"{name}__dag"), join_path(out_dir, f"{name}__combined")
    for df, path in zip((dag, combined), paths, strict=True):
        write_table(df, path, fmt)
    return paths


def parsed_name(nodes: DataFrame, out_name: str | None, stamp: str) -> str:
    """The given name, or the time and the base names of what the first query wrote, else of what it read."""
    if out_name is not None:
        return out_name[:NAME_LENGTH]
    first = nodes.where(F.col("query_id") == F.lit(nodes.agg(F.min("query_id")).first()[0]))
    written = F.get_json_object("details", "$.detail.arguments.file_path")
    read = F.from_json(F.get_json_object("details", "$.detail.location.location"), "array<string>")
    got = first.agg(F.collect_set(F.when(F.col("node_type") == "InsertIntoHadoopFsRelationCommand", written)).alias("w"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("node_type") == "Scan", read)))).alias("r")).first()
    names = sorted({p.rstrip("/").rsplit("/", 1)[-1].split(".")[0] for p in (got["w"] or got["r"] or [])})
    return f"{stamp}__{'_'.join(names)[:NAME_LENGTH]}"
